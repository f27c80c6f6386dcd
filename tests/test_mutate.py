import ast

import pytest

from cambium.operators import extract as X
from cambium.operators import graph as G
from cambium.operators import mutate as M

PY = "import os\n\n@cached\ndef top(a, b=1):\n    return a  # top\n\nclass K:\n    def only(self):\n        return 'only('\n\nLIMIT = 3\n"
GO = "package p\n\n// Open opens.\nfunc Open(a int) error {\n\treturn nil\n}\n"
RS = "pub struct S;\nimpl S {\n    pub fn go(&self, n: u32) -> u32 { n }\n    pub fn idle(&self) {}\n}\n"
TS = "export function run(): void {\n  return;\n}\nexport const make = (n: number) => n;\n"
JAVA = "public class A {\n  @Deprecated\n  public int size(int n) { return n; }\n}\n"


@pytest.mark.parametrize(
    "text, path, name, kind, first, last, mutation, has",
    [
        (PY, "m.py", "top", "function", 4, 5, "add-required-param", "def top(injected, a, b=1):"),
        (PY, "m.py", "only", "method", 8, 9, "add-required-param", "def only(self, injected):"),
        (PY, "m.py", "top", "function", 4, 5, "rename", "def topChanged(a, b=1):\n    return a  # top"),
        (PY, "m.py", "LIMIT", "constant", 11, 11, "rename", "LIMITChanged = 3"),
        (GO, "a.go", "Open", "function", 4, 6, "add-required-param", "func Open(injected string, a int) error"),
        (RS, "a.rs", "go", "method", 3, 3, "add-required-param", "fn go(&self, injected: i32, n: u32)"),
        (RS, "a.rs", "idle", "method", 4, 4, "add-required-param", "fn idle(&self, injected: i32) {}"),
        (TS, "a.ts", "run", "function", 1, 3, "add-required-param", "function run(injected: string): void"),
        (TS, "a.ts", "make", "constant", 4, 4, "add-required-param", "make = (injected: string, n: number) => n"),
        (JAVA, "A.java", "size", "method", 3, 3, "add-required-param", "int size(int injected, int n)"),
    ],
)
def test_mutations(text, path, name, kind, first, last, mutation, has):
    assert has in M.mutated(text, path, name, kind, first, last, mutation)


def test_removal_leaves_valid_code():
    without = M.mutated(PY, "m.py", "top", "function", 4, 5, "remove-declaration")
    assert "top" not in without and "@cached" not in without and ast.parse(without)
    empty = M.mutated(PY, "m.py", "only", "method", 8, 9, "remove-declaration")
    assert ast.parse(empty) and "only" not in empty
    assert M.mutated(JAVA, "A.java", "size", "method", 3, 3, "remove-declaration") == "public class A {\n}\n"


def test_what_cannot_be_mutated():
    assert M.mutated(PY, "m.py", "LIMIT", "constant", 11, 11, "add-required-param") is None
    assert M.mutated(PY, "m.py", "top", "class", 4, 5, "add-required-param") is None and M.mutated(PY, "m.py", "none", "function", 4, 5, "rename") is None
    assert M.mutated(None, "m.py", "top", "function", 4, 5, "rename") is None and M.mutated("x", "m.txt", "x", "function", 1, 1, "rename") is None
    assert M.mutated(PY, "m.py", "top", "function", 40, 50, "rename") is None


FILES = {
    "app.py": "from brain import Service\n\nclass Base:\n    def shared(self):\n        pass\n\nclass Sub(Base):\n    def __init__(self, s: Service):\n        self.s = s\n\n    def work(self):\n        super().shared()\n        self.s.run()\n\n    def loose(self, x):\n        x.persist()\n\n@app.get('/x')\ndef item():\n    pass\n",
    "brain.py": "class Service:\n    def run(self):\n        pass\n\n    def persist(self):\n        pass\n",
}


def test_dispatch_and_mutation_over_tables(spark):
    src = spark.createDataFrame([("r", p, t) for p, t in FILES.items()], "repo string, path string, text string")
    x = X.extract(src)
    edges, open_ = X.resolved(x)
    g = G.CodeGraph(x.symbols, src, edges.withColumnsRenamed({"source": "source_qname", "target": "target_qname"}), open_, src)
    expected = spark.createDataFrame(
        [("super", "r", "present", "app.Sub.work", "app.Base.shared"), ("typed", "r", "present", "app.Sub.work", "brain.Service.run"), ("bases", "r", "present", "app.Sub", "app.Base"), ("made up", "r", "absent", "app.Sub.loose", "brain.Service.persist"), ("entry", "r", "external", None, "app.item"), ("wrong", "r", "present", "app.item", "app.Base")],
        "label string, repo string, what string, source string, target string",
    )
    got = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in M.dispatch_check(g, expected).collect()}
    assert got == {k: (1, 0, 0, 1.0, 1.0) for k in ("super", "typed", "bases", "entry")} | {"made up": (0, 0, 0, 1.0, 1.0), "wrong": (0, 0, 1, 1.0, 0.0)}
    cases = x.symbols.where("name = 'run'").join(src, ["repo", "path"]).selectExpr("*", "'rename' as mutation")
    (row,) = M.mutate(cases).collect()
    assert row.qname == "brain.Service.run" and "def runChanged(self)" in row.text


def test_backends_can_be_added(spark):
    def lines(p, text):
        for k, line in enumerate(text.split("\n"), 1):
            if line.startswith("proc "):
                p.symbol(f"{p.module}.{line.split()[1]}", "function", k, k, exported=True, decorated=False, external_entry=False)

    toy = X.Backend("toy", lines, lambda path, root: path.rpartition(".")[0].replace("/", "."), lambda spec, path, root: [spec])
    src = spark.createDataFrame([("r", "a/b.toy", "proc go\nnothing\n"), ("r", "m.py", "def f(): pass\n")], "repo string, path string, text string")
    got = {(r.qname, r.language) for r in X.extract(src, backends={"toy": toy}).symbols.where("kind = 'function'").collect()}
    assert got == {("a.b.go", "toy"), ("m.f", "python")}
