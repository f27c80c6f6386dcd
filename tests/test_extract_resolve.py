import pytest

from cambium.operators import extract as X

PY = {
    "app/__init__.py": "",
    "app/base.py": "class Base:\n    def shared(self):\n        return 1\n\nclass Other:\n    def solo(self):\n        pass\n",
    "app/service.py": "from app.base import Base, Other\nimport app.util as u\nfrom .util import helper as h\n\nLIMIT = 3\n_hidden = 1\n\nclass Service(Base):\n    def __init__(self, other: Other):\n        self.other = other\n        self.made = Other()\n\n    @app.get('/x')\n    def run(self):\n        self.shared()\n        super().shared()\n        self.made.solo()\n        self.other.solo()\n        h(1)\n        u.helper(2)\n        unknown.thing()\n        def inner():\n            h(3)\n\ndef top(x: 'Service') -> Base:\n    s = Service(x)\n    s.run()\n    return s\n",
    "app/util.py": "def helper(v):\n    return v\n",
    "bad.py": "def broken(:\n    pass\n\nclass K:\n    def m(self):\n        pass\n",
}
OTHERS = {
    "src/index.ts": "export * from './shapes';\n",
    "src/shapes.ts": "export class Shape { area(): number { return 1; } }\nexport interface Box { w: number }\nexport const make = (n: number): Shape => { return new Shape(); };\nconst S = 'export function ghost() {}';\n",
    "src/view.tsx": "import { make } from './index';\nimport * as sh from './shapes';\nexport function View(p: Box) { make(1); sh.make(2); return <Panel a={1} />; }\nclass Panel extends sh.Shape { render() { this.area(); } }\n",
    "pkg/db/conn.go": 'package db\n\nimport (\n\t"fmt"\n\tu "x.example/mono/pkg/util"\n)\n\ntype Conn struct { n int }\n\nfunc (c *Conn) Open(a int) error {\n\tu.Check(a)\n\treturn nil\n}\n\nfunc TestX(t *T) {}\n',
    "pkg/util/u.go": "package util\n\nfunc Check(a int) bool { return inner(a) }\nfunc inner(a int) bool { return true }\n",
    "src/lib.rs": "use crate::store::Store;\npub struct Api;\nimpl Api { pub fn go(&self) -> u32 { Store::load(1); self.x(); 2 } }\n",
    "src/store.rs": "pub struct Store;\nimpl Store { pub fn load(n: u32) -> u32 { n } }\n",
    "src/main/java/com/a/Base.java": "package com.a;\npublic class Base { public int size() { return 1; } }\n",
    "src/main/java/com/a/Use.java": "package com.a;\nimport com.b.Tool;\npublic class Use extends Base {\n  public Use() {}\n  @Override\n  public int run(int n) { return Tool.make(n); }\n}\n",
    "src/main/java/com/b/Tool.java": "package com.b;\npublic final class Tool { public static int make(int n) { return n; } }\n",
}


@pytest.fixture(scope="module")
def world(spark):
    rows = [(repo, p, t, "clash") for repo, files in (("py", PY), ("mix", OTHERS)) for p, t in files.items()] + [(None, "a.py", "x = 1", ""), ("py", None, "x", ""), ("py", "n.py", None, ""), ("py", "notes.txt", "def f(): pass", "")]
    x = X.extract(spark.createDataFrame(rows, "repo string, path string, text string, module string"))
    edges, open_ = X.resolved(x)
    return x, {(r.repo, r.source, r.target, r.kind): r.method for r in edges.collect()}, {(r.source, r.target_text): r.bucket for r in open_.collect()}


def test_symbols(world):
    s = {(r.repo, r.qname): (r.kind, r.exported) for r in world[0].symbols.collect()}
    assert s[("py", "app.service.Service.run")] == ("method", False) and s[("py", "app.service.LIMIT")] == ("constant", True)
    assert ("py", "app.service._hidden") not in s and s[("py", "app")] == ("module", True)
    assert s[("py", "bad.broken")] == ("function", True) and s[("py", "bad.K.m")] == ("method", False)
    assert s[("mix", "src.shapes.make")] == ("function", True) and ("mix", "src.shapes.ghost") not in s
    assert s[("mix", "src.view.View")] == ("component", True) and s[("mix", "src.shapes.Box")] == ("interface", True)
    assert s[("mix", "pkg.db.Conn.Open")] == ("method", True) and ("mix", "pkg.db.TestX") not in s and s[("mix", "pkg.util.inner")] == ("function", False)
    assert s[("mix", "store.Store.load")] == ("method", True) and s[("mix", "src.main.java.com.b.Tool.make")] == ("method", True)
    assert world[0].errors.where("path = 'bad.py'").count() == 1
    route = world[0].symbols.where("qname = 'app.service.Service.run'").head()
    assert route.external_entry and route.external_hint == "app.get('/x')"


def test_python_resolution(world):
    e = world[1]
    run = "app.service.Service.run"
    assert e[("py", "app.service.Service", "app.base.Base", "inherits")] == "import"
    assert e[("py", run, "app.base.Base.shared", "calls")] == "same"  # through self and super, by the base
    assert e[("py", run, "app.base.Other.solo", "calls")] == "attr"  # by what self.made was given
    assert e[("py", run, "app.util.helper", "calls")] == "import"
    assert e[("py", "app.service.top", run, "calls")] == "attr"
    assert e[("py", "app.service", "app.util", "imports")] == "static" and e[("py", "app.service", "app.util.helper", "imports")] == "import"
    assert world[2][(run, "unknown.thing")] == "external"


def test_other_languages_resolution(world):
    e = world[1]
    assert e[("mix", "src.view.View", "src.shapes.make", "calls")] == "import"  # through the star export
    assert e[("mix", "src.view.View", "src.view.Panel", "renders")] == "same"
    assert e[("mix", "src.view.Panel", "src.shapes.Shape", "inherits")] == "import"
    assert e[("mix", "src.view.Panel.render", "src.shapes.Shape.area", "calls")] == "same"
    assert e[("mix", "pkg.db.Conn.Open", "pkg.util.Check", "calls")] == "import"
    assert e[("mix", "lib.Api.go" if ("mix", "lib.Api.go", "store.Store.load", "calls") in e else "src.Api.go", "store.Store.load", "calls")] == "import"
    assert e[("mix", "src.main.java.com.a.Use.run", "src.main.java.com.b.Tool.make", "calls")] == "import"
    assert ("mix", "src.main.java.com.a.Use", "src.main.java.com.a.Base", "inherits") in e


def test_candidates():
    assert X.spec_candidates("..util", "a/b/c.py", "python") == ["a.util"]
    assert X.spec_candidates("./x", "src/a.ts", "typescript")[0] == "src.x" and X.spec_candidates("react", "a.ts", "typescript") == []
    assert X.spec_candidates("h/a/b", "m.go", "go") == ["h.a.b", "a.b", "b"]
    assert X.module_id("src/a/mod.rs", "rust") == "a" and X.module_id("main.go", "go") is None and X.module_id("pkg/__init__.py", "python") == "pkg"


def test_empty(spark):
    x = X.extract(spark.createDataFrame([], "repo string, path string, text string"))
    edges, open_ = X.resolved(x)
    assert edges.count() == 0 and open_.count() == 0


def test_chains_of_bindings_and_star_exports(spark):
    py = {
        "lib/__init__.py": "", "lib/n/__init__.py": "", "lib/n/m.py": "class K:\n    def run(self):\n        pass\n",
        "top.py": "from lib import n\n\nclass Top:\n    def __init__(self):\n        self.x = n\n\n    def go(self):\n        a = self.x\n        b = a.m\n        c = b.K()\n        c.run()\n",
    }
    stars = {f"lib/m{i}.ts": f"export * from './m{i + 1}';\n" for i in range(14)} | {"lib/m14.ts": "export const far = (n: number) => { return n; };\n", "lib/m15.ts": "export const far = (n: number) => { return n; };\n", "lib/use.ts": "import { far } from './m0';\nexport function use() { far(1); }\n"}
    rows = [(repo, p, t) for repo, files in (("c", py), ("s", stars)) for p, t in files.items()]
    edges, _ = X.resolved(X.extract(spark.createDataFrame(rows, "repo string, path string, text string")))
    e = {(r.source, r.target, r.kind): r.method for r in edges.collect()}
    assert e[("top.Top.go", "lib.n.m.K.run", "calls")] == "attr"
    assert e[("lib.use.use", "lib.m14.far", "calls")] == "import"  # fourteen star exports away; the name isn't unique


def test_versions_of_a_path_stay_apart(spark):
    rows = [("r", "m.py", "def a():\n    pass\n\ndef b():\n    pass\n\ndef k():\n    a()\n"), ("r", "m.py", "def a():\n    pass\n\ndef b():\n    pass\n\ndef z():\n    b()\n")]
    edges, _ = X.resolved(X.extract(spark.createDataFrame(rows, "repo string, path string, text string")))
    assert {(r.source, r.target) for r in edges.where("kind = 'calls'").collect()} == {("m.k", "m.a"), ("m.z", "m.b")}
    docs = spark.createDataFrame([(i, "r", p, t, i) for i, (_, p, t) in enumerate(rows)], "doc_id bigint, repo string, path string, text string, collected_at int")
    assert [r.text for r in X.latest_texts(docs).collect()] == [rows[1][2]]


def test_four_bindings_in_a_row(spark):
    rows = [("r", "m.py", "class A:\n    def go(self):\n        pass\n\ndef k():\n    a = A()\n    b = a\n    c = b\n    d = c\n    d.go()\n")]
    edges, _ = X.resolved(X.extract(spark.createDataFrame(rows, "repo string, path string, text string")))
    assert ("m.k", "m.A.go", "attr") in {(r.source, r.target, r.method) for r in edges.collect()}


def test_import_roots(spark):
    src = {"src/pkg/__init__.py": "", "src/pkg/mod.py": "def f():\n    return 1\n", "src/pkg/use.py": "from pkg.mod import f\nfrom .mod import f as g\n\ndef go():\n    return f()\n\ndef also():\n    return g()\n", "tests/t.py": ""}
    top = {"core.py": "def f():\n    return 1\n", "src/pkg/mod.py": "def g():\n    return 2\n"}
    two = {"src/a.py": "", "lib/b.py": ""}
    rows = [(r, p, t) for r, files in (("src", src), ("top", top), ("two", two)) for p, t in files.items()]
    x = X.extract(spark.createDataFrame(rows, "repo string, path string, text string"))
    modules = {(r.repo, r.qname) for r in x.symbols.where("kind = 'module'").collect()}
    assert {("src", "pkg.mod"), ("src", "tests.t"), ("top", "src.pkg.mod"), ("two", "src.a"), ("two", "lib.b")} <= modules
    edges, _ = X.resolved(x)
    e = {(r.source, r.target): r.method for r in edges.where("kind = 'calls'").collect()}
    assert e == {("pkg.use.go", "pkg.mod.f"): "import", ("pkg.use.also", "pkg.mod.f"): "import"}
