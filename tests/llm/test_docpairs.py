import ast
import random

import pytest

from cambium.llm import docpairs as D


def got(text, path):
    return [x[1] for x in D.pairs_of([text], [path])]


def test_python():
    text = '''
import x

def a():
    """Does a thing."""

def b():
    x = 1
    """Not documentation."""

async def c(p: dict[str, int] = {"k": 1},
            q="):") -> "str":
    # a comment first
    r"""Reads the table."""

class K(Base):
    """Class text."""

    @router.get("/x")
    def m(self):
        \'\'\'Walks the list once.\'\'\'

    def n(self): "Short but true."

    class Inner:
        def deep(self):
            """Knows its place."""

def d():
    f"""Not plain {x}."""

def e():
    b"""Not text."""

def g():
    """TODO"""

def load_big_table():
    """Load the big table."""

def h():
    """:param x:
    :returns:
    """

def i():
    """Args:
        x: the late record
    """

SAMPLE = """
def inside():
    \\"\\"\\"Never counts.\\"\\"\\"
"""
'''
    assert got(text, "a/b.py") == ["a", "c", "K.m", "K.n", "K.Inner.deep", "i"]


def test_python_with_syntax_errors_and_odd_line_ends():
    assert got("def a(:\n    pass\n\ndef b():\r\n    '''Reads rows.'''\r", "x.py") == ["b"]
    assert got("def a():\r    '''Reads​ rows.'''\r    return", "x.py") == ["a"]
    assert got("﻿def a():\n    '''Reads rows.'''", "x.py") == ["a"]


def test_typescript():
    text = """
/** Adds them up. */
export function sum(a: number[]): Record<string, number> { return {}; }

// Not a doc comment.
function plain() {}

/** Detached. */

function far() {}

/** Of the constant. */
const LIMIT = 3;
function after() {}

/**
 * Walks once.
 * @param x the row
 */
// eslint-disable-next-line
export const walk = async (x: string): Promise<{ a: number }> => { return { a: 1 }; };

/** Held in a variable. */
let held = function (a) { return a; };

class Box extends Base {
  /** Opens it. */
  @Memo({ a: 1 })
  private static async open(p: string): Record<string, number> { if (p) { close(p); } }
  /* no */
  shut() {}
  /** @internal */
  hidden() {}
  /** Arrow member. */
  go = (x: number) => x + 1;
}
const text = `
/** In a string. */
function ghost() {}
`;
/** Reads. */ function near() {}
"""
    assert got(text, "a.tsx") == ["sum", "walk", "held", "Box.open", "Box.go", "near"]


def test_go():
    text = """package p

// Sum adds the rows.
func Sum(a []int) int { return 0 }

// Sum the rows.
func SumRows() {}

// Far away.

func Far() {}

/* Opens the file. */
//go:noinline
func (c *Conn[T]) Open(x int) (y map[string]int, err error) {
	for {
	}
}

// Keeps it.
var keep = func(a int) int { return a }

var s = `
// Ghost says things.
func Ghost() {}
`

x := 1 // trailing words
func Trail() {}
"""
    assert got(text, "p/a.go") == ["Sum", "Conn.Open", "keep"]


def test_rust():
    text = """//! Of the module.
use crate::x;

/// Adds rows.
/// And more.
#[must_use]
#[cfg(feature = "a, b")]
pub(crate) async fn add<'a>(x: &'a str) -> Vec<String> { vec![] }

// no doc
fn plain() {}

/** Opens it. */
fn open() {}

impl<T: Clone> Draw for Shape<T> where T: Copy {
    /// Draws the shape.
    fn draw(&self) -> char { 'x' }
}

trait Walk {
    /// Takes one step.
    fn step(&mut self);
}

/// Of the struct.
struct S;
fn after() {}

const R: &str = r#"
/// Ghost.
fn ghost() {}
"#;
"""
    assert got(text, "src/a.rs") == ["add", "open", "Shape.draw", "Walk.step"]


def test_java():
    text = """package a;
/** Of the class. */
public class Box<T> extends Base implements Run {
    /** A field. */
    private int limit = 3;

    /** Opens the box. */
    @Override
    @Get("/x)")
    public static <K> Map<String, List<Integer>> open(Map<String, K> a, int... b) throws IOException { if (a == null) { return x(b); } return null; }

    /** {@inheritDoc} */
    public void close() {}

    // no
    int other() { return 1; }

    static class Inner {
        /** Runs. Now. */ void run() {}
    }
    String t = \"\"\"
        /** Ghost. */
        void ghost() {}
        \"\"\";
}
"""
    assert got(text, "a/Box.java") == ["Box.open", "Box.Inner.run"]


@pytest.mark.parametrize("doc", ["", "  ", "...", "TODO", "todo: write docs", "tbd", "N/A", "-", "No description provided.", "Undocumented.", "Placeholder.", "See above.", "Add documentation here.", "@internal", "{@inheritDoc}", ":param a:", "@param a\n@param b", "get_row", "Get the row.", "Gets a row", "GetRow", "FIXME", "***"])
def test_trivial(doc):
    assert not D.informative(doc, "get_row", "a b")


@pytest.mark.parametrize("doc", ["Reads once.", "期限切れの台帳を返す。", "@param a the late row", ":returns: nothing if empty", "Get the row and lock it.", "get_row: Locks.", "@return the id"])
def test_informative(doc):
    assert D.informative(doc, "get_row", "a b")


def test_against_the_standard_parser_on_random_modules():
    rng = random.Random(5)
    for _ in range(60):
        lines, want = [], set()
        for i in range(rng.randrange(1, 9)):
            cls = rng.random() < 0.4
            pad = "    " if cls else ""
            if cls:
                lines.append(f"class C{i}:")
            told = rng.random() < 0.6
            args = rng.choice(["", "a", "a=(1, {'x': [2]})", "*a, **k", "a: 'b:c' = \"):\""])
            lines.append(f"{pad}{rng.choice(['', 'async '])}def f{i}({args}){rng.choice(['', ' -> dict[str, int]'])}:")
            quote = rng.choice(['"""', "'''", '"'])
            lines += [f"{pad}    {quote}Moves {i} rows{quote}"] if told else []
            lines += [f"{pad}    x = '# \"\"\" not'", f"{pad}    return {{'k': [1, 2]}}", ""]
            if told:
                want.add(f"C{i}.f{i}" if cls else f"f{i}")
        text = "\n".join(lines)
        ast.parse(text)
        assert set(got(text, "m.py")) == want


def test_operator(spark):
    docs = spark.createDataFrame(
        [(1, "r", "./pkg\\a.py", "def f():\n    '''Reads rows.'''\n", "x"), (1, "r", "pkg/a.py", "def f():\n    '''Reads rows.'''\n", "x"), (2, None, "b.go", "package p\n// Runs it.\nfunc F() {}", "x"), (3, "r", None, "def f(): pass", "x"), (None, "r", "c.py", "x", "x"), (4, "r", "d.py", None, "x"), (5, "r", "e.py", "", "x"), (6, "r", "long.py", "x = 1\n" * 300_000 + "def z():\n    '''Ends it all.'''\n", "x")],
        "doc_id bigint, repo string, path string, text string, local string",
    )
    files = spark.createDataFrame([("r", "pkg/a.py", "pkg.a"), ("r", "pkg//a.py", "pkg.a"), ("r", "long.py", None)], "repo string, path string, module_qname string")
    assert sorted((r.doc_id, r.qname) for r in D.function_pairs(docs, files).collect()) == [(1, "pkg.a.f"), (2, "b.F"), (6, "long.z")]
    assert D.function_pairs(docs.where("false"), files).count() == 0
    assert D.function_pairs(docs, files.where("false")).where("doc_id = 1").head().qname == "pkg.a.f"


def test_a_batch_of_files_joins_at_once():
    go, py = "// Opens what lies behind the door.\nfunc Open() {}\n", 'def close():\n    """Shuts it for good."""\n'
    texts, paths = [go, py, "", py + go, go, None, "x"], ["a.go", "b.py", "c.go", "d.py", "e.go", "f.go", "g.txt"]
    assert sorted((i, n) for i, n, _, _ in D.pairs_of(texts, paths)) == [(0, "Open"), (1, "close"), (3, "close"), (4, "Open")]


def test_literals_of_other_functions_do_not_count():
    assert got('def a():\n    pass\n\n"""Stands outside of everything."""\n\ndef b():\n    x = 1\n    """Comes too late to say it."""\n', "m.py") == []
    assert got('def a():\n    # note\n    r"""Counts as what it is."""\n    pass\n', "m.py") == ["a"]


def test_several_directives_between():
    assert got("/** Reads one row of the table. */\n// eslint-disable-next-line x\n// @ts-ignore\nfunction get() {}\n", "a.ts") == ["get"]
    assert got("/** Reads one row of the table. */\n// @ts-ignore\n// said in passing\nfunction get() {}\n", "a.ts") == []


def test_numbers_in_names():
    assert not D.informative("Merge the tenant.", "merge_tenant2") and not D.informative("Detach rotor 2.", "detachRotor2")
    assert D.informative("Merge 3 tenants.", "merge_tenant2")
