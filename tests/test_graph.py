import random

from cambium.operators import graph as G

S = "repo string, qname string, name string, kind string, file_path string, signature string, line_start int, line_end int, external_hint string, exported boolean, decorated boolean, external_entry boolean"
E = "repo string, source_qname string, target_qname string, kind string, method string"
FI = "repo string, path string, module_qname string, language string, sha256 string, line_count int"
U = "id bigint, repo string, source_qname string, target_text string, kind string, bucket string, member string"
C = "id bigint, consumer_repo string, consumer_qname string, provider_repo string, provider_qname string, kind string"


def graph(spark, symbols, edges, unresolved=(), contracts=(), files=()):
    rows = [("r", q, q.split(".")[-1], k, f, s, 1, 2, None, x, False, False) for q, k, f, s, x in symbols]
    return G.CodeGraph(spark.createDataFrame(rows, S), spark.createDataFrame(list(files), FI), spark.createDataFrame([("r", *e) for e in edges], E), spark.createDataFrame(list(unresolved), U), spark.createDataFrame(list(contracts), C))


def walk(nodes, edges, root, most):
    """Breadth-first, one node and edge after the other."""
    visited, front, parent, out = set(), {root}, {}, []
    for depth in range(most):
        if not front:
            break
        nxt = set()
        for cur in sorted(front):
            for s, t, k, _ in edges:
                if t != cur or s in visited or s == root or s not in nodes:
                    continue
                parent.setdefault(s, cur)
                path, at = [s], s
                while at != root:
                    at = parent[at]
                    path.append(at)
                out.append((s, "transitive" if depth else "direct", k, tuple(reversed(path))))
                nxt.add(s)
        visited |= front
        front = nxt - visited
    return sorted(out)


def test_dependents_on_random_graphs(spark):
    rng = random.Random(1)
    for _ in range(4):
        names = [f"n{i}" for i in range(rng.randrange(3, 9))]
        edges = sorted({(rng.choice(names), rng.choice(names), rng.choice(G.DEPENDENCY_KINDS), "same") for _ in range(rng.randrange(4, 22))})
        g = graph(spark, [(n, "function", f"{n}.py", None, True) for n in names[:-1]], edges)
        roots = spark.createDataFrame([("r", n) for n in names], "repo string, root string")
        for most in (1, 2, 3):
            got = {}
            for r in G.dependents(g, roots, most).collect():
                got.setdefault(r.root, []).append((r.qname, r.relation, r.edge_kind, tuple(r.path)))
            for n in names:
                assert sorted(got.get(n, [])) == walk(set(names[:-1]), edges, n, most), (n, most, edges)


def test_would_break_risks(spark):
    symbols = [("m.f", "function", "m.py", "(a, b=1)", True), ("m.g", "function", "n.py", None, True), ("m.T", "interface", "m.ts", "{ a: string; b(): void }", True), ("m.alone", "function", "m.py", "()", True)]
    g = graph(spark, symbols, [("m.g", "m.f", "calls", "same"), ("m.f", "m.f", "calls", "same"), ("m.g", "m.f", "imports", "import"), ("m.g", "m.T", "uses_type", "global")])

    def risk(q, change, new=None):
        t = spark.createDataFrame([("r", q, new)], "repo string, qname string, new_signature string")
        rows = G.would_break(g, t if new is not None else t.drop("new_signature"), change).collect()
        return (rows[0].risk, rows[0].direct, rows[0].confidence) if rows else None

    assert risk("m.f", "Removed") == ("high", 3, 0.95)
    assert risk("m.alone", "removed") == ("high", 0, 0.0)
    assert risk("m.f", "return_type") == ("medium", 2, 0.9)
    assert risk("m.f", "signature", "(a, b, c)") == ("high", 2, 0.9)
    assert risk("m.f", "signature", "(a)") == ("medium", 2, 0.9)
    assert risk("m.f", "signature", "(a: int, b=2)") == ("low", 2, 0.9)
    assert risk("m.T", "members", "{ a: string; c: int }")[0] == "high"
    assert risk("m.T", "members", "{ a: string; b(): void; c?: int }")[0] == "medium"
    assert risk("m.alone", "whatever") == ("none", 0, 0.0)
    assert risk("m.nothing", "removed") is None


def test_suspects_when_nobody_depends(spark):
    g = graph(spark, [("m.run", "function", "m.py", None, True), ("m.other", "function", "o.py", None, True)], [], [(1, "r", "m.other", "self.run", "calls", "dynamic", "run"), (2, "r", "x.y", "ext.run", "calls", "external", "run"), (3, "r", "x", "y", "calls", "dynamic", None)])
    row = G.impact(g, spark.createDataFrame([("r", "m.run"), ("r", "gone")], "repo string, root string")).orderBy("root").collect()
    assert [(r.root, r.found, r.risk, r.suspected) for r in row] == [("gone", False, "none", 0), ("m.run", True, "low", 1)]
    assert [r.file_path for r in G.suspected(g, "r", "run").collect()] == ["o.py"]


def test_change_surface_and_removal(spark):
    symbols = [("a", "module", "a.py", None, True), ("a.f", "function", "a.py", None, True), ("a._h", "function", "a.py", None, False), ("b", "module", "b.py", None, True), ("b.g", "function", "b.py", None, True), ("a.k", "function", "a.py", None, True)]
    edges = [("b.g", "a.f", "calls", "same"), ("b.g", "a._h", "calls", "same"), ("b", "a.f", "imports", "import"), ("a.k", "a.f", "calls", "same"), ("b", "a", "imports", "static")]
    g = graph(spark, symbols, edges, files=[("r", "a.py", "a", "python", "1", 1), ("r", "b.py", "b", "python", "1", 1)])
    ch = lambda gone: spark.createDataFrame([("r", "a.py", gone), ("r", "notes.txt", True)], "repo string, path string, gone boolean")
    assert sorted((r.qname, r.relation) for r in G.change_surface(g, ch(False)).collect()) == [("b", "file-level"), ("b.g", "direct")]
    after = G.without_files(g, ch(True))
    assert sorted(r.qname for r in after.symbols.collect()) == ["b", "b.g"] and after.edges.count() == 0
    assert [r.path for r in G.reconcile_candidates(g, ch(False).where("path = 'a.py'")).collect()] == ["b.py"]


def test_search_is_case_insensitive_and_bounded(spark):
    g = graph(spark, [(f"m.Ledger{i}", "class", "m.py", None, True) for i in range(30)], [])
    assert G.search(g, "ledger").count() == 25 and G.search(g, "led_er1", 5).count() == 5
