import random

from pyspark.sql import functions as F

from cambium.operators import hierarchy as H


def frame(spark, rows):
    return spark.createDataFrame(rows, "repo string, child string, parent string")


def run(spark, rows):
    df = frame(spark, rows).withColumns({"node": F.lit("clash"), "id": F.lit(1), "depth": F.lit(0)})
    return H.hierarchy(df, F.col("repo"), F.col("child"), F.col("parent"))


def brute(rows):
    parent = {}
    for r, c, p in rows:
        if r and c and p:
            parent[(r, c)] = min(parent.get((r, c), p), p)
    nodes = {(r, x) for (r, c), p in parent.items() for x in (c, p)}
    out = {}
    for r, n in nodes:
        seen, at = [], n
        while (r, at) in parent and at not in seen:
            seen.append(at)
            at = parent[(r, at)]
        out[(r, n)] = (min(seen[seen.index(at) :]), -1) if at in seen else (at, len(seen))
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    rows = []
    for repo in "ab":
        for i in range(60):
            rows.append((repo, f"n{i:02}", f"n{rng.randrange(60):02}" if rng.random() < 0.3 else f"n{max(0, i - rng.randrange(1, 4)):02}"))
    rows += [("c", f"k{i}", f"k{i + 1}") for i in range(150)]  # a long chain
    rows += [("d", f"s{i}", "hub") for i in range(300)]  # a wide family
    rows += [("e", "x", "x"), ("e", "y", "x"), rows[0], rows[1]]
    placed = run(spark, rows).collect()
    assert {(r.scope, r.node): (r.root, r.depth) for r in placed} == brute(rows)
    assert len(placed) == len({(r.scope, r.node) for r in placed})


def test_ancestors_paths_and_descendants(spark):
    rows = [("r", "b", "a"), ("r", "c", "a"), ("r", "d", "b"), ("r", "e", "d"), ("r", "y", "x"), ("r", "x", "z"), ("r", "z", "x")]
    placed = run(spark, rows)
    assert {r.node: r.path for r in H.paths(placed).collect()} == {"a": "a", "b": "a > b", "c": "a > c", "d": "a > b > d", "e": "a > b > d > e", "x": "x", "y": "x > y", "z": "z"}
    assert {r.node: r.descendants for r in placed.collect()} == {"a": 4, "b": 2, "c": 0, "d": 1, "e": 0, "x": 1, "y": 0, "z": 0}
    assert sorted((r.ancestor, r.node) for r in H.ancestor_pairs(placed).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "d"), ("b", "e"), ("d", "e"), ("x", "y")]


def test_nulls_blanks_repeats_several_parents_and_empty(spark):
    rows = [(None, "a", "b"), ("r", None, "b"), ("r", "a", None), ("r", "", "b"), ("r", "a", "c"), ("r", "a", "b"), ("r", "a", "c")]
    assert {(r.node, r.root, r.depth) for r in run(spark, rows).collect()} == {("a", "b", 1), ("b", "b", 0)}
    assert run(spark, []).count() == 0
