from datetime import datetime

from cambium.operators import references as R

D = datetime
SYM = "repo string, qname string, indexed_at timestamp_ntz, removed_at timestamp_ntz"
ROW = "id bigint, repo string, target string, recorded_at timestamp_ntz, key string, scope string"


def run(spark, refs, symbols):
    rows = spark.createDataFrame([(i, r, t, at, "clash", "clash") for i, r, t, at in refs], ROW)
    out = R.orphans([R.Reference("t", rows, "target", "repo")], spark.createDataFrame(symbols, SYM))
    return sorted((r.row_id, r.reason, r.period) for r in out.collect())


def test_reasons(spark):
    early, late = D(2025, 1, 1), D(2025, 6, 1)
    symbols = [("r", "a.live", early, None), ("r", "a.gone", early, late), ("r", "a.back", early, late), ("r", "a.back", late, None), ("r", "a.later", late, None), ("q", "a.other", early, None)]
    refs = [
        (1, "r", "a.live", D(2025, 2, 1)), (2, "r", " a::live() ", D(2025, 2, 1)), (3, "r", "a.gone", D(2025, 2, 1)), (4, "r", "a/back", D(2025, 2, 1)), (5, "r", "a.later", D(2025, 3, 5)), (6, "r", "a.later", late),
        (7, "r", "a.other", D(2025, 4, 1)), (8, "q", "a.other", D(2025, 4, 1)), (9, "r", "A.live", D(2024, 12, 31)), (10, "r", None, early), (11, "r", "  ", early), (12, "r", "nowhere", None), (9, "r", "A.live", D(2024, 12, 31)),
    ]
    assert run(spark, refs, symbols) == [(3, "deleted", "2025-02"), (5, "late", "2025-03"), (7, "missing", "2025-04"), (9, "missing", "2024-12"), (12, "missing", None)]


def test_hot_keys_and_empty_sides(spark):
    refs = [(i, "r", "hot.ok" if i % 3 == 0 else "hot.missing" if i % 3 == 1 else f"k{i}", D(2025, 1, 1)) for i in range(3000)]
    symbols = [("r", "hot.ok", D(2024, 1, 1), None)] + [("r", f"k{i}", D(2024, 1, 1), None) for i in range(0, 3000, 2)]
    want = sorted((i, "missing", "2025-01") for i, _, t, _ in refs if t == "hot.missing" or t.startswith("k") and i % 2)
    assert run(spark, refs, symbols) == want
    assert run(spark, [], symbols) == []
    assert len(run(spark, refs[:5], [])) == 5


def test_runs_collapse(spark):
    p = spark.createDataFrame([(i, D(2025, 1, 1 + i % 5)) for i in (1, 2, 3, 7, 8, 65535, 65536)], "id bigint, since timestamp_ntz")
    assert sorted((r.first, r.last) for r in R.parent_runs(p).collect()) == [(1, 3), (7, 8), (65535, 65535), (65536, 65536)]
    ids = spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 8, 9, 65536)], "id bigint")
    assert {r.id: r.inside for r in R.as_of_runs(ids, R.parent_runs(p)).collect()} == {0: False, 1: True, 3: True, 4: False, 8: True, 9: False, 65536: True}
