from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cambium.operators import incremental as I

T0 = datetime(2025, 1, 1)
FILES = "run_id bigint, repo string, path string, sha256 string, deleted boolean, recorded_at timestamp_ntz"
RUNS = "run_id bigint, repo string, root string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def runs(spark, *rows):
    return spark.createDataFrame([(i, "r", ".", T0 + timedelta(days=i), T0 + timedelta(days=i, hours=1) if s != "running" else None, s) for i, s in rows], RUNS)


def files(spark, *rows):
    return spark.createDataFrame([(i, "r", p, s, d, T0 + timedelta(days=i, minutes=m)) for i, p, s, d, m in rows], FILES)


def found(df):
    return sorted((r.run_id, r.path, r.change) for r in df.collect())


def test_changes_between_ok_runs(spark):
    f = files(
        spark,
        (1, "a.py", "x", False, 1), (1, "b.py", "x", False, 1), (1, "c.py", None, False, 1),
        (2, "a.py", "y", False, 1),  # a failed run: nothing seen only by it is lost or handled
        (3, "./a.py", "SHA256:Y\n", False, 1), (3, "c.py", None, False, 1), (3, "b.py", "x", True, 1), (3, "d.py", "z", False, 1),
        (4, "a.py", "y", False, 1), (4, "c.py", "k", False, 1), (4, "d.py", "q", False, 1), (4, "d.py", "z", False, 9), (4, "d.py", "z", False, 9),
    )
    r = runs(spark, (1, "ok"), (2, "failed"), (3, "ok"), (4, "ok"), (5, "running"))
    got = found(I.changed_paths(f, r, days=1))
    assert got == [(1, "a.py", "added"), (1, "b.py", "added"), (1, "c.py", "added"), (3, "a.py", "changed"), (3, "b.py", "removed"), (3, "d.py", "added"), (4, "c.py", "changed")]


def test_gap_and_return(spark):
    f = files(spark, (1, "a", "x", False, 1), (2, "b", "x", False, 1), (3, "a", "x", False, 1))
    r = runs(spark, (1, "ok"), (2, "ok"), (3, "ok"))
    assert found(I.changed_paths(f, r)) == [(1, "a", "added"), (2, "a", "removed"), (2, "b", "added"), (3, "a", "added"), (3, "b", "removed")]


def test_empty_null_and_clashing_columns(spark):
    r = runs(spark, (1, "ok"))
    assert found(I.changed_paths(files(spark), r)) == []
    odd = files(spark, (1, None, "x", False, 1), (1, "b", None, None, 1)).withColumns({"seq": F.lit(9), "_part": F.lit(3), "root": F.lit("z")})
    assert found(I.changed_paths(odd, r)) == [(1, "b", "added")]
    assert found(I.changed_paths(files(spark, (1, "b", "x", False, 1)), runs(spark))) == []


def test_refresh_recomputes_only_changed_parts_and_survives_failure(spark, tmp_path):
    state = I.PartitionedRefresh(spark, f"file://{tmp_path}/state")
    source = lambda rows: spark.createDataFrame(rows, "k int, v string").withColumn("_part", F.col("k") % 4)
    seen = []

    def compute(df):
        seen.append(sorted({r._part for r in df.select("_part").collect()}))
        return df.where("v is not null").select("_part", "k", F.upper("v").alias("v"))

    rows = [(0, "a"), (1, "b"), (2, None), (3, "c")]
    assert state.refresh(source(rows), compute) == [0, 1, 2, 3]
    assert state.refresh(source(list(reversed(rows))), compute) == []  # order doesn't matter
    rows[1] = (1, "z")
    assert state.refresh(source(rows), compute) == [1]
    assert sorted((r.k, r.v) for r in state.read().collect()) == [(0, "A"), (1, "Z"), (3, "C")]

    def fails(df):
        raise RuntimeError("lost")

    rows[3] = (3, "d")
    try:
        state.refresh(source(rows), fails)
    except RuntimeError:
        pass
    assert sorted((r.k, r.v) for r in state.read().collect()) == [(0, "A"), (1, "Z"), (3, "C")]  # as before
    assert state.refresh(source(rows), compute) == [3]  # and handled once, by the next run
    old = state.read()
    assert state.refresh(source(rows[1:]), compute) == [0]  # a part that is gone is emptied
    assert sorted((r.k, r.v) for r in state.read().collect()) == [(1, "Z"), (3, "D")]
    assert sorted((r.k, r.v) for r in old.collect()) == [(0, "A"), (1, "Z"), (3, "D")]  # whoever read before still can
    assert state.refresh(source([]), compute) == [1, 2, 3]
    assert state.read().count() == 0


def test_fingerprints_tell_nulls_and_repeats(spark):
    fp = lambda rows: sorted(map(tuple, I.fingerprints(spark.createDataFrame(rows, "_part int, v string")).collect()))
    assert fp([(0, None)]) != fp([(0, "")])
    assert fp([(0, "a")]) != fp([(0, "a"), (0, "a")])
    assert fp([(0, "a"), (0, "b")]) == fp([(0, "b"), (0, "a")])
    assert fp([]) == []


def test_new_runs_and_late_rows_recompute_their_parts_only(spark, tmp_path):
    state = I.PartitionedRefresh(spark, f"file://{tmp_path}/state")
    rows = [(i, p, f"{p}{i // 3}", False, 1) for i in range(1, 7) for p in "ab"]
    r = lambda n: runs(spark, *[(i, "ok") for i in range(1, n + 1)])
    parts = lambda *days: sorted({(T0 + timedelta(days=i)).toordinal() - datetime(1970, 1, 1).toordinal() for i in days})
    go = lambda data, n: I.refresh_changes(files(spark, *data), r(n), state, days=1)
    assert go([x for x in rows if x[0] <= 4], 4) == parts(1, 2, 3, 4)
    assert go(rows, 6) == parts(5, 6)  # history isn't touched
    assert go(rows, 6) == []
    rows.append((2, "c", "late", False, 9))
    assert go(rows, 6) == parts(2, 3)  # the run it belongs to, and the next, which misses it
    assert found(state.read()) == found(I.changed_paths(files(spark, *rows), r(6)))
    assert (3, "c", "removed") in found(state.read())
    assert I.refresh_changes(files(spark, *rows), runs(spark, *[(i, "failed" if i == 2 else "ok") for i in range(1, 7)]), state, days=1) == parts(2, 3)
    assert found(state.read()) == found(I.changed_paths(files(spark, *rows), runs(spark, *[(i, "failed" if i == 2 else "ok") for i in range(1, 7)])))
