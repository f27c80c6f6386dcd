from datetime import datetime, timedelta

from cambium.operators.incremental import PartitionedRefresh
from cambium.streaming.watch import follow_listings

T0 = datetime(2025, 1, 1)


def test_follow_listings_counts_rows_once(spark, tmp_path):
    src, log, state, cp = (f"file://{tmp_path}/{n}" for n in ("src", "log", "state", "cp"))
    schema = "run_id bigint, path string, sha256 string, deleted boolean, recorded_at timestamp"
    put = lambda *rows: spark.createDataFrame([(i, p, s, False, T0 + timedelta(days=i)) for i, p, s in rows], schema).coalesce(1).write.mode("append").parquet(src)
    runs = [1]
    read = lambda: spark.createDataFrame([(i, "r", ".", T0 + timedelta(days=i), T0 + timedelta(days=i), "ok") for i in range(1, runs[0] + 1)], "run_id bigint, repo string, root string, started_at timestamp, finished_at timestamp, status string")

    def go():
        q = follow_listings(spark, src, lambda: read(), log, state, cp)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.run_id, r.path, r.change) for r in PartitionedRefresh(spark, state).read().collect())

    put((1, "a", "x"), (1, "b", "x"))
    assert go() == [(1, "a", "added"), (1, "b", "added")]
    put((2, "a", "y"))
    runs[0] = 2
    assert go() == [(1, "a", "added"), (1, "b", "added"), (2, "a", "changed"), (2, "b", "removed")]
    assert len(go()) == 4
