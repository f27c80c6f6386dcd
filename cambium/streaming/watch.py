"""Staying fresh: re-indexing a tree at intervals, and following an append-only listing as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cambium.operators import graph as G
from cambium.operators.incremental import PartitionedRefresh, refresh_changes
from cambium.operators.indexing import index_repo, stored_graph
from cambium.session import scope
from cambium.sources import git
from cambium.sources.store import SnapshotStore


def cycle(spark: SparkSession, root: str, store: SnapshotStore, repo: str) -> dict:
    """One pass: index, and what the changed files reach."""
    summary = index_repo(spark, root, store, repo)
    affected = []
    if summary["changed_files"]:
        changed = git.changed(spark, root, repo, summary["changed_files"])
        with scope(spark):
            affected = [r.asDict() for r in G.change_surface(stored_graph(store), changed).orderBy("qname", "relation").collect()]
    return summary | {"affected": affected}


def watch(spark: SparkSession, root: str, store: SnapshotStore, repo: str, interval: float = 1.0, once: bool = False, report: Callable[[dict], None] = print) -> None:
    while True:
        result = cycle(spark, root, store, repo)
        if once or result["changed"] or result["removed"]:
            report(result)
        if once:
            return
        time.sleep(interval)


def follow_listings(spark: SparkSession, source: str, index_runs: Callable[[], DataFrame], log: str, state: str, checkpoint: str, days: int = 7) -> StreamingQuery:
    """Streams new files of the listing table `source` (parquet; run_id, path, sha256, deleted, recorded_at) into a log and
    refreshes the changed paths in `state` of the parts they touch; `index_runs` gives the runs as they are now.

    A micro-batch that is repeated after a failure overwrites its own part of the log, so rows count once, and the
    refresh recomputes from the log, so no change is lost or doubled. Ends when everything there is has been handled."""
    schema = spark.read.parquet(source).schema
    table = PartitionedRefresh(spark, state)

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(log)
        with scope(spark):
            refresh_changes(spark.read.parquet(log).drop("_epoch"), index_runs(), table, days)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
