"""Problem 1: each run processes only what is new or changed since the last successful run.

`PartitionedRefresh` keeps a derived table in step with its source, part by part. A part's fingerprint is its row count
and two additive sums of row hashes, so it doesn't depend on row order and partial sums combine map-side. A refresh
recomputes only parts whose fingerprint differs from the stored one and writes them by dynamic partition overwrite
under the number of the refresh; one rename then makes the refresh valid, fingerprints and rows together. A refresh that
dies half-way has changed nothing: the next one finds the same parts changed and overwrites what was left, so no record is
skipped and none is handled twice. Readers keep to the refresh they started with.

`run_changes` is the record-level step: from listings of successive runs to the paths each run must handle.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions.plain import blank, plain_path, plain_sha256
from cambium.session import cut, delete, scratch
from cambium.sources.pointer import Pointer, exists

PART, GEN, ROWS, SUM_LOW, SUM_HIGH = "_part", "_gen", "_fp_rows", "_fp_low", "_fp_high"
PRINT = (ROWS, SUM_LOW, SUM_HIGH)


def _sums(h: Column) -> list[Column]:
    return [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(SUM_LOW), F.sum(F.shiftright(h, 32)).alias(SUM_HIGH)]


def fingerprints(source: DataFrame, *by: str) -> DataFrame:
    """One row per part (`_part`, or the columns `by`): its row count and the sums of the low and high halves of a 64-bit
    hash of the whole row.

    Repeated rows count as often as they occur; nulls are told from empty strings. An empty source gives no rows."""
    by = by or (PART,)
    cells = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in source.dtypes]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in source.columns])
    return source.select(*by, F.xxhash64(*cells, nulls).alias("_h")).groupBy(*by).agg(F.count("*").alias(ROWS), *_sums(F.col("_h")))


class PartitionedRefresh:
    """A derived table in `folder` (on storage all executors share) that follows its source part by part.

    Rows lie in data/_part=P/_gen=G, fingerprints of refresh G in marks/G. The driver sees the names of parts only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointer = Pointer(spark, self.folder)

    def _marks(self, gen: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/marks/{gen}")

    def refresh(self, source: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list:
        """Brings the table up to date and returns the parts it recomputed.

        `source` has a column `_part`; `compute` maps rows of whole parts, `_part` included, to result rows that keep
        `_part`; it must not mix parts. A part whose result is empty holds no rows; one whose source is gone goes. An
        empty source empties the table."""
        return self.refresh_marked(fingerprints(source), lambda changed: compute(source.join(changed, PART, "left_semi")))

    def refresh_marked(self, marks: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list:
        """As `refresh`, for parts whose fingerprints are given (`_part` and the three numbers): `compute` takes the changed
        parts (`_part`) and returns their rows."""
        state = self.pointer.read() or {"gen": 0}
        last, gen = state["gen"], state["gen"] + 1
        new = marks.select(PART, *PRINT)
        if last:
            old = self._marks(last).select(PART, F.col(GEN).alias("_was"), *[F.col(c).alias(f"_was{c}") for c in PRINT])
            same = F.col("_was").isNotNull()
            for c in PRINT:
                same = same & (F.col(c) == F.col(f"_was{c}"))
            new = new.join(old, PART, "full").select(PART, F.when(F.col(ROWS).isNull(), -1).when(same, F.col("_was")).otherwise(gen).cast("bigint").alias(GEN), *PRINT)
        else:
            new = new.select(PART, F.lit(gen).cast("bigint").alias(GEN), *PRINT)
        new = cut(new, "marks")  # small, and read several times
        changed = sorted(r[0] for r in new.where(F.col(GEN).isin(-1, gen)).select(PART).collect())
        if last and not changed:
            return []
        new.where(F.col(GEN) > 0).write.mode("overwrite").parquet(f"{self.folder}/marks/{gen}")
        result = compute(self._marks(gen).where(F.col(GEN) == gen).select(PART)).withColumn(GEN, F.lit(gen).cast("bigint"))
        # adaptive execution splits large parts and joins small ones, so files follow the data and not the number of parts
        result.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, GEN).parquet(f"{self.folder}/data")
        self.pointer.swap({"gen": gen, "schema": result.schema.jsonValue()})
        self._clean(gen)
        return changed

    def _clean(self, gen: int) -> None:
        """Deletes what neither this refresh nor the one before it shows; readers of the latter may still be at work."""
        if gen < 3 or not exists(self.spark, f"{self.folder}/marks/{gen - 2}"):
            return
        for r in self._marks(gen - 2).select(PART, GEN).join(self._marks(gen - 1), [PART, GEN], "left_anti").collect():
            delete(self.spark, f"{self.folder}/data/{PART}={r[0]}/{GEN}={r[1]}")
        delete(self.spark, f"{self.folder}/marks/{gen - 2}")

    def read(self) -> DataFrame:
        """The derived rows of the last complete refresh, without bookkeeping."""
        state = self.pointer.read()
        if state is None:
            raise FileNotFoundError(self.folder)
        schema = T.StructType.fromJson(state["schema"])
        if not exists(self.spark, f"{self.folder}/data"):
            return self.spark.createDataFrame([], schema).drop(PART, GEN)
        shown = F.lit(False)  # on partition columns alone, so files of other refreshes aren't even opened
        for r in self._marks(state["gen"]).groupBy(GEN).agg(F.collect_list(PART).alias("parts")).collect():
            shown = shown | (F.col(GEN) == r[GEN]) & F.col(PART).isin(r["parts"])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data").where(shown).drop(PART, GEN)


def ok_runs(index_runs: DataFrame) -> DataFrame:
    """Successful runs (status ok, finished) with their number among those of the same repo and root, by started_at
    (ties by run_id). Repeated rows of a run count once. Columns: run_id, repo, root, started_at, seq, last."""
    root = F.coalesce(plain_path(F.col("root")), F.lit(""))
    runs = (
        index_runs.where((F.lower(F.trim("status")) == "ok") & F.col("finished_at").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.max(F.struct("started_at", "repo", root.alias("root"))).alias("r"))
        .select("run_id", "r.*")
    )
    w = Window.partitionBy("repo", "root")
    return runs.select("run_id", "repo", "root", "started_at", F.row_number().over(w.orderBy("started_at", "run_id")).alias("seq"), F.count("*").over(w).alias("last"))


def listings(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of files that belong to one of `runs` (see `ok_runs`), in plain form, with the run's number.

    Rows without a path or run are no listing and are left out; a null `deleted` counts as false."""
    r = runs.select("run_id", F.col("repo").alias("run_repo"), "root", "seq", "last")
    repo = F.col("repo") if "repo" in files.columns else F.lit(None).cast("string")
    f = files.select("run_id", repo.alias("file_repo"), plain_path(F.col("path")).alias("path"), plain_sha256(F.col("sha256")).alias("sha256"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "recorded_at").where(~blank(F.col("path")))
    return f.join(r, "run_id").select("run_id", F.coalesce("run_repo", "file_repo").alias("repo"), "root", "seq", "last", "path", "sha256", "deleted", "recorded_at")


def run_changes(listed: DataFrame) -> DataFrame:
    """What each run must handle: `repo, root, path, seq, change`, change being added, changed or removed.

    Of several rows of one run and path the one recorded last is valid (ties: the greater deleted, sha256). A path
    is compared with the same path in the previous successful run of its repo and root; two null digests are equal,
    a null and a known one are not. Everything partitions by path, so no group exceeds the number of runs of a root.
    """
    keys = ["repo", "root", "path"]
    valid = (
        listed.repartition(*keys)  # one shuffle serves the aggregate and the window
        .groupBy(*keys, "seq", "last")
        .agg(F.max(F.struct(F.coalesce(F.col("recorded_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "deleted", F.coalesce("sha256", F.lit("")).alias("sha"))).alias("v"))
        .select(*keys, "seq", "last", (~F.col("v.deleted")).alias("live"), F.col("v.sha").alias("sha"))
    )
    w = Window.partitionBy(*keys).orderBy("seq")
    live = valid.where("live").withColumns({"before": F.lag("seq").over(w), "sha_before": F.lag("sha").over(w), "after": F.lead("seq").over(w)})
    kept = F.col("before") == F.col("seq") - 1
    shown = live.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(~kept, F.lit(True)), F.struct(F.col("seq").alias("at"), F.lit("added").alias("change"))),
                    F.when(kept & (F.col("sha") != F.col("sha_before")), F.struct(F.col("seq").alias("at"), F.lit("changed").alias("change"))),
                    F.when((F.col("seq") < F.col("last")) & (F.coalesce("after", F.lit(0)) != F.col("seq") + 1), F.struct((F.col("seq") + 1).alias("at"), F.lit("removed").alias("change"))),
                )
            )
        ).alias("c"),
    )
    return shown.select(*keys, F.col("c.at").alias("seq"), F.col("c.change").alias("change"))


def period_of(started_at: Column, days: int) -> Column:
    """The number of the stretch of `days` days in which a run began."""
    return F.coalesce(F.floor(F.unix_date(started_at.cast("date")) / days), F.lit(0)).cast("int")


def refresh_changes(files: DataFrame, index_runs: DataFrame, state: PartitionedRefresh, days: int = 7) -> list[int]:
    """Brings `state` (`run_id, path, change`) up to date with the listings and returns the parts it recomputed.

    A part is the runs that began within the same `days` days, of any root. Its fingerprint covers its runs, their listings
    and those of the runs before them, as read, so new runs and rows that come late change the parts of the runs they
    bear on and no others. Tasks split a part by path, so its size bounds nothing. `days` has to stay the same between
    calls."""
    runs = cut(ok_runs(index_runs).withColumn(PART, period_of(F.col("started_at"), days)), "runs")
    own = fingerprints(files.select("run_id", "path", "sha256", "deleted", "recorded_at"), "run_id")
    own = cut(own.join(runs.select("run_id"), "run_id", "left_semi"), "prints")
    lone = runs.select("repo", "root", "seq", PART, "run_id").join(own, "run_id", "left")
    before = lone.select("repo", "root", (F.col("seq") + 1).alias("seq"), F.col("run_id").alias("_b"), *[F.col(c).alias(f"_b{c}") for c in PRINT])
    paired = lone.join(before, ["repo", "root", "seq"], "left")
    h = F.xxhash64("run_id", *PRINT, F.coalesce("_b", F.lit(-1)), *[F.coalesce(f"_b{c}", F.lit(-1)) for c in PRINT])
    marks = paired.select(PART, (F.coalesce(ROWS, F.lit(0)) + F.coalesce(f"_b{ROWS}", F.lit(0))).alias(ROWS), h.alias("_h")).groupBy(PART).agg(F.sum(ROWS).alias(ROWS), *_sums(F.col("_h")))

    def compute(changed: DataFrame) -> DataFrame:
        wanted = runs.join(changed, PART, "left_semi").select("repo", "root", "seq", "run_id", PART)
        needed = wanted.select("repo", "root", F.explode(F.array("seq", F.col("seq") - 1)).alias("seq")).distinct()
        found = run_changes(listings(files, runs.join(needed, ["repo", "root", "seq"], "left_semi")))
        # a removal shows in a run that doesn't list the path; those of runs that aren't wanted were only looked back at
        return found.join(wanted, ["repo", "root", "seq"]).select(PART, "run_id", "path", "change")

    return state.refresh_marked(marks, compute)


def changed_paths(files: DataFrame, index_runs: DataFrame, folder: str | None = None, days: int = 7) -> DataFrame:
    """`run_id, path, change`: per successful run the paths it must handle, kept in a `PartitionedRefresh` table.

    With a `folder` of an earlier call and the same `days`, only parts whose listings changed are recomputed. Files or runs
    that are empty give no rows; extra columns are ignored. A run whose repo is null, or which has no start, is a run
    like any other."""
    spark = files.sparkSession
    state = PartitionedRefresh(spark, folder or scratch(spark, "changed-paths"))
    refresh_changes(files, index_runs, state, days)
    return state.read()
