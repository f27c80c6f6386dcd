"""Problem 3: references to records that do not exist.

Keys of parents and references are numbered in sorted order. Neighbouring numbers that all belong to parents collapse
into runs [first, last]; a reference is matched as of the run that starts at or before it, and lies beyond that run's
end exactly if no parent has its key. Runs are cut at the borders of number ranges, so each range is matched on its
own and nothing is compared across tasks. Rows are reduced to one per key before anything is matched; only keys with
a fault go back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.plain import blank, plain_qname
from cambium.operators.hierarchy import numbered
from cambium.session import cut

RANGE_BITS = 16  # keys per range at most 2**16
HEAVY_KEYS = 1000  # a key with over 1/1000 of all rows is heavy, so there are fewer than this


@dataclass(frozen=True)
class Reference:
    """A field of a table that names a parent."""

    table_name: str
    rows: DataFrame
    field: str
    scope: str
    to_qname = staticmethod(plain_qname)

    def keyed(self) -> DataFrame:
        out = self.rows.select(
            F.lit(self.table_name).alias("table_name"), F.col("id").cast("bigint").alias("row_id"), F.lit(self.field).alias("field_name"),
            F.col(self.scope).alias("scope"), self.to_qname(F.col(self.field)).alias("key"), F.col("recorded_at").alias("at"),
        )
        return out.where(~blank(F.col("key")) & F.col("scope").isNotNull())


def parent_runs(parents: DataFrame) -> DataFrame:
    """`range, first, last, latest`: maximal runs of consecutive ids within a range; parents: `id, since`."""
    w = Window.partitionBy("range").orderBy("id")
    islands = parents.withColumn("range", F.shiftright("id", RANGE_BITS)).withColumn("island", F.col("id") - F.row_number().over(w))
    return islands.groupBy("range", "island").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("since").alias("latest")).drop("island")


def as_of_runs(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """`id, inside, latest` for each id: whether it lies in the run starting at or before it, and that run's latest."""
    points = ids.select(F.shiftright("id", RANGE_BITS).alias("range"), F.col("id").alias("at"), F.lit(1).alias("point"), F.lit(None).cast("struct<last:bigint,latest:timestamp_ntz>").alias("run"))
    starts = runs.select("range", F.col("first").alias("at"), F.lit(0).alias("point"), F.struct("last", F.col("latest").cast("timestamp_ntz").alias("latest")).alias("run"))
    w = Window.partitionBy("range").orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0)
    seen = points.unionByName(starts).withColumn("run", F.last("run", ignorenulls=True).over(w)).where("point = 1")
    return seen.select(F.col("at").alias("id"), F.coalesce(F.col("at") <= F.col("run.last"), F.lit(False)).alias("inside"), F.col("run.latest").alias("latest"))


def join_skewed(rows: DataFrame, states: DataFrame, on: list[str], row: str) -> DataFrame:
    """Inner join of many `rows` to at most one state a key, in one pass over the rows.

    `states` has a flag `heavy`, set for keys that hold over 1/HEAVY_KEYS of all rows, hence for fewer than HEAVY_KEYS of
    them, and `wanted`. Heavy states are broadcast; rows of heavy keys then need no partner and are spread by `row`
    instead of their key, and those of unwanted heavy keys go at once."""
    values = [c for c in states.columns if c not in (*on, "heavy", "wanted")]
    hot = states.where("heavy").limit(HEAVY_KEYS).select(*on, "wanted", F.struct(*values).alias("_hot"))
    cold = states.where("wanted and not heavy").select(*on, F.lit("").alias("_spread"), F.struct(*values).alias("_cold"))
    met = rows.join(F.broadcast(hot), on, "left").where("wanted is null or wanted")
    met = met.withColumn("_spread", F.when(F.col("wanted"), F.col(row).cast("string")).otherwise(""))
    both = met.join(cold, [*on, "_spread"], "left").where("_hot is not null or _cold is not null")
    return both.withColumn("_state", F.coalesce("_hot", "_cold")).select(*rows.columns, *[F.col(f"_state.{v}").alias(v) for v in values])


def orphans(references: list[Reference], symbols: DataFrame) -> DataFrame:
    """`table_name, row_id, field_name, reason, period`: one row per referring row and field at fault.

    missing: no symbol row has the key; deleted: all its rows have removed_at; late: it has a live row, but its
    earliest indexed_at is after the reference's recorded_at. A null or empty name, or a null scope, is no reference.
    A null recorded_at is never late and has a null period; symbols without indexed_at are never late. Repeated rows
    give one row. With no symbols every reference is missing; with no references there are no rows.
    """
    refs = references[0].keyed()
    for r in references[1:]:
        refs = refs.unionByName(r.keyed())
    known = symbols.select(F.col("repo").alias("scope"), plain_qname(F.col("qname")).alias("key"), F.col("indexed_at").cast("timestamp_ntz").alias("since"), F.col("removed_at").isNull().alias("live")).where(~blank(F.col("key")) & F.col("scope").isNotNull())
    both = known.select("scope", "key", "since", "live", F.lit(0).alias("refs"), F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(
        refs.select("scope", "key", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast("boolean").alias("live"), F.lit(1).alias("refs"), F.col("at").cast("timestamp_ntz").alias("at"))
    )
    keys = numbered(
        both.groupBy("scope", "key").agg(F.min("since").alias("since"), F.max("live").alias("live"), F.sum("refs").alias("refs"), F.min("at").alias("earliest")), "scope", "key"
    )
    parents = keys.where("live is not null")
    cited = keys.where("refs > 0").select("id")
    any_run = as_of_runs(cited, parent_runs(parents.select("id", "since")))
    live_run = as_of_runs(cited, parent_runs(parents.where("live").select("id", "since")))
    judged = any_run.select("id", F.col("inside").alias("exists")).join(live_run.select("id", F.col("inside").alias("lives"), "latest"), "id")
    # a run none of whose parents is younger than the key's first reference can't hold a late one
    faulty = ~F.col("lives") | (F.col("latest") > F.col("earliest"))
    total = keys.agg(F.sum("refs")).head()[0] or 0
    states = keys.where("refs > 0").join(judged, "id").select(
        "scope", "key", F.when(~F.col("exists"), "missing").when(~F.col("lives"), "deleted").alias("fault"), "since", F.coalesce(faulty, F.lit(False)).alias("wanted"), (F.col("refs") * HEAVY_KEYS > F.lit(total)).alias("heavy")
    )
    states = cut(states.where("wanted or heavy"), "states")
    hit = join_skewed(refs, states, ["scope", "key"], "row_id").where(F.col("fault").isNotNull() | (F.col("since") > F.col("at")))
    return hit.select("table_name", "row_id", "field_name", F.coalesce("fault", F.lit("late")).alias("reason"), F.date_format("at", "yyyy-MM").alias("period")).distinct()


def code_references(edges: DataFrame, contracts: DataFrame, unresolved: DataFrame) -> list[Reference]:
    return [
        Reference("edges", edges, "target_qname", "repo"),
        Reference("contracts", contracts, "provider_qname", "provider_repo"),
        Reference("contracts", contracts, "consumer_qname", "consumer_repo"),
        Reference("unresolved", unresolved, "source_qname", "repo"),
    ]


def per_period(found: DataFrame) -> DataFrame:
    """Faults counted per table, field, reason and month."""
    return found.groupBy("table_name", "field_name", "reason", "period").agg(F.count("*").alias("n"))
