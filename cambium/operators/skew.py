"""Problem 6: per-key results of a join when a few keys hold most of the rows.

Both inputs are aggregated by the join key before they meet. The partial aggregate of every task shrinks a hot key to
one compact state, so what is shuffled and joined is one row a key and task, however many rows the key has. Counts of
the joined rows follow by multiplication and sums by scaling with the other side's count; a coarser grouping is a
roll-up of these states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions.plain import blank, plain_kind, plain_qname
from cambium.session import cut


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, on: list[str], left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None, how: str = "inner", roll_up: list[str] | None = None
) -> DataFrame:
    """Aggregates of `left JOIN right USING (on)` per key, without forming the join.

    Result: the keys, `left_rows`, `right_rows`, `joined_rows`, `times` (how often the join repeats each left row of the
    key), and each named sum over the joined rows. `how` is inner or left; under left, a key without right rows counts
    each left row once. Null keys match nothing. With `roll_up`, a subset of the keys, joined_rows and the sums are
    added up to it. An empty input gives what the join would.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    sums_l, sums_r = left_sums or {}, right_sums or {}
    ls = left.groupBy(*on).agg(F.count("*").alias("left_rows"), *[F.sum(c).alias(f"_l_{k}") for k, c in sums_l.items()])
    rs = right.groupBy(*on).agg(F.count("*").alias("right_rows"), *[F.sum(c).alias(f"_r_{k}") for k, c in sums_r.items()])
    states = ls.join(rs, on, how).withColumn("right_rows", F.coalesce("right_rows", F.lit(0)))
    times = F.greatest("right_rows", F.lit(1)) if how == "left" else F.col("right_rows")
    out = states.select(
        *on, "left_rows", "right_rows", (F.col("left_rows") * times).alias("joined_rows"), times.alias("times"),
        *[(F.col(f"_l_{k}") * times).alias(k) for k in sums_l], *[(F.col(f"_r_{k}") * F.col("left_rows")).alias(k) for k in sums_r],
    )
    if roll_up is None:
        return out
    return out.groupBy(*roll_up).agg(*[F.sum(c).alias(c) for c in ("joined_rows", *sums_l, *sums_r)])


KEY = ["repo", "target_qname"]


def plain_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """`id, repo, target_qname` and those of source_qname and kind that are asked for, in plain form, repeats kept.

    Rows without an id, a repo or a target are no edges."""
    forms = {"source_qname": plain_qname, "target_qname": plain_qname, "kind": plain_kind}
    plain = edges.select("id", "repo", *[forms[c](F.col(c)).alias(c) for c in ("target_qname", *columns)])
    return plain.where(F.col("id").isNotNull() & F.col("repo").isNotNull() & ~blank(F.col("target_qname")))


def distinct_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """`plain_edges`, equal rows once: an edge delivered again counts once. Rows of one id that differ stay apart, so
    each of their keys holds that id."""
    return plain_edges(edges, *columns).distinct()


def _definitions(symbols: DataFrame) -> DataFrame:
    return symbols.select("repo", plain_qname(F.col("qname")).alias("target_qname"), F.col("removed_at").isNull().cast("bigint").alias("live"))


def dependants_per_target(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per (repo, target_qname): `edges` (distinct ids), `definitions` (symbol rows of that key), and the sums over
    edge-definition pairs `pairs` and `live_pairs`. Targets without a symbol have definitions 0."""
    joined = eager_join_aggregate(distinct_edges(edges).select(*KEY), _definitions(symbols), KEY, right_sums={"live_pairs": F.col("live")}, how="left")
    return joined.select(*KEY, F.col("left_rows").alias("edges"), F.col("right_rows").alias("definitions"), F.col("joined_rows").alias("pairs"), F.coalesce("live_pairs", F.lit(0)).alias("live_pairs"))


def dependants(edges: DataFrame) -> DataFrame:
    """Per (repo, target_qname): how many edges and how many different sources point at it.

    A hot target is first cut down to its distinct (target, source) states, which spread over all tasks."""
    states = distinct_edges(edges, "source_qname").groupBy(*KEY, "source_qname").agg(F.count("*").alias("n"))
    return states.groupBy(*KEY).agg(F.sum("n").alias("edges"), F.count("source_qname").alias("sources"))


def heavy_keys(edges: DataFrame, symbols: DataFrame, share: float = 0.01) -> DataFrame:
    """`repo, target_qname` of the targets that hold at least `share` of all distinct edge ids, those of edges without a
    repo or target included.

    Deliveries and definitions are aggregated by key and their states joined. In the join each delivery of a key occurs
    `times` over, so a key whose joined rows stay below share * ids * times can't reach the share: repeats only add
    rows. The few keys left are counted exactly by their distinct ids."""
    total = edges.agg(F.count_distinct("id")).head()[0]
    states = eager_join_aggregate(plain_edges(edges).select(*KEY), _definitions(symbols), KEY, how="left")
    # written, so that its size is known before the edges meet it
    candidates = cut(states.where(F.col("joined_rows") >= F.col("times") * (total * share)).select(*KEY), "candidates")
    exact = plain_edges(edges).join(candidates, KEY).groupBy(*KEY).agg(F.count_distinct("id").alias("edges"))
    return exact.where(F.col("edges") >= total * share).select(*KEY)
