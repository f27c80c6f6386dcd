"""Problem 7: filling fixed-capacity containers with documents.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first; of the open packing patterns the
shortest, with the most room left, is filled if the length fits, and the pattern counts are updated. That works on
(length, count) pairs, so the driver handles at most `capacity` lengths whatever the number of documents. The patterns
are joined back to the documents by length and rank among equals. Ranks come from counts per (length, bucket), so
documents of one hot length are ranked in many tasks.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.llm.tokens import DEFAULT_VOCABULARY, pieces, tokenizer
from cambium.session import cut, ship

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`doc_id, n_tokens`; a null text has no tokens, a null doc_id is left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [sum(t.count(p) for p in pieces(x)) for x in b["text"]]})

    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    return rows.mapInPandas(count, "doc_id bigint, n_tokens bigint")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many containers have each. Lengths lie in 1..capacity.

    An open pattern is one with room left; the one with the most room is taken while the next length fits, and as many of
    its containers as there are items of that length, so whole groups move at once. A length splits at most two groups and
    opens one, so there are never more than 3 * capacity patterns, of at most sqrt(2 * capacity) different lengths each,
    whatever the number of items."""
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)  # by room
    rooms: list[int] = []

    def add(room: int, pattern: Pattern, n: int) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = len(rooms) - 1
            if i < 0 or rooms[i] < length:  # fresh containers, as full of this length as fits
                per = min(left, capacity // length)
                n = left // per
                add(capacity - per * length, ((length, per),), n)
                left -= n * per
                continue
            room = rooms[i]
            pattern, have = next(iter(open_[room].items()))
            per = min(left, room // length)
            n = min(have, left // per)
            if n == have:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                open_[room][pattern] -= n
            grown = pattern[:-1] + ((length, pattern[-1][1] + per),) if pattern[-1][0] == length else (*pattern, (length, per))
            add(room - per * length, grown, n)
            left -= n * per
    return [(p, n) for room in sorted(open_) for p, n in open_[room].items()]


def slots(patterns: list[tuple[Pattern, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """`(length, first rank, end rank, first container, items of that length per container)` and the number of
    containers: ranks [first, end) of a length fill containers in order, `per` to each."""
    out, used, base = [], defaultdict(int), 0
    for pattern, n in patterns:
        for length, per in pattern:
            out.append((length, used[length], used[length] + n * per, base, per))
            used[length] += n * per
        base += n
    return out, base


def ranked(items: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """`items` with `rank` from 0 among equal keys, in the order of bucket and `order`; no task holds more of a key than
    its share in one bucket."""
    b = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = b.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = counts.select(key, "bucket", (F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1
    return b.withColumn("local", local).join(before, [key, "bucket"]).withColumn("rank", F.col("before") + F.col("local")).drop("bucket", "local", "before")


MAX_BROADCAST = 500_000  # slots, of 36 bytes; real histograms of capacity 8,192 have some 25,000
BUCKET_ROWS = 250_000  # documents of one length that one task ranks, about


def pack(sizes: DataFrame, capacity: int, buckets: int | None = None) -> DataFrame:
    """`container, doc_id, part, length` for documents `doc_id, n_tokens`.

    A document longer than `capacity` is divided: its full parts take a container each and its rest is packed like any
    other item; no other document is divided. Documents without tokens need no room and get no row. Repeated doc_ids
    are packed as often as they occur. An empty input gives no rows."""
    spark = sizes.sparkSession
    if capacity < 1:
        raise ValueError(f"capacity {capacity}")
    parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    items = sizes.where("n_tokens > 0").select("doc_id", F.posexplode(F.sequence(F.lit(1), parts)).alias("part", "k"), "n_tokens")
    items = items.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("length"))
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    found, _ = slots(shortest_pack_first(histogram, capacity))
    table = spark.createDataFrame(found, "length int, first bigint, end bigint, base bigint, per bigint")
    buckets = buckets or 1 + max(histogram.values(), default=0) // BUCKET_ROWS
    placed = ranked(items, "length", ["doc_id", "part"], buckets)
    hit = placed.join(F.broadcast(table) if len(found) <= MAX_BROADCAST else table, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return hit.select((F.col("base") + F.expr("(rank - first) div per")).alias("container"), "doc_id", "part", "length")


def packs(documents: DataFrame, token_limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, purpose: str = "pack") -> DataFrame:
    """`capacity, container, doc_id, part, length` for each capacity of that purpose in `token_limits`. Texts are
    tokenized once for all of them. Null and non-positive capacities are ignored."""
    sizes = cut(token_counts(documents, vocabulary), "sizes")
    capacities = _capacities(token_limits, purpose)
    if not capacities:
        return sizes.select(F.lit(0).alias("capacity"), F.lit(0).cast("bigint").alias("container"), "doc_id", F.lit(0).alias("part"), F.lit(0).alias("length")).where("false")
    out = None
    for c in capacities:
        one = pack(sizes, c).select(F.lit(c).alias("capacity"), "container", "doc_id", "part", "length")
        out = one if out is None else out.unionByName(one)
    return out


def _capacities(token_limits: DataFrame, purpose: str) -> list[int]:
    """Distinct capacities; the table is one of settings, with a few rows."""
    rows = token_limits.where((F.col("purpose") == purpose) & (F.col("capacity_tokens") > 0)).select("capacity_tokens").distinct().collect()
    return sorted(r[0] for r in rows)


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: `containers`, `items`, `tokens` and the share `filled` of the room they use."""
    g = packed.groupBy("capacity").agg(F.count_distinct("container").alias("containers"), F.count("*").alias("items"), F.sum("length").alias("tokens"))
    return g.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
