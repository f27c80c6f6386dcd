"""Problem 9: splitting oversized texts at natural boundaries.

A text's tokens are written down as one character each, which says how strong a boundary follows: P an empty line,
L a line end, S a sentence end, W a blank, c any other place between characters, x inside a character. On that string
a regular expression with bounded quantifiers does the cutting: each match is one piece of at most the limit in tokens,
its alternatives ordered by boundary strength, down to a plain character where there is none. Pieces start the given
number of tokens before the end of the one before. All of that is SQL over arrays; Python only tokenizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.tokens import DEFAULT_VOCABULARY, ByteTokenizer, pieces, tokenizer
from cambium.session import ship

STRENGTHS = ("P", "L", "S", "W")
LEAST_FILL = 0.5  # of the room; stronger boundaries are looked for beyond it first, then in all of it


def _table(*codes: int) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(codes)] = True
    return t


BLANK_BYTES, SPACE_BYTES, STOP_BYTES = _table(9, 10, 13, 32), _table(9, 32), _table(*b".!?;}")


def encoded(text: str, t: ByteTokenizer) -> np.ndarray:
    steps = [t.encode(p) for p in pieces(text)] if text else [np.zeros(0, dtype=np.int64)]
    return steps[0] if len(steps) == 1 else np.concatenate(steps)


def marks(text: str, ids: np.ndarray, t: ByteTokenizer) -> tuple[bytes, np.ndarray, np.ndarray | None]:
    """The boundary character of each token, the numbers of characters up to its end, and those of bytes (null where
    they are the same)."""
    raw = np.frombuffer(text.encode("utf-8") + b" ", dtype=np.uint8)  # the blank stands for what follows the text
    ends = np.cumsum(t.sizes[ids])
    nxt, last = raw[ends], raw[ends - 1]
    before = np.where(ends > 1, raw[ends - 2], 0)
    newline = (last == 10) | (last == 13) & (nxt != 10)
    third = np.where(ends > 2, raw[ends - 3], 0)
    empty = newline & ((before == 10) | (before == 13) & ((last == 13) | (third == 10) | (third == 13)))
    blank_next = BLANK_BYTES[nxt]
    sentence = STOP_BYTES[last] & blank_next
    code = np.where(blank_next | SPACE_BYTES[last], ord("W"), ord("c")).astype(np.uint8)
    plain = len(raw) - 1 == len(text)
    if not plain:  # full stops of east Asian scripts are three bytes: E3 80 82, EF BC 81, EF BC 9F
        sentence |= (third == 0xE3) & (before == 0x80) & (last == 0x82) | (third == 0xEF) & (before == 0xBC) & ((last == 0x81) | (last == 0x9F))
    code[sentence] = ord("S")
    code[newline] = ord("L")
    code[empty] = ord("P")
    ends = ends.astype(np.int32)
    if plain:
        return code.tobytes(), ends, None
    code[(nxt & 0xC0) == 0x80] = ord("x")
    return code.tobytes(), np.cumsum((raw & 0xC0) != 0x80)[ends - 1].astype(np.int32), ends


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if a is None else len(a) for a in arrays]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = np.concatenate([np.zeros(0, dtype=np.int32), *[a for a in arrays if a is not None]])
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=pa.array([a is None for a in arrays], pa.bool_()))


def marked(documents: DataFrame, more_than: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`doc_id, text, marks, ends, byte_ends` of the documents with more than so many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for b in batches:
            keep, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encoded(text, t)
                if len(ids) > more_than:
                    keep.append(k)
                    found.append(marks(text, ids, t))
            rows = pa.array(keep, pa.int64())
            columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array([m[0] for m in found], pa.binary()).cast(pa.string()), _lists([m[1] for m in found]), _lists([m[2] for m in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "marks", "ends", "byte_ends"])

    ship(documents.sparkSession)
    # no text has more tokens than bytes
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(f"doc_id is not null and octet_length(text) > {int(more_than)}")
    return rows.mapInArrow(run, "doc_id bigint, text string, marks string, ends array<int>, byte_ends array<int>")


BLOCK = 128


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each element. Arrays grow by copying, so it goes block by block: the copying stays within
    blocks and within the list of block totals, also for texts of very many pieces."""
    add = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    zero = F.array(F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(numbers) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(blocks, lambda x: F.aggregate(x, zero, add))
    totals = F.aggregate(inner, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1))))
    return F.flatten(F.zip_with(inner, F.slice(totals, F.lit(1), F.size(inner)), lambda x, t: F.transform(F.slice(x, F.lit(2), F.size(x)), lambda n: n + t)))


def pattern(first: int, later: int) -> str:
    """The expression whose matches are the pieces: at most `first` tokens at the start, `later` afterwards."""

    def upto(n: int) -> str:
        least = max(1, int(n * LEAST_FILL))
        strong = [rf".{{{least - 1},{n - 1}}}{s}" for s in STRENGTHS]
        anywhere = [rf".{{0,{least - 2}}}{s}" for s in STRENGTHS] if least > 1 else []
        return "|".join([rf".{{1,{n}}}\z", *strong, *anywhere, rf".{{0,{n - 1}}}[^x]", rf".{{1,{n}}}"])

    return rf"(?s)\A(?:{upto(first)})|(?!\A)\G(?:{upto(later)})"


def split(m: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """`capacity, doc_id, piece, start, end, n_tokens, text` with character positions, for each (capacity, overlap) and
    each of the `marked` documents that has more tokens than the capacity.

    A piece has at most `capacity` tokens, ends at the strongest boundary in the second half of its room, without any at
    the strongest in the first half, and only without any there inside a word; and, from
    the second on, begins `overlap` tokens before the previous one's end (up to three fewer, where that place lies
    inside a character). Characters are never cut unless one alone exceeds the room. The pieces without their overlaps
    are the text. The limits are elements of one array, not branches of a union, which would tokenize again."""
    def one(capacity: int, overlap: int):
        if not 0 <= overlap < capacity:
            raise ValueError(f"overlap {overlap} of capacity {capacity}")
        taken = F.transform(F.regexp_extract_all("marks", F.lit(pattern(capacity, capacity - overlap)), F.lit(0)), lambda s: F.length(s))
        cuts = running_sums(taken)
        fits = F.length("marks") > capacity
        return F.when(fits, F.struct(F.lit(capacity).alias("capacity"), F.lit(overlap).alias("overlap"), cuts.alias("cuts")))

    chosen = m.select("doc_id", F.col("text").cast("binary").alias("raw"), "marks", "ends", "byte_ends", F.explode(F.array_compact(F.array(*[one(*x) for x in limits]))).alias("c"))
    rows = chosen.select("*", F.posexplode("c.cuts").alias("piece", "last"))
    begin = F.when(F.col("piece") == 0, 0).otherwise(F.greatest(F.lit(0), F.get("c.cuts", F.col("piece") - 1) - F.col("c.overlap")))
    inside = F.length(F.regexp_extract(F.substr("marks", F.greatest(F.lit(1), begin), F.lit(4)), r"^x*", 0))
    placed = rows.withColumn("begin", F.when(begin > 0, begin + inside).otherwise(0))
    at = lambda ends: F.when(F.col("begin") == 0, 0).otherwise(F.get(ends, F.col("begin") - 1))
    placed = placed.withColumns({"start": at("ends"), "end": F.get("ends", F.col("last") - 1), "from": at(F.coalesce("byte_ends", "ends")), "to": F.get(F.coalesce("byte_ends", "ends"), F.col("last") - 1)})
    # bytes are sliced, not characters: finding the n-th character would read the text up to there for every piece
    text = F.expr("cast(substring(raw, from + 1, to - from) as string)")
    return placed.select(F.col("c.capacity").alias("capacity"), "doc_id", "piece", "start", "end", (F.col("last") - F.col("begin")).alias("n_tokens"), text.alias("text"))


def split_all(documents: DataFrame, token_limits: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, purpose: str = "split") -> DataFrame:
    """`split` for each capacity of that purpose in `token_limits`; texts are tokenized once for all of them. Null and
    empty texts and those within the least capacity give no pieces. Repeated rows give repeated pieces."""
    limits = token_limits.where((F.col("purpose") == purpose) & (F.col("capacity_tokens") > 0)).select("capacity_tokens", F.coalesce("overlap_tokens", F.lit(0))).distinct().collect()
    limits = sorted((r[0], r[1]) for r in limits)
    m = marked(documents, limits[0][0] if limits else 0, vocabulary)
    return split(m, limits) if limits else split(m, [(1, 0)]).where("false")
