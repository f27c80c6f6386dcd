"""Problem 8: evaluation texts leaking into training text.

Each task builds suffix arrays over the words of its share of the corpus and binary-searches every suffix of every
evaluation item in them, all suffixes at once. Equal ranges give every place that shares `least` words in a row;
places on one diagonal join to the longest verbatim match. The corpus is read in shards of bounded size, and not shuffled.

The evaluation items are tokenized and coded in the executors and sent to the tasks in blocks of bounded size, word numbers
and not text; each block is one pass over the corpus, so an evaluation set of any size is searched whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.session import cut, ship

LEAST = 13
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 16_000_000  # of evaluation text a pass over the corpus, about; a longer item makes a block of its own

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
_ESCAPE = re.compile(r"\\(?:u\{?([0-9A-Fa-f]{4,6})\}?|x([0-9A-Fa-f]{2})|([nrtfv0])|(.))", re.S)
_INLINE = re.compile(r"</?(?:b|i|em|strong|code|span|a|u|s|sub|sup|mark|font|tt|small|big|kbd|var|wbr|ins|del|abbr|q|cite)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?(?:[a-z][a-z0-9-]*)(?:\s[^<>]*)?/?>|<!--|-->|<!\[CDATA\[|\]\]>", re.I)
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")


def _unescape(m: re.Match[str]) -> str:
    point = m.group(1) or m.group(2)
    if point:
        n = int(point, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return " " if m.group(3) else m.group(4)


def words(text: str) -> list[str]:
    """The words of a text without case, spacing, punctuation, comment marks, markup, escapes and invisible characters."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.casefold())


@dataclass(frozen=True)
class Probes:
    """A block of evaluation items: word numbers by word, the items' words end to end, and the suffixes that count, with
    the item and the place in it each comes from. Suffixes are compared in their first `least` words."""

    vocabulary: dict[str, int]
    words: np.ndarray
    start: np.ndarray
    item: np.ndarray
    at: np.ndarray
    least: int


def coded_items(eval_items: DataFrame, least: int = LEAST) -> DataFrame:
    """`item_id, words, size, shared`: the words of each item and the places of rows of `least` words that several items
    share. One row an item and text; items of fewer words are left out."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "text_no": b["text_no"], "words": [words(t) for t in b["text"]], "size": b["text"].str.len()})

    rows = eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().withColumn("text_no", F.xxhash64("text"))
    coded = cut(rows.mapInPandas(split, "item_id bigint, text_no bigint, words array<string>, size bigint").where(F.size("words") >= least), "items")
    # rows of words by two hashes, 96 bits, one state each, however many items begin alike
    window = F.transform(F.sequence(F.lit(1), F.size("words") - (least - 1)), lambda p: F.struct((p - 1).alias("p"), F.xxhash64(F.slice("words", p, F.lit(least))).alias("h"), F.hash(F.slice("words", p, F.lit(least)), F.lit(1)).alias("g")))
    grams = coded.select("item_id", "text_no", F.inline(window))
    common = grams.groupBy("h", "g").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a < b").select("h", "g")
    shared = grams.join(common, ["h", "g"]).groupBy("item_id", "text_no").agg(F.collect_list("p").alias("shared"))
    return coded.join(shared, ["item_id", "text_no"], "left").select("item_id", "words", "size", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def counting(n_words: int, shared: np.ndarray, least: int) -> np.ndarray:
    """Places whose `least` words all lie outside rows that several items share."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edges, shared, 1)
    np.add.at(edges, shared + least, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:n_words] > 0)])
    places = np.arange(max(0, n_words - least + 1))
    return places[covered[places + least] == covered[places]]


def probes(items: list[tuple[int, list[int] | np.ndarray, list[int] | np.ndarray]], vocabulary: dict[str, int], least: int = LEAST) -> Probes:
    """A block out of (item, word numbers, shared places)."""
    start, item, at, offset = [], [], [], 0
    for i, w, shared in items:
        p = counting(len(w), np.asarray(shared, dtype=np.int64), least)
        start.append(offset + p)
        at.append(p)
        item.append(np.full(len(p), i))
        offset += len(w)
    join = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts]).astype(kind)
    return Probes(vocabulary, join([np.asarray(w) for _, w, _ in items], np.int32), join(start, np.int64), join(item, np.int64), join(at, np.int64), least)


def block_of_probes(items: DataFrame, least: int) -> Probes:
    """The rows of one block, which is bounded, brought to the driver as word numbers."""
    words_ = items.select(F.explode("words").alias("w")).distinct()
    vocabulary = {w: k for k, w in enumerate(sorted(r[0] for r in words_.collect()), 1)}
    # numbers instead of words, so that what comes to the driver is a few bytes a word
    numbers = items.sparkSession.createDataFrame(list(vocabulary.items()), "w string, k int")
    spread = items.select("item_id", "shared", F.monotonically_increasing_id().alias("row"), "words")
    spread = cut(spread, "block")
    coded = spread.select("row", F.posexplode("words").alias("p", "w")).join(numbers, "w").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("p", "k"))).alias("c"))
    rows = spread.select("row", "item_id", "shared").join(coded, "row").select("item_id", F.col("c.k").alias("k"), "shared").toPandas()
    return probes(list(zip(rows["item_id"].tolist(), rows["k"], rows["shared"], strict=True)), vocabulary, least)


def suffix_array(w: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `w` in the order of their first `depth` words or more, by prefix doubling."""
    n = len(w)
    rank = w.astype(np.int64)
    length = 1
    while True:
        if length >= depth or n == 0:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(n, dtype=np.int64)
        if length < n:
            ahead[: n - length] = rank[length:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        length *= 2


def _compare(w: np.ndarray, starts: np.ndarray, p: Probes, rows: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the text at `starts` sorts before, with or after the items' words at `rows`."""
    out = np.zeros(len(starts), dtype=np.int8)
    live = np.arange(len(starts))
    for k in range(p.least):
        a, b = w[starts[live] + k], p.words[rows[live] + k]
        less, more = a < b, a > b
        out[live[less]], out[live[more]] = -1, 1
        live = live[~(less | more)]
        if not len(live):
            break
    return out


def search(w: np.ndarray, sa: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the range [lo, hi) of the suffix array that starts with it; a binary search over all at once."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(p.start), dtype=np.int64), np.full(len(p.start), len(sa), dtype=np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            c = _compare(w, sa[mid], p, p.start[open_])
            right = (c <= 0) if upper else (c < 0)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        bounds.append(lo)
    return bounds[0], bounds[1]


def matches(docs: list[np.ndarray], p: Probes) -> pd.DataFrame:
    """`doc, item_id, words, at` for a shard: per document (its place in `docs`) and item the longest match."""
    kept, doc_of, pos_of = [], [], []
    for d, w in enumerate(docs):
        # only runs of known words can hold a match; 0 stands for any other word
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w > 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= p.least:
                kept.append(np.append(w[a:b], 0))
                doc_of.append(np.full(b - a + 1, d))
                pos_of.append(np.arange(a, b + 1))
    empty = pd.DataFrame({"doc": np.array([], dtype=np.int64), "item_id": np.array([], dtype=np.int64), "words": np.array([], dtype=np.int64), "at": np.array([], dtype=np.int64)})
    if not kept or not len(p.start):
        return empty
    text, doc, pos = np.concatenate(kept), np.concatenate(doc_of), np.concatenate(pos_of)
    sa = suffix_array(text, p.least)
    padded = np.concatenate([text, np.zeros(p.least, dtype=text.dtype)])
    lo, hi = search(padded, sa, p)
    hit = np.flatnonzero(hi > lo)
    found = []
    size, begin = (hi - lo)[hit], 0
    while begin < len(hit):  # in steps, so that a passage copied everywhere doesn't fill the memory at once
        end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), 4_000_000)))
        h, n = hit[begin:end], size[begin:end]
        start = sa[np.repeat(lo[h] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        q = np.repeat(h, n)
        found.append(pd.DataFrame({"doc": doc[start], "item_id": p.item[q], "diagonal": start - p.at[q], "start": start}))
        begin = end
    if not found:
        return empty
    f = pd.concat(found).drop_duplicates().sort_values(["doc", "item_id", "diagonal", "start"], ignore_index=True)
    new = (f[["doc", "item_id", "diagonal"]].diff().ne(0).any(axis=1)) | f["start"].diff().ne(1)
    f["run"] = new.cumsum()
    runs = f.groupby(["doc", "item_id", "run"], as_index=False).agg(n=("start", "size"), start=("start", "min"))
    best = runs.sort_values(["doc", "item_id", "n", "start"], ascending=[True, True, False, True]).drop_duplicates(["doc", "item_id"])
    return pd.DataFrame({"doc": best["doc"], "item_id": best["item_id"], "words": best["n"] + p.least - 1, "at": pos[best["start"].to_numpy()]})


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`doc_id, item_id, words, at`: documents and the items they leak, with the length in words of the longest
    verbatim match and the word at which it starts in the document.

    Null and empty texts, and items of fewer than `least` words, match nothing. Repeated rows give one result. A long
    text stays whole; shards end between documents. Rows of an item that several items share don't count."""
    ship(documents.sparkSession)
    items = coded_items(eval_items, least)
    size = items.agg(F.sum("size")).head()[0] or 0
    blocks = 1 + int(size) // block_bytes
    if blocks > 1:
        items = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "blocks")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    found = None
    for k in range(blocks):
        one = _found(rows, block_of_probes(items.where(F.col("block") == k) if blocks > 1 else items, least), shard_words)
        if blocks > 1:
            one = cut(one, "found")  # a pass ends before the next block is brought in
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("at")).alias("at"))).alias("m")).select("doc_id", "item_id", "m.words", (-F.col("m.at")).alias("at"))


def _found(rows: DataFrame, block: Probes, shard_words: int) -> DataFrame:
    """`doc_id, item_id, words, at` of one pass over the corpus."""
    p = rows.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = p.value.vocabulary.get
        ids: list[int] = []
        docs: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            m = matches(docs, p.value)
            return pd.DataFrame({"doc_id": np.array(ids, dtype=np.int64)[m["doc"].to_numpy(dtype=np.int64)], "item_id": m["item_id"], "words": m["words"], "at": m["at"]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                w = np.fromiter((number(x, 0) for x in words(text)), dtype=np.int32)
                if len(w) >= p.value.least and w.any():
                    ids.append(doc_id)
                    docs.append(w)
                    total += len(w)
                    if total >= shard_words:
                        yield flush()
                        ids, docs, total = [], [], 0
        if ids:
            yield flush()

    return rows.mapInPandas(scan, "doc_id bigint, item_id bigint, words bigint, at bigint")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that leak no item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
