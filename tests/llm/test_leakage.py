import random

import numpy as np

from cambium.llm import leakage as L


def brute(docs, items, least):
    coded = {i: L.words(t or "") for i, t in items}
    grams = {}
    for i, w in coded.items():
        for p in range(len(w) - least + 1):
            grams.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = set()
    for i, w in coded.items():
        shared = set()
        for p in range(len(w) - least + 1):
            if len(grams[tuple(w[p : p + least])]) > 1:
                shared |= set(range(p, p + least))
        probes = {tuple(w[p : p + least]) for p in range(len(w) - least + 1) if not shared & set(range(p, p + least))}
        for d, t in docs:
            v = L.words(t or "")
            if any(tuple(v[p : p + least]) in probes for p in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        w = rng.integers(0, 3, n).astype(np.int32)
        sa = L.suffix_array(w, 13)
        keys = [tuple(w[i : i + 13]) for i in sa]
        assert keys == sorted(keys) and sorted(sa) == list(range(n))


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    head = text(9)
    items = [(i, head + " " + text(rng.randrange(3, 25))) for i in range(8)] + [(8, None), (9, ""), (10, "w1 w2")]
    docs = [(d, text(rng.randrange(0, 120))) for d in range(60)] + [(100 + i, f"foo {t.upper()[: rng.randrange(20, 200)]}, bar") for i, t in items if t] + [(200, None), (201, ""), (200, None)]
    for least in (4, 6):
        e = spark.createDataFrame(items, "item_id bigint, text string")
        df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as words", "'x' as item_id")
        for shard, block in ((50, 10**6), (10**6, 150)):  # in one block of items, and in several
            got = L.leaks(df, e, least, shard, block).collect()
            assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, least)
            assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and all(r.words >= least for r in got)


PASSAGE = "the quick brown fox jumps over the lazy dog_house while seven grey owls watch"


def test_disguises():
    want = L.words(PASSAGE)
    assert len(want) == 14
    for hidden in [
        PASSAGE.upper(), PASSAGE.replace(" ", "\n// "), PASSAGE.replace(" ", " * "), "<p>" + PASSAGE.replace("fox", "<b>fox</b>").replace("lazy", "la<wbr>zy") + "</p>",
        PASSAGE.replace("quick", "**quick**").replace("_", "\\_"), PASSAGE.replace(" ", "&nbsp;"), PASSAGE.replace("brown", "br​own").replace("owls", "o­wls"),
        '"' + PASSAGE.replace(" ", "\\n") + '"', PASSAGE.replace("fox", "\\u0066ox"), PASSAGE.replace("quick", "ｑｕｉｃｋ"), PASSAGE.replace(" ", "&amp;nbsp;"), PASSAGE.replace(" ", ",  "), "_" + PASSAGE.replace(" ", "_ _") + "_",
    ]:
        assert L.words(hidden) == want, hidden


def test_longest_match_and_clean(spark):
    items = spark.createDataFrame([(1, PASSAGE + " and nobody counts them"), (2, "other words entirely " * 6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so then " + PASSAGE + " and went"), (2, "clean " * 40), (3, " ".join(PASSAGE.split()[:12])), (4, "x " * 300_000 + PASSAGE)], "doc_id bigint, text string")
    found = L.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id, r.words, r.at) for r in found.collect()) == [(1, 1, 15, 2), (4, 1, 14, 300_000)]
    assert sorted(r.doc_id for r in L.without_leaks(docs, found).collect()) == [2, 3]
    assert L.leaks(docs, items.where("false")).count() == 0 and L.leaks(docs.where("false"), items).count() == 0
