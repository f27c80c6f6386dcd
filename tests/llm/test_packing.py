import random
from collections import Counter

from cambium.llm import packing as P


def unpack(patterns):
    c = Counter()
    for pattern, n in patterns:
        for length, per in pattern:
            c[length] += per * n
    return c


def test_patterns_hold_everything_and_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(1, 60)
        h = {rng.randrange(1, capacity + 1): rng.randrange(1, 500) for _ in range(rng.randrange(1, 12))}
        patterns = P.shortest_pack_first(h, capacity)
        assert unpack(patterns) == Counter(h)
        assert all(sum(a * b for a, b in p) <= capacity and n > 0 for p, n in patterns)
        total = sum(k * v for k, v in h.items())
        assert sum(n for _, n in patterns) <= 1 + 2 * total / capacity  # never half empty on average
    assert P.shortest_pack_first({}, 5) == []


def test_slots_cover_ranks_once():
    patterns = P.shortest_pack_first({7: 5, 3: 11, 2: 4}, 10)
    slots, containers = P.slots(patterns)
    for length, n in {7: 5, 3: 11, 2: 4}.items():
        ranks = sorted((a, b) for x, a, b, _, _ in slots if x == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    assert containers == sum(n for _, n in patterns)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 3, 3, 3, 5, 8, 25, rng.randrange(1, 30)])) for i in range(800)] + [(7, 3), (7, 3)]
    packed = P.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 10, buckets=5).collect()
    fill, whole = Counter(), Counter()
    for r in packed:
        fill[r.container] += r.length
        whole[r.doc_id] += r.length
    want = Counter()
    for i, n in rows:
        want[i] += n
    assert max(fill.values()) <= 10 and +want == whole
    once = {i: n for i, n in rows if i != 7}
    parts = Counter(r.doc_id for r in packed)
    assert all(parts[i] == max(-(-n // 10), 0) for i, n in once.items())
    rooms = []  # best fit, longest first, one item after the other
    for n in sorted((r.length for r in packed), reverse=True):
        fits = [x for x in rooms if x >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 10) - n)
    assert len(fill) <= len(rooms) * 1.01 + 1
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 10).count() == 0


def test_texts(spark):
    docs = spark.createDataFrame([(1, "one two three", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, "word " * 400_000, 0)], "doc_id bigint, text string, container int")
    limits = spark.createDataFrame([("pack", 64, 0), ("pack", 64, 0), ("split", 8, 2), ("pack", None, 0), ("pack", -1, 0)], "purpose string, capacity_tokens int, overlap_tokens int")
    rows = P.packs(docs, limits).collect()
    assert {r.capacity for r in rows} == {64} and {r.doc_id for r in rows} == {1, 4}
    from cambium.llm.tokens import tokenizer

    assert sum(r.length for r in rows if r.doc_id == 4) == tokenizer().count("word " * 400_000)
    assert P.packs(docs, limits.where("false")).count() == 0
