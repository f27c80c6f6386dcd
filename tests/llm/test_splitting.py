import random
from collections import defaultdict

from cambium.llm import splitting as S
from cambium.llm.tokens import pieces, tokenizer


def test_steps_tokenize_as_the_whole(monkeypatch):
    import cambium.llm.tokens as T

    monkeypatch.setattr(T, "STEP", 50)
    rng = random.Random(1)
    t = tokenizer()
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", "\n", "x1", "é", "。", "  ", "\n\n", "9", "'s"]) for _ in range(rng.randrange(400)))
        assert "".join(T.pieces(text)) == text
        assert [i for p in T.pieces(text) for i in t.encode(p)] == list(t.encode(text))


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [([],), ([5],), (list(range(1, 129)),), (list(range(1, 130)),), ([1] * 1000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<int>").select(S.running_sums(F.col("a"))).collect()]
    assert got == [[sum(a[: i + 1]) for i in range(len(a))] for (a,) in rows]


def test_pieces(spark):
    rng = random.Random(3)
    texts = {1: "One sentence here. " * 60, 2: "para one\n\n" * 40, 3: "日本語の文章です。" * 50, 4: "😀👍🏽" * 90, 5: "x" * 1500, 6: "short", 7: "", 8: None, 9: "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(400)), 10: "a\r\n\r\nb\r\n" * 60, 11: "<|endoftext|> " * 40}
    docs = spark.createDataFrame([*texts.items(), (None, "y " * 200)], "doc_id bigint, text string").withColumn("piece", __import__("pyspark").sql.functions.lit(1))
    limits = spark.createDataFrame([("split", 32, 4), ("split", 50, 0), ("pack", 9, 0)], "purpose string, capacity_tokens int, overlap_tokens int")
    got = defaultdict(list)
    for r in S.split_all(docs, limits).orderBy("capacity", "doc_id", "piece").collect():
        got[(r.capacity, r.doc_id)].append(r)
    t = tokenizer()
    assert set(got) == {(c, i) for c in (32, 50) for i, x in texts.items() if x and t.count(x) > c}
    for (capacity, i), rows in got.items():
        text, last = texts[i], 0
        for k, r in enumerate(rows):
            assert r.piece == k and r.text == text[r.start : r.end] and r.start <= last < r.end
            assert r.n_tokens <= capacity and t.count(r.text) <= capacity
            if k and capacity == 50:
                assert r.start == last
            last = r.end
        assert last == len(text)
    # the strongest boundary within reach is taken
    assert all(r.text.endswith("\n\n") for r in got[(32, 2)][:-1]) and all(r.text.rstrip().endswith(".") for r in got[(32, 1)][:-1])
    assert all(r.text.endswith("。") for r in got[(50, 3)][:-1])
    assert S.split_all(docs, limits.where("false")).count() == 0 and S.split_all(docs.where("false"), limits).count() == 0


def test_no_word_is_cut_while_the_room_holds_a_blank(spark):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice(["ab cd", " ", "x" * rng.randrange(30, 300), "\n", "q" * 80]) for _ in range(40)) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    limits = spark.createDataFrame([("split", 16, 3)], "purpose string, capacity_tokens int, overlap_tokens int")
    inside = 0
    rows = S.split_all(docs, limits).orderBy("doc_id", "piece").collect()
    for k, r in enumerate(rows):
        text, last = texts[r.doc_id], rows[k - 1].end if r.piece else 0
        if r.end < len(text) and not text[r.end - 1].isspace() and not text[r.end].isspace():
            inside += 1
            assert not any(c.isspace() for c in text[last : r.end].strip()), (r.doc_id, text[last : r.end])
    assert inside > 10 and len(rows) > inside
