from pyspark.sql import functions as F

from cambium.operators import skew as K


def test_equals_the_join(spark):
    left = spark.createDataFrame([(k, v) for k in (1, 1, 1, 2, 3, None) for v in (10, 20)], "k int, v int")
    right = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (4, 8), (None, 9)], "k int, w int")
    for how in ("inner", "left"):
        j = left.join(right, "k", how)
        want = {r.k: (r.n, r.v, r.w) for r in j.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
        got = {r.k: (r.joined_rows, r.v, r.w) for r in K.eager_join_aggregate(left, right, ["k"], {"v": F.col("v")}, {"w": F.col("w")}, how).collect()}
        assert got == want
    assert K.eager_join_aggregate(left, right.where("false"), ["k"]).count() == 0


def test_roll_up(spark):
    left = spark.createDataFrame([(g, k, 1) for g in "ab" for k in (1, 2, 2)], "g string, k int, v int")
    right = spark.createDataFrame([(g, k) for g in "ab" for k in (1, 2, 2)], "g string, k int")
    got = K.eager_join_aggregate(left, right, ["g", "k"], {"v": F.col("v")}, roll_up=["g"])
    assert sorted((r.g, r.joined_rows, r.v) for r in got.collect()) == [("a", 5, 5), ("b", 5, 5)]


EDGE = "id bigint, repo string, source_qname string, target_qname string, kind string, n int"
SYM = "repo string, qname string, removed_at timestamp_ntz"


def test_heavy_keys(spark):
    rows = [(i, "r", f"s{i}", " hot() " if i % 2 else "hot", "calls", 0) for i in range(150)] + [(1000 + i, "r", "s", f"t{i}", "calls", 0) for i in range(100)]
    rows += rows[:50] + [(None, "r", "s", "hot", "calls", 0), (5000, None, "s", "hot", "calls", 0), (5001, "r", "s", None, "calls", 0)]
    e, s = spark.createDataFrame(rows, EDGE), spark.createDataFrame([("r", "hot", None)], SYM)
    assert [tuple(r) for r in K.heavy_keys(e, s).collect()] == [("r", "hot")]
    assert {r.target_qname: (r.edges, r.sources) for r in K.dependants(e).collect()}["hot"] == (150, 150)
    assert {r.target_qname: (r.edges, r.definitions) for r in K.dependants_per_target(e, s).collect()}["t1"] == (1, 0)
    assert K.heavy_keys(e.where("false"), s).count() == 0
    assert K.heavy_keys(e, s, 0.6).count() == 0 and K.heavy_keys(e, s, 150 / 252).count() == 1  # 252 ids, two of them without a key


def test_heavy_keys_join_two_aggregates(spark, monkeypatch):
    e = spark.createDataFrame([(i, "r", "s", f"t{i % 3}", "calls", 0) for i in range(30)], EDGE)
    s = spark.createDataFrame([("r", "t0", None), ("r", "t0", None), ("r", "t1", None)], SYM)
    plans = []

    def keep(df, label=""):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(K, "cut", keep)
    assert {r.target_qname for r in K.heavy_keys(e, s).collect()} == {"t0", "t1", "t2"}
    (plan,) = plans
    join = plan[plan.index("Join") :]
    assert join.count("Aggregate") == 2 and "removed_at" in join and "Aggregate" not in plan[: plan.index("Join")]


def test_repeats_do_not_make_a_key_heavy(spark):
    rows = [(1, "r", "s", "often", "calls", 0)] * 50 + [(i, "r", "s", "many", "calls", 0) for i in range(2, 12)]
    e, s = spark.createDataFrame(rows, EDGE), spark.createDataFrame([], SYM)
    assert [r.target_qname for r in K.heavy_keys(e, s, 0.5).collect()] == ["many"]
