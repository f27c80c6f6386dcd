from pyspark.sql import functions as F

from cambium.functions import signature as S


def test_params():
    assert S.top_level_params("(a: Map<string, int>, b = f(1, 2), ...c)") == ["a: Map<string", "int>", "b = f(1, 2)", "...c"]
    assert S.top_level_params("def (x, (y, z), [p, q], {r: 1, s: 2},)") == ["x", "(y, z)", "[p, q]", "{r: 1, s: 2}"]
    assert S.top_level_params("no parens") == S.top_level_params("(open") == S.top_level_params(None) == S.top_level_params("()") == []


def test_names_and_risk(spark):
    df = spark.createDataFrame([("(a: int, b?: str, ...c)", "(a, b, c, d=1)"), ("(a)", "(a)"), ("(a, b)", "(a)"), ("(a)", "(a, b?)")], "old string, new string")
    df = df.withColumns({"o": S.params_of("old"), "n": S.params_of("new")})
    rows = df.select(F.transform("o", S.param_name).alias("names"), S.signature_risk(F.col("o"), F.col("n")).alias("r"), S.signature_risk(F.col("o"), F.col("n"), True).alias("s")).collect()
    assert rows[0].names == ["a", "b", "c"]
    assert [(r.r, r.s) for r in rows] == [("high", "medium"), ("low", "low"), ("medium", "medium"), ("high", "medium")]


def test_annotations(spark):
    row = spark.range(1).select(S.annotation_candidates(F.lit("dict[str, app.Brain] | None")).alias("a"), S.member_names(F.lit("{ a: x; run(): y; b?: z }")).alias("m")).head()
    assert row.a == ["dict", "str", "app.Brain"] and sorted(row.m) == ["a", "b", "run"]
