import random

from cambium.llm import handwritten as H

FUNCTION = "def move_{0}(rows, limit_{0}):\n    kept_{0} = [row for row in rows if row.size_{0} != limit_{0}]\n    total_{0} = sum(row.weight_{0} for row in kept_{0})\n    return kept_{0}, total_{0}\n\n"
SCHEMA = "doc_id bigint, repo string, path string, text string, lines int, reason string"


def judge(spark, rows):
    df = spark.createDataFrame([(i, r, p, t, 0, "clash") for i, (r, p, t) in enumerate(rows)], SCHEMA)
    return {(x.repo, x.path): x.reason for x in H.machine_made(df).collect()}


def code(*ids):
    return "import os\n\n" + "".join(FUNCTION.format(i) for i in ids)


def test_kinds(spark):
    rng = random.Random(1)
    numbers = "T = [\n" + "".join(f"    {rng.random() * 90:.6f}, {rng.random():.4f}, 0x{rng.randrange(255):02x},\n" for _ in range(80)) + "]\n"
    encoded = 'pub static K: &str = "' + "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(4000)) + '";\n'
    packed = "!function(){" + "".join(f"var a{i}=b.c(d,{i});if(a{i}!==e)return f(g);" for i in range(60)) + "}();\n"
    drawing = " ".join(f"L{rng.randrange(400)} {rng.randrange(400)}" for _ in range(500))
    rows = [
        ("r", "src/a.py", code(1, 2, 3)),
        ("r", "src/gen.py", "# Code generated by maker v1.2. DO NOT EDIT.\n" + code(4)),
        ("r", "src/tail.rs", "fn x() {}\n\n// <auto-generated>\n"),
        ("r", "api/rows_pb2.py", code(5)),
        ("r", "src/out.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nexports.a = 1;\n'),
        ("r", "src/fields.py", "".join(f"def get_{i}(m):\n    return m._fields[{i}]\n\n" for i in range(9))),
        ("r", "src/talk.py", '# The emitter writes "Code generated by maker. DO NOT EDIT." on top.\n' + code(6)),
        ("r", "src/hand.py", "# Not generated: written by hand.\n" + code(7)),
        ("r", "lib/generator/autogen_rules.py", code(8)),
        ("r", "data/numbers.py", numbers),
        ("r", "data/key.rs", encoded),
        ("r", "web/app.js", packed),
        ("r", "web/lib.min.js", "x()"),
        ("r", "src/icon.py", code(9) + f'SHAPE = "{drawing}"\n'),
        ("r", "src/icon2.py", f"def draw(p):\n    return p\n\n# shape {drawing}\n"),
        ("r", "vendor/tidy/util.py", code(20, 21, 22, 23)),
        ("r", "vendor_portal/main.py", code(24)),
        ("r", "src/banner.py", "# neat v1.2.3 | (c) the neat contributors | MIT\n\n" + code(30, 31, 32, 33)),
        ("r", "src/owner.py", "# Copyright the tidy authors\n# Licensed under the terms in the LICENSE file.\n" + code(34)),
        ("r", "src/billing/own.py", "# Copyright the billing authors\n" + code(35)),
        ("q", "src/deep/renamed.py", code(20, 21, 22, 23)[:-80]),
        ("q", "src/deep/renamed2.py", "# copied\n" + code(30, 31, 32, 33, 99)),
        ("q", "src/b.py", code(1, 2, 3)),  # our own module, copied by hand
        ("q", "src/partly.py", code(20, 41, 42, 43, 44)),
    ]
    assert judge(spark, rows) == {
        ("r", "src/gen.py"): "generated", ("r", "src/tail.rs"): "generated", ("r", "api/rows_pb2.py"): "generated", ("r", "src/out.js"): "generated", ("r", "src/fields.py"): "generated",
        ("r", "data/numbers.py"): "data", ("r", "data/key.rs"): "data", ("r", "web/app.js"): "minified", ("r", "web/lib.min.js"): "minified",
        ("r", "vendor/tidy/util.py"): "vendored", ("r", "src/banner.py"): "vendored", ("r", "src/owner.py"): "vendored", ("q", "src/deep/renamed.py"): "copied", ("q", "src/deep/renamed2.py"): "copied",
    }


def test_nulls_empty_repeats_and_long(spark):
    rows = [(None, "vendor/x/a.py", "x"), ("r", None, "x"), ("r", "", "x"), ("r", "vendor/x/a.py", None), ("r", "./vendor\\x/a.py", ""), ("r", "a.py", None), ("r", "b.unknown", "text"), ("r", "long.py", "def f(x):\n    return x\n" * 100_000)]
    assert judge(spark, rows) == {("r", "vendor/x/a.py"): "vendored"}
    assert judge(spark, []) == {}


def test_hand_written_keeps_columns(spark):
    df = spark.createDataFrame([(1, "r", "vendor/x/a.py", "x", 1, "k"), (2, "r", "a.py", "y = 1", 2, "k"), (3, "r", None, "prose", 2, "k")], SCHEMA)
    left = H.hand_written(df)
    assert left.columns == df.columns and [r.doc_id for r in left.collect()] == [2]


def test_banners_far_from_the_top(spark):
    licence = "".join(f"# Clause {i}: the terms of this licence hold for every copy of the work.\n" for i in range(60))
    rows = [
        ("r", "src/header.py", licence + "# Vendored from farlib 1.2\n\n" + code(50, 51, 52, 53)),
        ("r", "src/end.py", "".join(FUNCTION.format(i) for i in range(60, 80)) + "# This file is part of endlib.\n"),
        ("r", "vendor/tidy/util.py", code(20)),
        ("r", "src/owner.py", licence + "# Copyright the tidy authors\n" + code(34)),
        ("q", "src/copy.py", code(50, 51, 52, 53)),
        ("q", "src/own.py", licence + code(81, 82)),
    ]
    assert judge(spark, rows) == {("r", "src/header.py"): "vendored", ("r", "src/end.py"): "vendored", ("r", "vendor/tidy/util.py"): "vendored", ("r", "src/owner.py"): "vendored", ("q", "src/copy.py"): "copied"}


def test_tables_of_few_digits_and_small_ones(spark):
    names = [a + b + "istan" for a in ("afghan", "turkmen", "uzbek", "kyrgyz", "kazakh") for b in ("", "o", "u", "e", "i", "y")]
    rows = [
        ("r", "data/ranks.py", "RANKS = {\n" + "".join(f'    "{n}": {i % 9},\n' for i, n in enumerate(names * 3)) + "}\n"),
        ("r", "data/small.py", "T = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3]\n"),
        ("r", "data/blob.rs", 'pub static K: &str = "' + "aZ3k9QxB" * 20 + '";\n'),
        ("r", "src/limits.py", "WIDTH = 80\nHEIGHT = 24\nDEPTH = 3\n"),
        ("r", "src/code.py", code(1, 2)),
    ]
    assert judge(spark, rows) == {("r", "data/ranks.py"): "data", ("r", "data/small.py"): "data", ("r", "data/blob.rs"): "data"}


def test_short_copies_and_libraries_without_names(spark):
    short = "class Pool9:\n    least_connections_kept_open = 4\n"
    rows = [
        ("r", "external/lite/Pool9.py", short), ("q", "src/pools.py", "# copied\n" + short), ("q", "src/other.py", "class Pool8:\n    most_connections_kept_open = 9\n"),
        ("r", "vendor/foo.py", code(20, 21, 22, 23)), ("q", "vendor/foo.py", code(20, 21, 22, 23)), ("s", "vendor/bar.py", code(20, 21, 22, 23)), ("q", "src/renamed.py", code(20, 21, 22, 23)[:-80]),
        ("r", "vendor/one/__init__.py", "x = 1\n"), ("r", "vendor/two/__init__.py", "x = 1\n"), ("q", "src/idiom.py", "x = 1\n"),
        ("r", "vendor/one/empty.py", ""), ("q", "src/empty.py", ""),
    ]
    assert {k: v for k, v in judge(spark, rows).items() if v == "copied"} == {("q", "src/pools.py"): "copied", ("q", "src/renamed.py"): "copied"}
