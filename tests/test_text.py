from pyspark.sql import functions as F

from millrace.functions import hashing, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalize(spark):
    cases = {"A\tb\n C": "a b c", "": "", "  \n ": "", "a​b": "ab", "﻿x": "x", "É à": "é à", "a\r\n\r\nb": "a b", "x᠎y": "xy", "a b": "a b", None: None}
    for given, wanted in cases.items():
        assert one(spark, text.normalize, given) == wanted


def test_paragraphs(spark):
    assert one(spark, text.paragraphs, "One\r\ntwo\r\n \t\r\nThree\n\n\n\nfour") == ["one two", "three", "four"]
    assert one(spark, text.paragraphs, " \n ") == []


def test_windows(spark):
    assert one(spark, lambda t: text.shingles(t, 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda t: text.shingles(t, 4), "a b c") == []
    assert one(spark, lambda t: text.shingles(t, 0), "a b c") == []


def test_latex_and_math(spark):
    assert one(spark, text.strip_latex_comments, "a % b\nc \\% d") == "a \nc \\% d"
    assert one(spark, text.holds_math, "cost \\$5 and $6") is False
    assert one(spark, text.holds_math, "so $x$ holds") is True
    assert one(spark, text.holds_math, "\\begin{align*}") is True


def test_claims_numbers_calls(spark):
    assert one(spark, text.claims, "A b. C!  D? e") == ["A b.", "C!", "D?", "e"]
    assert one(spark, text.numbers, "1.5 and 20") == ["1.5", "20"]
    assert one(spark, text.parse_tool_call, "  run  a b ").asDict() == {"tool": "run", "args": "a b"}
    assert one(spark, text.parse_tool_call, "  ") is None
    assert one(spark, text.canonical_math, "$ \\left( 1 + 2 \\right) $") == "(1+2)"


def test_unsigned_hashes(spark):
    import hashlib

    row = spark.createDataFrame([("x y",)], "t string").select(hashing.seeded_hash(3, F.col("t")).alias("h")).first()
    assert row.h == hashlib.sha256((3).to_bytes(8, "little") + b"x y").digest()[:8][::-1].hex()
    stream = hashing.SplitMix(9)
    assert [stream.next() for _ in range(4)] == hashing.SplitMix(9).many(4).tolist()
    assert hashing.fnv1a64(b"") == hashing.FNV_OFFSET and hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    order = hashing.shuffle_order(50, 7, 1)
    assert sorted(order) == list(range(50)) and order.tolist() != hashing.shuffle_order(50, 7, 2).tolist()
