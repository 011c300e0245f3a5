import unicodedata

from pyspark.sql import functions as F

from tactile.functions import text as txt


def values(spark, inputs, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_normalize_examples(spark):
    given = ["สวัสดีครับ", "  Hello   สวัสดี  ", "", None, "กิ่", "a\n\tb“c”", "éx", "Keep CASE 10%!"]
    expected = ["สวัสดีครับ", "Hello สวัสดี", "", "", "กิ่", "a b c", "x", "Keep CASE 10%!"]
    assert values(spark, given, txt.normalize) == expected


def test_normalize_is_idempotent(spark):
    given = ["é ǘ — x", "นุ้", " a  b ", "가"]
    once = values(spark, given, txt.normalize)
    assert values(spark, once, txt.normalize) == once


def test_quick_check_never_misses(spark):
    """All code points alone and after a base letter, and all pairs of Thai marks."""
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    marks = [chr(c) for c in range(0xE30, 0xE50)]
    texts = [chr(c) for c in points] + ["a" + chr(c) for c in points]
    texts += ["ก" + a + b + c for a in marks for b in marks for c in ("", "ฺ")]
    changing = [t for t in texts if unicodedata.normalize("NFC", t) != t]
    assert all(values(spark, changing, txt.may_change_under_nfc))
    assert values(spark, changing, txt.nfc) == [unicodedata.normalize("NFC", t) for t in changing]


def test_plain_thai_and_quotes_stay_in_the_engine(spark):
    given = ["สวัสดีครับ ยินดีต้อนรับสู่ระบบอักษรเบรลล์", "naïve — “quoted” …", "plain"]
    assert not any(values(spark, given, txt.may_change_under_nfc))


def test_strip_follows_both_white_space_sets(spark):
    given = ["\x1f a \x85", "﻿b ", "　c "]
    assert values(spark, given, txt.strip) == ["a", "﻿b", "c"]
    assert values(spark, given, txt.browser_trim) == ["\x1f a \x85", "b", "c"]


def test_strip_equals_python(spark):
    given = [chr(c) + "x" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    assert values(spark, given, txt.strip) == [g.strip() for g in given]


def test_blank_is_what_trimming_leaves_empty(spark):
    given = ["", " \x1f\x85", "\ufeff\u3000", "a", " \n", None]
    assert values(spark, given, txt.has_text) == [False, False, True, True, False, None]
    assert values(spark, given, txt.is_blank) == [True, False, True, False, True, True]


def test_second_engine_cleanup(spark):
    assert values(spark, [" a\r\n\nb  c\n d "], txt.second_engine_cleanup) == ["a b c d"]


def test_every_blank_of_browsers_collapses_and_nothing_else(spark):
    points = [p for p in range(1, 0x10000) if not 0xD800 <= p < 0xE000] + [0x1F600]
    rows = [(chr(p), f"a{chr(p)}{chr(p)}b") for p in points]
    df = spark.createDataFrame(rows, "c string, t string").where(txt.second_engine_cleanup(F.col("t")) == "a b")
    assert {r.c for r in df.select("c").collect()} == set(txt.BROWSER_SPACE)


def test_gate_band_snippet(spark):
    rows = [("x", 50.0), ("x", 49.9), ("", 99.0), ("x", None)]
    df = spark.createDataFrame(rows, "t string, c double")
    got = df.select(txt.accepted(F.col("t"), F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    bands = spark.createDataFrame([(80.0,), (79.9,), (50.0,), (49.0,)], "c double")
    got = bands.select(txt.confidence_band(F.col("c"))).collect()
    assert [r[0] for r in got] == ["high", "medium", "medium", "low"]
    assert values(spark, ["a" * 22, "ก" * 23], txt.snippet) == ["a" * 22, "ก" * 22 + "..."]


def test_outside_names_every_other_character(spark):
    chars = "a\tz9 éÿĀก่　😀"
    points = [p for p in [*range(1, 0x3100), *range(0x1F5F0, 0x1F610), 0x10FFFF] if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(chr(p),) for p in points], "c string")
    hit = {r.c for r in df.where(F.col("c").rlike(txt.outside(chars))).collect()}
    assert hit == {chr(p) for p in points} - set(chars)
    # Up to 255 no ranges: single characters become a table of bits.
    assert "-\\x{FF}" not in txt.outside("b") and "\\x{61}\\x{63}" in txt.outside("b")
