from pyspark.sql import functions as F

from tactile.functions import braille
from tactile.operators import pages

SAMPLE = "สวัสดีครับ ยินดีต้อนรับสู่ระบบอักษรเบรลล์"


def paged(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pages.paginate(df)


def dots_of(spark, ch):
    row = spark.createDataFrame([(ch,)], "c string").select(
        braille.dots(braille.mask(braille.encode(F.col("c")))).alias("d")
    )
    return "".join(map(str, row.first()["d"]))


def test_dictionary_size():
    patterns = set(braille.MASKS.values())
    assert len(braille.DOTS) == 127 and len(patterns) == 45
    assert sum(0xE00 <= ord(c) <= 0xE7F for c in braille.DOTS) == 64


def test_known_patterns(spark):
    known = {
        "ท": "23456", "ห": "125", "่": "35", "้": "256", "๊": "2356",
        "์": "356", "A": "1", "B": "12", "ก": "1245", "า": "345", " ": "", "⠾": "", "!": "",
    }
    assert {ch: dots_of(spark, ch) for ch in known} == known


def test_case_fallback_covers_every_code_point():
    found = {}
    for c in range(0x110000):
        ch = chr(c)
        if ch not in braille.DOTS:
            for other in (ch.upper(), ch.lower()):
                if other in braille.DOTS:
                    found[ch] = braille.MASKS[other]
                    break
    assert found == {ch: braille.LOOKUP[ch] for ch in braille.CASE_FALLBACK}


def test_glyph_of_dots(spark):
    row = spark.range(1).select(braille.glyph(F.lit(0b111110)).alias("g")).first()
    assert row["g"] == "⠾"


def test_chunk_sizes(spark):
    got = paged(spark, "", "12345678901234", "12345678901234ABCDEFGHIJKLMNOP").orderBy("doc_id", "page_idx")
    assert [(r.doc_id, len(r.chunk), r.n_pages, r.start_char, r.end_char) for r in got.collect()] == [
        (0, 0, 1, 0, 0), (1, 14, 1, 1, 14), (2, 14, 3, 1, 14), (2, 14, 3, 15, 28), (2, 2, 3, 29, 30),
    ]


def test_pages_concatenate_to_the_text(spark):
    texts = [SAMPLE, "a\nb" * 30, "😀x" * 20]
    rows = paged(spark, *texts).orderBy("doc_id", "page_idx").collect()
    for i, text in enumerate(texts):
        assert "".join(r.chunk for r in rows if r.doc_id == i) == text


def test_raised_pins_equal_dots(spark):
    encoded = pages.encode_pages(paged(spark, SAMPLE, "Hello World 123", ""))
    for r in encoded.collect():
        assert len(r.glyphs) == 14
        assert r.raised == sum(len(braille.DOTS.get(c, "")) for c in r.chunk)


def test_pins_follow_the_order(spark):
    row = pages.pin_pages(paged(spark, "ท")).first()
    assert row["pins"] == "011111" + "0" * 78
    vector = paged(spark, "a").select(
        braille.pin_vector(braille.fill_cells(braille.encode(F.col("chunk")))).alias("v")
    ).first()["v"]
    assert vector == [True] + [False] * 83


def test_cells_and_labels(spark):
    rows = pages.cell_rows(paged(spark, "12345678901234ab")).where("page_idx = 1").orderBy("cell_idx").collect()
    assert [r.label for r in rows[:3]] == ["CELL #1 [15]", "CELL #2 [16]", "CELL #3"]
    assert rows[1].dots == [1, 2] and rows[1].dots_bool == [True, True, False, False, False, False]
    assert rows[13].ch == " " and rows[13].glyph == braille.BLANK


def test_page_at(spark):
    df = spark.createDataFrame([(i, "x" * 30) for i in (-2, 1, 7)], "i int, text string")
    assert [r.page_idx for r in pages.page_at(df, F.col("i")).orderBy("i").collect()] == [0, 1, 2]
    kept = pages.page_at(df, F.col("i"), kept=True).orderBy("i").collect()
    assert [(r.page_idx, len(r.chunk)) for r in kept] == [(0, 14), (1, 14), (0, 14)]


def test_shared_patterns(spark):
    usage = pages.character_usage(spark.createDataFrame([("ชดดx",), ("a1!",)], "text string"))
    got = {tuple(r.chars): r.uses for r in pages.shared_patterns(usage).collect()}
    assert got == {("1", "a"): 2, ("ช", "ด"): 3}


def test_dictionary_table(spark):
    assert pages.dictionary(spark).where("size(dots) = bit_count(mask)").count() == 127


def test_a_batch_of_pages_equals_the_columns(spark):
    """Null, empty, unknown, astral, composed and overlong chunks, encoded together."""
    chunks = [None, "", "a", "กข่ Z9#", "😀áé\n", "ıſK", " " * 14, "abcdefghijklmn", "x" * 20, None]
    df = spark.createDataFrame(list(enumerate(chunks)), "n int, chunk string").coalesce(1)
    glyphs = braille.fill_cells(braille.encode(F.col("chunk")))
    expected = df.select("n", glyphs.alias("g"), braille.raised_pins(glyphs).alias("r"), braille.pin_string(glyphs).alias("p"))
    cells = braille.page_cells(F.col("chunk"))
    actual = df.select("n", cells["glyphs"], cells["raised"], braille.page_pins(F.col("chunk")))
    assert [tuple(r) for r in actual.orderBy("n").collect()] == [tuple(r) for r in expected.orderBy("n").collect()]
