"""Braille pages as rows. Everything here is narrow: no operator but the audits shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tactile.functions import braille


def paginate(df: DataFrame, text: str = "text", cells: int = braille.CELLS) -> DataFrame:
    """F6, A17, F11, W3. One row per page, the other columns of ``df`` kept."""
    keep = [c for c in df.columns if c != text]
    n_chars, n_pages, idx = F.col("n_chars"), F.col("n_pages"), F.col("page_idx")
    start, end = F.col("start_char"), F.col("end_char")
    return (
        # The length is taken before the text is taken apart, not once more for every page.
        df.withColumn("n_chars", F.length(text))
        .select(
            *keep,
            "n_chars",
            F.posexplode(braille.chunks(F.col(text), cells)).alias("page_idx", "chunk"),
        )
        .withColumn("n_pages", braille.page_count(n_chars, cells))
        .withColumn("start_char", braille.start_char(idx, n_chars, cells))
        .withColumn("end_char", braille.end_char(idx, n_chars, cells))
        .withColumns(
            {
                "has_prev": braille.has_previous(idx),
                "has_next": braille.has_next(idx, n_pages),
                "page_label": braille.page_label(idx, n_pages),
                "range_label": braille.range_label(start, end),
            }
        )
    )


def encode_pages(pages: DataFrame) -> DataFrame:
    """J2, F7, F10, A16. Adds the glyphs of the fourteen cells and the number of raised pins."""
    encoded = pages.withColumn("_cells", braille.page_cells(F.col("chunk")))
    return encoded.withColumns({c: F.col(f"_cells.{c}") for c in ("glyphs", "raised")}).drop("_cells")


def pin_pages(pages: DataFrame) -> DataFrame:
    """F9. Adds the 84 pins of each page."""
    return pages.withColumn("pins", braille.page_pins(F.col("chunk")))


def cell_rows(pages: DataFrame) -> DataFrame:
    """F5, F7, F8, F12. One row per cell of each page. A page is encoded as a whole, before its
    cells are exploded; the rest is computed by generated code."""
    keep = [c for c in pages.columns if c not in ("chunk", "page_label", "range_label")]
    padded = F.rpad("chunk", braille.CELLS, " ")
    label = braille.cell_label(
        F.col("cell_idx"), F.col("chunk"), F.col("start_char"), F.col("n_chars")
    )
    places = F.array(*[F.lit(i) for i in range(braille.CELLS)])
    at = F.col("cell_idx") + 1
    return (
        pages.withColumns({"_padded": padded, "_glyphs": braille.page_cells(F.col("chunk"))["glyphs"]})
        .select(*keep, "chunk", "_padded", "_glyphs", F.explode(places).alias("cell_idx"))
        .withColumns({"ch": F.substring("_padded", at, F.lit(1)), "glyph": F.substring("_glyphs", at, F.lit(1))})
        .drop("_padded", "_glyphs")
        .withColumn("mask", braille.mask(F.col("glyph")))
        .withColumns(
            {
                "dots": braille.dots(F.col("mask")),
                "dots_bool": braille.dots_bool(F.col("mask")),
                "label": label,
            }
        )
        .drop("chunk")
    )


def page_at(
    df: DataFrame,
    page_idx: Column,
    text: str = "text",
    kept: bool = False,
    into: tuple[str, str] = ("page_idx", "chunk"),
) -> DataFrame:
    """O4. Adds the wanted page of each text and its index, without building the other pages;
    ``kept`` follows the rule for replaced text."""
    n_pages = braille.page_count(F.length(text))
    choose = braille.kept_page if kept else braille.clamp_page
    return (
        df.withColumn("n_pages", n_pages)
        .withColumn(into[0], choose(page_idx, F.col("n_pages")))
        .withColumn(into[1], braille.chunk_at(F.col(text), F.col(into[0])))
    )


def dictionary(spark) -> DataFrame:
    """The dictionary as a table of its fixed entries."""
    rows = [
        (ch, [int(d) for d in dots], braille.MASKS[ch], chr(braille.BLANK_CODE + braille.MASKS[ch]))
        for ch, dots in braille.DOTS.items()
    ]
    return spark.createDataFrame(rows, "ch string, dots array<int>, mask int, glyph string")


def character_usage(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each character. Counts are combined before the shuffle, so that a frequent
    character is no hot key."""
    return (
        df.select(F.explode(braille.characters(F.col(text))).alias("ch"))
        .where(F.col("ch") != "")
        .groupBy("ch")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def shared_patterns(usage: DataFrame) -> DataFrame:
    """A18. Patterns that stand for more than one character of the texts. The groups hold
    dictionary characters only, so their size is bounded by the dictionary."""
    # Tied to the count, so that the filter is not moved below it, onto every single character.
    mask = F.when(F.col("uses") > 0, braille.mask(braille.encode(F.col("ch"))))
    known = usage.withColumn("mask", mask).where("mask > 0")
    return (
        known.groupBy("mask")
        .agg(
            F.array_sort(F.collect_set("ch")).alias("chars"),
            F.sum("uses").alias("uses"),
        )
        .where(F.size("chars") > 1)
        .withColumn("glyph", braille.glyph(F.col("mask")))
    )
