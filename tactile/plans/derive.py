"""Inputs of the operators, derived from the given tables by integer arithmetic.

The tables hold no boxes, frames or Thai text. Each recipe is row-local, covers whole tables and
whole texts, and is written so that other engines can follow it to the same numbers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tactile.operators.results import NO_WORDS

LATIN = "abcdefghijklmnopqrstuvwxyz"
THAI = "กขคงจชซดตถทนบปผพมยรลวสหอ่้"

WORDS_PER_ROW = 6
# Characters of text that are taken apart into boxes in one task: some 600,000 words.
PART_CHARS = 4_000_000
# Words of engines in an Arrow batch: some 10 MB.
BATCH_WORDS = 100_000
TEXT_IMAGE_WIDTH = 32
HOUR_MS = 3_600_000
FRAMES_START_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores before a step that multiplies them, when the scan gives fewer pieces
    than cores (a single small file). A scan of many splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def image_of(doc_id: Column) -> Column:
    return F.concat(F.lit("doc-"), doc_id)


def instant(ts: Column) -> Column:
    """Zoneless times of the tables as instants in UTC, whatever the zone of the session."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp").alias("ts")


def thai(text: Column) -> Column:
    """Latin letters as Thai letters and marks."""
    return F.translate(F.lower(text), LATIN, THAI)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def by_image(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    """Texts dealt by image before they are taken apart, so that nothing wider is dealt again. The
    number of parts goes by the length of all texts: a part stays small at any size of the table.
    Images ``without`` are left out, while there is one row of each: a join among the boxes makes one
    method of the generated code so long (over 8000 bytes) that the JVM does not compile it."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.agg(F.sum("n_chars")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    texts = docs.select("doc_id", "text", image_of(F.col("doc_id")).alias("image"))
    if without is not None:
        texts = texts.join(without, "image", "left_anti")
    return texts.repartition(int(parts), "image")


def _real(number: Column) -> Column:
    """Sums and products of whole numbers are exact as doubles, and a multiple faster than with the
    check for overflow that whole numbers get."""
    return number.cast("double")


def _sum_mod(doc_id: Column, a: int, i: Column, b: int, modulus: int) -> Column:
    return (_real(doc_id) * float(a) + _real(i) * float(b)).cast("long") % modulus


def _boxes(docs: DataFrame) -> DataFrame:
    """One box per word, six to a row of text, side by side: ``i, w`` and the corners (whole numbers
    as doubles), beside ``doc_id`` and ``image``. Some boxes are tall enough to touch the next row. A
    row is taken apart as a whole, so the places of its boxes need no window."""
    doc_id, row, n = F.col("doc_id"), F.col("row"), F.size("words")
    in_rows = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / F.lit(WORDS_PER_ROW)).cast("int")),
        lambda r: F.slice("words", r * WORDS_PER_ROW + 1, WORDS_PER_ROW),
    )
    rows = docs.select("doc_id", "image", words(F.col("text")).alias("words")).select(
        "doc_id", "image", F.posexplode(F.when(n > 0, in_rows)).alias("row", "six")
    )

    def width(w: Column, i: Column) -> Column:
        return _real(F.length(w)) * 10.0 + _real(i % 4)

    # The right edges of a row's boxes, each from the one before.
    rows = rows.withColumn("first", row * WORDS_PER_ROW)
    ends = [f"x1_{col}" for col in range(WORDS_PER_ROW)]
    for col, end in enumerate(ends):
        i = F.col("first") + col
        own = width(F.get("six", F.lit(col)), i)
        rows = rows.withColumn(end, F.col(ends[col - 1]) + own + _real(_sum_mod(doc_id, 7, i, 13, 9)) - 1.0 if col else own)
    i, col = F.col("i"), F.col("col")
    return (
        rows.select("doc_id", "image", "row", F.array(*ends).alias("ends"), F.posexplode("six").alias("col", "w"))
        .withColumn("i", (_real(row) * float(WORDS_PER_ROW) + _real(col)).cast("int"))
        .withColumn("x1", F.get("ends", col))
        .withColumn("y0", _real(row) * 40.0 + _real(col) * 4.0)
        .select(
            "doc_id",
            "image",
            "i",
            "w",
            (F.col("x1") - width(F.col("w"), i)).alias("x0"),
            "y0",
            "x1",
            (F.col("y0") + F.when(_sum_mod(doc_id, 1, i, 1, 29) == 0, 45.0).otherwise(30.0)).alias("y1"),
        )
    )


def detections(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    """Skewed polygons at twice the size; texts padded, and blank for one word in 37, or for all
    words of one image in 43. Nothing is found in images ``without``."""
    doc_id, i = F.col("doc_id"), F.col("i")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def corner(x: Column, y: Column) -> Column:
        return F.struct((x * 2.0).alias("x"), (y * 2.0).alias("y"))

    padded = F.concat(F.lit(" "), F.col("w"), F.when(i % 5 == 0, "\t").otherwise(""))
    return _boxes(by_image(spark, sf_dir, without)).select(
        "image",
        i.alias("det_idx"),
        F.array(
            corner(x0, y0 + 1.0), corner(x1 - 1.0, y0), corner(x1, y1 - 1.0), corner(x0 + 1.0, y1)
        ).alias("points"),
        F.when((_sum_mod(doc_id, 1, i, 1, 37) == 0) | (doc_id % 43 == 7), "  ").otherwise(padded).alias("text"),
        (_real(_sum_mod(doc_id, 31, i, 17, 65)) / F.lit(64.0)).alias("confidence"),
        F.lit(2.0).alias("scale"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images; one in 41 failed."""
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        image_of(doc_id).alias("image"),
        F.when(doc_id % 41 == 0, F.concat(F.lit("cannot decode "), doc_id)).alias("error"),
    )


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of two engines: texts blank or missing, confidences missing, zero or fractional;
    ``listed`` says whether the engine gives its words, which are those of ``engine_words``."""
    doc_id = F.col("doc_id")
    docs = documents(spark, sf_dir)
    image = image_of(doc_id).alias("image")
    first = docs.where(doc_id % 5 != 0).select(
        image,
        F.lit(1).alias("engine_rank"),
        F.when(doc_id % 3 == 0, " \t ").otherwise(F.col("text")).alias("text"),
        F.when(doc_id % 7 != 0, (doc_id % 101).cast("double")).alias("confidence"),
        (doc_id % 2 == 0).alias("listed"),
    )
    second = docs.where(doc_id % 4 != 1).select(
        image,
        F.lit(2).alias("engine_rank"),
        F.concat(F.lit("\n "), F.col("text"), F.lit(" \r\n")).alias("text"),
        F.when(doc_id % 6 == 0, F.lit(0.0)).otherwise(doc_id % 97 + F.lit(0.5)).alias("confidence"),
        F.lit(True).alias("listed"),
    )
    return first.unionByName(second)


def engine_words() -> Column:
    """The bare words of a row of ``engine_results``, null where the engine gives none."""
    return F.when(F.col("listed"), words(F.col("text")))


def engine_word(w: Column, i: Column) -> Column:
    """The i-th word as the engine gives it: with and without confidence and area."""
    left = i % WORDS_PER_ROW * 100
    top = F.floor(i / F.lit(WORDS_PER_ROW)) * 40
    right = left + F.when(i % 11 == 0, 0).otherwise(F.length(w) * 10)
    corners = {"x0": left, "y0": top, "x1": right, "y1": top + 30}
    return F.struct(
        F.concat(F.lit(" "), w).alias("text"),
        F.struct(*[v.cast("double").alias(c) for c, v in corners.items()]).alias("bbox"),
        F.when(i % 7 == 0, F.lit(0.0))
        .when(i % 5 != 0, (i % 101).cast("double"))
        .alias("confidence"),
    )


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bare words to words in a few rows at a time, so that a batch stays small."""
    for batch in batches:
        ends = np.cumsum(_sizes(batch.column("words")))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + BATCH_WORDS, "right")))
            part = batch.slice(first, last - first)
            yield part.set_column(part.schema.get_field_index("words"), "words", _listed(part.column("words")))
            first = last


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _listed(bare: pa.ListArray) -> pa.ListArray:
    """``engine_word`` for each entry of some lists of words; no list becomes an empty one."""
    sizes = _sizes(bare)
    ends = np.cumsum(sizes)
    i = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
    w = bare.flatten()
    left, top = i % WORDS_PER_ROW * 100.0, i // WORDS_PER_ROW * 40.0
    right = left + np.where(i % 11 == 0, 0, pc.utf8_length(w).to_numpy(zero_copy_only=False) * 10.0)
    corners = [pa.array(v, pa.float64()) for v in (left, top, right, top + 30.0)]
    confidence = pa.array(np.where(i % 7 == 0, 0.0, i % 101), mask=(i % 7 != 0) & (i % 5 == 0))
    word = pa.StructArray.from_arrays(
        [
            pc.binary_join_element_wise(" ", w, ""),
            pa.StructArray.from_arrays(corners, ["x0", "y0", "x1", "y1"]),
            confidence,
        ],
        ["text", "bbox", "confidence"],
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), word)


def with_engine_words(rows: DataFrame) -> DataFrame:
    """``engine_word`` for all entries of the column ``words``, in Arrow batches: a lambda over a list
    is not compiled, and takes several times as long for a word of seven values."""
    kinds = [f"`{f.name}` {f.dataType.simpleString() if f.name != 'words' else NO_WORDS}" for f in rows.schema]
    return rows.mapInArrow(_with_words, ", ".join(kinds))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames, one session per label, 300 ms apart by row number of the table."""
    pixel = lambda e: F.least(
        F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))
    ).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label-"), F.col("label")).alias("session_id"),
        F.timestamp_millis(F.col("vec_id") * 300 + FRAMES_START_MS).alias("ts"),
        "vec_id",
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.transform("embedding", pixel).alias("luma"),
    )


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a gray image of 32 pixels a row, a pixel per character."""
    text, rows = F.col("text"), F.col("height")
    return (
        documents(spark, sf_dir)
        .withColumn("width", F.lit(TEXT_IMAGE_WIDTH))
        .withColumn("height", F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(TEXT_IMAGE_WIDTH))).cast("int"))
        .select(
            "doc_id",
            "width",
            "height",
            F.transform(
                F.split(F.rpad(text, rows * TEXT_IMAGE_WIDTH, " "), ""),
                lambda c: F.least(F.lit(255), F.ascii(c) * 2),
            ).alias("luma"),
        )
    )


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture session per user: focus from the value, flags from number and type."""
    return event_flags_of(table(spark, sf_dir, "events"))


def event_flags_of(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return events.select(
        F.col("user_id").alias("session_id"),
        instant(F.col("ts")),
        "event_id",
        (F.col("value") * 16).alias("focus"),
        (F.col("event_type") != "signup").alias("has_document"),
        (n % 13 != 0).alias("lock_tl"),
        (n % 11 != 0).alias("lock_tr"),
        (n % 17 != 0).alias("lock_bl"),
        ((n % 19 != 0) & (n % 13 != 0)).alias("lock_br"),
        (n % 7 != 0).alias("stable"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per event; an error in three is forced."""
    return event_messages_of(table(spark, sf_dir, "events"))


def event_messages_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"),
        instant(F.col("ts")),
        "event_id",
        F.col("event_type").alias("text"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("forced"),
    )
