"""What the operators of this subpackage share: tables, stored steps, prefix sums, slices."""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tactile.session import new_folder

# Words are runs of anything but ASCII white space; bytes.split() of Python cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANGE_ROWS = 200_000
BROADCAST_ROWS = 500_000
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, and the next
    stage's caches come on top of what it keeps. Where the C library has no such call, only Arrow does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    pieces = F.split(text, SPACE)
    blank = (F.element_at(pieces, 1) == "").cast("long")
    last = ((F.element_at(pieces, -1) == "") & (F.size(pieces) > 1)).cast("long")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(pieces) - blank - last).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal doc_id (null: of nothing) modulo ``divisor``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast only of a side whose counted ``rows`` are few."""
    return F.broadcast(df) if rows <= limit else df


def prefix_sums(df: DataFrame, group: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``new: value`` of ``values``, the sum of ``value`` over the rows before, in
    ``order`` within ``group``, on stored ranges of about ``RANGE_ROWS`` rows.

    One group may hold any share of the rows: a window never sees more than one range of it.
    Rows equal in all of ``order`` are in any order among themselves. ``group`` holds no nulls.
    """
    part = "_range"
    df = store(df, "prefix")
    n_ranges = max(1, math.ceil(df.count() / RANGE_ROWS))
    ranged = df.repartitionByRange(n_ranges, group, *order)
    # The bounds come from a sample: fix the numbers before they are used twice.
    ranged = store(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    along = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, part).agg(*[F.sum(v).alias(v) for v in set(values.values())])
    carries = totals.select(
        group,
        part,
        *[F.coalesce(F.sum(v).over(along), F.lit(0)).alias(f"_carry_{new}") for new, v in values.items()],
    )
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = {new: F.sum(v).over(inside) - F.col(v) + F.col(f"_carry_{new}") for new, v in values.items()}
    return ranged.join(carries, [group, part]).withColumns(own).drop(part, *[f"_carry_{n}" for n in values])


def text_slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of a binary column that are small enough to work on, with the row each starts at."""
    for a, b in slices([n or 0 for n in pc.binary_length(column).to_pylist()]):
        yield a, column.slice(a, b - a)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of rows of at most ``most`` bytes (or one row)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total + size > most and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
