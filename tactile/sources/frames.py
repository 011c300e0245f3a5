"""Frame sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tactile.operators.frames import FRAME_INTERVAL_MS

SCHEMA = "session_id string, ts timestamp, width int, height int, luma binary"


def read_frames(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_frames(
    spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """S9. Frames as they are written to a folder; ``files_per_trigger`` holds back the source
    when the analysis is slower."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def thin_stream(
    frames: DataFrame, delay: str = "10 seconds", interval_ms: int = FRAME_INTERVAL_MS, earliest: bool = True
) -> DataFrame:
    """S9. At most one frame per session and interval, the earliest, as ``frames.thin`` gives it: a
    frame comes out once no earlier one can come any more, so the order of arrival within ``delay``
    makes no difference. Of frames at one instant the smallest wins. Frames without pixels are skipped.
    The state of an open interval is one frame.

    Rows without ``session_id`` only move time on (``streaming.capture.closing_row``).

    Without ``earliest`` the first frame to arrive is taken, and at once. It keeps its event time, so
    ``live_capture`` can follow in the same query.
    """
    if not earliest:
        slot = F.floor(F.unix_millis("ts") / F.lit(interval_ms))
        rows = frames.where(F.col("luma").isNotNull()).withColumn("slot", slot).withWatermark("ts", delay)
        return rows.dropDuplicatesWithinWatermark(["session_id", "slot"]).drop("slot")
    keep = [c for c in frames.columns if c not in ("session_id", "ts")]
    # The instant is part of the condition, so that it is not checked before the watermark is.
    taken = F.when(F.col("luma").isNotNull() | F.col("session_id").isNull(), F.col("ts").isNotNull())
    slots = frames.withWatermark("ts", delay).where(taken).groupBy(
        F.window("ts", f"{interval_ms} milliseconds").alias("slot"), "session_id"
    )
    first = slots.agg(F.min(F.struct("ts", *keep)).alias("first"))
    return first.where(F.when(F.col("session_id").isNotNull(), F.col("slot.start").isNotNull())).select("session_id", "first.*")
