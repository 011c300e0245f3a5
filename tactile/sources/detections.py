"""Raw detections: reader and the hook for a recogniser."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "image string, det_idx int, points array<struct<x:double,y:double>>, "
    "text string, confidence double"
)
RECOGNISED = SCHEMA + ", error string"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema(
    [
        ("image", pa.string()), ("det_idx", pa.int32()), ("points", pa.list_(_POINT)),
        ("text", pa.string()), ("confidence", pa.float64()), ("error", pa.string()),
    ]
)


@dataclass(frozen=True)
class Batch:
    """How many images one call of a recogniser gets: both bounds hold, but for a single image."""

    rows: int = 16
    bytes: int = 64 << 20


def _size(row: dict) -> int:
    return sum(len(v) for v in row.values() if isinstance(v, (bytes, bytearray, str)))


def bounded(rows: Iterator[dict], batch: Batch) -> Iterator[list[dict]]:
    held: list[dict] = []
    total = 0
    for row in rows:
        size = _size(row)
        if held and (len(held) >= batch.rows or total + size > batch.bytes):
            yield held
            held, total = [], 0
        held.append(row)
        total += size
    if held:
        yield held


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """S3. Detections written by an earlier run."""
    return spark.read.schema(SCHEMA).parquet(path)


def recognize(
    images: DataFrame,
    load: Callable[[], object],
    read: Callable[[object, dict], list],
    fallback: Callable[[object, dict], list] | None = None,
    name: str | None = None,
    batch: Batch | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """U1, S7. Detections of each image by a recogniser of the user.

    ``load`` makes the model, once per Python worker: calls that give the same ``name`` share it,
    a call without a name has its own. ``read(model, row)`` returns tuples
    (points, text, confidence 0..1) for a row given as a dict, and ``fallback`` is tried when it
    fails. ``images`` has ``image`` and whatever ``read`` needs. An image that fails becomes one
    row with ``error``, without detections; the run goes on. The result is lazy: write it if it is
    used more than once (operators that must measure groups do so themselves).

    With ``batch``, ``read`` gets a list of rows, of consecutive images of a partition, and returns a
    list of results in their order. If that fails, or is not one result an image, its images are read
    one by one, each with its own fallback, so an image that cannot be read fails alone. ``fallback``
    gets one row either way. ``profile`` says what the stage needs, such as GPUs of its tasks.
    """
    key = name or uuid.uuid4().hex

    def single(loaded: object, row: dict) -> list:
        try:
            return read(loaded, [row])[0] if batch else read(loaded, row)
        except Exception:
            if fallback is None:
                raise
            return fallback(loaded, row)

    def rows_of(row: dict, found: list) -> list[dict]:
        return [
            {
                "image": row["image"],
                "det_idx": idx,
                "points": [{"x": float(x), "y": float(y)} for x, y in points],
                "text": text,
                "confidence": float(confidence),
            }
            for idx, (points, text, confidence) in enumerate(found)
        ]

    def one(row: dict) -> list[dict]:
        from tactile.sources import _models

        try:
            return rows_of(row, single(_models.model(key, load), row))
        except Exception as failure:
            return [{"image": row["image"], "error": f"OCR failed: {failure}"}]

    def together(rows: list[dict]) -> list[dict]:
        from tactile.sources import _models

        try:
            found = read(_models.model(key, load), rows)
            if len(found) != len(rows):
                raise ValueError("not one result an image")
            return [out for row, own in zip(rows, found) for out in rows_of(row, own)]
        except Exception:
            return [out for row in rows for out in one(row)]

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row at a time leaves Arrow, so what is held is what one call gets.
        rows = (part.slice(i, 1).to_pylist()[0] for part in incoming for i in range(part.num_rows))
        for part in bounded(rows, batch or Batch(rows=1)):
            out = together(part) if batch and len(part) > 1 else [out for row in part for out in one(row)]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return images.mapInArrow(batches, RECOGNISED, profile=profile)
