"""Two recognisers of whole results, the second one only where the first gave nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tactile.functions import text as txt
from tactile.operators.calibration import ERROR_PREFIX
from tactile.operators.results import NO_WORDS, choose_engine
from tactile.session import new_folder

RESULT = f"image string, engine_rank int, text string, confidence double, words {NO_WORDS}, error string"
_BBOX = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_WORD = pa.struct([("text", pa.string()), ("bbox", _BBOX), ("confidence", pa.float64())])
_ARROW = pa.schema(
    [
        ("image", pa.string()), ("engine_rank", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()),
        ("words", pa.list_(_WORD)), ("error", pa.string()),
    ]
)


@dataclass(frozen=True)
class Engine:
    """``load`` makes the model, once per Python worker; ``read(model, row)`` returns a dict with any of
    ``text``, ``confidence`` (0 to 100) and ``words`` (dicts of ``text``, ``bbox``, ``confidence``)."""

    load: Callable[[], object]
    read: Callable[[object, dict], dict]


def run_engine(images: DataFrame, engine: Engine, rank: int) -> DataFrame:
    """A row per image: its result, or ``error``. Stored, so that an image is read once whatever
    follows."""
    key = uuid.uuid4().hex

    def one(row: dict) -> dict:
        from tactile.sources import _models

        out = {"image": row["image"], "engine_rank": rank}
        try:
            found = engine.read(_models.model(key, engine.load), row)
            return out | {c: found.get(c) for c in ("text", "confidence", "words")}
        except Exception as failure:
            return out | {"error": f"OCR failed: {failure}"}

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([one(batch.slice(i, 1).to_pylist()[0])], schema=_ARROW)

    folder = new_folder(images.sparkSession, f"engine-{rank}")
    images.mapInArrow(batches, RESULT).write.parquet(folder)
    return images.sparkSession.read.schema(RESULT).parquet(folder)


def cascade(images: DataFrame, first: Engine, second: Engine) -> DataFrame:
    """J5, S7. ``choose_engine`` with ``note``, over results made on demand: ``second`` runs on the images
    for which ``first`` failed or found no text, and on no other. ``images`` has ``image``, once each,
    and what the engines read. ``note`` says why an image has no result: the failure of the second
    engine, or of the first if the second found nothing."""
    one = run_engine(images, first, 1)
    done = one.where(F.col("error").isNull() & ~txt.is_blank(F.col("text"))).select("image")
    two = run_engine(images.join(done, "image", "left_anti"), second, 2)
    read = one.unionByName(two).where(F.col("error").isNull()).drop("error")
    failed = [
        df.where(F.col("error").isNotNull()).select("image", F.col("error").alias(name))
        for df, name in ((one, "first_error"), (two, "second_error"))
    ]
    chosen = choose_engine(images, read)
    for df in failed:
        chosen = chosen.join(df, "image", "left")
    reason = F.coalesce("second_error", "first_error")
    failure = txt.is_blank(F.col("text")) & reason.isNotNull()
    return chosen.withColumn("note", F.when(failure, F.concat(F.lit(ERROR_PREFIX), reason)).otherwise("")).drop(
        "first_error", "second_error"
    )
