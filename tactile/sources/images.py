"""Image files: listing, decoding, upload checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tactile.operators import frames

# Suffixes of image files.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")

EMPTY_UPLOAD = "Empty image upload"
UNREADABLE = "preprocessing failed: the image cannot be decoded"


def has_image_suffix(path: Column) -> Column:
    """U-2. Case-insensitive membership in the list of suffixes."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)\z", 1)).isin(*EXTENSIONS)


def is_image_type(mime: Column) -> Column:
    """S8."""
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def image_name(path: Column, folder: str | None = None) -> Column:
    """P17. Name below ``folder`` if it is given (recursive listing), else the file name."""
    if folder is None:
        return F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(path, "^(file:/*(?=/))?" + re.escape(folder.rstrip("/")) + "/", "")


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """S1, O3. Image files of a folder with size and name, by path. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .drop("content")
    )
    return (
        files.where(has_image_suffix(F.col("path")))
        .withColumn("image", image_name(F.col("path"), folder if recursive else None))
        .orderBy("path")
    )


def decode_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """S2, S7. Decoded images in gray, with ``error`` set where a file could not be decoded.
    Formats are those of the image source of Spark."""
    source = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .where(has_image_suffix(F.col("image.origin")))
    )
    failed = F.col("height") <= 0
    return (
        frames.gray_images(source)
        .withColumn("image", image_name(F.col("origin"), folder if recursive else None))
        .withColumn("error", F.when(failed, UNREADABLE))
        .withColumn("luma", F.when(~failed, F.col("luma")))
    )


def check_uploads(uploads: DataFrame) -> DataFrame:
    """S7, S8. ``error`` for an upload that is empty or no image (columns ``mime``, ``content``)."""
    return uploads.withColumn(
        "error",
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, EMPTY_UPLOAD).when(
            ~is_image_type(F.col("mime")), "not an image"
        ),
    )
