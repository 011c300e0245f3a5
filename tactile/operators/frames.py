"""Measures and decisions on frames and still images.

Frames are rows of ``session_id, ts, width, height, luma``. Everything is local to a row except
the motion, which needs the frame before (one ordered pass per session).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tactile.functions import geometry, pixels
from tactile.operators.ordered import Bound, Scan, by_size

# Focus bands, presence of a document, corner density, motion.
FOCUS_BLURRY = 80.0
FOCUS_SHARP = 160.0
MIN_STROKES = 35
MIN_CONTRAST = 18
CORNER_DENSITY = 0.012
MOTION_LIMIT = 24.0
# Tiles with content, spread of their means, high quality, denoising.
CONTENT_STD = 15.0
LIGHTING_SPREAD = 55.0
QUALITY_STD = 40.0
QUALITY_LAPLACIAN = 15.0
DENOISE_STRENGTH = 6
# Fixed value: cadence of the frame source.
FRAME_INTERVAL_MS = 300

# Frames are wide: 100,000 of 120 x 160 pixels are about 2 GB.
FRAMES = Bound(max_rows=100_000, chunk_rows=50_000)

CORNERS = list(pixels.ZONES)
IMAGE = ("luma", "width", "height")


# ------------------------------------------------------------------- per frame
def focus_score(luma="luma", width="width", height="height") -> Column:
    """A11. Rounded to a tenth, never below 0, and 0 where there is nothing to measure."""
    variance = pixels.laplacian_variance(luma, width, height)
    tenth = geometry.round_up_half(variance * F.lit(10.0)) / F.lit(10.0)
    return F.coalesce(F.greatest(F.lit(0.0), tenth), F.lit(0.0))


def focus_band(
    focus: Column, blurry: float = FOCUS_BLURRY, sharp: float = FOCUS_SHARP
) -> Column:
    """P13."""
    return F.when(focus < blurry, "blurry").when(focus < sharp, "adjusting").otherwise("sharp")


def _zone_pixels(zone: str, width: Column, height: Column) -> Column:
    """Divisor of a density: one less per side than the inclusive zone holds, at least 1."""
    fx0, fx1, fy0, fy1 = (F.lit(f) for f in pixels.ZONES[zone])
    wide = geometry.round_up_half(width * fx1) - geometry.round_up_half(width * fx0)
    tall = geometry.round_up_half(height * fy1) - geometry.round_up_half(height * fy0)
    return F.greatest(F.lit(1), wide * tall)


def frame_metrics(frames: DataFrame) -> DataFrame:
    """T1 without motion: A11, A12, A13. Pixels stay in the row for whoever needs them."""
    width, height = F.col("width"), F.col("height")
    s = F.col("_strokes")
    rows = frames.withColumn("focus", focus_score()).withColumn(
        "_strokes", pixels.stroke_counts(*IMAGE)
    )
    densities = {
        f"d_{z}": s[z] / _zone_pixels(z, width, height).cast("double") for z in CORNERS
    }
    return (
        rows.withColumn("contrast", s["max_luma"] - s["min_luma"])
        .withColumn("strokes", s["total"])
        .withColumns(densities)
        .drop("_strokes")
    )


def frame_motion(
    frames: DataFrame,
    order: list[str] | None = None,
    bound: Bound = FRAMES,
) -> DataFrame:
    """A14, J3. Mean luma difference to the frame before in the session, 0 for the first."""
    order = order or ["ts"]
    scans = {"_previous": Scan("prev", F.col("luma"))}
    rows = by_size(
        frames,
        ["session_id"],
        lambda df, how: how.scan(df, ["session_id"], order, scans),
        bound,
    )
    motion = pixels.mean_difference(F.col("luma"), F.col("_previous"))
    return rows.withColumn("motion", F.coalesce(motion, F.lit(0.0))).drop("_previous")


def frame_flags(
    metrics: DataFrame,
    min_strokes: int = MIN_STROKES,
    min_contrast: int = MIN_CONTRAST,
    corner_density: float = CORNER_DENSITY,
    motion_limit: float = MOTION_LIMIT,
    focus_limits: tuple[float, float] | None = None,
) -> DataFrame:
    """P13-P16, A15. Decisions from the metrics of a frame. Without a document no corner is locked
    and the focus counts as 0."""
    present = (F.col("strokes") >= min_strokes) & (F.col("contrast") >= min_contrast)
    there = F.col("has_document")
    locked = {f"lock_{z}": there & (F.col(f"d_{z}") >= corner_density) for z in CORNERS}
    count = sum((F.col(f"lock_{z}").cast("int") for z in CORNERS), F.lit(0))
    return (
        metrics.withColumn("has_document", F.coalesce(present, F.lit(False)))
        .withColumns({name: F.coalesce(flag, F.lit(False)) for name, flag in locked.items()})
        .withColumns(
            {
                "locked": count,
                "alignment": alignment(count),
                "focus_band": focus_band(F.when(there, F.col("focus")).otherwise(0.0), *(focus_limits or ())),
                "stable": F.col("motion") < motion_limit,
            }
        )
    )


def alignment(locked: Column) -> Column:
    """A15. Locked corners of four, in percent."""
    return geometry.round_up_half(locked / F.lit(4.0) * F.lit(100.0)).cast("int")


def thin(
    frames: DataFrame, interval_ms: int = FRAME_INTERVAL_MS, keep: list[str] | None = None
) -> DataFrame:
    """S9 in batch. The first frame of each interval of a session. Combined before the shuffle,
    and keyed by session and interval, so a long session is spread."""
    keep = keep or [c for c in frames.columns if c not in ("session_id", "ts")]
    slot = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / F.lit(interval_ms))
    # Of frames at the same instant the smallest wins, so that the choice is repeatable.
    first = F.min(F.struct("ts", *keep))
    return (
        frames.groupBy("session_id", slot.alias("slot"))
        .agg(first.alias("f"))
        .select("session_id", "slot", "f.*")
    )


# ------------------------------------------------------------------ still images
def lighting(
    images: DataFrame,
    content_std: float = CONTENT_STD,
    spread: float = LIGHTING_SPREAD,
) -> DataFrame:
    """A8, A9. Whether tile means are too far apart; tiles with content decide if there are at
    least two of them, else all tiles."""
    means = F.transform(F.col("tiles"), lambda t: t["mean"])
    content = F.transform(
        F.filter(F.col("tiles"), lambda t: t["std"] >= content_std), lambda t: t["mean"]
    )
    used = F.col("_used")
    return (
        images.withColumn("tiles", pixels.tile_stats(*IMAGE))
        .withColumn("content_tiles", F.size(content))
        .withColumn("_used", F.when(F.size(content) >= 2, content).otherwise(means))
        .withColumn("spread", F.when(F.size(used) >= 2, F.array_max(used) - F.array_min(used)))
        .withColumn("uneven", F.coalesce(F.col("spread") > spread, F.lit(False)))
        .drop("_used")
    )


def quality(
    images: DataFrame,
    min_std: float = QUALITY_STD,
    min_laplacian: float = QUALITY_LAPLACIAN,
) -> DataFrame:
    """A10. Contrast and sharpness of the whole image."""
    s = F.col("_stats")
    good = (s["std"] >= min_std) & (s["laplacian"] >= min_laplacian)
    return (
        images.withColumn("_stats", pixels.global_stats(*IMAGE))
        .withColumn("std", s["std"])
        .withColumn("laplacian", s["laplacian"])
        .withColumn("high_quality", F.coalesce(good, F.lit(False)))
        .drop("_stats")
    )


def enhancement_plan(judged: DataFrame, source: Column) -> DataFrame:
    """P12. Which filters an image needs, from its lighting, quality and source."""
    denoise = source == "camera"
    return judged.withColumns(
        {
            "needs_threshold": F.col("uneven") & ~F.col("high_quality"),
            "needs_denoise": denoise,
            "denoise_strength": F.when(denoise, DENOISE_STRENGTH).otherwise(0),
        }
    )


def resize_plan(images: DataFrame) -> DataFrame:
    """P11. Scale and new size of each image."""
    scale = F.col("scale")
    return images.withColumn(
        "scale", geometry.resize_scale(F.col("width"), F.col("height"))
    ).withColumns(
        {
            "new_width": geometry.resized(F.col("width"), scale),
            "new_height": geometry.resized(F.col("height"), scale),
        }
    )


def gray_images(decoded: DataFrame) -> DataFrame:
    """F13 for rows of Spark's image source: origin, width, height and luma bytes. A file that
    could not be decoded keeps its row with null pixels."""
    image = F.col("image")
    return decoded.select(
        image["origin"].alias("origin"),
        image["width"].alias("width"),
        image["height"].alias("height"),
        pixels.gray_of_bgr(image["data"], image["nChannels"]).alias("luma"),
    )
