"""Neighbourhood measures of gray images, as Arrow UDFs.

Only what looks at neighbouring pixels is here: numpy over Arrow buffers costs about a thirtieth
of array lambdas on a 120 x 160 frame. Thresholds, flags and bands are ordinary columns in
``operators.frames``. Pixels are ``binary`` (one byte each, row by row) or ``array<int>``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

# The four corner zones as fractions of width and height (x0, x1, y0, y1).
ZONES = {
    "tl": (0.08, 0.38, 0.08, 0.40),
    "tr": (0.62, 0.92, 0.08, 0.40),
    "bl": (0.08, 0.38, 0.60, 0.92),
    "br": (0.62, 0.92, 0.60, 0.92),
}
# Least stroke threshold and its share of the contrast.
MIN_STROKE_THRESHOLD = 16.0
STROKE_SHARE = 0.15


def _rows(pixels: pa.Array) -> list[np.ndarray | None]:
    """One flat numpy view per row, None for null."""
    if pa.types.is_binary(pixels.type) or pa.types.is_large_binary(pixels.type):
        return [None if p is None else np.frombuffer(p, np.uint8) for p in pixels.to_pylist()]
    values = pixels.values.to_numpy(zero_copy_only=False)
    ends = pixels.offsets.to_numpy()
    valid = pixels.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]


def _images(pixels: pa.Array, width: pa.Array, height: pa.Array) -> Iterator[np.ndarray | None]:
    """One 2-D image per row; None where it is missing or its size does not fit."""
    for flat, w, h in zip(_rows(pixels), width.to_pylist(), height.to_pylist()):
        fits = flat is not None and w and h and w > 0 and h > 0 and len(flat) == w * h
        yield flat.reshape(h, w).astype(np.int64) if fits else None


def _laplacian(img: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian of the interior."""
    return (
        img[:-2, 1:-1] + img[2:, 1:-1] + img[1:-1, :-2] + img[1:-1, 2:] - 4 * img[1:-1, 1:-1]
    )


def _moments(values: np.ndarray) -> tuple[float, float]:
    """Mean and population variance of integers, from exact sums."""
    n, total, squares = values.size, int(values.sum()), int((values * values).sum())
    return total / n, (n * squares - total * total) / (n * n)


@F.arrow_udf(T.DoubleType())
def laplacian_variance(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """A11 before rounding: population variance over interior pixels; null when there are none."""
    out = []
    for img in _images(pixels, width, height):
        if img is None or min(img.shape) < 3:
            out.append(None)
            continue
        lap = _laplacian(img)
        mean = int(lap.sum()) / lap.size
        out.append(int((lap * lap).sum()) / lap.size - mean * mean)
    return pa.array(out, pa.float64())


STATS = ("mean", "std", "laplacian")


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in STATS]))
def global_stats(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """A10. Mean, population std, and Laplacian variance with borders mirrored about the edge."""
    out = []
    for img in _images(pixels, width, height):
        if img is None:
            out.append(None)
            continue
        # A side of one pixel has no neighbour to mirror, so it repeats itself.
        mirrored = img
        for axis, size in enumerate(img.shape):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (1, 1)
            mirrored = np.pad(mirrored, pad, mode="reflect" if size > 1 else "edge")
        mean, variance = _moments(img)
        out.append(
            {
                "mean": mean,
                "std": math.sqrt(variance),
                "laplacian": _moments(_laplacian(mirrored))[1],
            }
        )
    return pa.array(out, pa.struct([(c, pa.float64()) for c in STATS]))


TILE = ("mean", "std")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in TILE])))
def tile_stats(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """A8. Mean and population std of tiles of a quarter of each side, row by row; a remainder
    makes further partial tiles."""
    out = []
    for img in _images(pixels, width, height):
        if img is None:
            out.append([])
            continue
        th, tw = (max(1, side // 4) for side in img.shape)
        tops, lefts = np.arange(0, img.shape[0], th), np.arange(0, img.shape[1], tw)

        def per_tile(values):
            return np.add.reduceat(np.add.reduceat(values, tops, axis=0), lefts, axis=1)

        n = per_tile(np.ones_like(img))
        mean = per_tile(img) / n
        # Integer sums keep the variance of a flat tile exactly 0.
        std = np.sqrt(n * per_tile(img * img) - per_tile(img) ** 2) / n
        out.append(
            [
                {"mean": m, "std": d}
                for m, d in zip(mean.ravel().tolist(), std.ravel().tolist())
            ]
        )
    return pa.array(out, pa.list_(pa.struct([(c, pa.float64()) for c in TILE])))


STROKES = ("min_luma", "max_luma", "total", *ZONES)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in STROKES]))
def stroke_counts(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """A12, A13, J4. Interior pixels whose |dx| + |dy| is above the threshold, in all and per
    zone (bounds inclusive)."""
    out = []
    for img in _images(pixels, width, height):
        if img is None:
            out.append(None)
            continue
        low, high = int(img.min()), int(img.max())
        energy = np.abs(img[1:-1, 2:] - img[1:-1, :-2]) + np.abs(img[2:, 1:-1] - img[:-2, 1:-1])
        strokes = np.zeros(img.shape, bool)
        strokes[1:-1, 1:-1] = energy > max(MIN_STROKE_THRESHOLD, (high - low) * STROKE_SHARE)
        row = {"min_luma": low, "max_luma": high, "total": int(strokes.sum())}
        for zone, (x0, x1, y0, y1) in zone_bounds(img.shape[1], img.shape[0]).items():
            row[zone] = int(strokes[y0 : y1 + 1, x0 : x1 + 1].sum())
        out.append(row)
    return pa.array(out, pa.struct([(c, pa.int32()) for c in STROKES]))


def zone_bounds(width: int, height: int) -> dict[str, tuple[int, int, int, int]]:
    """J4. Zones in pixels: x0, x1, y0, y1."""
    return {
        zone: tuple(
            int(np.floor(side * f + 0.5)) for side, f in zip((width, width, height, height), fractions)
        )
        for zone, fractions in ZONES.items()
    }


@F.arrow_udf(T.DoubleType())
def mean_difference(pixels: pa.Array, previous: pa.Array) -> pa.Array:
    """A14. Mean absolute difference of two images of one size; null when one is missing."""
    out = []
    for now, before in zip(_rows(pixels), _rows(previous)):
        if now is None or before is None or len(now) != len(before) or len(now) == 0:
            out.append(None)
        else:
            out.append(int(np.abs(now.astype(np.int64) - before).sum()) / len(now))
    return pa.array(out, pa.float64())


@F.arrow_udf(T.BinaryType())
def gray_of_bgr(data: pa.Array, channels: pa.Array) -> pa.Array:
    """F13 on the bytes of Spark's image source (blue, green, red, maybe alpha)."""
    out = []
    for flat, n in zip(_rows(data), channels.to_pylist()):
        if flat is None or n not in (1, 3, 4):
            out.append(None)
        elif n == 1:
            out.append(flat.tobytes())
        else:
            px = flat.reshape(-1, n).astype(np.float64)
            gray = np.floor(0.299 * px[:, 2] + 0.587 * px[:, 1] + 0.114 * px[:, 0] + 0.5)
            out.append(gray.astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())
