import numpy as np
import pytest
from pyspark.sql import functions as F

from tactile.operators import frames
from tactile.operators.ordered import SMALL, Bound

SCHEMA = "id int, width int, height int, luma binary"


def image_rows(spark, arrays):
    rows = [(i, a.shape[1], a.shape[0], bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, SCHEMA)


def noise(seed, shape):
    return np.random.default_rng(seed).integers(0, 256, shape)


def checks(size=40):
    y, x = np.mgrid[:size, :size]
    return np.where((x % 4 < 2) & (y % 4 < 2), 255, 0)


def test_focus_of_flat_and_sharp_frames(spark):
    got = image_rows(spark, [np.full((40, 40), 128), checks(), noise(1, (2, 9))]).withColumn("f", frames.focus_score())
    flat, sharp, tiny = [r.f for r in got.orderBy("id").collect()]
    assert flat == 0 and sharp >= 160 and tiny == 0


def test_focus_of_missing_or_misfit_pixels_is_zero(spark):
    df = spark.createDataFrame([(1, 4, 4, None), (2, 4, 4, bytearray(b"abc")), (3, None, 4, bytearray(b"abc"))], SCHEMA)
    assert [r.f for r in df.withColumn("f", frames.focus_score()).collect()] == [0, 0, 0]


def test_array_and_bytes_agree(spark):
    arrays = [noise(s, shape) for s, shape in enumerate([(8, 8), (160, 120), (5, 31), (3, 3)])]
    as_bytes = image_rows(spark, arrays)
    as_array = spark.createDataFrame(
        [(i, a.shape[1], a.shape[0], a.ravel().tolist()) for i, a in enumerate(arrays)],
        "id int, width int, height int, luma array<int>",
    )
    measured = [
        frames.quality(frames.lighting(frames.frame_metrics(df))).drop("luma").orderBy("id").collect()
        for df in (as_bytes, as_array)
    ]
    assert measured[0] == measured[1]


def test_stroke_counts_by_definition(spark):
    img = noise(7, (60, 80)) // 3
    got = frames.frame_metrics(image_rows(spark, [img])).first()
    contrast = img.max() - img.min()
    assert got.contrast == contrast
    limit, counts = max(16, 0.15 * contrast), {"all": 0, "tl": 0, "tr": 0, "bl": 0, "br": 0}
    x_of = {"l": (6, 30), "r": (50, 74)}
    y_of = {"t": (5, 24), "b": (36, 55)}
    for y in range(1, 59):
        for x in range(1, 79):
            if abs(img[y, x + 1] - img[y, x - 1]) + abs(img[y + 1, x] - img[y - 1, x]) > limit:
                counts["all"] += 1
                for v, (y0, y1) in y_of.items():
                    for h, (x0, x1) in x_of.items():
                        counts[v + h] += y0 <= y <= y1 and x0 <= x <= x1
    assert got.strokes == counts["all"]
    for zone in ("tl", "tr", "bl", "br"):
        assert got[f"d_{zone}"] == pytest.approx(counts[zone] / (24 * 19))


def test_tiles_with_remainder(spark):
    img = noise(3, (11, 9))
    row = frames.lighting(image_rows(spark, [img])).first()
    tiles = [img[y : y + 2, x : x + 2] for y in range(0, 11, 2) for x in range(0, 9, 2)]
    assert [t["mean"] for t in row.tiles] == pytest.approx([t.mean() for t in tiles])
    assert [t["std"] for t in row.tiles] == pytest.approx([t.std() for t in tiles])


def test_lighting_uses_content_tiles_only(spark):
    blank_and_text = np.full((40, 40), 250)
    blank_and_text[:20] = checks()[:20]
    shadow = np.full((40, 40), 240)
    shadow[:, :20] = 100
    even, uneven = frames.lighting(image_rows(spark, [blank_and_text, shadow])).orderBy("id").collect()
    assert not even.uneven and even.content_tiles == 8
    assert uneven.uneven and uneven.content_tiles == 0


def test_quality_mirrors_the_border(spark):
    img = noise(5, (7, 6))
    padded = np.pad(img, 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * img
    row = frames.quality(image_rows(spark, [img])).first()
    assert row.std == pytest.approx(img.std()) and row.laplacian == pytest.approx(lap.var())
    assert row.high_quality


def test_enhancement_plan(spark):
    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "id int, uneven boolean, high_quality boolean")
    source = F.when(F.col("id") == 1, "camera").otherwise("upload")
    got = frames.enhancement_plan(df, source).orderBy("id").collect()
    assert [(r.needs_threshold, r.needs_denoise, r.denoise_strength) for r in got] == [
        (True, True, 6), (False, False, 0), (False, False, 0)
    ]


def test_resize_plan(spark):
    sizes = [(640, 800), (0, 10), (320, 500), (200, 400), (291, 300), (500, 1001)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "id int, width int, height int")
    got = frames.resize_plan(df).orderBy("id").collect()
    assert [(r.scale, r.new_width, r.new_height) for r in got] == [
        (1.0, 640, 800), (1.0, 0, 10), (2.0, 640, 1000), (2.0, 400, 800),
        (640 / 291, 640, round(300 * (640 / 291))), (1.28, 640, round(1001 * 1.28)),
    ]


def test_alignment(spark):
    df = spark.createDataFrame([(n,) for n in range(5)], "n int")
    assert [r[0] for r in df.select(frames.alignment(F.col("n"))).collect()] == [0, 25, 50, 75, 100]


def test_luma_rounds_halves_up(spark):
    from tactile.functions import geometry

    df = spark.createDataFrame([(255, 255, 255), (128, 128, 128), (1, 2, 3)], "r int, g int, b int")
    got = [r[0] for r in df.select(geometry.luma(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == [255, 128, 2]
    halves = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (-1.5,)], "v double")
    assert [r[0] for r in halves.select(geometry.round_up_half(F.col("v"))).collect()] == [0, 1, 2, -1]


def test_motion_of_a_large_session(spark):
    images = [noise(i, (4, 5)) for i in range(40)]
    rows = [("hot" if i % 4 else f"s{i % 3}", i, 5, 4, bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(images)]
    df = spark.createDataFrame(rows, "session_id string, ts int, width int, height int, luma binary").repartition(3)
    got = [
        {r.ts: r.motion for r in frames.frame_motion(df, bound=b).collect()}
        for b in (SMALL, Bound(max_rows=5, chunk_rows=6))
    ]
    last, expected = {}, {}
    for session, ts, *_ in rows:
        before = last.get(session)
        expected[ts] = 0.0 if before is None else np.abs(images[ts] - images[before]).mean()
        last[session] = ts
    assert got[0] == pytest.approx(expected) and got[1] == got[0]


def test_thinning_keeps_the_first_of_each_interval(spark):
    df = spark.createDataFrame(
        [("a", t, t) for t in (0, 100, 299, 300, 899, 900)] + [("b", 50, 50)], "session_id string, at long, n int"
    ).withColumn("ts", F.timestamp_millis("at"))
    got = {(r.session_id, r.n) for r in frames.thin(df, keep=["n"]).collect()}
    assert got == {("a", 0), ("a", 300), ("a", 899), ("a", 900), ("b", 50)}


def test_without_a_document_nothing_is_locked(spark):
    row = [(10, 17, 500.0, 0.0, 9.0, 9.0, 9.0, 9.0), (10**6, 255, 500.0, 0.0, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(row, "strokes int, contrast int, focus double, motion double, d_tl double, d_tr double, d_bl double, d_br double")
    none, page = frames.frame_flags(df).orderBy("strokes").collect()
    assert (none.has_document, none.locked, none.alignment, none.focus_band) == (False, 0, 0, "blurry")
    assert (page.has_document, page.locked, page.alignment, page.focus_band) == (True, 4, 100, "sharp")
