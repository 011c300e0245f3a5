import json
import os
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tactile.operators import calibration, layout, results
from tactile.plans import derive
from tactile.plans.queries import QUERIES
from tactile.sources import detections, images, sinks


# Workers do not see the tests folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def png(pixels: np.ndarray) -> bytes:
    """Minimal encoder for 8-bit RGB."""
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def folder_of_images(tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3))
    (tmp_path / "sub").mkdir()
    files = {
        "b.PNG": png(rgb), "a.png": png(rgb[:3]), "broken.png": b"no image", "note.txt": b"x",
        "png": b"x", "sub/c.png": png(rgb[:2]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return rgb


def test_list_images(spark, tmp_path):
    folder_of_images(tmp_path)
    flat = images.list_images(spark, str(tmp_path)).collect()
    assert [r.image for r in flat] == ["a.png", "b.PNG", "broken.png"]
    deep = images.list_images(spark, str(tmp_path), recursive=True).collect()
    assert [r.image for r in deep] == ["a.png", "b.PNG", "broken.png", "sub/c.png"]


def test_decode_images(spark, tmp_path):
    rgb = folder_of_images(tmp_path)
    got = {r.image: r for r in images.decode_images(spark, str(tmp_path)).collect()}
    assert got["broken.png"].error == images.UNREADABLE and got["broken.png"].luma is None
    gray = np.floor(rgb @ [0.299, 0.587, 0.114] + 0.5).astype(np.uint8)
    row = got["b.PNG"]
    assert (row.width, row.height, row.error) == (7, 5, None) and bytes(row.luma) == gray.tobytes()


def test_upload_checks(spark):
    rows = [("image/png", b"x"), ("text/plain", b"x"), ("image/png", b""), (None, b"x"), ("image/png", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mime string, content binary")
    got = [r.error for r in images.check_uploads(df).orderBy("i").collect()]
    assert got == [None, "not an image", images.EMPTY_UPLOAD, "not an image", images.EMPTY_UPLOAD]


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def fake_read(model, row):
    if row["image"] == "bad":
        raise RuntimeError("no luck")
    if row["image"] == "empty":
        return []
    found = [(square(0, 0, 40, 20), " Hi ", 0.5), (square(100, 0, 60, 20), model, 1.0), (square(0, 50, 5, 5), " \t", 0.1)]
    return found


def fake_fallback(model, row):
    if row["image"] == "bad":
        raise RuntimeError("no luck twice")
    return []


def test_recognise_to_reports(spark, tmp_path):
    names = spark.createDataFrame([("one",), ("bad",), ("empty",)], "image string")
    found = detections.recognize(names, lambda: "you", fake_read, fake_fallback, "fake").cache()
    boxes = layout.to_boxes(found.where("error is null"), scale=2.0)
    assert sorted((r.text, r.confidence, r.x1, r.y1) for r in boxes.collect()) == [
        ("Hi", 50.0, 20.0, 10.0), ("you", 100.0, 80.0, 10.0)
    ]
    placed = layout.layout(boxes).cache()
    errors = found.where("error is not null").select("image", "error")
    summary = calibration.summary(names.join(errors, "image", "left"), layout.image_text(placed))
    got = {r.image: tuple(r)[1:] for r in summary.collect()}
    assert got == {
        "one": ("Hi you", 75.0, ""),
        "bad": ("", 0.0, "ERROR: OCR failed: no luck twice"),
        "empty": ("", 0.0, "no text detected"),
    }
    out = str(tmp_path / "gaps.csv")
    counts = sinks.write_calibration(calibration.calibration_rows(placed), summary, out)
    assert counts == {"rows": 2, "summary": 3}
    report = spark.read.csv(out, header=True).orderBy("position_in_line").collect()
    assert report[0].asDict() == {
        "image": "one", "line": "0", "position_in_line": "0", "text": "Hi", "confidence": "50.0",
        "gap_before_px": None, "char_width_px": "10.0", "gap_ratio": None,
        "space_inserted_before": "line-start", "x0": "0.0", "y0": "0.0", "x1": "20.0", "y1": "10.0",
    }
    assert report[1].space_inserted_before == "True" and report[1].gap_ratio == "3.0"
    assert os.path.isdir(str(tmp_path / "gaps_summary.csv"))
    assert list(report[0].asDict()) == calibration.ROW_COLUMNS


def test_report_is_rounded_half_up(spark):
    values = [0.05, 0.25, -0.25, 15.625, 1.5625, -0.04, 1e17, float("nan"), float("inf"), 0.0, None, 2.675, 0.0005, 1.0005]
    columns = ["confidence", "gap", "char_width", "gap_ratio", "x0", "y0", "x1", "y1"]
    placed = spark.createDataFrame([("a", 0, k, "w", True, *[v] * 8) for k, v in enumerate(values)], "image string, line int, position_in_line int, text string, space boolean, " + ", ".join(f"{c} double" for c in columns))
    digits = {"confidence": 1, "gap": 2, "char_width": 2, "gap_ratio": 3} | dict.fromkeys(columns[4:], 1)
    rounds = {c: F.round(c, d) for c, d in digits.items()}
    rounds["char_width"] = F.when(F.col("char_width") > 0, rounds["char_width"])
    got = calibration.calibration_rows(placed).withColumnsRenamed({"gap_before_px": "gap", "char_width_px": "char_width"})
    tables = [df.orderBy("position_in_line").select(columns).collect() for df in (got, placed.withColumns(rounds))]
    assert str(tables[0]) == str(tables[1])


def test_detections_are_read_back(spark, tmp_path):
    rows = [("a", 0, [(0.0, 1.0), (2.0, 3.0)], "x", 0.5)]
    spark.createDataFrame(rows, detections.SCHEMA).write.parquet(str(tmp_path / "d"))
    got = layout.to_boxes(detections.read_detections(spark, str(tmp_path / "d")), 1.0).first()
    assert (got.x0, got.y0, got.x1, got.y1, got.confidence) == (0.0, 1.0, 2.0, 3.0, 50.0)


RESULTS = f"image string, engine_rank int, text string, confidence double, words {results.NO_WORDS}"
WORD = (" a ", (0.0, 0.0, 5.0, 5.0), 0.0)


def test_engine_cascade(spark, tmp_path):
    rows = [
        ("first", 1, "ok", None, [WORD]), ("first", 2, "no", 99.0, []),
        ("second", 1, " ﻿ ", 99.0, []), ("second", 2, "x\r\n y", 70.5, None),
        ("blank", 2, "  ", 0.0, [("b", (0.0, 0.0, 0.0, 5.0), 40.0)]), ("none", 1, None, 3.0, []),
    ]
    names = spark.createDataFrame([(n,) for n in ("first", "second", "blank", "none")], "image string")
    chosen = results.choose_engine(names, spark.createDataFrame(rows, RESULTS)).cache()
    got = {r.image: (r.engine_rank, r.text, r.confidence, len(r.words)) for r in chosen.collect()}
    assert got == {
        "first": (1, "ok", 90.0, 1), "second": (2, "x y", 71.0, 0), "blank": (2, "", 85.0, 1), "none": (0, "", 0.0, 0),
    }
    words = {r.image: (r.text, r.confidence, r.drawable) for r in results.words_of(chosen).collect()}
    assert words == {"first": ("a", 90.0, True), "blank": ("b", 40.0, False)}
    badges = {r.image: (r.words, r.confidence) for r in results.word_badges(chosen).collect()}
    assert badges["first"] == (1, 90) and badges["none"] == (0, 0)
    sinks.write_results(chosen.where("image = 'first'"), str(tmp_path / "json"))
    line = spark.read.text(str(tmp_path / "json")).first()[0]
    assert json.loads(line) == {
        "text": "ok", "confidence": 90.0,
        "words": [{"text": " a ", "bbox": {"x0": 0.0, "y0": 0.0, "x1": 5.0, "y1": 5.0}, "confidence": 0.0}],
    }


def test_failed_rows_go_to_quarantine(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "broken")], "image string, error string")
    sinks.write_split(df, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert [r.image for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert [r.image for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b"]


def test_drawable(spark):
    from tactile.functions import geometry

    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = df.select(geometry.drawable(*[F.col(c) for c in "abcd"])).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    """Eight tasks after each other in few worker processes; and each call has its own model."""
    names = spark.range(8, numPartitions=8).select(F.col("id").cast("string").alias("image"))

    def loader(text):
        def load():
            import uuid

            (tmp_path / text / uuid.uuid4().hex).mkdir(parents=True)
            return os.getpid(), text

        return load

    def read(model, row):
        assert model[0] == os.getpid()
        return [(square(0, 0, 1, 1), f"{model[1]} {model[0]}", 1.0)]

    for text in ("one", "two"):
        found = detections.recognize(names, loader(text), read)
        texts = [r.text.split() for r in found.collect()]
        assert {t[0] for t in texts} == {text} and len(texts) == 8
        assert len(os.listdir(tmp_path / text)) == len({t[1] for t in texts})


def test_layout_recognises_each_image_once(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("b",)], "image string")

    def read(model, row):
        import uuid

        (tmp_path / f"{row['image']}-{uuid.uuid4().hex}").mkdir()
        return [(square(0, 0, 40, 20), "x", 1.0), (square(100, 0, 60, 20), "y", 1.0)]

    found = detections.recognize(names, lambda: None, read)
    texts = layout.assemble_text(layout.to_boxes(found.where("error is null"), scale=1.0)).collect()
    assert {r.text for r in texts} == {"x y"} and len(os.listdir(tmp_path)) == 2


def test_cascade_sorts_no_texts(spark):
    rows = spark.createDataFrame([("a", 1, "t", 1.0, [])], RESULTS)
    chosen = results.choose_engine(spark.createDataFrame([("a",)], "image string"), rows)
    lines = chosen._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("SortAggregate" in line for line in lines)
    assert any("ShuffledHashJoin" in line and "BuildLeft" in line for line in lines)


def test_no_temporary_folder_on_a_cluster(monkeypatch):
    from tactile import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        session.checkpoint_root(Spark())


def _log(folder, kind, image):
    """A call that can be counted from outside the worker."""
    import uuid

    (folder / f"{kind}.{image}.{uuid.uuid4().hex}").mkdir()


def _calls(folder, kind):
    return sorted(name.split(".")[1] for name in os.listdir(folder) if name.startswith(kind + "."))


def test_second_engine_runs_only_where_the_first_gave_nothing(spark, tmp_path):
    from tactile.sources.engines import Engine, cascade

    def first(model, row):
        _log(tmp_path, "first", row["image"])
        if row["image"].startswith("broken"):
            raise ValueError("no first")
        return {"text": {"good": "found", "blank": " "}.get(row["image"]), "confidence": 70.0, "words": None}

    def second(model, row):
        _log(tmp_path, "second", row["image"])
        if row["image"] == "broken-twice":
            raise ValueError("no second")
        return {"text": "a\r\nb" if row["image"] != "broken-empty" else ""}

    images = ["good", "blank", "none", "broken", "broken-twice", "broken-empty"]
    df = spark.createDataFrame([(i,) for i in images], "image string")
    chosen = cascade(df, Engine(lambda: None, first), Engine(lambda: None, second))
    for _ in range(2):
        got = {r["image"]: (r["engine_rank"], r["text"], r["confidence"], r["note"]) for r in chosen.collect()}
        assert got == {
            "good": (1, "found", 70.0, ""), "blank": (2, "a b", 85.0, ""), "none": (2, "a b", 85.0, ""),
            "broken": (2, "a b", 85.0, ""), "broken-twice": (0, "", 0.0, "ERROR: OCR failed: no second"),
            "broken-empty": (2, "", 85.0, "ERROR: OCR failed: no first"),
        }
    # Each image once by the first engine, the rest once by the second, however often it is used.
    assert _calls(tmp_path, "first") == sorted(images)
    assert _calls(tmp_path, "second") == sorted(set(images) - {"good"})


def test_batches_of_images(spark, tmp_path):
    """As many calls as batches; an image that cannot be read fails alone, or falls back."""
    names = [f"i{k}" for k in range(10)]
    images = spark.createDataFrame([(n, b"x" * (50 if n == "i9" else 10)) for n in names], "image string, data binary").coalesce(1)

    def read(model, rows):
        _log(tmp_path / kind, "read", str(len(rows)))
        if any(r["image"] in bad for r in rows):
            raise ValueError("poisoned")
        return [[(square(0, 0, 1, 1), r["image"], 1.0)] for r in rows]

    for kind, bad, fallback in (("all", (), None), ("bad", ("i2",), None), ("back", ("i2",), lambda m, row: [(square(0, 0, 1, 1), "again", 0.5)])):
        (tmp_path / kind).mkdir()
        found = detections.recognize(images, lambda: None, read, fallback, batch=detections.Batch(rows=4, bytes=100)).collect()
        got = {r["image"]: (r["text"], r["error"]) for r in found}
        if kind == "all":
            assert got == {n: (n, None) for n in names} and len(found) == 10
            assert _calls(tmp_path / kind, "read") == ["2", "4", "4"]
        else:
            expected = (None, "OCR failed: poisoned") if kind == "bad" else ("again", None)
            assert got == {n: (n, None) if n != "i2" else expected for n in names}
            assert _calls(tmp_path / kind, "read") == ["1"] * 4 + ["2", "4", "4"]
    one = detections.bounded(iter([{"a": b"x" * 500}, {"a": b"x"}]), detections.Batch(rows=4, bytes=100))
    assert [len(p) for p in one] == [1, 1]


def test_both_reports_or_neither(spark, tmp_path):
    rows = [("a", k, [(10.0 * k, 0.0), (10.0 * k + 8, 10.0)], f"t{k}", 0.5) for k in range(3)]
    boxes = layout.to_boxes(spark.createDataFrame(rows, detections.SCHEMA), 1.0)
    images = spark.createDataFrame([("a", None), ("b", "no image")], "image string, error string")
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    placed = layout.layout(boxes)
    counted = placed.mapInArrow(seen, placed.schema)
    out = str(tmp_path / "gaps.csv")
    assert sinks.write_reports(counted, images, out) == {"rows": 3, "summary": 2}
    assert runs.value == 3, "the layout runs once for both"
    report, summary = (sorted(open(f"{tmp_path}/{n}/{f}").read() for f in os.listdir(f"{tmp_path}/{n}") if f.startswith("part")) for n in ("gaps.csv", "gaps_summary.csv"))

    def fails(batches):
        for batch in batches:
            raise ValueError("lost")
            yield batch

    good = calibration.calibration_rows(placed)
    bad = calibration.summary(images, layout.image_text(placed))
    broken = bad.mapInArrow(fails, bad.schema)
    with pytest.raises(Exception, match="lost"):
        sinks.write_calibration(good.limit(1), broken, out)
    again = [sorted(open(f"{tmp_path}/{n}/{f}").read() for f in os.listdir(f"{tmp_path}/{n}") if f.startswith("part")) for n in ("gaps.csv", "gaps_summary.csv")]
    assert again == [report, summary], "both are as before"
    assert sorted(os.listdir(tmp_path)) == ["gaps.csv", "gaps_summary.csv"]
    assert sinks.write_calibration(good, bad, out) == {"rows": 3, "summary": 2}


def test_counted_words_do_not_go_through_the_join(spark):
    """The number of words of the chosen result, and no list of words in what is shuffled."""
    word = ("a", (0.0, 0.0, 1.0, 1.0), 1.0)
    rows = [
        ("a", 1, "x", 1.0, [word, word]), ("a", 2, "y", 1.0, [word]), ("b", 1, " ", 1.0, [word]),
        ("b", 2, "y", 1.0, [word] * 3), ("c", 1, "x", 1.0, None),
    ]
    kind = f"image string, engine_rank int, text string, confidence double, words {results.NO_WORDS}"
    found = spark.createDataFrame(rows, kind)
    names = spark.createDataFrame([(i,) for i in "abcd"], "image string")
    counted = results.choose_engine(names, found, counted=True)
    plain = results.choose_engine(names, found).withColumn("words", F.size("words"))
    assert counted.columns == plain.columns
    assert sorted(counted.collect()) == sorted(plain.collect())
    assert {r.image: r.words for r in counted.collect()} == {"a": 2, "b": 3, "c": 0, "d": 0}


def test_words_listed_late_equal_words_listed_before(spark):
    """An expression in place of the column, and bare words that ``words_of`` makes words of."""
    rows = [
        ("a", 1, " x  yy ", 1.0, True), ("a", 2, "z", 2.0, True), ("b", 1, " ", 1.0, True), ("b", 2, "p\n q", None, True),
        ("c", 1, "x", 1.0, False), ("d", 2, " ", 0.0, True), ("e", 2, None, 3.0, True), ("f", 1, None, 3.0, True),
    ]
    found = spark.createDataFrame(rows, "image string, engine_rank int, text string, confidence double, listed boolean")
    names = spark.createDataFrame([(i,) for i in "abcdefg"], "image string")
    bare = derive.engine_words()
    full = F.transform(bare, derive.engine_word)
    before = results.choose_engine(names, found.withColumn("words", full))
    after = results.choose_engine(names, found, words=full)
    assert after.columns == before.columns and sorted(after.collect()) == sorted(before.collect())
    assert {r.image: len(r.words) for r in after.collect()} == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0, "f": 0, "g": 0}
    chosen = results.choose_engine(names, found, words=bare)
    plain, made = results.words_of(before), results.words_of(chosen, derive.engine_word)
    assert made.schema.simpleString() == plain.schema.simpleString()
    assert sorted(made.collect()) == sorted(plain.collect()) and plain.count() == 4
    counted = results.choose_engine(names, found, counted=True, words=bare)
    assert sorted(counted.collect()) == sorted(before.withColumn("words", F.size("words")).collect())


def test_words_made_in_arrow_batches_equal_the_expression(spark):
    """However few rows are taken at a time; lists may be empty or missing."""
    words = ["a", "été", "กิน", "😀x", "\"q\\", "w" * 90]
    rows = [(f"d{n}", [words[(n + i) % 6] for i in range(n * 31 % 250)], n) for n in range(40)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "image string, words array<string>, n int")
    made = derive.with_engine_words(df)
    listed = F.coalesce(F.transform("words", derive.engine_word).cast(results.NO_WORDS), F.array())
    expected = df.withColumn("words", listed)
    assert made.columns == df.columns and made.schema["words"].dataType.simpleString() == results.NO_WORDS
    assert sorted(made.collect()) == sorted(expected.collect())
    batch = pa.RecordBatch.from_pydict({"words": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    whole = list(derive._with_words(iter([batch])))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(derive, "BATCH_WORDS", 300)
        parts = list(derive._with_words(iter([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)])))
    assert len(whole) == 1 and len(parts) > 10
    assert sum((p.column("words").to_pylist() for p in parts), []) == whole[0].column("words").to_pylist()


def test_the_words_of_a_json_object_are_made_without_a_lambda(spark):
    plan = QUERIES["result_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan
