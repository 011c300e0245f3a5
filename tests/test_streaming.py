import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactile.operators import capture, frames
from tactile.operators.ordered import SMALL
from tactile.operators.sessions import Hold, Throttle, fold
from tactile.sources.frames import SCHEMA, stream_frames, thin_stream
from tactile.streaming import runs
from tactile.streaming.capture import closing_row, fold_stream, live_capture

START = 1_704_067_200_000


def write_in_files(spark, rows, schema, folder, files):
    """One file per slice of the rows, one after the other."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], schema).coalesce(1)
        part.withColumn("ts", F.timestamp_millis(F.col("ms") + START)).drop("ms").write.mode("append").parquet(folder)


def drain(spark, stream, folder):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", folder + "-state")
        .outputMode("append").trigger(availableNow=True).start(folder)
    )
    query.awaitTermination()
    batches = [p["numInputRows"] for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(folder), batches


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


SCHEMA_OF_EVENTS = "session_id string, n int, ms long, ok boolean, text string, forced boolean"


def prepared(df):
    return df.withColumn("ms", F.unix_millis("ts")).withColumn("code", F.when(~F.col("ok"), "MOVING"))


def run_stream(spark, tmp_path, machine, **options):
    folder = str(tmp_path / "in")
    table = spark.read.parquet(folder)
    closing_row(table).coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    stream = fold_stream(prepared(reader.parquet(folder)), machine, ["ts", "n"], **options)
    live, batches = drain(spark, stream, str(tmp_path / "out"))
    return live, [b for b in batches if b], table.where("session_id is not null")


@pytest.fixture
def in_runs(spark):
    """Streams keep what waits in runs."""
    before = spark.conf.get(runs.PROVIDER)
    spark.conf.set(runs.PROVIDER, runs.ROCKS)
    yield {"in_runs": True}
    spark.conf.set(runs.PROVIDER, before)


@pytest.mark.parametrize("files, idle_ms", [(1, None), (5, 700)])
@pytest.mark.parametrize("kind", ["hold", "throttle"])
def test_runs_do_not_depend_on_the_cut(spark, tmp_path, in_runs, kind, files, idle_ms):
    rng = random.Random(9)
    rows = [(f"s{i % 4}", i, i * 80, rng.random() < 0.9, rng.choice("ab"), rng.random() < 0.04) for i in range(400)]
    rows = [r for r in rows if not 100 < r[1] < 140]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 9_000))
    write_in_files(spark, rows, SCHEMA_OF_EVENTS, str(tmp_path / "in"), files)
    machine = Hold() if kind == "hold" else Throttle()
    live, batches, table = run_stream(spark, tmp_path, machine, idle_ms=idle_ms, **in_runs)
    assert len(batches) >= files
    assert live.where("late").count() == 0
    same(live.drop("late"), fold(prepared(table), machine, ["session_id"], ["ts", "n"], (), SMALL, idle_ms))


def test_late_rows_come_out_as_late_with_runs(spark, tmp_path, in_runs):
    rows = [("a", i, i * 1000, True, "x", False) for i in range(60)]
    late = rows.pop(20)
    write_in_files(spark, [*rows, late], SCHEMA_OF_EVENTS, str(tmp_path / "in"), 15)
    live, _, table = run_stream(spark, tmp_path, Hold(), **in_runs)
    assert [(r.n, r.code) for r in live.where("late").collect()] == [(20, None)]
    rest = prepared(table.where("n <> 20"))
    same(live.where("not late").drop("late"), fold(rest, Hold(), ["session_id"], ["ts", "n"], (), SMALL))


class Store:
    """State and timers of one session in memory; counts the bytes that pass."""

    def __init__(self):
        self.value, self.map, self.timers, self.moved = None, {}, set(), 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        self.moved += len(self.map[key][0])
        return self.map[key]

    def updateValue(self, key, value):
        self.moved += len(value[0])
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_what_a_batch_touches_follows_its_rows():
    """Each row is written once and read once, but for those of the bucket that is due in part."""
    held = pa.schema([("session_id", pa.string()), ("ms", pa.int64()), ("ok", pa.bool_()), ("code", pa.string())])
    keep = ["session_id", "ms"]
    store, machine, step = Store(), Hold(), runs.Fold(Hold(), held, ["ms"], keep, 0, 5_000)
    step.init(store)
    frame = lambda lo, hi: pd.DataFrame({"session_id": "a", "ms": range(lo, hi, 10), "ok": True, "code": None})
    store.watermark, got, batches = 0, [], 40
    for i in range(batches):
        got += step.handleInputRows(("a",), iter([frame(i * 2_500, i * 2_500 + 2_500)]), store)
        store.watermark = max(1, i * 2_500 - 30_000)
        if any(t <= store.watermark for t in store.timers):
            store.timers = {t for t in store.timers if t > store.watermark}
            got += step.handleExpiredTimer(("a",), store, None)
    store.watermark = batches * 2_500 + 1
    got += step.handleExpiredTimer(("a",), store, None)
    whole = frame(0, batches * 2_500)
    out, _ = machine.run(machine.initial, *[whole[c].tolist() for c in machine.inputs])
    assert [(r.ms, r.code) for pdf in got for r in pdf.itertuples()] == [(int(whole["ms"][e[0]]), e[2]) for e in out]
    assert not store.map and store.exists()
    table = pa.Table.from_pandas(frame(0, 1_000), held, preserve_index=False)
    assert store.moved < 3 * batches * 2.5 * len(runs.packed(table))
    store.watermark += 10_000
    assert list(step.handleExpiredTimer(("a",), store, None)) == [] and not store.exists()


@pytest.mark.parametrize("idle_ms", [700])
@pytest.mark.parametrize("files, shuffled", [(1, False), (5, True), (20, True)])
@pytest.mark.parametrize("kind", ["hold", "throttle"])
def test_machines_do_not_depend_on_the_cut(spark, tmp_path, kind, files, shuffled, idle_ms):
    rng = random.Random(8)
    rows = [(f"s{i % 4}", i, i * 80, rng.random() < 0.9, rng.choice("ab"), rng.random() < 0.04) for i in range(400)]
    rows = [r for r in rows if not 100 < r[1] < 140]
    if shuffled:
        rows.sort(key=lambda r: r[2] + rng.randint(0, 9_000))
    write_in_files(spark, rows, SCHEMA_OF_EVENTS, str(tmp_path / "in"), files)
    machine = Hold() if kind == "hold" else Throttle()
    live, batches, table = run_stream(spark, tmp_path, machine, idle_ms=idle_ms)
    assert len(batches) >= files
    assert live.where("late").count() == 0
    same(live.drop("late"), fold(prepared(table), machine, ["session_id"], ["ts", "n"], (), SMALL, idle_ms))


def test_late_rows_come_out_as_late(spark, tmp_path):
    rows = [("a", i, i * 1000, True, "x", False) for i in range(60)]
    late = rows.pop(20)
    write_in_files(spark, [*rows, late], SCHEMA_OF_EVENTS, str(tmp_path / "in"), 60)
    live, _, table = run_stream(spark, tmp_path, Hold())
    assert [(r.n, r.code) for r in live.where("late").collect()] == [(20, None)]
    rest = prepared(table.where("n <> 20"))
    same(live.where("not late").drop("late"), fold(rest, Hold(), ["session_id"], ["ts", "n"], (), SMALL))


def camera(n):
    """Sharp pages, with blank, shifted and half-covered ones in between."""
    y, x = np.mgrid[:160, :120]
    page = np.where((x % 4 < 2) & (y % 4 < 2), 255, 0)
    rng = random.Random(3)
    rows = []
    for i in range(n):
        img = page.copy()
        kind = rng.choice(["page"] * 12 + ["blank", "dark", "half", "negative"])
        if kind == "blank":
            img[:] = 200
        elif kind == "half":
            img[:80] = 0
        elif kind == "negative":
            img = 255 - img
        elif kind == "dark":
            img = img // 20
        rows.append((f"cam{i % 2}", i * 150, 120, 160, bytearray(img.astype(np.uint8).tobytes())))
    return rows


def test_live_capture_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "frames")
    write_in_files(spark, camera(120), "session_id string, ms long, width int, height int, luma binary", folder, 4)
    table = spark.read.schema(SCHEMA).parquet(folder)
    assert dict(table.dtypes)["luma"] == "binary"

    closing_row(table).coalesce(1).write.mode("append").parquet(folder)
    table = table.where("session_id is not null")
    live, _ = drain(spark, live_capture(stream_frames(spark, folder, files_per_trigger=1)), str(tmp_path / "out"))
    live = live.where("not late").drop("late")
    flags = frames.frame_flags(frames.frame_motion(frames.frame_metrics(table)))
    events = capture.guidance(capture.judged(flags), bound=SMALL)
    spoken = capture.throttle(capture.messages(events), ["ts", "seq"], bound=SMALL).select("session_id", "ts", "seq")
    batch = events.join(spoken.withColumn("said", F.lit(True)), ["session_id", "ts", "seq"], "left").join(
        flags.select("session_id", "ts", "motion"), ["session_id", "ts"]
    )
    batch = batch.withColumn("spoken", F.coalesce("said", F.lit(False)))
    codes = {r.code for r in live.select("code").distinct().collect()}
    assert {"FIRE", "WARN", "HOLD_START", "NO_DOC", "TOP"} <= codes
    same(live, batch)


def test_thinned_stream_feeds_the_capture(spark, tmp_path):
    folder = str(tmp_path / "frames")
    rows = [r for r in camera(80)] + [("cam0", 40 * 150 + 1, 120, 160, None)]
    # In any order within some seconds.
    shuffled = sorted(rows, key=lambda r: (r[1] // 4000, random.Random(repr(r[:2])).random()))
    write_in_files(spark, shuffled, "session_id string, ms long, width int, height int, luma binary", folder, 3)
    closing_row(spark.read.parquet(folder)).coalesce(1).write.mode("append").parquet(folder)
    thinned = thin_stream(stream_frames(spark, folder, files_per_trigger=1))
    got, _ = drain(spark, thinned, str(tmp_path / "thin"))
    # The same frames as in batch, whatever the order of arrival.
    seen = spark.read.schema(SCHEMA).parquet(folder).where("luma is not null and session_id is not null")
    same(got, frames.thin(seen))
    slots = got.groupBy("session_id", F.floor(F.unix_millis("ts") / 300)).count()
    assert slots.agg(F.max("count")).first()[0] == 1
    assert slots.count() == seen.select(
        "session_id", F.floor(F.unix_millis("ts") / 300)
    ).distinct().count()
    chained = live_capture(thin_stream(stream_frames(spark, folder, files_per_trigger=1), earliest=False), delay_ms=None)
    events, _ = drain(spark, chained, str(tmp_path / "live"))
    assert events.where("code = 'HOLD_START'").count() > 0


def test_a_pause_ends_a_hold(spark, tmp_path):
    """In batch as on a stream; without an idle time it does not."""
    rows = [("a", 0, 0, True, "", False), ("b", 1, 0, True, "", False), ("b", 2, 200_000, True, "", False), ("a", 3, 600_000, True, "", False)]
    write_in_files(spark, rows, SCHEMA_OF_EVENTS, str(tmp_path / "in"), 4)
    live, _, table = run_stream(spark, tmp_path, Hold(), delay_ms=1000, idle_ms=30_000)
    codes = [r.code for r in live.where("session_id = 'a'").orderBy("ts").collect()]
    assert codes == ["HOLD_START", "HOLD_START"]
    batch = fold(prepared(table), Hold(), ["session_id"], ["ts", "n"], (), SMALL)
    assert [r.code for r in batch.where("session_id = 'a'").orderBy("ts", "seq").collect()] == ["HOLD_START", "WARN", "FIRE"]


@pytest.mark.parametrize("idle_ms", [None, 700])
@pytest.mark.parametrize("kind", ["hold", "throttle"])
def test_sessions_share_the_calls_of_their_bucket(spark, tmp_path, kind, idle_ms):
    """Many small sessions need as many states as there are buckets, with the rows of the batch."""
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(150)}", i, i * 60, rng.random() < 0.9, rng.choice("ab"), rng.random() < 0.1) for i in range(900)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 9_000))
    write_in_files(spark, rows, SCHEMA_OF_EVENTS, str(tmp_path / "in"), 4)
    machine = Hold() if kind == "hold" else Throttle()
    table = spark.read.parquet(str(tmp_path / "in"))
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    closing_row(table).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = fold_stream(prepared(reader.parquet(str(tmp_path / "in"))), machine, ["ts", "n"], idle_ms=idle_ms, buckets=3)
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-state")
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    states = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(states) <= 3 + 1  # the closing row has a group of its own
    live = spark.read.schema(stream.schema).parquet(out)
    assert live.where("late").count() == 0
    same(live.drop("late"), fold(prepared(table.where("session_id is not null")), machine, ["session_id"], ["ts", "n"], (), SMALL, idle_ms))
