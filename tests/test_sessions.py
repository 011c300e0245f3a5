import random

import pytest
from pyspark.sql import functions as F

from tactile.operators import capture
from tactile.operators.ordered import SMALL, Bound, Chunks, Scan, Windows
from tactile.operators.sessions import Hold, Idle, Switched, Throttle, fold

HOT = Bound(max_rows=5, chunk_rows=7)


def codes(machine, frames):
    events, _ = machine.run(machine.initial, *map(list, zip(*frames)))
    return [(frames[i][0], code) for i, _, code, _ in events if code != "HOLDING"]


def test_hold_at_the_usual_cadence():
    frames = [(t, True, None) for t in range(0, 3100, 300)]
    assert codes(Hold(), frames) == [
        (0, "HOLD_START"), (600, "WARN"), (1200, "FIRE"),
        (1500, "HOLD_START"), (2100, "WARN"), (2700, "FIRE"), (3000, "HOLD_START"),
    ]


def test_hold_breaks_and_warns_with_the_shot():
    frames = [(0, True, None), (400, False, "MOVING"), (500, True, None), (1600, True, None)]
    assert codes(Hold(), frames) == [
        (0, "HOLD_START"), (400, "MOVING"), (500, "HOLD_START"), (1600, "WARN"), (1600, "FIRE"),
    ]


def test_no_shot_without_auto_capture():
    frames = [(t, True, None) for t in range(0, 3100, 300)]
    assert codes(Hold(auto_capture=False), frames) == [(0, "HOLD_START"), (600, "WARN")]


def test_throttle_example():
    ms, text = [0, 2000, 2100, 4800], ["X", "X", "Y", "X"]
    passed, _ = Throttle().run(Throttle.initial, ms, text, [False] * 4)
    assert [i for (i,) in passed] == [0, 2, 3]
    passed, _ = Throttle().run(Throttle.initial, [0, 100, 1850], ["X", "X", "Y"], [False, True, False])
    assert [i for (i,) in passed] == [0, 1]


def random_rows(rng, n, step, share_ok):
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice([0, 1, step // 4, step, step, 4 * step])
        rows.append((t, rng.random() < share_ok, rng.choice("abc"), rng.random() < 0.05))
    return rows


@pytest.mark.parametrize("auto", [True, False])
def test_hold_chunks_compose(auto):
    """Entering states found from the reports are those of the plain run, for any cut."""
    rng = random.Random(1)
    for _ in range(400):
        machine = Hold(rng.choice([300, 1000, 2500]), rng.choice([0, 300, 500]), auto)
        rows = random_rows(rng, rng.randint(1, 60), 300, rng.choice([0.5, 0.9, 1.0]))
        columns = [[r[0] for r in rows], [r[1] for r in rows], [None] * len(rows)]
        _compare(machine, columns, rng)


def test_throttle_chunks_compose():
    rng = random.Random(2)
    for _ in range(400):
        machine = Throttle(*rng.choice([(1800, 2500), (500, 500), (2500, 900)]))
        rows = random_rows(rng, rng.randint(1, 60), 600, 0)
        columns = [[r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
        _compare(machine, columns, rng)


def _compare(machine, columns, rng):
    n = len(columns[0])
    cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 6)))})
    plain, linked = machine.initial, machine.initial
    for a, b in zip(cuts, cuts[1:]):
        part = [c[a:b] for c in columns]
        assert linked == plain
        _, plain = machine.run(plain, *part)
        linked = tuple(machine.enter(linked, machine.heads(*part)))
    assert linked == plain


def events(spark, n=900, hot_share=0.6):
    rng = random.Random(4)
    rows, clock = [], {}
    for i in range(n):
        s = "hot" if rng.random() < hot_share else f"s{rng.randint(0, 5)}"
        clock[s] = clock.get(s, 0) + rng.choice([0, 100, 300, 300, 1500])
        rows.append((s, i, clock[s], rng.random() < 0.85, rng.choice("abc"), rng.random() < 0.03))
    return (
        spark.createDataFrame(rows, "session_id string, n int, at long, ok boolean, text string, forced boolean")
        .withColumn("ts", F.timestamp_millis("at"))
        .withColumn("ms", F.col("at"))
        .withColumn("code", F.when(~F.col("ok"), "MOVING"))
        .repartition(5)
    )


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("machine", [Hold(), Throttle()], ids=["hold", "throttle"])
def test_large_sessions_take_chunks_to_the_same_rows(spark, machine):
    rows = events(spark)
    run = lambda bound: collected(fold(rows, machine, ["session_id"], ["ts", "n"], ("ok",), bound))
    assert run(SMALL) == run(HOT)


def test_scan_in_chunks_equals_windows(spark):
    rows = events(spark).cache()
    scans = {
        "p": Scan("prev", F.when(F.col("n") % 3 != 0, F.col("n"))),
        "mx": Scan("max_before", F.col("at") % 97),
        "mn": Scan("min_from", F.col("at") % 89),
        "s": Scan("sum_to", F.col("n").cast("long")),
    }
    keep = ["session_id", "n", *scans]
    plain = Windows().scan(rows, ["session_id"], ["ts", "n"], scans).select(*keep)
    parts = Chunks(900, 40).scan(rows, ["session_id"], ["ts", "n"], scans).select(*keep)
    assert collected(plain) == collected(parts)


def test_once_ends_at_the_first_shot(spark):
    frames = [("a", t) for t in range(0, 3100, 300)] + [("b", 0), ("b", 300)]
    rows = (
        spark.createDataFrame(frames, "session_id string, ms long")
        .withColumn("ts", F.timestamp_millis("ms"))
        .withColumn("ok", F.lit(True))
        .withColumn("code", F.lit(None).cast("string"))
    )
    got = capture.guidance(rows, once=True).orderBy("session_id", "ts", "seq").collect()
    assert [(r.session_id, r.code) for r in got] == [
        ("a", "HOLD_START"), ("a", "HOLDING"), ("a", "WARN"), ("a", "FIRE"),
        ("b", "HOLD_START"), ("b", "HOLDING"),
    ]
    assert [r.remaining_s for r in got][:4] == ["1.0", "0.7", "0.4", "0.0"]


def test_remaining_rounds_as_decimal_text_of_the_binary_value(spark):
    left = [250, 750, 150, 50, 350, 1000, 0, 1250]
    df = spark.createDataFrame([(i, 2000 - v) for i, v in enumerate(left)], "i int, e long")
    got = [r[0] for r in df.orderBy("i").select(capture.remaining(F.col("e"), 2000)).collect()]
    # 0.15 lies below its tie in binary, 0.05 and 0.35 do not lie above and below alike.
    assert got == ["0.3", "0.8", "0.1", "0.1", "0.3", "1.0", "0.0", "1.3"]


def test_ladder(spark):
    yes, no = True, False
    table = [
        ((no, yes, yes, yes, yes, 500.0, yes), "NO_DOC"), ((yes, yes, yes, yes, yes, 79.9, yes), "BLURRY"),
        ((yes, yes, yes, yes, yes, 80.0, yes), "ADJUSTING"), ((yes, yes, yes, yes, yes, 160.0, no), "MOVING"),
        ((yes, yes, yes, yes, yes, 160.0, yes), None), ((yes, no, no, no, no, 1.0, yes), "ALL_OUT"),
        ((yes, no, no, yes, no, 1.0, yes), "TOP"), ((yes, yes, no, no, no, 1.0, yes), "BOTTOM"),
        ((yes, no, yes, no, yes, 1.0, yes), "LEFT"), ((yes, yes, no, yes, no, 1.0, yes), "RIGHT"),
        ((yes, no, yes, yes, no, 1.0, yes), "TL"), ((yes, yes, no, no, yes, 1.0, yes), "TR"),
        ((yes, yes, yes, no, yes, 1.0, yes), "BL"), ((yes, yes, yes, yes, no, 1.0, yes), "BR"),
    ]
    df = spark.createDataFrame(
        [(i, *t) for i, (t, _) in enumerate(table)],
        "i int, has_document boolean, lock_tl boolean, lock_tr boolean, lock_bl boolean, lock_br boolean, focus double, stable boolean",
    )
    got = df.orderBy("i").select(capture.waiting_code(), capture.ready()).collect()
    assert [r[0] for r in got] == [code for _, code in table]
    assert [r[1] for r in got] == [code is None for _, code in table]


def test_messages_without_voice(spark):
    df = spark.createDataFrame([("WARN", True), ("NO_DOC", False), ("HOLDING", False)], "code string, forced boolean")
    assert capture.messages(df).count() == 2
    assert [r.code for r in capture.messages(df, voice=False).collect()] == ["WARN"]


@pytest.mark.parametrize("kind", ["hold", "once", "throttle"])
def test_chunks_with_pauses_compose(kind):
    """As above, with an idle time and with sessions that end at a shot."""
    rng = random.Random(3)
    for _ in range(300):
        machine = Throttle(400, 700) if kind == "throttle" else Hold(600, None, True, kind == "once")
        if rng.random() < 0.7:
            machine = Idle(machine, rng.choice([200, 900]))
        rows = random_rows(rng, rng.randint(1, 60), 300, 0.9)
        columns = [[r[0] for r in rows], [r[1] for r in rows], [None if r[1] else "MOVING" for r in rows]]
        if kind == "throttle":
            columns = [[r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
        state, plain_state = machine.initial, machine.initial
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in columns]
            state = machine.enter(state, machine.heads(*part))
            plain_state = machine.run(plain_state, *part)[1]
            assert tuple(state) == tuple(plain_state)


def test_reports_of_dense_chunks_are_short():
    n = 5000
    assert len(Hold().heads([0] * n, [True] * n, [None] * n)) <= 3
    assert len(Throttle().heads([0] * n, ["a", "b"] * (n // 2), [False] * n)) <= 3


def test_warning_follows_the_hold():
    assert Hold(3000).warn_ms == 2500 and Hold(3000, 100).warn_ms == 100


def test_a_fold_runs_once(spark):
    """Hold, end at the shot and throttle are one pass each; nothing is counted by running them."""
    df = spark.createDataFrame([("a", 0), ("a", 500)], "session_id string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    rows = df.withColumn("ok", F.lit(True)).withColumn("code", F.lit(None).cast("string"))
    sizes = Bound(sizes=rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows")))
    events = capture.guidance(rows, once=True, bound=sizes)
    plan = capture.throttle(capture.messages(events), ["ts", "seq"], bound=sizes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


# ------------------------------------------------------------- start and stop
def switched_rows(rng, n):
    rows = random_rows(rng, n, 300, 0.9)
    return [(t, ok, code, rng.choice([None] * 8 + ["start", "stop"])) for t, ok, code, _ in rows]


def plain_switched(machine, rows):
    """Each stretch between rows of control as a session of its own."""
    out, running, part = [], True, []
    for i, row in enumerate([*rows, (None, None, None, "stop")]):
        if row[3] is None:
            part.append((i, row))
            continue
        if running and part:
            found, _ = machine.run(machine.initial, *map(list, zip(*[r[:3] for _, r in part])))
            out += [(part[e[0]][0], *e[1:]) for e in found]
        running, part = row[3] == "start", []
    return out


def test_control_rows_start_and_stop_a_session():
    rng = random.Random(12)
    for _ in range(300):
        rows, machine = switched_rows(rng, rng.randint(1, 60)), Hold()
        whole = Switched(machine)
        found, state = whole.run(whole.initial, *map(list, zip(*rows)))
        assert found == plain_switched(machine, rows)
        # Any cut into pieces, and chunks that are entered by their reports, come to the same.
        cut = rng.randrange(len(rows) + 1)
        pieces, entered, at = [], whole.initial, whole.initial
        for start, part in ((0, rows[:cut]), (cut, rows[cut:])):
            if part:
                columns = list(map(list, zip(*part)))
                out, at = whole.run(at, *columns)
                pieces += [(row[0] + start, *row[1:]) for row in out]
                entered = whole.enter(entered, whole.heads(*columns))
                assert tuple(entered) == tuple(at)
        assert pieces == found and tuple(at) == tuple(state)


def test_switched_sessions_in_chunks(spark):
    """A hot session in chunks gives what the plain walk gives."""
    rng = random.Random(3)
    rows = [(f"s{k}", i, *r) for k, n in enumerate((3, 200)) for i, r in enumerate(switched_rows(rng, n))]
    df = spark.createDataFrame(rows, "session_id string, n int, ms long, ok boolean, code string, control string")
    for bound in (Bound(), HOT):
        found = fold(df, Switched(Hold()), ["session_id"], ["ms", "n"], (), bound).collect()
        got = sorted((r["session_id"], r["n"], r["seq"], r["code"], r["elapsed_ms"]) for r in found if r["code"])
        expected = []
        for key in ("s0", "s1"):
            own = [r for r in rows if r[0] == key]
            expected += [(key, own[i][1], seq, code, e) for i, seq, code, e in plain_switched(Hold(), [r[2:] for r in own])]
        assert sorted(got, key=str) == sorted(expected, key=str)
