"""Live capture: the batch machines behind ``applyInPandasWithState``.

The result does not depend on how frames are cut into micro-batches, nor on their order within
``delay``. A session's frames wait in its state until no earlier one can come any more, and then
run in event order. A frame that comes later than that is not run: it is returned with ``late``
set, to be counted or written elsewhere. The watermark trails ``grace`` behind ``delay``, so that
Spark hands late frames over; those beyond both are dropped by Spark, which counts them in the
metric ``numRowsDroppedByWatermark`` of the query.

State per session: pixels of the last frame, the hold, the last message, and the waiting frames,
as many as come within ``delay`` and one micro-batch. With ``idle_ms`` a pause ends a session, in
batch as on a stream, and its state is freed once the pause is over; without, small states stay.

A row without ``session_id`` only moves time on: bounded input ends with one (``closing_row``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tactile.operators import capture, frames
from tactile.operators.sessions import (
    HOLD_MS, Hold, Idle, Throttle, emitted, schema_of,
)
from tactile.streaming import runs
from tactile.streaming.runs import LATE, SLICE_ROWS, late_rows

DELAY_MS = 10_000
GRACE_MS = 60_000
END = "2200-01-01"


def closing_row(rows: DataFrame) -> DataFrame:
    """A row like those of ``rows`` that moves time to the end: what waits comes out after it."""
    kinds = {c: rows.schema[c].dataType for c in ("session_id", "ts")}
    return rows.limit(1).withColumns(
        {"session_id": F.lit(None).cast(kinds["session_id"]), "ts": F.lit(END).cast(kinds["ts"])}
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    """Times stay as pandas has them, without a zone."""
    return pa.schema(
        [(f.name, pa.timestamp("us") if isinstance(f.dataType, T.TimestampType) else to_arrow_type(f.dataType)) for f in schema]
    )


def fold_stream(
    df: DataFrame,
    machine,
    order: list[str],
    carry: tuple[str, ...] = (),
    delay_ms: int | None = DELAY_MS,
    grace_ms: int = GRACE_MS,
    idle_ms: int | None = None,
    in_runs: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """T3, T5, T6, T7. A session machine on a stream: the rows ``sessions.fold`` gives, with
    ``late`` false, and the frames that came too late, with ``late`` true and nothing emitted.
    ``df`` has ``session_id``, ``ts`` (timestamp), ``ms`` (``ts`` in milliseconds) and the
    machine's columns; ``order`` starts with ``ts``. ``delay_ms=None`` keeps the watermark that
    ``df`` has already; Spark drops and counts what is late then. With ``in_runs`` what waits is kept
    in pieces (``runs``), for long delays or many frames a session. ``buckets`` is for many sessions of
    few frames: that many groups, dealt by the hash of the session, share a call and a value of state
    each, as a call takes far longer than the rows of such a session. It cannot change between runs on
    one checkpoint."""
    if in_runs and buckets is not None:
        raise ValueError("sessions kept in runs have groups of their own")
    if idle_ms is not None:
        machine = Idle(machine, idle_ms)
    keep = ["session_id", *order, *carry]
    rows = df.select(*dict.fromkeys([*keep, *machine.inputs]))
    if delay_ms is None:
        grace_ms = 0
    else:
        rows = rows.withWatermark("ts", f"{delay_ms + grace_ms} milliseconds")
    held = _arrow_schema(rows.schema)
    schema = schema_of(df, keep, [*machine.outputs, (LATE, "boolean")])
    if in_runs:
        fold = runs.Fold(machine, held, order, keep, grace_ms, idle_ms)
        return rows.groupBy("session_id").transformWithStateInPandas(fold, schema, "Append", "EventTime")

    key_column, key_of = "session_id", F.col("session_id")
    if buckets is not None:
        key_column, key_of = "_bucket", F.when(key_of.isNotNull(), F.pmod(F.xxhash64(key_of), F.lit(buckets)))
    entering = _arrow_schema(schema_of(df, ["session_id"], [*machine.state, ("_last_ms", "bigint")]))

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            for _ in pdfs:
                pass
            return
        watermark = state.getCurrentWatermarkMs()
        # Nothing before this can still come in time.
        horizon = watermark + grace_ms if watermark > 0 else -(1 << 62)
        before, waiting = state.get if state.exists else (None, None)
        known = {} if before is None else {row[0]: row[1:] for row in _rows(runs.unpacked(before))}
        pieces = [runs.unpacked(waiting)] if waiting is not None else []
        for pdf in () if state.hasTimedOut else pdfs:
            late = pdf["ms"] < horizon
            if late.any():
                yield late_rows(machine, pdf[late], keep)
            pieces.append(pa.Table.from_pandas(pdf[~late], held, preserve_index=False))
        table = pa.concat_tables(pieces) if pieces else held.empty_table()
        is_due = pc.less(table.column("ms"), horizon)
        due, rest = table.filter(is_due), table.filter(pc.invert(is_due))
        due = due.sort_by([(c, "ascending") for c in ("session_id", *order)])
        for start in range(0, due.num_rows, SLICE_ROWS):
            out = _walk(machine, due.slice(start, SLICE_ROWS), keep, known)
            if len(out):
                yield out.assign(**{LATE: False})
        wakes = [pc.min(rest.column("ms")).as_py() + 1] if rest.num_rows else []
        if idle_ms is not None:
            busy = set(rest.column("session_id").to_pylist())
            quiet = {s: row[-1] + idle_ms for s, row in known.items() if s not in busy}
            known = {s: row for s, row in known.items() if s in busy or quiet[s] >= horizon}
            wakes += [quiet[s] + 2 for s in known if s in quiet]
        if not known and not rest.num_rows:
            if state.exists:
                state.remove()
            return
        after = [(s, *row) for s, row in known.items()]
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*after), entering)], entering) if after else None
        state.update((table and runs.packed(table), runs.packed(rest) if rest.num_rows else None))
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes) - grace_ms, max(watermark, 0) + 1))

    return rows.withColumn(key_column, key_of).groupBy(key_column).applyInPandasWithState(
        step,
        schema,
        "_entering binary, _waiting binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in table.columns]))


def _walk(machine, table: pa.Table, keep: list[str], known: dict) -> pd.DataFrame:
    """Run rows sorted by session; ``known`` has each session's state and last time, and gets the new ones."""
    columns = [table.column(c).to_pylist() for c in machine.inputs]
    sessions, ms, out, start = table.column("session_id").to_pylist(), table.column("ms").to_pylist(), [], 0
    for session, rows in groupby(sessions):
        end = start + sum(1 for _ in rows)
        *entering, _ = known.get(session, (*machine.initial, None))
        part, entering = machine.run(tuple(entering), *[c[start:end] for c in columns])
        known[session] = (*entering, ms[end - 1])
        out += [(row[0] + start, *row[1:]) for row in part]
        start = end
    return emitted(machine, table.select(keep).to_pandas(), keep, out)


class Live:
    """T1, T2, T5-T7 on frames in order: motion, hold and throttle in one pass.

    ``still`` says that a frame would be ready if the camera did not move, ``code`` is the code
    of a frame for which it is false.
    """

    inputs = ["ms", "still", "code", "luma"]
    outputs = [
        ("seq", "int"), ("code", "string"), ("elapsed_ms", "bigint"),
        ("motion", "double"), ("spoken", "boolean"),
    ]
    state = [("luma", "binary"), *Hold.state, *Throttle.state]
    initial = (None, *Hold.initial, *Throttle.initial)

    def __init__(self, hold: Hold, throttle: Throttle, motion_limit: float, voice: bool = True):
        self.hold, self.throttle = hold, throttle
        self.motion_limit, self.voice = motion_limit, voice

    def run(self, state, ms, still, code, luma):
        before, start, warned, last_ms, last_text = state
        before = None if before is None else bytes(before)
        motion = []
        for px in luma:
            motion.append(_difference(before, px))
            before = px
        ok = [s and m < self.motion_limit for s, m in zip(still, motion)]
        codes = ["MOVING" if s and not o else c for s, o, c in zip(still, ok, code)]
        events, hold_state = self.hold.run((start, warned), ms, ok, codes)
        said = [
            e for e in range(len(events))
            if events[e][2] in capture.UTTERANCES and (self.voice or events[e][2] in capture.FORCED)
        ]
        passed, talk_state = self.throttle.run(
            (last_ms, last_text),
            [ms[events[e][0]] for e in said],
            [capture.UTTERANCES[events[e][2]] for e in said],
            [events[e][2] in capture.FORCED for e in said],
        )
        spoken = {said[p[0]] for p in passed}
        out = [(*ev, motion[ev[0]], e in spoken) for e, ev in enumerate(events)]
        return out, (before, *hold_state, *talk_state)


def _difference(before: bytes | None, now: bytes | None) -> float:
    if before is None or now is None or len(before) != len(now) or not now:
        return 0.0
    a, b = (np.frombuffer(p, np.uint8).astype(np.int64) for p in (before, now))
    return int(np.abs(a - b).sum()) / len(a)


def live_rows(
    frame_rows: DataFrame,
    focus_limits: tuple[float, float] = capture.FOCUS_LIMITS,
    flag_limits: dict[str, float] | None = None,
) -> DataFrame:
    """Stateless part: metrics, flags, and the code with motion left out."""
    metrics = frames.frame_metrics(frame_rows).withColumn("motion", F.lit(0.0))
    flags = frames.frame_flags(metrics, **(flag_limits or {}))
    return flags.select(
        "session_id",
        "ts",
        capture.millis(F.col("ts")).alias("ms"),
        capture.ready(focus_limits[1]).alias("still"),
        capture.waiting_code(focus_limits).alias("code"),
        "luma",
    )


def live_capture(
    frame_rows: DataFrame,
    voice: bool = True,
    auto_capture: bool = True,
    delay_ms: int | None = DELAY_MS,
    grace_ms: int = GRACE_MS,
    idle_ms: int | None = None,
    hold_ms: int = HOLD_MS,
    warn_ms: int | None = None,
    focus_limits: tuple[float, float] = capture.FOCUS_LIMITS,
    flag_limits: dict[str, float] | None = None,
    in_runs: bool = False,
) -> DataFrame:
    """T1-T7 as one streaming plan over frames of ``sources.frames``: every emitted code with the
    motion it was judged by and whether its message is spoken. ``voice`` and ``auto_capture`` are
    the switches of T4; ``flag_limits`` are keywords of ``frames.frame_flags``; ``in_runs`` as in
    ``fold_stream``."""
    motion_limit = (flag_limits or {}).get("motion_limit", frames.MOTION_LIMIT)
    machine = Live(Hold(hold_ms, warn_ms, auto_capture), Throttle(), motion_limit, voice)
    rows = live_rows(frame_rows, focus_limits, flag_limits)
    return fold_stream(rows, machine, ["ts"], (), delay_ms, grace_ms, idle_ms, in_runs)
