"""State machines over the ordered rows of a session.

A machine is a small object with ``run(state, columns)``: it walks rows in order, returns what
they emit and the state afterwards. The same ``run`` serves batch groups and streaming keys.

Sessions of normal size are walked one after the other in sorted partitions. A larger one is cut
into chunks of bounded size. What a chunk does depends on the state it is entered with, but both machines forget: which row they
restart from decides everything after it. So each chunk first reports, for the few rows at its
head where an entering state can restart, the state it would end in (``heads``); a pass over
these reports, chunk by chunk, finds every entering state (``enter``); then all chunks run in
parallel. The result equals the plain run. Reports are short as long as a chunk lasts well longer
than a hold or a silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tactile.operators.ordered import CHUNK, DEFAULT, Bound, Chunks, chunked, split_hot

# Hold before firing, how long before it the warning comes, silence between messages
# (any, the same one).
HOLD_MS = 1000
WARN_BEFORE_MS = 500
ANY_SILENCE_MS = 1800
SAME_SILENCE_MS = 2500


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(),
}


_PANDAS = {"int": "Int32", "bigint": "Int64", "double": "float64", "boolean": "boolean", "string": "object", "binary": "object"}


class Hold:
    """T5, T6 and the hold part of T2. State: (start of the hold or None, warned).

    Columns: ``ms``, ``ok`` and ``code``, the code of a frame that is not ok (None: nothing).
    Emits (seq, code, elapsed_ms); ``seq`` orders what one frame emits. The warning comes
    ``WARN_BEFORE_MS`` before the end of the hold unless ``warn_ms`` says when. ``once`` ends the
    session at its first shot, as a camera that closes; the state is then (-1, False).
    """

    inputs = ["ms", "ok", "code"]
    outputs = [("seq", "int"), ("code", "string"), ("elapsed_ms", "bigint")]
    state = [("start", "bigint"), ("warned", "boolean")]
    initial = (None, False)

    closed = (-1, False)

    def __init__(self, hold_ms=HOLD_MS, warn_ms=None, auto_capture=True, once=False):
        self.hold_ms, self.auto_capture, self.once = hold_ms, auto_capture, once
        self.warn_ms = hold_ms - WARN_BEFORE_MS if warn_ms is None else warn_ms

    def run(self, state, ms, ok, code):
        start, warned = state
        out = []
        if self.once and state == self.closed:
            return out, state
        for i, now in enumerate(ms):
            if not ok[i]:
                start, warned = None, False
                if code[i] is not None:
                    out.append((i, 0, code[i], None))
                continue
            if start is None:
                start, warned = now, False
                out.append((i, 0, "HOLD_START", 0))
                continue
            elapsed = now - start
            if not warned:
                warned = elapsed >= self.warn_ms
                out.append((i, 0, "WARN" if warned else "HOLDING", elapsed))
            if self.auto_capture and elapsed >= self.hold_ms:
                out.append((i, 1, "FIRE", elapsed))
                if self.once:
                    return out, self.closed
                start, warned = None, False
        return out, (start, warned)

    def heads(self, ms, ok, code):
        """Rows (ms, ok, state at the end of the chunk): first for entering without a hold, then
        for each head row that can end the hold the chunk is entered with; of neighbours that
        lead to the same end only the last, as any hold that ends at one before may end there."""
        ms, n = np.asarray(ms), len(ms)
        fire = np.searchsorted(ms, ms + self.hold_ms) if self.auto_capture else np.full(n, n)
        ends = [self.initial] * (n + 1)  # state at the end when row i is met without a hold
        stop = n  # first row from i on that is not ok
        for i in range(n - 1, -1, -1):
            if not ok[i]:
                stop, ends[i] = i, ends[i + 1]
                continue
            f = max(int(fire[i]), i + 1)
            if f < stop:
                ends[i] = self.closed if self.once else ends[f + 1]
            elif stop < n:
                ends[i] = ends[stop]
            else:
                ends[i] = (int(ms[i]), bool(n - 1 > i and ms[-1] - ms[i] >= self.warn_ms))
        rows = [(int(ms[-1]), False, *ends[0])]
        for i in range(n):
            if not ok[i]:
                rows.append((int(ms[i]), False, *ends[i]))
                break
            if self.auto_capture:
                row = (int(ms[i]), True, *(self.closed if self.once else ends[i + 1]))
                if len(rows) > 1 and rows[-1][2:] == row[2:]:
                    rows.pop()
                rows.append(row)
                if ms[i] - ms[0] >= self.hold_ms:
                    break
        return rows

    head = [("ms", "bigint"), ("ok", "boolean"), *state]

    def enter(self, state, rows):
        """State after a chunk that is entered with ``state``."""
        (last, _, *free), restarts = rows[0], rows[1:]
        start, warned = state
        if self.once and tuple(state) == self.closed:
            return self.closed
        if start is None:
            return tuple(free)
        for ms, ok, *after in restarts:
            if not ok or ms - start >= self.hold_ms:
                return tuple(after)
        return start, bool(warned or last - start >= self.warn_ms)


class Throttle:
    """T7. State: (time, text) of the last message that passed; time None if there is none.

    Columns: ``ms``, ``text``, ``forced``. Emits nothing but the row itself.
    """

    inputs = ["ms", "text", "forced"]
    outputs: list[tuple[str, str]] = []
    state = [("last_ms", "bigint"), ("last_text", "string")]
    initial = (None, None)

    def __init__(self, any_ms=ANY_SILENCE_MS, same_ms=SAME_SILENCE_MS):
        self.any_ms, self.same_ms = any_ms, same_ms
        self.longest = max(any_ms, same_ms)

    def _passes(self, last_ms, last_text, now, text, forced):
        if forced or last_ms is None:
            return True
        quiet = now - last_ms
        return quiet >= self.any_ms and (text != last_text or quiet >= self.same_ms)

    def run(self, state, ms, text, forced):
        last_ms, last_text = state
        out = []
        for i, now in enumerate(ms):
            if self._passes(last_ms, last_text, now, text[i], forced[i]):
                last_ms, last_text = now, text[i]
                out.append((i,))
        return out, (last_ms, last_text)

    head = [("ms", "bigint"), ("text", "string"), ("forced", "boolean"), *state]

    def heads(self, ms, text, forced):
        """Head rows with the last message of the chunk if they pass. A row with the time and text
        of one before passes only where that one does."""
        arr, n = np.asarray(ms), len(ms)
        soonest = np.searchsorted(arr, arr + self.any_ms)
        latest = np.searchsorted(arr, arr + self.longest)
        ends, next_forced = [None] * n, n
        for i in range(n - 1, -1, -1):
            k = max(int(soonest[i]), i + 1)
            stop = min(next_forced, max(int(latest[i]), k))
            while k < stop and not self._passes(ms[i], text[i], ms[k], text[k], forced[k]):
                k += 1
            k = min(k, next_forced)
            ends[i] = ends[k] if k < n else (int(ms[i]), text[i])
            if forced[i]:
                next_forced = i
        rows, seen = [], set()
        for i in range(n):
            if forced[i] or (ms[i], text[i]) not in seen:
                seen.add((ms[i], text[i]))
                rows.append((int(ms[i]), text[i], bool(forced[i]), *ends[i]))
            if forced[i] or ms[i] - ms[0] >= self.longest:
                break
        return rows

    def enter(self, state, rows):
        for ms, text, forced, *after in rows:
            if self._passes(*state, ms, text, forced):
                return tuple(after)
        return state


class Switched:
    """T3. Another machine that rows of control start and stop: at ``start`` and at ``stop`` it forgets
    everything, and between a stop and the next start frames are not looked at. Before the first
    control row a session is on.

    Columns: those of the machine, and ``control`` (``start``, ``stop``, or null on a frame). Rows of
    control emit nothing; they act in the order of the rows, before or after frames of their instant.
    """

    def __init__(self, machine):
        self.machine = machine
        self.inputs, self.outputs = [*machine.inputs, "control"], machine.outputs
        self.state = [("running", "boolean"), *machine.state]
        self.initial = (True, *machine.initial)
        if hasattr(machine, "head"):
            self.head = [("switched", "boolean"), ("running", "boolean"), ("frames", "int"), *machine.head]

    def run(self, state, *columns):
        running, *inner = state
        inner, out, start = tuple(inner), [], 0
        *frames, control = columns
        for at in [*(i for i, c in enumerate(control) if c is not None), len(control)]:
            if running and at > start:
                part, inner = self.machine.run(inner, *[c[start:at] for c in frames])
                out += [(row[0] + start, *row[1:]) for row in part]
            if at < len(control):
                running, inner, start = control[at] == "start", self.machine.initial, at + 1
        return out, (running, *inner)

    def heads(self, *columns):
        """As of the machine for what follows the last row of control."""
        *frames, control = columns
        last = max((i for i, c in enumerate(control) if c is not None), default=-1)
        tail = [c[last + 1 :] for c in frames]
        shared = (last >= 0, last < 0 or control[last] == "start", len(tail[0]))
        rows = self.machine.heads(*tail) if len(tail[0]) else [(None,) * len(self.machine.head)]
        return [(*shared, *row) for row in rows]

    def enter(self, state, rows):
        running, *inner = state
        switched, starts, frames = rows[0][:3]
        if switched:
            running, inner = starts, self.machine.initial
        if running and frames:
            inner = self.machine.enter(tuple(inner), [tuple(row[3:]) for row in rows])
        return (running, *inner)


class Idle:
    """T3. Another machine that starts anew after a pause of more than ``idle_ms``."""

    def __init__(self, machine, idle_ms: int):
        self.machine, self.idle_ms = machine, idle_ms
        self.inputs, self.outputs = machine.inputs, machine.outputs
        self.state = [("seen_ms", "bigint"), *machine.state]
        self.initial = (None, *machine.initial)
        if hasattr(machine, "head"):
            self.head = [("first_ms", "bigint"), ("cut", "boolean"), ("end_ms", "bigint"), *machine.head]

    def _starts(self, ms, before=None) -> list[int]:
        """Rows that come after a pause."""
        gaps = np.flatnonzero(np.diff(np.asarray(ms, dtype=np.int64)) > self.idle_ms) + 1
        first = [0] if before is not None and ms[0] - before > self.idle_ms else []
        return first + gaps.tolist()

    def run(self, state, *columns):
        before, *inner = state
        inner, ms = tuple(inner), columns[0]
        if not len(ms):
            return [], state
        starts = self._starts(ms, before)
        bounds = [0, *[s for s in starts if s], len(ms)]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            if a in starts:
                inner = self.machine.initial
            part, inner = self.machine.run(inner, *[c[a:b] for c in columns])
            out += [(row[0] + a, *row[1:]) for row in part]
        return out, (int(ms[-1]), *inner)

    def heads(self, *columns):
        ms = columns[0]
        starts = self._starts(ms)
        tail = starts[-1] if starts else 0
        shared = (int(ms[0]), bool(starts), int(ms[-1]))
        return [(*shared, *row) for row in self.machine.heads(*[c[tail:] for c in columns])]

    def enter(self, state, rows):
        seen, *inner = state
        first, cut, last = rows[0][:3]
        anew = cut or (seen is not None and first - seen > self.idle_ms)
        inner = self.machine.initial if anew else tuple(inner)
        return (last, *self.machine.enter(inner, [row[3:] for row in rows]))


# ------------------------------------------------------------------------ driver
def plain(values: pd.Series) -> list:
    """A column as Python values, missing ones as None."""
    return values.astype(object).where(values.notna(), None).tolist()


def ordered_columns(machine, pdf: pd.DataFrame, order: list[str]):
    pdf = pdf.sort_values(order, kind="stable")
    return pdf, [plain(pdf[c]) for c in machine.inputs]


def emitted(machine, pdf: pd.DataFrame, keep: list[str], rows: list[tuple]) -> pd.DataFrame:
    """Emitted rows with the key and order columns of the row they come from."""
    index = [r[0] for r in rows]
    out = pdf[keep].iloc[index].reset_index(drop=True)
    for c, (name, kind) in enumerate(machine.outputs, start=1):
        out[name] = pd.Series([r[c] for r in rows], dtype=_PANDAS[kind])
    return out


def schema_of(df: DataFrame, keep: list[str], extra: list[tuple[str, str]]) -> T.StructType:
    types = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType(
        [T.StructField(c, types[c]) for c in keep]
        + [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in extra]
    )


def _run_sorted(machine, group, keep, entering=None):
    """Walk batches sorted by group: a group may start in one batch and end in a later one, so
    memory is bound by the batch and not by the group. ``entering`` names the columns that hold
    the state a group starts with."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, machine.initial
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in group]))
            columns = [batch.column(c).to_pylist() for c in machine.inputs]
            index, emissions, start, n = [], [], 0, batch.num_rows
            while start < n:
                end = start
                while end < n and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key:
                    key = keys[start]
                    state = machine.initial
                    if entering:
                        state = tuple(batch.column(c)[start].as_py() for c in entering)
                out, state = machine.run(state, *[c[start:end] for c in columns])
                index += [start + row[0] for row in out]
                emissions += out
                start = end
            picked = batch.select(keep).take(pa.array(index, pa.int32()))
            extra = [
                pa.array([row[c] for row in emissions], _ARROW[kind])
                for c, (_, kind) in enumerate(machine.outputs, start=1)
            ]
            names = [*keep, *[name for name, _ in machine.outputs]]
            yield pa.RecordBatch.from_arrays([*picked.columns, *extra], names)

    return walk


def _sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def fold(
    df: DataFrame,
    machine,
    group: list[str],
    order: list[str],
    carry: tuple[str, ...] = (),
    bound: Bound = DEFAULT,
    idle_ms: int | None = None,
) -> DataFrame:
    """Run ``machine`` over each group in the given order. ``order`` must start with a column
    that agrees with ``ms``; the columns ``carry`` are copied to what a row emits. A pause of more
    than ``idle_ms`` starts the machine anew."""
    if idle_ms is not None:
        machine = Idle(machine, idle_ms)
    keep = [*group, *order, *carry]
    rows = df.select(*dict.fromkeys([*keep, *machine.inputs]))
    schema = schema_of(df, keep, machine.outputs)
    normal, hot, n_hot = split_hot(rows, group, bound.max_rows, bound.sizes)
    walk = _run_sorted(machine, group, keep)
    parts = [_sorted(normal, group, order).mapInArrow(walk, schema)]
    if hot is not None:
        n_chunks = Chunks(n_hot, bound.chunk_rows).n_chunks
        parts.append(_fold_chunks(hot, machine, group, order, keep, n_chunks))
    return reduce(DataFrame.unionByName, parts)


def _fold_chunks(df, machine, group, order, keep, n_chunks) -> DataFrame:
    schema, key = schema_of(df, keep, machine.outputs), [*group, CHUNK]
    parts = chunked(df, group, order, n_chunks)
    entering = [(f"_enter_{name}", kind) for name, kind in machine.state]
    heads = [(f"_head_{i}", kind) for i, (_, kind) in enumerate(machine.head)]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, columns = ordered_columns(machine, pdf, order)
        rows = machine.heads(*columns)
        out = pd.DataFrame(
            {name: pd.Series([r[i] for r in rows], dtype=_PANDAS[kind]) for i, (name, kind) in enumerate(heads)}
        )
        for c in key:
            out[c] = pdf[c].iloc[0]
        out["_n"] = range(len(rows))
        return out[[*key, "_n", *[name for name, _ in heads]]]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = machine.initial, []
        columns = [name for name, _ in heads]
        for chunk, part in pdf.sort_values([CHUNK, "_n"]).groupby(CHUNK, sort=True):
            rows.append((chunk, *state))
            state = machine.enter(state, list(zip(*[plain(part[c]) for c in columns])))
        out = pd.DataFrame(
            {name: pd.Series([r[i] for r in rows], dtype=_PANDAS[kind])
             for i, (name, kind) in enumerate([(CHUNK, "int"), *entering])}
        )
        for c in group:
            out[c] = pdf[c].iloc[0]
        return out[[*key, *[name for name, _ in entering]]]

    reports = parts.groupBy(*key).applyInPandas(
        report, schema_of(parts, key, [("_n", "int"), *heads])
    )
    states = reports.groupBy(*group).applyInPandas(link, schema_of(parts, key, entering))
    walk = _run_sorted(machine, key, keep, [name for name, _ in entering])
    return _sorted(parts.join(states, key), key, order).mapInArrow(walk, schema)


