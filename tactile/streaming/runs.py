"""Session machines on a stream with state in pieces, behind ``transformWithStateInPandas``.

``capture.fold_stream`` keeps what waits of a session in one value, which each micro-batch reads and
writes whole. Here the rows of a micro-batch are put down as runs, one for each bucket of
``BUCKET_MS`` they fall into, and are read once, when a timer says that no earlier row can come: what
a batch touches follows its new rows. A bucket that is due in part is put back as one run. Beside the
runs a session keeps its machine's state and one small entry per bucket that waits.

Needs the state store that has maps and timers (``ROCKS`` as ``PROVIDER`` in the session).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tactile.operators.sessions import emitted, ordered_columns

# Names of Spark's setting and of its class.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_MS = 1_000
SLICE_ROWS = 2_000
LATE = "late"
ALWAYS = -(1 << 62)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def late_rows(machine, pdf: pd.DataFrame, keep: list[str]) -> pd.DataFrame:
    blank = [tuple([i, *[None] * len(machine.outputs)]) for i in range(len(pdf))]
    return emitted(machine, pdf, keep, blank).assign(**{LATE: True})


class Waiting:
    """Entries ``bucket: (runs, first ms)`` of a session, as one small value."""

    def __init__(self, data: bytes | None):
        rows = np.frombuffer(bytes(data or b""), np.int64).reshape(-1, 3).tolist()
        self.of = {bucket: (runs, first) for bucket, runs, first in rows}

    def bytes(self) -> bytes:
        return np.array([(b, *self.of[b]) for b in sorted(self.of)], np.int64).tobytes()

    def first_ms(self) -> int | None:
        return min((first for _, first in self.of.values()), default=None)


class Fold(StatefulProcessor):
    """A machine over the rows of a session in event order. Rows that come once their time is over
    come out as late; rows without a session only move time on."""

    def __init__(self, machine, held: pa.Schema, order: list[str], keep: list[str], grace_ms: int, idle_ms: int | None):
        self.machine, self.held, self.order, self.keep = machine, held, order, keep
        self.grace_ms, self.idle_ms = grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{name} {kind}" for name, kind in self.machine.state)
        self.handle = handle
        self.entering = handle.getValueState("entering", f"{kinds}, _last_ms bigint, _waiting binary")
        self.runs = handle.getMapState("runs", "bucket bigint, run int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            for _ in rows:
                pass
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        horizon = self._horizon(watermark)
        pieces = []
        for pdf in rows:
            late = pdf["ms"] < horizon
            if late.any():
                yield late_rows(self.machine, pdf[late], self.keep)
            if not late.all():
                pieces.append(pa.Table.from_pandas(pdf[~late], self.held, preserve_index=False))
        if not pieces:
            return
        entering, last_ms, waiting = self._state()
        self._put(waiting, pa.concat_tables(pieces).sort_by("ms"))
        self.entering.update((*entering, last_ms, waiting.bytes()))
        self._wake(waiting.first_ms() + 1, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entering.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        horizon = self._horizon(watermark)
        entering, last_ms, waiting = self._state()
        for bucket in sorted(b for b, (_, first) in waiting.of.items() if first < horizon):
            table = self._take(waiting, bucket).sort_by([(c, "ascending") for c in self.order])
            ready = int(np.searchsorted(table.column("ms").to_numpy(), horizon, side="left"))
            for start in range(0, ready, SLICE_ROWS):
                part = table.slice(start, min(SLICE_ROWS, ready - start)).to_pandas()
                pdf, columns = ordered_columns(self.machine, part, self.order)
                last_ms = int(columns[0][-1])
                out, entering = self.machine.run(entering, *columns)
                if out:
                    yield emitted(self.machine, pdf, self.keep, out).assign(**{LATE: False})
            if ready < table.num_rows:
                self._put(waiting, table.slice(ready))
        first = waiting.first_ms()
        if first is None and self.idle_ms is not None and (last_ms is None or last_ms + self.idle_ms < horizon):
            self.entering.clear()
            return
        self.entering.update((*entering, last_ms, waiting.bytes()))
        if first is not None:
            self._wake(first + 1, watermark)
        elif self.idle_ms is not None:
            self._wake(last_ms + self.idle_ms + 2, watermark)

    def close(self) -> None:
        pass

    def _horizon(self, watermark: int) -> int:
        """Nothing before this can still come in time."""
        return watermark + self.grace_ms if watermark > 0 else ALWAYS

    def _state(self) -> tuple[tuple, int | None, Waiting]:
        if not self.entering.exists():
            return tuple(self.machine.initial), None, Waiting(None)
        *entering, last_ms, waiting = self.entering.get()
        return tuple(entering), last_ms, Waiting(waiting)

    def _put(self, waiting: Waiting, table: pa.Table) -> None:
        """Rows in order of ``ms`` as one more run of each of their buckets."""
        ms = table.column("ms").to_numpy()
        buckets = ms // BUCKET_MS
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(ms)]
        for start, end in zip(edges, edges[1:], strict=False):
            bucket, first = int(buckets[start]), int(ms[start])
            runs, before = waiting.of.get(bucket, (0, first))
            self.runs.updateValue((bucket, runs), (packed(table.slice(start, end - start)),))
            waiting.of[bucket] = (runs + 1, min(before, first))

    def _take(self, waiting: Waiting, bucket: int) -> pa.Table:
        keys = [(bucket, run) for run in range(waiting.of.pop(bucket)[0])]
        table = pa.concat_tables([unpacked(self.runs.getValue(k)[0]) for k in keys])
        for k in keys:
            self.runs.removeKey(k)
        return table

    def _wake(self, due: int, watermark: int) -> None:
        self.handle.registerTimer(max(due - self.grace_ms, max(watermark, 0) + 1))
