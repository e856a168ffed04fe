"""The per-user state of strict histories on a stream."""

from __future__ import annotations

import itertools
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark starts the worker that reads a processor's state variables before shipped files are on its path,
# so the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


ROWS = 256  # of a chunk of pending events, which is cut when it has twice as many


class HistoryProcessor(StatefulProcessor):
    """Per user: the last h items before the open instant, and the events after it in chunks, each from one time to the next one's.

    A batch reads and writes the chunks of its own events only, and closing reads the chunks that the watermark has reached and the
    first one behind it; what waits in later chunks is not touched. Every call to the state is a message between processes, so a
    chunk is as many events as one message may well carry, however their times lie.
    """

    def __init__(self, h: int):
        self.h = h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "t bigint, event_id string, item_id string")
        self.pending = handle.getMapState("chunks", "b bigint", "t array<bigint>, event_id array<string>, item_id array<string>")
        self.open = handle.getValueState("open", "b array<bigint>")
        self.timer = handle.getValueState("timer", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for frame in rows:
            new |= zip(zip(frame["t"].astype(int).tolist(), frame["event_id"].tolist()), frame["item_id"].tolist())
        known = self._open()
        # what is earlier than all chunks goes to the first one
        own: dict = {}
        for (t, event), item in new.items():
            own.setdefault(known[max(bisect_right(known, t) - 1, 0)] if known else None, {})[t, event] = item
        starts = set(known)
        for b, some in own.items():
            held = {} if b is None else self._get(b)
            if b is not None and b > min(some)[0]:
                self.pending.removeKey((b,))
                starts.discard(b)
            starts |= self._fill(b, held | some)
        if starts != set(known):
            self.open.update((sorted(starts),))
        first = min((t for t, _ in new), default=None)
        held = self.timer.get()
        if first is not None and (held is None or first < held[0]):
            self._wait(first)
        yield from self._close(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, timerValues.getCurrentWatermarkInMs())

    def _open(self) -> list:
        """Where chunks start, in order."""
        held = self.open.get()
        return [] if held is None else [int(b) for b in held[0]]

    def _fill(self, b: int | None, rows: dict) -> set:
        """Write the events of the chunk from b, cut where it is too long and the time changes; return where the pieces start."""
        order = sorted(rows, key=lambda k: k[0])
        pieces = [[]]
        for i, k in enumerate(order):
            if len(order) > 2 * ROWS and len(pieces[-1]) >= ROWS and k[0] != order[i - 1][0]:
                pieces.append([])
            pieces[-1].append(k)
        starts = [piece[0][0] for piece in pieces]
        if b is not None:
            starts[0] = min(b, starts[0])  # of a chunk of which the first events have closed, b is earlier than the rest
        for start, piece in zip(starts, pieces):
            self._put(start, {k: rows[k] for k in piece})
        return set(starts)

    def _get(self, b: int) -> dict:
        t, event, item = self.pending.getValue((b,))
        return {(int(x), y): z for x, y, z in zip(t, event, item)}

    def _put(self, b: int, rows: dict) -> None:
        self.pending.updateValue((b,), ([t for t, _ in rows], [e for _, e in rows], list(rows.values())))

    def _wait(self, t: int) -> None:
        self.timer.update((t,))
        self.handle.registerTimer(t * 1000)

    def _close(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Emit every event at or before the watermark; the rest stays pending."""
        columns = ["user_id", "event_id", "t", "history"]
        held = self.timer.get()
        if held is None or held[0] * 1000 > watermark_ms:
            return
        closed, later, left = [], None, self._open()
        while left:
            rows = self._get(left[0])
            due = {k: item for k, item in rows.items() if k[0] * 1000 <= watermark_ms}
            closed += [(t, event, item) for (t, event), item in due.items()]
            if len(due) < len(rows):
                rest = {k: item for k, item in rows.items() if k not in due}
                later = min(t for t, _ in rest)
                if due:
                    self._put(left[0], rest)
                break
            self.pending.removeKey((left.pop(0),))
        past, out = [tuple(x) for x in self.past.get()], []
        for _, block in itertools.groupby(sorted(closed), key=lambda x: x[0]):
            tied = list(block)
            # a row that came late, yet before Spark drops it, must not see what happened after it
            items = [x[2] for x in past if x[0] < tied[0][0]]
            out += [(key[0], event, t, items) for t, event, _ in tied]
            past = sorted(past + tied)[-self.h :]
        if past:
            self.past.put(past)
        if later is None:
            self.timer.clear()
            self.open.clear()
        else:
            self.open.update((left,))
            self._wait(later)
        if out:
            yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass
