"""Event streams: answer deltas with a held-back marker, and windows (an extension)."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Workers may not have this package: what they run of this module goes along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "---CYTATY---"


def fold_deltas(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, answer): all deltas in order, up to the marker."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return deltas.groupBy(key).agg(whole.alias("a")).select(key, F.substring_index("a", MARK, 1).alias("answer"))


def _shown(tail: str, done: bool, deltas) -> tuple[str, str, bool]:
    """(shown, tail, done) after some deltas: the longest end that a marker could begin with is held back."""
    out = tail + "".join(t for t in deltas if isinstance(t, str))
    if done:
        return "", "", True
    if MARK in out:
        return out[: out.index(MARK)], "", True
    keep = next(n for n in range(min(len(MARK) - 1, len(out)), -1, -1) if out.endswith(MARK[:n]))
    return out[: len(out) - keep], out[len(out) - keep :], False


def stream_deltas(deltas: DataFrame, key: str, text: str, order: str | None = None, last: str | None = None) -> DataFrame:
    """(key, shown) for a stream of deltas: what may be shown so far, never part of a marker that
    goes on in a later delta; nothing after the marker.

    Only the held-back tail is kept of an answer, and no more than a flag after its marker.  Deltas of one
    batch are taken in the order of the column `order`; the one with a true `last` shows the tail and ends
    the answer's state.  A null delta is an empty one."""

    def show(k, batches, state):
        import pandas as pd

        tail, done = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches))
        rows = rows.sort_values(order, kind="stable") if order else rows
        ended = bool(last and rows[last].fillna(False).any())
        out, tail, done = _shown(tail, done, rows[text])
        if ended:
            out += tail
            if state.exists:
                state.remove()
        else:
            state.update((tail, done))
        yield pd.DataFrame({key: [k[0]], "shown": [out]})

    kind = deltas.schema[key].dataType.simpleString()
    return deltas.groupBy(key).applyInPandasWithState(show, f"{key} {kind}, shown string", "tail string, done boolean", "append", "NoTimeout")


class _Answer(StatefulProcessor):
    """What `shown_by` keeps of an answer: the held-back tail, and whether its marker was seen."""

    def __init__(self, key: str, text: str, order: str, last: str | None, wait_ms: int):
        self.key, self.text, self.order, self.last, self.wait_ms = key, text, order, last, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "tail string, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        tail, done = self.state.get() if self.state.exists() else ("", False)
        rows = sorted(rows, key=lambda r: r[self.order])
        out, tail, done = _shown(tail, done, [r[self.text] for r in rows])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.last and any(r[self.last] for r in rows):
            self.state.clear()
            out += tail
        else:
            self.state.update((tail, done))
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), *(r["__at"] or 0 for r in rows)) + self.wait_ms)
        yield Row(**{self.key: key[0], "shown": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        tail, _ = self.state.get() if self.state.exists() else ("", False)
        self.state.clear()
        if tail:
            yield Row(**{self.key: key[0], "shown": tail})

    def close(self) -> None:
        pass


def shown_by(deltas: DataFrame, key: str, text: str, order: str, time: str, wait_ms: int, last: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, shown) as `stream_deltas`, of answers that may never end: one without a delta until the watermark (of column
    `time`, `late`) has gone `wait_ms` milliseconds further shows its tail, and its state goes.  Needs the RocksDB state store."""
    stream = deltas.withWatermark(time, late).withColumn("__at", F.unix_millis(time))
    kind = deltas.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithState(_Answer(key, text, order, last, wait_ms), f"{key} {kind}, shown string", "append", "eventTime")


def windowed(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total); with a watermark of `late` on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    got = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
