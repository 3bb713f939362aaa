"""Stateful streams with ``transformWithState``: reports every N batches (ST2) and time limits of units (ST3).

State and timers live in RocksDB state stores (``state_store`` sets them up in
the session), so a key's state may be larger than memory. The rows of a key
come as an iterator of frames; nothing of a key is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, which timers and maps of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


# ------------------------------------------------------------------ ST2

_CURVE = "run string, batch long, steps long, avg_loss double, accuracy double"


class _Curve(StatefulProcessor):
    """Sums per block of ``every`` batches until all earlier blocks are whole, then one report a block."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "loss double, correct long, total long, seen binary")
        self.done = handle.getValueState("done", "block long, steps long, loss double, correct long, total long")
        self.last = handle.getValueState("last", "batch long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        reported = self.done.get() if self.done.exists() else (0, 0, 0.0, 0, 0)
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            ends = pdf.loc[pdf["ends"].fillna(False).astype(bool), "batch"]
            if len(ends):
                last = int(ends.max())
                self.last.update((last,))
            block = (pdf["batch"] - 1) // self.every + 1
            for b, part in pdf[block > reported[0]].groupby(block):
                self._add(int(b), part)
        out = []
        while True:
            b = reported[0] + 1
            first, size = (b - 1) * self.every + 1, self.every
            if last is not None:
                size = min(size, last - first + 1)
            if size <= 0 or not self.blocks.containsKey((b,)):
                break
            loss, correct, total, seen = self.blocks.getValue((b,))
            if int(np.unpackbits(np.frombuffer(seen, np.uint8)).sum()) < size:
                break
            self.blocks.removeKey((b,))
            reported = (b, reported[1] + size, reported[2] + loss, reported[3] + correct, reported[4] + total)
            out.append((key[0], first + size - 1, reported[1], reported[2] / reported[1], reported[3] / reported[4] if reported[4] else 0.0))
        if out:
            self.done.update(reported)
        yield pd.DataFrame(out, columns=["run", "batch", "steps", "avg_loss", "accuracy"])

    def _add(self, block: int, part: pd.DataFrame) -> None:
        """Add the batches that the block has not seen: each counts once however often it comes."""
        if self.blocks.containsKey((block,)):
            loss, correct, total, seen = self.blocks.getValue((block,))
        else:
            loss, correct, total, seen = 0.0, 0, 0, bytes(-(-self.every // 8))
        bits = np.unpackbits(np.frombuffer(seen, np.uint8)).astype(bool)
        part = part.drop_duplicates("batch")
        at = ((part["batch"] - 1) % self.every).to_numpy()
        new = ~bits[at]
        part, at = part[new], at[new]
        bits[at] = True
        self.blocks.updateValue((block,), (loss + float(part["loss"].sum()), correct + int(part["correct"].sum()),
                                           total + int(part["total"].sum()), np.packbits(bits).tobytes()))

    def close(self) -> None:
        pass


def metrics_every(events: DataFrame, run: str, batch: str, loss: str, correct: str, total: str, ends: Column, every: int = 1000) -> DataFrame:
    """ST2: (run, batch, steps, avg_loss, accuracy) cumulative at each ``every``-th batch of a run and at its end.

    Batches are numbered from 1; the row of the last one has ``ends``. They may
    come in any order and cut into micro-batches in any way: a report is made
    once, when all batches up to it are there. A batch that comes again, in the
    same or a later micro-batch, counts once. The state of a run is its open
    blocks, one bit for each of their batches.
    """
    x = events.select(F.col(run).cast("string").alias("run"), F.col(batch).cast("long").alias("batch"), F.col(loss).cast("double").alias("loss"),
                      F.col(correct).cast("long").alias("correct"), F.col(total).cast("long").alias("total"), ends.alias("ends"))
    return x.where("batch >= 1").groupBy("run").transformWithStateInPandas(_Curve(every), _CURVE, "append", "none")


# ------------------------------------------------------------------ ST3

_TIMEOUTS = "proof long, first_ts timestamp, last_ts timestamp, finished boolean, timed_out boolean"


class _Limit(StatefulProcessor):
    """First and last event time of an open unit, and one timer at its deadline."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first_ms long, last_ms long")
        # units told once stay told: what comes late for them starts no second life
        self.told = handle.getValueState("told", "at_ms long")

    @staticmethod
    def _row(key: Any, first: int, last: int, finished: bool, out: bool) -> pd.DataFrame:
        times = [pd.Timestamp(t, unit="ms") for t in (first, last)]
        return pd.DataFrame({"proof": [key[0]], "first_ts": [times[0]], "last_ts": [times[1]], "finished": [finished], "timed_out": [out]})

    def _tell(self, now: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.span.clear()
        self.told.update((now,))
        self.handle.registerTimer(now + self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            for _ in rows:
                pass
            return
        had = self.span.exists()
        first, last = self.span.get() if had else (None, None)
        finished = False
        for pdf in rows:
            lo, hi = int(pdf["ms"].min()), int(pdf["ms"].max())
            begin = lo if first is None else min(first, lo)
            first, last = begin, hi if last is None else max(last, hi)
            finished = finished or bool(pdf["fin"].fillna(False).any())
        if first is None:
            return
        now = timerValues.getCurrentWatermarkInMs()
        if finished or first + self.limit_ms <= now:
            self._tell(max(now, last))
            yield self._row(key, first, last, finished, last - first > self.limit_ms if finished else True)
            return
        if not had or first < self.span.get()[0]:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first + self.limit_ms)
        self.span.update((first, last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            self.told.clear()
            return
        first, last = self.span.get()
        self._tell(timerValues.getCurrentWatermarkInMs())
        yield self._row(key, first, last, False, True)

    def close(self) -> None:
        pass


def unit_timeouts(events: DataFrame, unit: str, ts: str, finished: Column, limit: str = "30 days",
                  watermark: str = "1 day") -> DataFrame:
    """ST3: each unit once, when it finishes (timed_out: only after ``limit``) or when the watermark passes its first
    event + ``limit`` (timed_out, not finished).

    A timer in the state store does the waiting. A unit that was told is
    remembered for another ``limit`` of event time, so events within the
    watermark's delay that come after it are dropped; then its state is gone.
    Events later than the watermark are dropped by the stream itself.
    """
    ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    x = events.select(F.col(unit).cast("long").alias("proof"), F.col(ts).cast("timestamp").alias("ts"), finished.alias("fin"))
    x = x.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    return x.groupBy("proof").transformWithStateInPandas(_Limit(ms, ms), _TIMEOUTS, "append", "eventTime")
