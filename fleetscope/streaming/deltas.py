"""Streaming snapshot deltas (STR-1).

``groupBy(server, keys).transformWithStateInPandas`` keeps keyed state with timers, per series:

* ``last``: the last emitted snapshot (one value),
* ``pending``: snapshots not yet behind the watermark, a map from time bucket to the bucket's snapshots.

An arriving snapshot touches its own bucket only; nothing else of the series' state is read or written again.  Every
bucket arms an event-time timer at its end.  When the watermark has passed it, the bucket's snapshots are put in order,
become deltas, and leave the state, so arrival order does not matter; snapshots at or before the last emitted one are late
and dropped.  The last snapshot arms a timer of its own: after the bucket ``max_minutes`` ahead no delta to it could be valid, so
its state ends then.  A series holds at most the snapshots inside the watermark's delay and one more bucket.

The operator needs a state store with column families (RocksDB): see :data:`STATE_STORE`.  The result equals the
batch :func:`fleetscope.operators.snapshots.snapshot_delta` with ``strict=False`` on the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from ..functions.scalar import ntz_to_instant

#: session settings under which the stream has to be started
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_snapshot_delta(stream: DataFrame, keys: Sequence[str], counters: Sequence[str], *, ts: str = "check_ts",
                          server: str = "server_name", watermark: str = "2 hours", min_minutes: int = 1,
                          max_minutes: int = 60, bucket_minutes: int = 60) -> DataFrame:
    """STR-1: reset-aware per-series deltas of a stream of counter snapshots."""
    group = [server, *keys]
    counters = list(counters)
    out_schema = StructType([StructField(f.name, f.dataType) for f in (stream.schema[c] for c in group)] + [
        StructField(ts, TimestampNTZType()), StructField("prev_ts", TimestampNTZType()),
        StructField("elapsed_seconds", LongType()), StructField("elapsed_minutes", LongType())] +
        [StructField(f"{c}_delta", LongType()) for c in counters])
    names = [f.name for f in out_schema.fields]
    bucket_ms, second, minute = bucket_minutes * 60_000, 1_000_000, 60_000_000
    keep_ms = (max_minutes + 1) * 60_000

    # nested, so that workers get the class with the query and need not import this package
    class SeriesDeltas(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, vals array<bigint>, ends long")
            self.pending = handle.getMapState("pending", "bucket long", "at array<bigint>, vals array<array<bigint>>")

        def handleInputRows(self, key, rows, timerValues):
            newest = self.last.get()[0] if self.last.exists() else None
            arrived: dict[int, list] = {}
            for pdf in rows:
                at = pdf[ts].astype("datetime64[us]").astype("int64")
                for t, *vals in zip(at, *(pdf[c] for c in counters), strict=True):
                    if newest is None or t > newest:
                        arrived.setdefault(t // 1000 // bucket_ms, []).append((t, [int(v) for v in vals]))
            for bucket, found in arrived.items():
                times, values = [], []
                if self.pending.containsKey((bucket,)):
                    times, values = map(list, self.pending.getValue((bucket,)))
                else:
                    self.handle.registerTimer((bucket + 1) * bucket_ms)
                self.pending.updateValue((bucket,), (times + [t for t, _ in found], values + [v for _, v in found]))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs()
            bucket = now // bucket_ms - 1
            before = self.last.get() if self.last.exists() else None
            if now % bucket_ms or not self.pending.containsKey((bucket,)):
                if before is not None and before[2] <= now:
                    self.last.clear()
                return
            first_of: dict[int, list] = {}
            for t, vals in zip(*self.pending.getValue((bucket,)), strict=True):
                first_of.setdefault(t, vals)
            self.pending.removeKey((bucket,))
            old, old_vals, out = (before[0], before[1], []) if before is not None else (None, None, [])
            for t, vals in sorted(first_of.items()):
                if old is not None and t <= old:
                    continue
                if old is not None:
                    minutes = t // minute - old // minute
                    if min_minutes <= minutes <= max_minutes and all(v >= w for v, w in zip(vals, old_vals, strict=True)):
                        out.append((*key, t, old, t // second - old // second, minutes,
                                    *[v - w for v, w in zip(vals, old_vals, strict=True)]))
                old, old_vals = t, vals
            if before is None or old != before[0]:
                # just after the bucket that a snapshot within max_minutes would be in
                ends = ((old // 1000 + keep_ms) // bucket_ms + 1) * bucket_ms + 1
                self.last.update((old, list(old_vals), ends))
                self.handle.registerTimer(ends)
            if out:
                pdf = pd.DataFrame(out, columns=names)
                for c in (ts, "prev_ts"):
                    pdf[c] = pd.to_datetime(pdf[c], unit="us")
                yield pdf

        def close(self) -> None:
            pass

    # watermarks need an instant: zone-less timestamps are read as UTC
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        stream = stream.withColumn("__event_time", ntz_to_instant(ts))
        wcol = "__event_time"
    else:
        wcol = ts
    return (stream.withWatermark(wcol, watermark).groupBy(*group)
            .transformWithStateInPandas(SeriesDeltas(), out_schema, "append", "EventTime"))
