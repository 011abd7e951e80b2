"""Structured Streaming operators (STR-2 ... STR-6) and a runner.

Every stream is event-time with a watermark; aggregations use append mode
so each window is emitted once, when it can no longer change.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import instant_to_ntz, ntz_to_instant
from ..session import scratch_path

ET = "__event_time"


def _with_event_time(df: DataFrame, ts: str) -> tuple[DataFrame, bool]:
    """Watermarks need an instant; zone-less timestamps are read as UTC."""
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return df.withColumn(ET, ntz_to_instant(ts)), True
    return df.withColumn(ET, F.col(ts)), False


def run_available(stream: DataFrame, *, spark: SparkSession, name: str, output_mode: str = "append",
                  sink: Callable | None = None, conf: Mapping[str, str] | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available now into a
    parquet folder (or a ``foreachBatch`` ``sink``) and return what was
    written as a batch DataFrame.  The checkpoint makes a restart resume
    where the lost run stopped.  ``conf``: settings the stream is started with."""
    root = scratch_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        w = stream.writeStream.option("checkpointLocation", f"{root}/_checkpoint").outputMode(output_mode)
        if sink is None:
            q = w.format("parquet").option("path", f"{root}/out").trigger(availableNow=True).start()
        else:
            q = w.foreachBatch(lambda df, epoch: sink(df, epoch, f"{root}/out")).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def windowed_rates(events: DataFrame, *, ts: str = "ts", key: str = "event_type", value: str = "value",
                   size: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """STR-2: tumbling (``slide=None``) or sliding window counts, sums and
    per-second rates per key."""
    e, ntz = _with_event_time(events, ts)
    win = F.window(ET, size) if slide is None else F.window(ET, size, slide)
    g = e.withWatermark(ET, watermark).groupBy(win.alias("w"), key).agg(
        F.count(F.lit(1)).cast("long").alias("events"), F.round(F.sum(value), 4).alias("total_value"))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    conv = instant_to_ntz if ntz else (lambda c: c)
    return g.select(conv(F.col("w.start")).alias("window_start"), conv(F.col("w.end")).alias("window_end"), key,
                    "events", "total_value", F.round(F.col("events") / secs, 6).alias("events_per_sec"))


def threshold_alerts(events: DataFrame, rules: DataFrame, *, key: str = "event_type", value: str = "value") -> DataFrame:
    """STR-3: stream-static join of events with a rule table (Spark
    broadcasts it only if its size allows); events over their threshold become finding rows."""
    j = events.join(rules, key).filter(F.col(value) > F.col("threshold"))
    return j.select("event_id", "ts", key, value, "check_id", "finding")


def dedup_events(events: DataFrame, *, key: str = "event_id", ts: str = "event_ts", watermark: str = "1 day") -> DataFrame:
    """STR-4: drop replayed events (same id) within the watermark."""
    e, _ = _with_event_time(events, ts)
    return e.withWatermark(ET, watermark).dropDuplicatesWithinWatermark([key]).drop(ET)


def activity_sessions(events: DataFrame, *, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                      watermark: str = "1 hour") -> DataFrame:
    """STR-5: session windows of activity per user (inactivity ``gap``)."""
    e, ntz = _with_event_time(events, ts)
    g = e.withWatermark(ET, watermark).groupBy(F.session_window(ET, gap).alias("s"), user).agg(
        F.count(F.lit(1)).cast("long").alias("events"))
    conv = instant_to_ntz if ntz else (lambda c: c)
    return g.select(user, conv(F.col("s.start")).alias("session_start"), conv(F.col("s.end")).alias("session_end"),
                    "events")


def retention_sink(keep_days: int, *, ts: str = "ts", partition: str = "day", writer: str = "stream"):
    """STR-6 / SNK-1 / SNK-2 as a ``foreachBatch`` sink: append the batch
    partitioned by day, exactly once per (writer, batch id), then drop whole day partitions older than
    ``keep_days`` before the newest day of the table (partition expiry, no row
    rewrites).  A batch that is run again replaces what its first run left; days that have expired stay out."""
    from ..sinks.history import append_history, expire_partitions, newest_partition

    def sink(df: DataFrame, epoch: int, path: str) -> None:
        append_history(df.withColumn(partition, F.to_date(ts)), path, partition_by=[partition], writer=writer, batch_id=epoch)
        newest = newest_partition(df.sparkSession, path, partition)
        if newest is not None:
            expire_partitions(df.sparkSession, path, partition, newest, keep_days)

    return sink


def model_sink(model, *, fold_every: int = 20):
    """DOC-5 as a ``foreachBatch`` sink: keeps a :class:`~fleetscope.sinks.readmodel.ReadModel` up to date."""
    def sink(df: DataFrame, epoch: int, path: str) -> None:
        model.update(df, path, epoch)
        if epoch and epoch % fold_every == 0:
            model.fold(df.sparkSession, path)

    return sink
