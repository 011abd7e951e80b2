"""Registered queries: Structured Streaming (STR-1 ... STR-6, SNK-1/2).

Each query feeds data derived from the test tables through a real stream
(file source under the session's checkpoint folder, ``availableNow``
trigger, parquet or ``foreachBatch`` sink with a checkpoint) and returns
what the sink holds.  The oracle states the streaming semantics in batch
SQL (append mode emits a window once the watermark has passed its end).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import deadlocks as dl
from ..sources.events import parse_deadlocks
from ..streaming import pipelines as sp
from ..session import scratch_path
from ..sinks.readmodel import Measure, ReadModel
from ..streaming.deltas import STATE_STORE, stream_snapshot_delta
from . import fixtures as fx
from .fixture_f6 import f6_documents
from .q_deadlocks import F6 as F6_SQL
from .q_deadlocks import PROC_COLS
from .q_snapshots import COUNTERS, _delta_sql

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


HEARTBEAT = "~heartbeat"


def _stage_files(df, path: str, chunks: int, chunk_key) -> None:
    """Write ``df`` as ``chunks`` groups of files, one group after the other."""
    for i in range(chunks):
        df.filter(chunk_key == i).write.mode("append").parquet(path)


@reg("str01_streaming_snapshot_delta", _delta_sql("restart"))
def q_str01(spark, sf_dir):
    # A row arrives with the rows of its own or of the next day (out of event-time order), five days
    # to a group of files.  A watermark of a week covers both, so no state holds more than that.
    snaps = fx.f1_counters(spark, sf_dir, "restart").persist()
    span = snaps.agg(F.to_date(F.min("check_ts")).alias("a"), F.to_date(F.max("check_ts")).alias("b")).first()
    group = F.floor((F.datediff(F.to_date("check_ts"), F.lit(span["a"])) + F.abs(F.xxhash64("check_ts")) % 2) / 5)
    path = scratch_path(spark, "str01") + "/in"
    _stage_files(snaps, path, ((span["b"] - span["a"]).days + 1) // 5 + 1, group)
    spark.createDataFrame([(HEARTBEAT, dt.datetime(2100, 1, 1), HEARTBEAT, 0, 0, 0)], snaps.schema).write.mode("append").parquet(path)
    snaps.unpersist()
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 16).parquet(path)
    out = stream_snapshot_delta(stream, ["metric"], COUNTERS, watermark="7 days", bucket_minutes=24 * 60)
    res = sp.run_available(out, spark=spark, name="str01-out", conf=STATE_STORE)
    return res.filter(F.col("server_name") != HEARTBEAT)


def _events_stream(spark, sf_dir, flush: bool = False):
    """The events as a stream; with ``flush`` a last row far ahead moves the
    watermark past all data, so that the last windows are emitted too."""
    schema = fx._t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if not flush:
        return stream
    path = scratch_path(spark, "heartbeat") + "/in"
    beat = {"ts": dt.datetime(2100, 1, 1)}
    spark.createDataFrame([tuple(beat.get(f.name) for f in schema.fields)], schema).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(schema).parquet(path))


@reg("str02_tumbling_rates", """
WITH g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS events,
                  round(sum(value), 4) AS total_value FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, events, total_value,
       round(events / 3600, 6) AS events_per_sec
FROM g""")
def q_str02(spark, sf_dir):
    out = sp.windowed_rates(_events_stream(spark, sf_dir, flush=True), size="1 hour", watermark="10 minutes")
    return sp.run_available(out, spark=spark, name="str02")


@reg("str02_sliding_rates", """
WITH s AS (SELECT e.*, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * o) AS window_start
           FROM events e, range(0, 4) t(o)),
g AS (SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total_value
      FROM s GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, events, total_value,
       round(events / 3600, 6) AS events_per_sec
FROM g""")
def q_str02s(spark, sf_dir):
    out = sp.windowed_rates(_events_stream(spark, sf_dir, flush=True), size="1 hour", slide="15 minutes", watermark="10 minutes")
    return sp.run_available(out, spark=spark, name="str02s")


# Fixed test rules: event type, threshold, check id, finding.
STREAM_RULES = [("error", 90.0, 301, "High error value"), ("purchase", 95.0, 302, "Large purchase")]


@reg("str03_threshold_alerts", """
WITH r(event_type, threshold, check_id, finding) AS (VALUES """ + ", ".join(
    f"('{a}', {b}, {c}, '{d}')" for a, b, c, d in STREAM_RULES) + """)
SELECT event_id, ts, e.event_type, value, CAST(check_id AS INTEGER) AS check_id, finding
FROM events e JOIN r ON e.event_type = r.event_type WHERE value > threshold""")
def q_str03(spark, sf_dir):
    rules = spark.createDataFrame(STREAM_RULES, "event_type string, threshold double, check_id int, finding string")
    out = sp.threshold_alerts(_events_stream(spark, sf_dir), rules)
    return sp.run_available(out, spark=spark, name="str03")


@reg("str04_deadlock_stream_dedup", F6_SQL + f"SELECT {PROC_COLS} FROM f6")
def q_str04(spark, sf_dir):
    # events arrive year by year, each year followed by replays of a part of it; state older than the
    # watermark leaves, and a replay that is older still is late and dropped
    root = scratch_path(spark, "str04")
    # documents repeat the same names: compressed well, they take a fraction of the text that arrives
    small = {"compression": "zstd"}
    f6_documents(spark, sf_dir).withColumn("year", F.year("event_ts")).write.options(**small).partitionBy("year").parquet(f"{root}/years")
    years = spark.read.parquet(f"{root}/years")
    ev = years.drop("year")
    for y in sorted(r["year"] for r in years.select("year").distinct().collect()):
        one = years.filter(F.col("year") == y).drop("year")
        one.write.mode("append").options(**small).parquet(f"{root}/in")
        one.filter(F.col("event_id") % 3 == 0).write.mode("append").options(**small).parquet(f"{root}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    uniq = sp.dedup_events(stream, watermark="366 days")
    columns = [c for c in dl.PROCESS_FIELDS if c != "frames"]
    out = dl.processes(parse_deadlocks(uniq, schema=dl.document_schema(process=columns), batches=True), columns)
    return sp.run_available(out, spark=spark, name="str04-out")


@reg("str05_activity_sessions", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
             CAST(count(*) AS BIGINT) AS events FROM g GROUP BY user_id, sid)
SELECT * FROM s""")
def q_str05(spark, sf_dir):
    out = sp.activity_sessions(_events_stream(spark, sf_dir, flush=True), gap="30 minutes", watermark="1 hour")
    return sp.run_available(out, spark=spark, name="str05")


@reg("str06_retention_expiry", """
SELECT *, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 7 DAY""")
def q_str06(spark, sf_dir):
    return sp.run_available(_events_stream(spark, sf_dir), spark=spark, name="str06",
                            sink=sp.retention_sink(7, ts="ts", partition="day")).drop("written_by")


MODEL = ReadModel(["event_type", "day"], [
    Measure("events", "count"), Measure("total_cents", "sum", "cents"), Measure("first_ts", "min", "ts"), Measure("last_ts", "max", "ts"),
    Measure("users", "distinct", "user_id")])


def _fed_model(spark, sf_dir, name):
    """The events in four batches of a stream; every batch is also delivered a second time."""
    path = scratch_path(spark, name)
    ev = fx._t(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts")).withColumn("cents", fx.cents("value"))
    for i in range(4):
        ev.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).write.parquet(f"{path}/in/part={i}")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in/*")
    feed = sp.model_sink(MODEL, fold_every=2)

    def twice(df, epoch, _):
        feed(df, epoch, f"{path}/model")
        feed(df, epoch, f"{path}/model")

    q = stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(
        lambda df, epoch: twice(df, epoch, None)).trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{path}/model"


@reg("doc05_read_model_from_batches", """
SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents,
       min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL""")
def q_doc05_batches(spark, sf_dir):
    return MODEL.read(spark, _fed_model(spark, sf_dir, "doc05")).drop("users")


@reg("ag02_distinct_from_sketches", """
SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, TRUE AS within_three_errors FROM events GROUP BY ALL""")
def q_ag02(spark, sf_dir):
    # days and batches merged to the whole per type from the stored sketches, beside the exact count
    about = MODEL.read(spark, _fed_model(spark, sf_dir, "ag02"), keys=["event_type"]).select("event_type", F.col("users").alias("about"))
    exact = fx._t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").cast("long").alias("users"))
    off = F.abs(F.col("about") - F.col("users")) <= 3 * 1.04 / 2 ** 6 * F.col("users")
    return exact.join(about, "event_type").select("event_type", "users", off.alias("within_three_errors"))
