"""Registered queries: snapshot-delta family (SD-*) on fixture F1/F3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators import snapshots as sd
from ..session import scratch_path
from ..sources.tables import read_bucketed, write_bucketed
from . import fixtures as fx
from . import oracle_fixtures as ofx

QUERIES: dict = {}
ORACLE: dict = {}

COUNTERS = ["cum_value", "cum_count", "cum_signal"]

# Fixed values of the test dimension: a category per metric name; "error" is
# deliberately missing so that it falls into "Other".
CATEGORIES = [("click", "User", False), ("view", "Idle", True), ("purchase", "Commerce", False),
              ("signup", "Commerce", False)]
POISON = ["purchase", "signup"]


def _register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def category_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "metric string, category string, ignorable boolean")


_CAT_SQL = "cat(metric, category, ignorable) AS (VALUES " + ", ".join(
    f"('{m}', '{c}', {str(i).lower()})" for m, c, i in CATEGORIES) + ")"

_DELTA_SELECT = """
SELECT w.server_name, w.metric, w.check_ts, p.check_ts AS prev_ts,
       date_diff('second', p.check_ts, w.check_ts) AS elapsed_seconds,
       date_diff('minute', p.check_ts, w.check_ts) AS elapsed_minutes,
       w.cum_value - p.cum_value AS cum_value_delta,
       w.cum_count - p.cum_count AS cum_count_delta,
       w.cum_signal - p.cum_signal AS cum_signal_delta
FROM f1 w
JOIN cal c ON c.server_name = w.server_name AND c.check_ts = w.check_ts
JOIN f1 p ON p.server_name = w.server_name AND p.metric = w.metric AND p.check_ts = c.prev
WHERE date_diff('minute', p.check_ts, w.check_ts) BETWEEN 1 AND 60
  AND w.cum_value >= p.cum_value AND w.cum_count >= p.cum_count AND w.cum_signal >= p.cum_signal"""

_CAL = """cal AS (SELECT server_name, check_ts, lag(check_ts) OVER (PARTITION BY server_name ORDER BY check_ts) AS prev
               FROM (SELECT DISTINCT server_name, check_ts FROM f1))"""


def _delta_sql(variant: str) -> str:
    return ofx.with_(ofx.f1(variant), _CAL) + _DELTA_SELECT


def _deltas(spark, sf_dir, variant):
    return sd.snapshot_delta(fx.f1_counters(spark, sf_dir, variant), ["metric"], COUNTERS)


@_register("sd01_snapshot_delta_restart", _delta_sql("restart"))
def q_sd01_restart(spark, sf_dir):
    return _deltas(spark, sf_dir, "restart")


@_register("sd01_delta_from_bucketed_history", ofx.with_(ofx.f1("restart", "f1_all") + """,
f1 AS (SELECT * FROM f1_all WHERE check_ts >= TIMESTAMP '2024-01-10' AND check_ts < TIMESTAMP '2024-01-20')""", _CAL) + _DELTA_SELECT)
def q_sd01_bucketed(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    table = "snapshots_" + path.rsplit("-", 1)[1]
    write_bucketed(fx.f1_counters(spark, sf_dir, "restart"), table, f"{path}/t", series=["server_name", "metric"], buckets=8)
    window = read_bucketed(spark, table, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
    return sd.snapshot_delta(window, ["metric"], COUNTERS, bucket=None)


@_register("sd01_snapshot_delta_gappy", _delta_sql("gappy"))
def q_sd01_gappy(spark, sf_dir):
    return _deltas(spark, sf_dir, "gappy")


@_register("sd02_rates", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")") + """
SELECT server_name, metric, check_ts, elapsed_seconds,
       round(cum_value_delta / nullif(elapsed_seconds, 0), 6) AS cum_value_per_sec,
       round(cum_value_delta * 60 / nullif(elapsed_seconds, 0), 6) AS cum_value_per_min,
       round(cum_count_delta / nullif(elapsed_seconds, 0), 6) AS cum_count_per_sec,
       round(cum_count_delta * 60 / nullif(elapsed_seconds, 0), 6) AS cum_count_per_min
FROM d""")
def q_sd02(spark, sf_dir):
    d = sd.with_rates(_deltas(spark, sf_dir, "plain"), ["cum_value", "cum_count"])
    return d.select("server_name", "metric", "check_ts", "elapsed_seconds", "cum_value_per_sec", "cum_value_per_min",
                    "cum_count_per_sec", "cum_count_per_min")


_TOP_WAITS_SQL = ofx.with_(ofx.f1("restart"), _CAL, "d AS (" + _DELTA_SELECT + ")", _CAT_SQL) + """,
g AS (
  SELECT d.server_name, d.metric, coalesce(cat.category, 'Other') AS category,
         CAST(sum(cum_value_delta) AS BIGINT) AS wait_total, CAST(sum(cum_count_delta) AS BIGINT) AS waits,
         CAST(sum(elapsed_seconds) AS BIGINT) AS seconds_sampled, CAST(sum(cum_signal_delta) AS BIGINT) AS signal_total
  FROM d LEFT JOIN cat ON d.metric = cat.metric
  WHERE NOT coalesce(cat.ignorable, false)
  GROUP BY ALL)
SELECT *, round(CASE WHEN waits = 0 THEN 0 ELSE wait_total / waits END, 4) AS avg_per_wait,
       round(CASE WHEN wait_total = 0 THEN 0 ELSE signal_total * 100 / wait_total END, 4) AS signal_pct,
       row_number() OVER (PARTITION BY server_name ORDER BY wait_total DESC, metric) AS wait_rank
FROM g QUALIFY wait_rank <= 3"""


def top_waits(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Slice 0 / flagship: F1 (with restarts) -> SD-1 -> SD-4 -> top waits per server."""
    d = _deltas(spark, sf_dir, "restart")
    d = sd.categorize(d, category_dim(spark))
    return sd.top_waits(d, n=n)


QUERIES["sd04_top_waits"] = top_waits
ORACLE["sd04_top_waits"] = _TOP_WAITS_SQL


@_register("sd04_wait_categories", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")", _CAT_SQL) + """
SELECT d.server_name, d.metric, d.check_ts, d.cum_value_delta,
       coalesce(cat.category, 'Other') AS category, coalesce(cat.ignorable, false) AS ignorable
FROM d LEFT JOIN cat ON d.metric = cat.metric""")
def q_sd04_cat(spark, sf_dir):
    d = sd.categorize(_deltas(spark, sf_dir, "plain"), category_dim(spark))
    return d.select("server_name", "metric", "check_ts", "cum_value_delta", "category", "ignorable")


@_register("sd07_significant_waits", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")") + """
SELECT server_name, check_ts, metric, elapsed_seconds, cum_value_delta AS wait_delta,
       CAST(floor(cum_value_delta / 1000) AS BIGINT) AS wait_seconds,
       row_number() OVER (PARTITION BY server_name, check_ts ORDER BY cum_value_delta DESC, metric) AS wait_rank
FROM d WHERE cum_value_delta > 0.5 * elapsed_seconds * 0.5
QUALIFY wait_rank <= 10""")
def q_sd07(spark, sf_dir):
    # the fixture counters are cents per hour, so elapsed seconds are scaled
    # by 0.5 (instead of 1000 ms) to get a non-trivial answer
    return sd.significant_waits(_deltas(spark, sf_dir, "plain"), share=0.5, scale=0.5)


@_register("sd08_poison_waits", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")") + """
SELECT server_name, check_ts, metric, cum_value_delta AS wait_delta,
       CAST(floor(cum_value_delta / 1000) AS BIGINT) AS wait_seconds
FROM d WHERE metric IN ('purchase', 'signup') AND cum_value_delta > 1000""")
def q_sd08(spark, sf_dir):
    return sd.poison_waits(_deltas(spark, sf_dir, "plain"), POISON, threshold=1000)


_FILE_SQL = """
cal AS (SELECT server_name, check_ts, lag(check_ts) OVER (PARTITION BY server_name ORDER BY check_ts) AS prev
        FROM (SELECT DISTINCT server_name, check_ts FROM f3f)),
fd AS (
SELECT f.server_name, f.database_id, f.file_id, f.check_ts, f.type_desc, f.physical_name,
       date_diff('second', p.check_ts, f.check_ts) AS elapsed_seconds,
       f.size_on_disk_mb - p.size_on_disk_mb AS size_growth_mb,
       f.io_stall_read_ms - p.io_stall_read_ms AS io_stall_read_ms,
       f.num_of_reads - p.num_of_reads AS num_of_reads,
       round(CASE WHEN f.num_of_reads - p.num_of_reads = 0 THEN 0
             ELSE (f.io_stall_read_ms - p.io_stall_read_ms) / (f.num_of_reads - p.num_of_reads) END, 4) AS avg_read_stall_ms,
       round((f.bytes_read - p.bytes_read) / 1048576.0, 4) AS mb_read,
       f.io_stall_write_ms - p.io_stall_write_ms AS io_stall_write_ms,
       f.num_of_writes - p.num_of_writes AS num_of_writes,
       round(CASE WHEN f.num_of_writes - p.num_of_writes = 0 THEN 0
             ELSE (f.io_stall_write_ms - p.io_stall_write_ms) / (f.num_of_writes - p.num_of_writes) END, 4) AS avg_write_stall_ms,
       round((f.bytes_written - p.bytes_written) / 1048576.0, 4) AS mb_written
FROM f3f f JOIN cal c ON c.server_name = f.server_name AND c.check_ts = f.check_ts
JOIN f3f p ON p.server_name = f.server_name AND p.database_id = f.database_id AND p.file_id = f.file_id
          AND p.check_ts = c.prev
WHERE f.num_of_reads >= p.num_of_reads AND f.num_of_writes >= p.num_of_writes
  AND date_diff('minute', p.check_ts, f.check_ts) >= 1)"""


def file_deltas(spark, sf_dir):
    # monthly snapshots: the 60-minute gap rule is switched off (max_minutes=None)
    return sd.file_io_deltas(fx.f3_files(spark, sf_dir), max_minutes=None)


@_register("sd03_file_io_deltas", ofx.with_(ofx.f3_files(), _FILE_SQL) + "SELECT * FROM fd")
def q_sd03(spark, sf_dir):
    return file_deltas(spark, sf_dir)
