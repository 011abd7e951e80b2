"""Registered queries: the rest of the snapshot family (SD-5, 6, 9-17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import snapshots as sd
from ..operators.waits import is_benign, wait_category
from . import fixtures as fx
from . import oracle_fixtures as ofx
from .q_snapshots import _CAL, _DELTA_SELECT, _FILE_SQL, _deltas, file_deltas

QUERIES: dict = {}
ORACLE: dict = {}

T1 = dt.datetime(2024, 1, 10, 0, 0)
T2 = dt.datetime(2024, 1, 10, 6, 0)
T1S, T2S = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-10 06:00:00'"

# Fixed test thresholds for the increment alerts (metric, threshold, check id,
# priority, group, finding).
ALERT_RULES = [
    ("error", 2000, 51, 100, "Query Problems", "Deadlocks"),
    ("signup", 3000, 13, 1, "SQL Server Internal Maintenance", "Log File Growing"),
    ("purchase", 4000, 29, 100, "Table Problems", "Forwarded Fetches/Sec High"),
]


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


D_PLAIN = ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")")


@reg("sd05_two_sample_report", ofx.with_(ofx.f1("plain")) + f"""
, g AS (
  SELECT b.server_name, b.metric, e.cum_value - b.cum_value AS wait_ms, e.cum_count - b.cum_count AS waits,
         e.cum_signal - b.cum_signal AS signal_ms
  FROM f1 b JOIN f1 e ON b.server_name = e.server_name AND b.metric = e.metric
  WHERE b.check_ts = {T1S} AND e.check_ts = {T2S})
SELECT server_name, metric, date_diff('second', {T1S}, {T2S}) AS seconds_sampled,
       round(wait_ms / 1000.0, 4) AS wait_seconds,
       round(CASE WHEN waits = 0 THEN 0 ELSE wait_ms / waits END, 4) AS avg_ms_per_wait,
       round(wait_ms / 1000.0 / 8 / date_diff('second', {T1S}, {T2S}), 4) AS per_core_per_second,
       round(signal_ms / 1000.0, 4) AS signal_seconds,
       round(CASE WHEN wait_ms = 0 THEN 0 ELSE signal_ms * 100.0 / wait_ms END, 4) AS pct_signal,
       waits AS number_of_waits
FROM g WHERE waits > 0 AND wait_ms > 0""")
def q_sd05(spark, sf_dir):
    return sd.two_sample_report(fx.f1_counters(spark, sf_dir, "plain"), T1, T2, cores=8)


@reg("sd06_drive_stall_ranking", ofx.with_(ofx.f3_files(), _FILE_SQL) + """,
g AS (SELECT server_name, regexp_extract(physical_name, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1) AS drive,
             CAST(sum(io_stall_read_ms) AS BIGINT) AS rs, CAST(sum(num_of_reads) AS BIGINT) AS r,
             CAST(sum(io_stall_write_ms) AS BIGINT) AS ws, CAST(sum(num_of_writes) AS BIGINT) AS w
      FROM fd GROUP BY ALL),
u AS (SELECT server_name, drive, 'READ' AS pattern, rs AS stall_ms, r AS ios FROM g
      UNION ALL SELECT server_name, drive, 'WRITE', ws, w FROM g)
SELECT *, round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) AS avg_stall_ms,
       row_number() OVER (PARTITION BY server_name, pattern
                          ORDER BY round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) DESC, drive) AS stall_rank
FROM u""")
def q_sd06(spark, sf_dir):
    return sd.drive_stall_ranking(file_deltas(spark, sf_dir))


@reg("sd06_file_stall_ranking", ofx.with_(ofx.f3_files(), _FILE_SQL) + """,
g AS (SELECT server_name, physical_name,
             CAST(sum(io_stall_read_ms) AS BIGINT) AS rs, CAST(sum(num_of_reads) AS BIGINT) AS r,
             CAST(sum(io_stall_write_ms) AS BIGINT) AS ws, CAST(sum(num_of_writes) AS BIGINT) AS w
      FROM fd GROUP BY ALL),
u AS (SELECT server_name, physical_name, 'READ' AS pattern, rs AS stall_ms, r AS ios FROM g
      UNION ALL SELECT server_name, physical_name, 'WRITE', ws, w FROM g)
SELECT *, round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) AS avg_stall_ms,
       row_number() OVER (PARTITION BY server_name, pattern
                          ORDER BY round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) DESC, physical_name) AS stall_rank
FROM u QUALIFY stall_rank <= 5""")
def q_sd06f(spark, sf_dir):
    return sd.file_stall_ranking(file_deltas(spark, sf_dir), n=5)


_FINDING_COLS = "server_name, database_name, check_ts, check_id, priority, findings_group, finding, details, value"


@reg("sd09_slow_files", ofx.with_(ofx.f3_files(), _FILE_SQL) + """
SELECT server_name, CAST(database_id AS VARCHAR) AS database_name, check_ts, 11 AS check_id, 50 AS priority,
       'Server Performance' AS findings_group, 'Slow Data File Reads' AS finding,
       'File: ' || physical_name || '; reads: ' || CAST(num_of_reads AS VARCHAR) AS details,
       CAST(floor(io_stall_read_ms / num_of_reads) AS DOUBLE) AS value
FROM fd WHERE type_desc = 'ROWS' AND num_of_reads > 0 AND io_stall_read_ms > 1000
  AND floor(io_stall_read_ms / num_of_reads) >= 40
UNION ALL
SELECT server_name, CAST(database_id AS VARCHAR), check_ts, 12, 50, 'Server Performance', 'Slow Log File Writes',
       'File: ' || physical_name || '; writes: ' || CAST(num_of_writes AS VARCHAR),
       CAST(floor(io_stall_write_ms / num_of_writes) AS DOUBLE)
FROM fd WHERE type_desc = 'LOG' AND num_of_writes > 0 AND io_stall_write_ms > 1000
  AND floor(io_stall_write_ms / num_of_writes) >= 40""")
def q_sd09(spark, sf_dir):
    return sd.slow_files(file_deltas(spark, sf_dir), threshold_ms=40)


_SLOW_SQL = ofx.with_(ofx.f3_files(), _FILE_SQL) + """, slow AS (
SELECT server_name, CAST(database_id AS VARCHAR) AS database_name, check_ts, 11 AS check_id, 50 AS priority,
       'Server Performance' AS findings_group, 'Slow Data File Reads' AS finding,
       'File: ' || physical_name || '; reads: ' || CAST(num_of_reads AS VARCHAR) AS details,
       CAST(floor(io_stall_read_ms / num_of_reads) AS DOUBLE) AS value
FROM fd WHERE type_desc = 'ROWS' AND num_of_reads > 0 AND io_stall_read_ms > 1000
  AND floor(io_stall_read_ms / num_of_reads) >= 40
UNION ALL
SELECT server_name, CAST(database_id AS VARCHAR), check_ts, 12, 50, 'Server Performance', 'Slow Log File Writes',
       'File: ' || physical_name || '; writes: ' || CAST(num_of_writes AS VARCHAR),
       CAST(floor(io_stall_write_ms / num_of_writes) AS DOUBLE)
FROM fd WHERE type_desc = 'LOG' AND num_of_writes > 0 AND io_stall_write_ms > 1000
  AND floor(io_stall_write_ms / num_of_writes) >= 40)"""


@reg("sd16_findings_review", _SLOW_SQL + """
SELECT server_name, priority, findings_group, finding, CAST(count(*) AS BIGINT) AS total_occurrences, min(check_ts) AS first_occurrence,
       max(check_ts) AS last_occurrence
FROM slow WHERE check_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND priority BETWEEN 1 AND 50 GROUP BY ALL""")
def q_sd16b(spark, sf_dir):
    return sd.findings_review(q_sd09(spark, sf_dir), dt.datetime(1996, 1, 1), dt.datetime(1999, 12, 31))


@reg("sd16_files_review", ofx.with_(ofx.f3_files(), _FILE_SQL) + """,
g AS (SELECT server_name, physical_name,
             CAST(sum(io_stall_read_ms) AS BIGINT) AS rs, CAST(sum(num_of_reads) AS BIGINT) AS r,
             CAST(sum(io_stall_write_ms) AS BIGINT) AS ws, CAST(sum(num_of_writes) AS BIGINT) AS w
      FROM fd WHERE check_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ALL),
u AS (SELECT server_name, physical_name, 'READ' AS pattern, rs AS stall_ms, r AS ios FROM g
      UNION ALL SELECT server_name, physical_name, 'WRITE', ws, w FROM g)
SELECT *, round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) AS avg_stall_ms,
       row_number() OVER (PARTITION BY server_name, pattern
                          ORDER BY round(CASE WHEN ios = 0 THEN 0 ELSE stall_ms / ios END, 4) DESC, physical_name) AS stall_rank
FROM u QUALIFY stall_rank <= 3""")
def q_sd16c(spark, sf_dir):
    return sd.files_review(file_deltas(spark, sf_dir), dt.datetime(1996, 1, 1), dt.datetime(1999, 12, 31), n=3)



@reg("sd16_counters_review", ofx.with_(ofx.f1_perfmon()) + """
, w AS (SELECT * FROM f1p WHERE check_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12')
SELECT server_name, object_name, counter_name, instance_name, check_ts, cntr_value, min(cntr_value) OVER g AS window_min, max(cntr_value) OVER g AS window_max,
       last_value(cntr_value) OVER (PARTITION BY server_name, object_name, counter_name, instance_name ORDER BY check_ts
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS window_last
FROM w WINDOW g AS (PARTITION BY server_name, object_name, counter_name, instance_name)""")
def q_sd16d(spark, sf_dir):
    return sd.counters_review(fx.f1_perfmon(spark, sf_dir), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))


@reg("sd16_ranked_queries_review", ofx.with_(ofx.f4_query_stats()) + """
, w AS (SELECT 'srv' || query_id % 3 AS server_name, interval_ts AS check_ts, query_id, plan_id, cpu, reads, duration FROM f4
        WHERE interval_ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'),
u AS (SELECT server_name, check_ts, query_id, plan_id, 'cpu' AS sort_order, CAST(cpu AS DOUBLE) AS value FROM w
      UNION ALL SELECT server_name, check_ts, query_id, plan_id, 'reads', reads FROM w
      UNION ALL SELECT server_name, check_ts, query_id, plan_id, 'duration', duration FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY server_name, sort_order, check_ts ORDER BY value DESC, query_id, plan_id) AS time_frame_rank
      FROM u QUALIFY time_frame_rank <= 5)
SELECT *, row_number() OVER (PARTITION BY server_name, sort_order ORDER BY value DESC, check_ts, query_id, plan_id) AS overall_rank FROM r""")
def q_sd16e(spark, sf_dir):
    q = fx.f4_query_stats(spark, sf_dir).withColumn("server_name", F.concat(F.lit("srv"), (F.col("query_id") % 3).cast("string"))).withColumnRenamed(
        "interval_ts", "check_ts")
    return sd.ranked_queries_review(q, dt.datetime(1995, 1, 1), dt.datetime(1996, 6, 30), metrics=["cpu", "reads", "duration"], key=["query_id", "plan_id"])


@reg("sd10_ratio_alert", D_PLAIN + """
, g AS (SELECT server_name, check_ts, sum(CASE WHEN metric = 'click' THEN cum_value_delta END) AS num,
               sum(CASE WHEN metric = 'view' THEN cum_value_delta END) AS den, max(elapsed_seconds) AS secs
        FROM d WHERE metric IN ('click', 'view') GROUP BY ALL)
SELECT server_name, CAST(NULL AS VARCHAR) AS database_name, check_ts, 15 AS check_id, 50 AS priority,
       'Query Problems' AS findings_group, 'Compilations/Sec High' AS finding,
       'numerator: ' || CAST(num AS VARCHAR) || '; denominator: ' || CAST(den AS VARCHAR) AS details,
       CAST(num AS DOUBLE) AS value
FROM g WHERE num > 75 AND den IS NOT NULL AND (num > 0.1 * secs OR num > den)""")
def q_sd10(spark, sf_dir):
    return sd.ratio_alert(_deltas(spark, sf_dir, "plain"), "click", "view", min_numerator=75, per_second=0.1)


_RULES_SQL = "rules(metric, threshold, check_id, priority, findings_group, finding) AS (VALUES " + ", ".join(
    f"('{m}', {t}, {c}, {p}, '{g}', '{f}')" for m, t, c, p, g, f in ALERT_RULES) + ")"


@reg("sd11_counter_alerts", D_PLAIN + "," + _RULES_SQL + """
SELECT d.server_name, CAST(NULL AS VARCHAR) AS database_name, d.check_ts, CAST(r.check_id AS INTEGER) AS check_id,
       CAST(r.priority AS INTEGER) AS priority, r.findings_group, r.finding,
       'delta during the sample: ' || CAST(d.cum_value_delta AS VARCHAR) AS details,
       CAST(d.cum_value_delta AS DOUBLE) AS value
FROM d JOIN rules r ON d.metric = r.metric WHERE d.cum_value_delta > r.threshold""")
def q_sd11(spark, sf_dir):
    rules = spark.createDataFrame(ALERT_RULES, "metric string, threshold long, check_id int, priority int, "
                                               "findings_group string, finding string")
    return sd.counter_alerts(_deltas(spark, sf_dir, "plain"), F.broadcast(rules))


QS_T1, QS_T2 = dt.datetime(1997, 1, 1), dt.datetime(1998, 12, 1)


@reg("sd12_query_stats_delta", ofx.with_(ofx.f4_query_stats()) + """
, d AS (SELECT query_id, plan_id, CAST(sum(executions) AS BIGINT) AS executions, CAST(sum(cpu) AS BIGINT) AS cpu,
               CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(writes) AS BIGINT) AS writes,
               CAST(sum(duration) AS BIGINT) AS duration
        FROM f4 WHERE interval_ts > TIMESTAMP '1997-01-01' AND interval_ts <= TIMESTAMP '1998-12-01' GROUP BY ALL),
u AS (UNPIVOT d ON executions, cpu, reads, writes, duration INTO NAME sort_metric VALUE delta)
SELECT query_id, plan_id, sort_metric, delta,
       row_number() OVER (PARTITION BY sort_metric ORDER BY delta DESC, query_id, plan_id) AS metric_rank
FROM u QUALIFY metric_rank <= 10""")
def q_sd12(spark, sf_dir):
    from ..operators.querystats import query_stats_delta_top
    return query_stats_delta_top(fx.f4_cumulative(spark, sf_dir), QS_T1, QS_T2, n=10)


@reg("sd13_cumulative_share", ofx.with_(ofx.f1("plain")) + """
, last AS (SELECT server_name, metric, arg_max(cum_value, check_ts) AS wait_ms, arg_max(cum_signal, check_ts) AS signal_ms,
                  min(check_ts) AS first_ts, max(check_ts) AS last_ts FROM f1 GROUP BY ALL),
tot AS (SELECT server_name, sum(wait_ms) AS server_wait_ms, min(first_ts) AS f, max(last_ts) AS l FROM last GROUP BY ALL)
SELECT l.server_name, l.metric, date_diff('hour', t.f, t.l) AS hours_sampled,
       round(wait_ms / 3600000.0, 4) AS wait_hours,
       round(wait_ms / 60000.0 / nullif(date_diff('hour', t.f, t.l), 0), 4) AS wait_minutes_per_hour,
       round(CASE WHEN server_wait_ms = 0 THEN 0 ELSE wait_ms * 100.0 / server_wait_ms END, 4) AS pct_of_total,
       round(CASE WHEN wait_ms = 0 THEN 0 ELSE signal_ms * 100.0 / wait_ms END, 4) AS pct_signal
FROM last l JOIN tot t ON l.server_name = t.server_name""")
def q_sd13(spark, sf_dir):
    return sd.cumulative_share(fx.f1_counters(spark, sf_dir, "plain"))


@reg("sd14_point_in_time_summary", ofx.with_(ofx.f1("plain")) + """
, g AS (SELECT server_name, CAST(sum(cum_value) AS BIGINT) AS wait_ms, CAST(sum(cum_count) AS BIGINT) AS tasks,
               CAST(sum(cum_signal) AS BIGINT) AS signal_ms
        FROM f1 WHERE (server_name, check_ts) IN (SELECT server_name, max(check_ts) FROM f1 GROUP BY ALL) GROUP BY ALL)
SELECT server_name, wait_ms, tasks, signal_ms, wait_ms - signal_ms AS resource_ms,
       round(CASE WHEN wait_ms = 0 THEN 0 ELSE signal_ms * 100.0 / wait_ms END, 4) AS signal_pct,
       round(CASE WHEN wait_ms = 0 THEN 0 ELSE (wait_ms - signal_ms) * 100.0 / wait_ms END, 4) AS resource_pct,
       round(CASE WHEN tasks = 0 THEN 0 ELSE wait_ms / tasks END, 4) AS avg_wait_ms
FROM g""")
def q_sd14(spark, sf_dir):
    return sd.point_in_time_summary(fx.f1_counters(spark, sf_dir, "plain"))


@reg("sd15_counter_ratio", ofx.with_(ofx.f1("plain")) + """
SELECT server_name, check_ts,
       round(sum(CASE WHEN metric = 'purchase' THEN cum_value END) * 100.0
             / nullif(sum(CASE WHEN metric = 'view' THEN cum_value END), 0), 4) AS ratio_pct
FROM f1 WHERE metric IN ('purchase', 'view') GROUP BY ALL""")
def q_sd15(spark, sf_dir):
    return sd.counter_ratio(fx.f1_counters(spark, sf_dir, "plain"), "purchase", "view")


@reg("sd16_window_review", D_PLAIN + """
, w AS (SELECT * FROM d WHERE check_ts >= TIMESTAMP '2024-01-05' AND check_ts < TIMESTAMP '2024-01-12'),
p AS (SELECT server_name, check_ts, metric, cum_value_delta AS delta,
             row_number() OVER (PARTITION BY server_name, check_ts ORDER BY cum_value_delta DESC, metric) AS rank_in_sample
      FROM w QUALIFY rank_in_sample <= 2),
t AS (SELECT server_name, metric, CAST(sum(cum_value_delta) AS BIGINT) AS window_total FROM w GROUP BY ALL),
t2 AS (SELECT *, rank() OVER (PARTITION BY server_name ORDER BY window_total DESC, metric) AS rank_in_window FROM t)
SELECT p.*, t2.window_total, t2.rank_in_window FROM p JOIN t2 USING (server_name, metric)""")
def q_sd16(spark, sf_dir):
    return sd.window_review(_deltas(spark, sf_dir, "plain"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12), n=2)


@reg("sd17_counter_types", ofx.with_(ofx.f1_perfmon()) + """
, cal AS (SELECT server_name, check_ts, lag(check_ts) OVER (PARTITION BY server_name ORDER BY check_ts) AS prev
          FROM (SELECT DISTINCT server_name, check_ts FROM f1p)),
d AS (SELECT c.server_name, c.object_name, c.counter_name, c.instance_name, c.check_ts, c.cntr_type, c.cntr_value,
             c.cntr_value - p.cntr_value AS dv, date_diff('second', p.check_ts, c.check_ts) AS secs
      FROM f1p c JOIN cal ON cal.server_name = c.server_name AND cal.check_ts = c.check_ts
      JOIN f1p p ON p.server_name = c.server_name AND p.object_name = c.object_name
                 AND p.counter_name = c.counter_name AND p.instance_name = c.instance_name AND p.check_ts = cal.prev
      WHERE date_diff('minute', p.check_ts, c.check_ts) BETWEEN 1 AND 60),
base AS (SELECT *, trim(lower(regexp_replace(counter_name, '(?i)base.*$', ''))) AS j FROM d
         WHERE cntr_type = 1073939712 AND dv <> 0),
num AS (SELECT *, CASE WHEN cntr_type = 1073874176 THEN trim(lower(regexp_replace(counter_name, '\\(.*$', '')))
                       ELSE trim(lower(counter_name)) END AS j
        FROM d WHERE cntr_type IN (1073874176, 537003264) AND dv <> 0)
SELECT n.server_name, n.object_name, n.instance_name, n.check_ts, n.counter_name,
       CASE WHEN n.cntr_type = 537003264 THEN round(n.dv / b.dv, 3) ELSE round(n.dv / b.dv, 6) END AS value
FROM num n JOIN base b ON n.server_name = b.server_name AND n.object_name = b.object_name
     AND n.instance_name = b.instance_name AND n.check_ts = b.check_ts AND n.j = b.j
UNION ALL
SELECT server_name, object_name, instance_name, check_ts, counter_name, round(dv / nullif(secs, 0), 6)
FROM d WHERE cntr_type IN (272696576, 272696320) AND dv <> 0
UNION ALL
SELECT server_name, object_name, instance_name, check_ts, counter_name, CAST(cntr_value AS DOUBLE)
FROM d WHERE cntr_type IN (65792, 65536)""")
def q_sd17(spark, sf_dir):
    return sd.counter_values_by_type(fx.f1_perfmon(spark, sf_dir))


# wait types of the fixture, dealt to the events by id
_WAITS = ["LCK_M_S", "LCK_M_X", "PAGEIOLATCH_SH", "PAGELATCH_UP", "LATCH_EX", "CXPACKET", "SOS_SCHEDULER_YIELD", "WRITELOG", "LOGBUFFER",
          "ASYNC_NETWORK_IO", "RESOURCE_SEMAPHORE", "THREADPOOL", "HADR_SYNC_COMMIT", "HADR_WORK_QUEUE", "PREEMPTIVE_OS_GETPROCADDRESS",
          "CLR_AUTO_EVENT", "BROKER_TASK_STOP", "WAITFOR", "DTC_STATE", "BACKUPIO", "SLEEP_TASK", "SQLTRACE_FILE_BUFFER", "NEW_KIND"]


@reg("sd04_wait_category_rules", """
WITH n(i, wait_type, category, benign) AS (VALUES (0, 'LCK_M_S', 'Lock', false), (1, 'LCK_M_X', 'Lock', false),
  (2, 'PAGEIOLATCH_SH', 'Buffer IO', false), (3, 'PAGELATCH_UP', 'Buffer Latch', false), (4, 'LATCH_EX', 'Latch', false),
  (5, 'CXPACKET', 'Parallelism', false), (6, 'SOS_SCHEDULER_YIELD', 'CPU', false), (7, 'WRITELOG', 'Tran Log IO', false),
  (8, 'LOGBUFFER', 'Tran Log IO', false), (9, 'ASYNC_NETWORK_IO', 'Network IO', false), (10, 'RESOURCE_SEMAPHORE', 'Memory', false),
  (11, 'THREADPOOL', 'Worker Thread', false), (12, 'HADR_SYNC_COMMIT', 'Replication', false), (13, 'HADR_WORK_QUEUE', 'Replication', true),
  (14, 'PREEMPTIVE_OS_GETPROCADDRESS', 'Preemptive', false), (15, 'CLR_AUTO_EVENT', 'SQL CLR', true), (16, 'BROKER_TASK_STOP', 'Service Broker', true),
  (17, 'WAITFOR', 'User Wait', true), (18, 'DTC_STATE', 'Transaction', false), (19, 'BACKUPIO', 'Other Disk IO', false),
  (20, 'SLEEP_TASK', 'Idle', true), (21, 'SQLTRACE_FILE_BUFFER', 'Tracing', false), (22, 'NEW_KIND', 'Other', false))
SELECT category, benign AS ignorable, CAST(count(*) AS BIGINT) AS waits, round(sum(value), 4) AS total_wait
FROM events JOIN n ON event_id % 23 = i GROUP BY ALL""")
def q_sd04c(spark, sf_dir):
    wait = F.element_at(F.array(*[F.lit(w) for w in _WAITS]), (F.col("event_id") % len(_WAITS) + 1).cast("int"))
    e = fx._t(spark, sf_dir, "events").select(wait.alias("wait_type"), "value")
    return e.groupBy(wait_category(F.col("wait_type")).alias("category"), is_benign(F.col("wait_type")).alias("ignorable")).agg(
        F.count(F.lit(1)).cast("long").alias("waits"), F.round(F.sum("value"), 4).alias("total_wait"))
