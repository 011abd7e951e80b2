"""Registered queries: query-statistics family (QS-*, ST-1/2) on F4."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary, try_ratio
from ..operators import querystats as qs
from . import fixtures as fx
from . import fixtures_more as fm
from . import oracle_fixtures as ofx

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_PLAN_SQL = """
p AS (SELECT query_id, plan_id, CAST(sum(executions) AS BIGINT) AS total_executions,
             CAST(sum(cpu) AS BIGINT) AS total_cpu, CAST(sum(reads) AS BIGINT) AS total_reads,
             CAST(sum(writes) AS BIGINT) AS total_writes, CAST(sum(duration) AS BIGINT) AS total_duration,
             min(interval_ts) AS first_seen, max(interval_ts) AS last_seen, min(min_cpu) AS min_cpu, max(max_cpu) AS max_cpu
      FROM f4 GROUP BY query_id, plan_id),
pa AS (SELECT *, round(CASE WHEN total_executions = 0 THEN 0 ELSE total_cpu / total_executions END, 4) AS avg_cpu,
              round(CASE WHEN total_executions = 0 THEN 0 ELSE total_reads / total_executions END, 4) AS avg_reads,
              round(CASE WHEN total_executions = 0 THEN 0 ELSE total_writes / total_executions END, 4) AS avg_writes,
              round(CASE WHEN total_executions = 0 THEN 0 ELSE total_duration / total_executions END, 4) AS avg_duration
       FROM p)"""


@reg("qs01_share_of_total", ofx.with_(ofx.f4_query_stats(), _PLAN_SQL) + """
, t AS (SELECT sum(executions) AS e, sum(cpu) AS c, sum(reads) AS r, sum(writes) AS w, sum(duration) AS d FROM f4)
SELECT query_id, plan_id,
       round(total_executions * 100.0 / t.e, 4) AS pct_executions, round(total_cpu * 100.0 / t.c, 4) AS pct_cpu,
       round(total_reads * 100.0 / t.r, 4) AS pct_reads, round(total_writes * 100.0 / t.w, 4) AS pct_writes,
       round(total_duration * 100.0 / t.d, 4) AS pct_duration,
       round(CASE WHEN date_diff('minute', first_seen, last_seen) = 0 THEN 0
                  ELSE total_executions / date_diff('minute', first_seen, last_seen) END, 4) AS executions_per_minute
FROM pa, t""")
def q_qs01(spark, sf_dir):
    return qs.share_of_total(fx.f4_query_stats(spark, sf_dir))


_FLAGS = ["frequent_execution", "parameter_sniffing", "long_running", "long_running_low_cpu", "low_cost_high_cpu", "near_parallel",
          "unused_grant", "big_spills", "bad_estimate"]


@reg("qs02_query_flags_and_warnings", ofx.with_(ofx.f4_query_stats(), _PLAN_SQL) + """
, r AS (SELECT query_id, plan_id, min(n_rows) AS min_rows, max(n_rows) AS max_rows, avg(n_rows) AS avg_rows, max(duration) AS max_duration
        FROM f4 GROUP BY ALL),
e AS (SELECT pa.*, r.* EXCLUDE (query_id, plan_id),
             round(CASE WHEN date_diff('minute', first_seen, last_seen) = 0 THEN 0
                        ELSE total_executions / date_diff('minute', first_seen, last_seen) END, 4) AS executions_per_minute,
             CAST(query_id % 60 AS DOUBLE) / 10 AS plan_cost
      FROM pa JOIN r USING (query_id, plan_id)),
f AS (SELECT query_id, plan_id,
             coalesce(executions_per_minute > 0.001, false) AS frequent_execution,
             coalesce(total_executions > 3 AND avg_reads > 0 AND (min_cpu < 0.7 * avg_cpu OR max_cpu > 1.3 * avg_cpu
                      OR min_rows < 0.7 * avg_rows OR max_rows > 1.3 * avg_rows), false) AS parameter_sniffing,
             coalesce(avg_duration > 300000 OR max_cpu > 300000 OR max_duration > 300000, false) AS long_running,
             coalesce(avg_duration > avg_cpu * 4 AND avg_cpu < 500, false) AS long_running_low_cpu,
             coalesce(plan_cost <= 10 AND avg_cpu > 5000, false) AS low_cost_high_cpu,
             plan_id % 2 <> 0 AND plan_cost BETWEEN 4.5 AND 5.0 AS near_parallel,
             query_id % 100 <= 10 AND plan_id * 100 > 1024 AS unused_grant,
             coalesce(avg_reads / 128.0 > 0.0005, false) AS big_spills,
             avg_rows > 0 AND ((query_id % 7) * 1000 * 1000 < avg_rows OR (query_id % 7) * 1000 > avg_rows * 1000) AS bad_estimate
      FROM e)
SELECT *, concat_ws(', ', CASE WHEN frequent_execution THEN 'Frequent Execution' END,
                          CASE WHEN parameter_sniffing THEN 'Parameter Sniffing' END,
                          CASE WHEN long_running THEN 'Long Running Query' END,
                          CASE WHEN long_running_low_cpu THEN 'Long Running With Low CPU' END,
                          CASE WHEN low_cost_high_cpu THEN 'Low Cost Query With High CPU' END,
                          CASE WHEN near_parallel THEN 'Nearly Parallel' END,
                          CASE WHEN unused_grant THEN 'Unused Memory Grant' END,
                          CASE WHEN big_spills THEN 'Big Spills' END,
                          CASE WHEN bad_estimate THEN 'Row Estimate Mismatch' END) AS warnings
FROM f""")
def q_qs02(spark, sf_dir):
    f4 = fx.f4_query_stats(spark, sf_dir)
    r = f4.groupBy("query_id", "plan_id").agg(F.min("n_rows").alias("min_rows"), F.max("n_rows").alias("max_rows"),
                                              F.avg("n_rows").alias("avg_rows"), F.max("duration").alias("max_duration"))
    p = qs.plan_summary(f4).join(r, ["query_id", "plan_id"])
    p = p.withColumns({
        "executions_per_minute": F.round(try_ratio("total_executions", datediff_boundary(
            "minute", F.col("first_seen"), F.col("last_seen")), 0.0), 4),
        "plan_cost": (F.col("query_id") % 60).cast("double") / 10, "is_parallel": F.col("plan_id") % 2 == 0,
        "pct_grant_used": F.col("query_id") % 100, "min_grant_kb": F.col("plan_id") * 100, "avg_spills": F.col("avg_reads"),
        "estimated_rows": (F.col("query_id") % 7) * 1000})
    f = qs.warning_string(qs.query_flags(p, execution_threshold=0.001, sniffing_reads=0, cost_col="plan_cost", spill_mb=0.0005))
    return f.select("query_id", "plan_id", *_FLAGS, "warnings")


@reg("qs05_multiple_plans", ofx.with_(ofx.f4_query_stats()) + """
SELECT query_id, CAST(count(DISTINCT plan_id) AS BIGINT) AS plan_count,
       arg_max(plan_id, (interval_ts, plan_id)) AS latest_plan_id, max(interval_ts) AS last_seen
FROM f4 GROUP BY query_id HAVING count(DISTINCT plan_id) >= 30""")
def q_qs05(spark, sf_dir):
    return qs.multiple_plans(fx.f4_query_stats(spark, sf_dir), min_plans=30)


AS_OF = dt.datetime(2001, 12, 1)


@reg("qs06_cache_age_histogram", ofx.with_(ofx.f4_query_stats()) + """
, p AS (SELECT query_id, plan_id, min(interval_ts) AS created, sum(executions) AS execs FROM f4 GROUP BY ALL),
q AS (SELECT query_id, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT *, date_diff('hour', created, TIMESTAMP '2001-12-01') AS age FROM p)
SELECT CAST(count(*) AS BIGINT) AS plans,
       round(count_if(age <= 2160) * 100.0 / count(*), 4) AS pct_created_2160h,
       round(count_if(age <= 8760) * 100.0 / count(*), 4) AS pct_created_8760h,
       round(count_if(age <= 26280) * 100.0 / count(*), 4) AS pct_created_26280h,
       round(count_if(execs = 1) * 100.0 / count(*), 4) AS pct_single_use,
       round((SELECT sum(n - 1) FROM q) * 100.0 / count(*), 4) AS pct_duplicate_plans,
       CAST((SELECT count(*) FROM q WHERE n > 1) AS BIGINT) AS queries_with_duplicates
FROM h""")
def q_qs06(spark, sf_dir):
    return qs.cache_age_histogram(fx.f4_query_stats(spark, sf_dir), AS_OF, windows_hours=(2160, 8760, 26280))


@reg("qs11_daily_intervals", ofx.with_(ofx.f4_hourly()) + """
SELECT query_id, plan_id, date_trunc('day', interval_ts) AS interval_day,
       CAST(sum(count_executions) AS BIGINT) AS executions,
       round(sum(avg_duration * count_executions) / sum(count_executions), 4) AS avg_duration,
       round(sum(avg_cpu * count_executions) / sum(count_executions), 4) AS avg_cpu
FROM f4h GROUP BY ALL""")
def q_qs11(spark, sf_dir):
    return qs.daily_intervals(fm.f4_hourly(spark, sf_dir))


def _worst_sql(unit: str) -> str:
    return ofx.with_(ofx.f4_hourly()) + f"""
, u AS (SELECT date_trunc('{unit}', interval_ts) AS interval_start, 'avg_duration' AS metric,
               avg_duration * count_executions AS total FROM f4h
        UNION ALL SELECT date_trunc('{unit}', interval_ts), 'avg_cpu', avg_cpu * count_executions FROM f4h),
g AS (SELECT metric, interval_start, round(sum(total), 4) AS total FROM u GROUP BY ALL)
SELECT metric, interval_start, total, lower(strftime(interval_start, '%-I%p')) AS hour_label
FROM g QUALIFY row_number() OVER (PARTITION BY metric ORDER BY total DESC, interval_start DESC) = 1"""


@reg("qs11_worst_day", _worst_sql("day"))
def q_qs11w(spark, sf_dir):
    return qs.worst_intervals(fm.f4_hourly(spark, sf_dir), unit="day")


@reg("qs17_worst_hour_ampm", _worst_sql("hour"))
def q_qs17(spark, sf_dir):
    return qs.worst_intervals(fm.f4_hourly(spark, sf_dir), unit="hour")


@reg("qs12_top_plans_in_worst_intervals", ofx.with_(ofx.f4_hourly()) + """
, u AS (SELECT query_id, plan_id, date_trunc('day', interval_ts) AS interval_start, 'avg_duration' AS metric,
               avg_duration * count_executions AS total FROM f4h
        """ + " ".join(f"UNION ALL SELECT query_id, plan_id, date_trunc('day', interval_ts), '{m}', {m} * count_executions FROM f4h"
                         for m in ["avg_cpu", *fm.HOURLY_METRICS]) + """),
g AS (SELECT metric, interval_start, round(sum(total), 4) AS total FROM u GROUP BY ALL),
worst AS (SELECT metric, interval_start FROM g
          QUALIFY row_number() OVER (PARTITION BY metric ORDER BY total DESC, interval_start DESC) = 1),
pl AS (SELECT u.metric, query_id, plan_id, round(sum(total), 4) AS total FROM u
       JOIN worst w ON u.metric = w.metric AND u.interval_start = w.interval_start GROUP BY ALL),
top AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY metric ORDER BY total DESC, query_id, plan_id) <= 3)
SELECT query_id, plan_id, list_sort(list_distinct(list(metric))) AS metrics FROM top GROUP BY ALL""")
def q_qs12(spark, sf_dir):
    return qs.top_plans_in_worst_intervals(fm.f4_hourly(spark, sf_dir), n=3,
                                            avg_metrics=["avg_duration", "avg_cpu", *fm.HOURLY_METRICS])


@reg("qs13_plan_regressions", ofx.with_(ofx.f4_query_stats()) + """
, p AS (SELECT query_id, plan_id, max(interval_ts) AS last_seen, sum(duration) / sum(executions) AS avg_metric
        FROM f4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rk, lead(avg_metric) OVER w AS prev_avg, lead(plan_id) OVER w AS prev_plan_id
      FROM p WINDOW w AS (PARTITION BY query_id ORDER BY last_seen DESC, plan_id DESC))
SELECT query_id, plan_id AS current_plan_id, prev_plan_id, round(avg_metric, 4) AS current_avg,
       round(prev_avg, 4) AS previous_avg, round((avg_metric - prev_avg) * 100.0 / nullif(prev_avg, 0), 4) AS pct_change
FROM r WHERE rk = 1 AND prev_plan_id IS NOT NULL""")
def q_qs13(spark, sf_dir):
    return qs.plan_regressions(fx.f4_query_stats(spark, sf_dir))


@reg("qs15_top_resource_queries", ofx.with_(ofx.f4_query_stats()) + """
, g AS (SELECT query_id, CAST(sum(executions) AS BIGINT) AS total_executions, CAST(sum(cpu) AS BIGINT) AS total_cpu,
               CAST(sum(reads) AS BIGINT) AS total_reads, CAST(sum(writes) AS BIGINT) AS total_writes,
               CAST(sum(duration) AS BIGINT) AS total_duration FROM f4 GROUP BY query_id)
SELECT g.*, round(CASE WHEN total_executions = 0 THEN 0 ELSE total_cpu / total_executions END, 4) AS avg_cpu,
       p_name AS query_text
FROM g JOIN part ON g.query_id = p_partkey ORDER BY total_cpu DESC, query_id LIMIT 10""")
def q_qs15(spark, sf_dir):
    return qs.top_resource_queries(fx.f4_query_stats(spark, sf_dir), fm.f4_texts(spark, sf_dir), n=10, by="cpu")


@reg("st02_sort_by_parameter", ofx.with_(ofx.f4_query_stats(), _PLAN_SQL) + """
SELECT *, 'avg duration' AS sort_order FROM pa ORDER BY avg_duration DESC, query_id, plan_id LIMIT 10""")
def q_st02(spark, sf_dir):
    return qs.sorted_plans(fx.f4_query_stats(spark, sf_dir), "avg duration", n=10)
