"""Query-statistics analytics (QS-*, SD-12).

Input is a query-store style table: one row per ``(query_id, plan_id,
interval_ts)`` with summed counters (``executions, cpu, reads, writes,
duration``) or a cumulative plan-cache variant of it.  Grand totals are
scalar subqueries (one small job, value inlined), never an unpartitioned
window, and per-metric rankings unpivot once and use one window partitioned
by metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary, try_ratio

METRICS = ["executions", "cpu", "reads", "writes", "duration"]


def _stack(metrics: Sequence[str], name: str = "sort_metric", value: str = "delta") -> Column:
    pairs = ", ".join(f"'{m}', CAST({m} AS BIGINT)" for m in metrics)
    return F.expr(f"stack({len(metrics)}, {pairs}) AS ({name}, {value})")


def query_stats_delta_top(cumulative: DataFrame, start_ts, end_ts, *, n: int = 10, metrics: Sequence[str] = METRICS,
                          keys: Sequence[str] = ("query_id", "plan_id"), ts: str = "interval_ts") -> DataFrame:
    """SD-12: resource use between two samples of cumulative plan counters
    (``value at end - value at start``, start missing = 0), top ``n`` per
    metric.  One grouped pass with ``max_by``; no self-join."""
    c = cumulative.filter(F.col(ts) <= F.lit(end_ts))
    early = F.col(ts) <= F.lit(start_ts)
    aggs = []
    for m in metrics:
        aggs.append((F.max_by(F.col(m), F.col(ts)) - F.coalesce(
            F.max_by(F.when(early, F.col(m)), F.when(early, F.col(ts))), F.lit(0))).cast("long").alias(m))
    g = c.groupBy(*keys).agg(*aggs)
    u = g.select(*keys, _stack(metrics))
    w = Window.partitionBy("sort_metric").orderBy(F.col("delta").desc(), *[F.col(k) for k in keys])
    return u.withColumn("metric_rank", F.row_number().over(w).cast("long")).filter(F.col("metric_rank") <= n)


def plan_summary(stats: DataFrame, *, keys: Sequence[str] = ("query_id", "plan_id"), ts: str = "interval_ts",
                 metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per plan totals, averages per execution, first/last seen."""
    aggs = [F.sum(m).cast("long").alias(f"total_{m}") for m in metrics]
    aggs += [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")]
    if "min_cpu" in stats.columns:
        aggs += [F.min("min_cpu").alias("min_cpu"), F.max("max_cpu").alias("max_cpu")]
    g = stats.groupBy(*keys).agg(*aggs)
    for m in metrics:
        if m != "executions":
            g = g.withColumn(f"avg_{m}", F.round(try_ratio(f"total_{m}", "total_executions", 0.0), 4))
    return g


def share_of_total(stats: DataFrame, *, keys: Sequence[str] = ("query_id", "plan_id"), ts: str = "interval_ts",
                   metrics: Sequence[str] = METRICS, digits: int = 4) -> DataFrame:
    """QS-1: each plan's share of the grand total per metric and executions
    per minute of its lifetime.  Grand totals come from one scalar subquery
    per metric (a tiny separate aggregate); nothing is cross-joined."""
    p = plan_summary(stats, keys=keys, ts=ts, metrics=metrics)
    # one scalar subquery returning a struct, projected once as a column
    totals = stats.agg(F.struct(*[F.sum(m).alias(m) for m in metrics]).alias("t")).scalar()
    p = p.withColumn("__totals", totals)
    cols = [*keys]
    for m in metrics:
        tot = F.col("__totals").getField(m)
        cols.append(F.round(try_ratio(F.col(f"total_{m}") * 100.0, tot, 0.0), digits).alias(f"pct_{m}"))
    minutes = datediff_boundary("minute", F.col("first_seen"), F.col("last_seen"))
    cols.append(F.round(try_ratio("total_executions", minutes, 0.0), digits).alias("executions_per_minute"))
    return p.select(*cols)


DEFAULT_FLAGS = dict(execution_threshold=1000, sniffing_pct=30, sniffing_reads=100000,
                     long_running_ms=300 * 1000, low_cpu_ms=500.0, high_cpu_ms=5000.0)


def query_flags(plans: DataFrame, *, execution_threshold: float = 1000, sniffing_pct: float = 30,
                sniffing_reads: float = 100000, long_running_ms: float = 300 * 1000, low_cpu_ms: float = 500.0,
                cost_col: str | None = None, low_cost: float = 10.0, high_cpu_ms: float = 5000.0, cost_threshold: float = 5.0,
                near_pct: float = 10.0, grant_pct: float = 10.0, min_grant_kb: float = 1024.0, spill_mb: float = 499.0) -> DataFrame:
    """QS-2: query-level warning flags from a :func:`plan_summary` frame.

    Optional inputs (flags without their inputs are left out):
    ``executions_per_minute``; ``min_cpu, max_cpu``; ``min_rows, max_rows,
    avg_rows`` (returned rows); ``max_duration``; the plan cost (``cost_col``)
    with ``is_parallel``; ``pct_grant_used, min_grant_kb``; ``avg_spills``
    (pages); ``estimated_rows``."""
    cols = set(plans.columns)
    avg_reads, avg_cpu, avg_dur = F.col("avg_reads"), F.col("avg_cpu"), F.col("avg_duration")
    execs = F.col("total_executions")
    lo, hi = 1.0 - sniffing_pct / 100.0, 1.0 + sniffing_pct / 100.0
    flags = {}
    if "executions_per_minute" in cols:
        flags["frequent_execution"] = F.col("executions_per_minute") > execution_threshold
    spread, slow = F.lit(False), avg_dur > long_running_ms
    for low, high, mean in (("min_cpu", "max_cpu", "avg_cpu"), ("min_rows", "max_rows", "avg_rows")):
        if {low, high, mean} <= cols:
            spread = spread | (F.col(low) < F.lit(lo) * F.col(mean)) | (F.col(high) > F.lit(hi) * F.col(mean))
            flags["parameter_sniffing"] = (execs > 3) & (avg_reads > sniffing_reads) & spread
    for c in ("max_cpu", "max_duration"):
        if c in cols:
            slow = slow | (F.col(c) > long_running_ms)
    flags["long_running"] = slow
    flags["long_running_low_cpu"] = (avg_dur > avg_cpu * 4) & (avg_cpu < low_cpu_ms)
    if cost_col:
        cost = F.col(cost_col)
        flags["low_cost_high_cpu"] = (cost <= low_cost) & (avg_cpu > high_cpu_ms)
        if "is_parallel" in cols:
            flags["near_parallel"] = ~F.col("is_parallel") & cost.between(cost_threshold * (1 - near_pct / 100.0), cost_threshold)
    if {"pct_grant_used", "min_grant_kb"} <= cols:
        flags["unused_grant"] = (F.col("pct_grant_used") <= grant_pct) & (F.col("min_grant_kb") > min_grant_kb)
    if "avg_spills" in cols:
        flags["big_spills"] = F.col("avg_spills") / 128.0 > spill_mb
    if {"estimated_rows", "avg_rows"} <= cols:
        est, rows = F.col("estimated_rows"), F.col("avg_rows")
        flags["bad_estimate"] = (rows > 0) & ((est * 1000 < rows) | (est > rows * 1000))
    return plans.select("*", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


WARNING_TEXT = {
    "frequent_execution": "Frequent Execution",
    "parameter_sniffing": "Parameter Sniffing",
    "long_running": "Long Running Query",
    "long_running_low_cpu": "Long Running With Low CPU",
    "low_cost_high_cpu": "Low Cost Query With High CPU",
    "near_parallel": "Nearly Parallel",
    "unused_grant": "Unused Memory Grant",
    "big_spills": "Big Spills",
    "bad_estimate": "Row Estimate Mismatch",
}


def warning_string(flagged: DataFrame, *, out: str = "warnings", sep: str = ", ") -> DataFrame:
    """QS-4: the set flags as one comma-separated warning string."""
    parts = [F.when(F.col(k), F.lit(v)) for k, v in WARNING_TEXT.items() if k in flagged.columns]
    return flagged.withColumn(out, F.array_join(F.array_compact(F.array(*parts)), sep))


def multiple_plans(stats: DataFrame, *, min_plans: int = 2, query: str = "query_id", plan: str = "plan_id",
                   ts: str = "interval_ts") -> DataFrame:
    """QS-5: queries with several plans; the most recent plan via ``max_by``
    with the plan id as tie-break."""
    g = stats.groupBy(query).agg(
        F.count_distinct(plan).cast("long").alias("plan_count"),
        F.max_by(F.col(plan), F.struct(F.col(ts), F.col(plan))).alias("latest_plan_id"),
        F.max(ts).alias("last_seen"))
    return g.filter(F.col("plan_count") >= min_plans)


def cache_age_histogram(stats: DataFrame, as_of, *, windows_hours: Sequence[int] = (24, 4, 1),
                        query: str = "query_id", plan: str = "plan_id", ts: str = "interval_ts",
                        executions: str = "executions") -> DataFrame:
    """QS-6: share of plans created within each window before ``as_of`` (hours
    by boundary: a window of one hour starts at the hour before), of single-use
    plans, and of duplicate plans (plans beyond the first of their query)."""
    p = stats.groupBy(query, plan).agg(F.min(ts).alias("created"), F.sum(executions).alias("execs"))
    hours = datediff_boundary("hour", F.col("created"), F.lit(as_of))
    flags = [F.sum(F.when(hours <= h, 1).otherwise(0)).alias(f"n{h}") for h in windows_hours]
    per = p.groupBy(query).agg(F.count(F.lit(1)).cast("long").alias("plans"), F.sum(F.when(F.col("execs") == 1, 1).otherwise(0)).alias("single"),
                               *flags)
    total = F.sum("plans")

    def pct(x):
        return F.round(x * 100.0 / total, 4)

    return per.agg(total.cast("long").alias("plans"), *[pct(F.sum(f"n{h}")).alias(f"pct_created_{h}h") for h in windows_hours],
                   pct(F.sum("single")).alias("pct_single_use"), pct(F.sum(F.col("plans") - 1)).alias("pct_duplicate_plans"),
                   F.count_if(F.col("plans") > 1).cast("long").alias("queries_with_duplicates"))


def daily_intervals(hourly: DataFrame, *, keys: Sequence[str] = ("query_id", "plan_id"), ts: str = "interval_ts",
                    count: str = "count_executions", avg_metrics: Sequence[str] = ("avg_duration", "avg_cpu"),
                    unit: str = "day") -> DataFrame:
    """QS-11: roll hourly query-store intervals up to days with a weighted
    mean ``Σ(avg·n)/Σn`` (the reference's ``SUM(avg)/SUM(n)`` is not a mean)."""
    g = hourly.groupBy(*keys, F.date_trunc(unit, ts).alias("interval_day")).agg(
        F.sum(count).cast("long").alias("executions"),
        *[F.sum(F.col(m) * F.col(count)).alias(f"__w_{m}") for m in avg_metrics])
    return g.select(*keys, "interval_day", "executions",
                    *[F.round(try_ratio(f"__w_{m}", "executions"), 4).alias(m) for m in avg_metrics])


def worst_intervals(hourly: DataFrame, *, ts: str = "interval_ts", count: str = "count_executions",
                    avg_metrics: Sequence[str] = ("avg_duration", "avg_cpu"), unit: str = "day") -> DataFrame:
    """QS-11/QS-17: for each metric the interval with the largest total
    (``Σ avg·n``) and its hour label (``12am``..``11pm`` for hourly units)."""
    parts = ", ".join(f"'{m}', {m} * {count}" for m in avg_metrics)
    u = hourly.select(F.date_trunc(unit, ts).alias("interval_start"),
                      F.expr(f"stack({len(avg_metrics)}, {parts}) AS (metric, total)"))
    g = u.groupBy("metric", "interval_start").agg(F.round(F.sum("total"), 4).alias("total"))
    best = g.groupBy("metric").agg(F.max_by(F.struct("total", "interval_start"), F.struct(
        F.col("total"), F.col("interval_start"))).alias("b"))
    out = best.select("metric", F.col("b.interval_start").alias("interval_start"), F.col("b.total").alias("total"))
    return out.withColumn("hour_label", F.lower(F.date_format("interval_start", "ha")))


def top_plans_in_worst_intervals(hourly: DataFrame, *, n: int = 3, keys: Sequence[str] = ("query_id", "plan_id"),
                                 ts: str = "interval_ts", count: str = "count_executions",
                                 avg_metrics: Sequence[str] = ("avg_duration", "avg_cpu"),
                                 unit: str = "day") -> DataFrame:
    """QS-12: per metric the top ``n`` plans inside that metric's worst
    interval, unioned and de-duplicated to one row per plan listing the
    metrics it was selected for.  The worst-interval frame has one row per
    metric, so the equi-join against it is a broadcast by AQE's measurement."""
    worst = worst_intervals(hourly, ts=ts, count=count, avg_metrics=avg_metrics, unit=unit).select(
        "metric", "interval_start")
    parts = ", ".join(f"'{m}', {m} * {count}" for m in avg_metrics)
    u = hourly.select(*keys, F.date_trunc(unit, ts).alias("interval_start"),
                      F.expr(f"stack({len(avg_metrics)}, {parts}) AS (metric, total)"))
    u = u.join(worst, ["metric", "interval_start"], "left_semi")
    g = u.groupBy("metric", *keys).agg(F.round(F.sum("total"), 4).alias("total"))
    w = Window.partitionBy("metric").orderBy(F.col("total").desc(), *[F.col(k) for k in keys])
    top = g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_set("metric")).alias("metrics"))


def plan_regressions(stats: DataFrame, *, query: str = "query_id", plan: str = "plan_id", ts: str = "interval_ts",
                     metric: str = "duration", executions: str = "executions", min_pct: float | None = None) -> DataFrame:
    """QS-13: current plan (latest last-seen) against the plan before it, %
    change in average ``metric``.  ``lag`` is taken before keeping rank 1
    (the reference filters first, which leaves the previous value NULL)."""
    p = stats.groupBy(query, plan).agg(F.max(ts).alias("last_seen"),
                                       (F.sum(metric) / F.sum(executions)).alias("avg_metric"))
    w = Window.partitionBy(query).orderBy(F.col("last_seen").desc(), F.col(plan).desc())
    p = p.select("*", F.row_number().over(w).alias("__rk"),
                 F.lead("avg_metric").over(w).alias("prev_avg"), F.lead(plan).over(w).alias("prev_plan_id"))
    cur = p.filter((F.col("__rk") == 1) & F.col("prev_plan_id").isNotNull())
    out = cur.select(query, F.col(plan).alias("current_plan_id"), "prev_plan_id",
                     F.round("avg_metric", 4).alias("current_avg"), F.round("prev_avg", 4).alias("previous_avg"),
                     F.round(try_ratio((F.col("avg_metric") - F.col("prev_avg")) * 100.0, "prev_avg"), 4)
                     .alias("pct_change"))
    return out if min_pct is None else out.filter(F.col("pct_change") >= min_pct)


def top_resource_queries(stats: DataFrame, texts: DataFrame, *, n: int = 10, by: str = "cpu",
                         query: str = "query_id") -> DataFrame:
    """QS-15 / ST-1 / ST-2: top ``n`` queries by total ``by`` with their text
    (inner join on the query key after the per-query aggregate, so only
    aggregated rows move; the final ``orderBy().limit()`` is a
    TakeOrderedAndProject with a unique tie-break)."""
    g = stats.groupBy(query).agg(*[F.sum(m).cast("long").alias(f"total_{m}") for m in METRICS])
    g = g.withColumn(f"avg_{by}", F.round(try_ratio(f"total_{by}", "total_executions", 0.0), 4))
    j = g.join(texts, query)
    return j.orderBy(F.col(f"total_{by}").desc(), F.col(query)).limit(n)


SORT_ORDERS = {
    "cpu": "total_cpu", "reads": "total_reads", "writes": "total_writes", "duration": "total_duration",
    "executions": "total_executions", "avg cpu": "avg_cpu", "avg reads": "avg_reads", "avg writes": "avg_writes",
    "avg duration": "avg_duration",
}


def sorted_plans(stats: DataFrame, sort_order: str = "cpu", *, n: int = 10) -> DataFrame:
    """ST-2: sort key chosen by parameter name (``avg ...`` = total ÷ executions)."""
    col = SORT_ORDERS[sort_order.lower()]
    p = plan_summary(stats)
    return p.orderBy(F.col(col).desc(), "query_id", "plan_id").limit(n).withColumn("sort_order", F.lit(sort_order))
