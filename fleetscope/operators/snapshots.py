"""Snapshot-delta operators (SD-1 ... SD-17).

Telemetry arrives as cumulative counters sampled at check times.  A delta
is the difference to the *immediately previous* snapshot of the same
server; it is only meaningful when the gap is short and the counter did not
fall (which means the server restarted and the counters were reset).

Physical plan: one ``lag`` window over ``(server, keys, day)`` ordered by
time -- a hot server is spread over its keys and a hot series over its days,
with the first row of a day patched from the previous day's last row -- plus
an equi-join to the per-server snapshot calendar (distinct ``(server, ts)``,
small; AQE broadcasts it when it measures small).  This replaces the
reference's theta self-join on ``CheckDate``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary, try_ratio


def snapshot_calendar(df: DataFrame, *, ts: str = "check_ts", server: str = "server_name",
                      bucket: str | None = "day") -> DataFrame:
    """Distinct snapshot times per server with the server's previous time
    (time-bucketed ``lag``, so a server with most snapshots is not one task)."""
    from .relational import bucketed_lag

    snaps = df.select(server, ts).distinct()
    return bucketed_lag(snaps, by=[server], ts=ts, bucket=bucket, prefix="__cal_").withColumnRenamed(
        f"__cal_{ts}", "server_prev_ts")


def _bucketed_lag(base: DataFrame, part: Sequence[str], ts: str, counters: Sequence[str], bucket: str) -> DataFrame:
    """``lag`` over ``(series, ts)`` computed without one task per series:
    the window runs per ``(series, time bucket)`` and the first row of a
    bucket takes its predecessor from the previous non-empty bucket (see
    :func:`fleetscope.operators.relational.bucketed_lag`)."""
    from .relational import bucketed_lag

    x = bucketed_lag(base, by=part, ts=ts, cols=counters, bucket=bucket, prefix="__prev_")
    return x.withColumnRenamed(f"__prev_{ts}", "prev_ts")


def snapshot_delta(
    df: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    *,
    ts: str = "check_ts",
    server: str = "server_name",
    carry: Sequence[str] = (),
    min_minutes: int | None = 1,
    max_minutes: int | None = 60,
    monotonic: Sequence[str] | None = None,
    drop_resets: bool = True,
    strict: bool = True,
    bucket: str | None = "day",
) -> DataFrame:
    """SD-1: per-counter delta against the previous snapshot.

    Output columns: ``server, keys, ts, carry, prev_ts, elapsed_seconds,
    elapsed_minutes`` and ``<counter>_delta`` for each counter.

    * ``strict``: the key must exist at the server's immediately previous
      snapshot (the reference inner-joins on the previous check date); a
      plain per-key ``lag`` would otherwise reach further back.
    * the gap rule counts minute *boundaries* like T-SQL ``DATEDIFF``.
    * ``drop_resets``: rows where any ``monotonic`` counter fell are dropped.
    * ``bucket``: the ``lag`` runs per ``(series, time bucket)`` with a
      boundary fix-up (:func:`_bucketed_lag`) so one hot series never lands
      in a single task; ``None`` uses one window per series.
    """
    monotonic = list(counters) if monotonic is None else list(monotonic)
    part = [server, *keys]
    cols = [*part, ts, *carry, *counters]
    base = df.select(*dict.fromkeys(cols))
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(ts)
        out = base.select(
            "*",
            F.lag(ts).over(w).alias("prev_ts"),
            *[F.lag(c).over(w).alias(f"__prev_{c}") for c in counters],
        )
    else:
        out = _bucketed_lag(base, part, ts, counters, bucket)
    out = out.filter(F.col("prev_ts").isNotNull())
    if strict:
        cal = snapshot_calendar(df, ts=ts, server=server)
        out = out.join(cal, [server, ts], "inner").filter(F.col("prev_ts") == F.col("server_prev_ts")).drop(
            "server_prev_ts")
    minutes = datediff_boundary("minute", F.col("prev_ts"), F.col(ts))
    if min_minutes is not None:
        out = out.filter(minutes >= min_minutes)
    if max_minutes is not None:
        out = out.filter(minutes <= max_minutes)
    if drop_resets and monotonic:
        cond = None
        for c in monotonic:
            ok = F.col(c) >= F.col(f"__prev_{c}")
            cond = ok if cond is None else cond & ok
        out = out.filter(cond)
    return out.select(
        *part, ts, *carry, "prev_ts",
        datediff_boundary("second", F.col("prev_ts"), F.col(ts)).alias("elapsed_seconds"),
        minutes.alias("elapsed_minutes"),
        *[(F.col(c) - F.col(f"__prev_{c}")).alias(f"{c}_delta") for c in counters],
    )


def with_rates(deltas: DataFrame, counters: Sequence[str], *, digits: int = 6) -> DataFrame:
    """SD-2: per-second and per-minute rates of each ``<counter>_delta``."""
    cols = []
    for c in counters:
        d = F.col(f"{c}_delta")
        cols.append(F.round(try_ratio(d, "elapsed_seconds"), digits).alias(f"{c}_per_sec"))
        cols.append(F.round(try_ratio(d * 60, "elapsed_seconds"), digits).alias(f"{c}_per_min"))
    return deltas.select("*", *cols)


def categorize(deltas: DataFrame, categories: DataFrame, *, key: str = "metric", category_key: str = "metric",
               category: str = "category", ignorable: str = "ignorable", default: str = "Other") -> DataFrame:
    """SD-4: attach a category dimension: ``COALESCE(category, 'Other')``,
    ``COALESCE(ignorable, false)``.  Left join; AQE broadcasts the dimension
    when its measured size is small."""
    dim = categories.select(F.col(category_key).alias("__k"), F.col(category).alias("__cat"),
                            F.col(ignorable).alias("__ign"))
    j = deltas.join(dim, deltas[key] == dim["__k"], "left")
    return j.select(
        *[deltas[c] for c in deltas.columns],
        F.coalesce(F.col("__cat"), F.lit(default)).alias(category),
        F.coalesce(F.col("__ign"), F.lit(False)).alias(ignorable),
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  rank_col: str = "rn") -> DataFrame:
    """WN-1 / ST-1: ``ROW_NUMBER`` top-n per group.  ``order`` must end in a
    unique tie-break so the result is deterministic."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).filter(F.col(rank_col) <= n)


def top_waits(deltas: DataFrame, *, n: int = 10, server: str = "server_name", metric: str = "metric",
              value: str = "cum_value_delta", count: str = "cum_count_delta", signal: str | None = "cum_signal_delta",
              exclude_ignorable: bool = True) -> DataFrame:
    """Top waits per server over the whole window: total wait, waits, avg per
    wait, signal share.  Partial aggregation happens before the exchange."""
    d = deltas
    if exclude_ignorable and "ignorable" in d.columns:
        d = d.filter(~F.col("ignorable"))
    keys = [server, metric] + (["category"] if "category" in d.columns else [])
    aggs = [F.sum(value).cast("long").alias("wait_total"), F.sum(count).cast("long").alias("waits"),
            F.sum("elapsed_seconds").cast("long").alias("seconds_sampled")]
    if signal:
        aggs.append(F.sum(signal).cast("long").alias("signal_total"))
    g = d.groupBy(*keys).agg(*aggs)
    g = g.withColumn("avg_per_wait", F.round(try_ratio("wait_total", "waits", 0.0), 4))
    if signal:
        g = g.withColumn("signal_pct", F.round(try_ratio(F.col("signal_total") * 100, "wait_total", 0.0), 4))
    return top_per_group(g, [server], [F.col("wait_total").desc(), F.col(metric)], n, "wait_rank")


def significant_waits(deltas: DataFrame, *, share: float = 0.5, n: int = 10, server: str = "server_name",
                      metric: str = "metric", value: str = "cum_value_delta", ts: str = "check_ts",
                      scale: float = 1000.0) -> DataFrame:
    """SD-7: per sample, waits whose delta exceeds ``share`` x elapsed time
    (``value`` in ms, so ``elapsed_seconds * scale``); top ``n`` per sample."""
    d = deltas.filter(F.col(value) > F.lit(share) * F.col("elapsed_seconds") * F.lit(scale))
    d = d.select(server, ts, metric, "elapsed_seconds", F.col(value).alias("wait_delta"),
                 F.floor(F.col(value) / 1000).cast("long").alias("wait_seconds"))
    return top_per_group(d, [server, ts], [F.col("wait_delta").desc(), F.col(metric)], n, "wait_rank")


def poison_waits(deltas: DataFrame, poison: Sequence[str], *, threshold: float = 1000.0, server: str = "server_name",
                 metric: str = "metric", value: str = "cum_value_delta", ts: str = "check_ts") -> DataFrame:
    """SD-8: listed metric names with delta above ``threshold``.  The list is
    a literal in the plan (``isin``), so no join is needed."""
    return deltas.filter(F.col(metric).isin(list(poison)) & (F.col(value) > threshold)).select(
        server, ts, metric, F.col(value).alias("wait_delta"),
        F.floor(F.col(value) / 1000).cast("long").alias("wait_seconds"))


def file_io_deltas(files: DataFrame, *, max_minutes: int | None = 60, min_minutes: int | None = 1,
                   server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-3: file I/O deltas: size growth, stalls, average stall per I/O (0
    when there was no I/O), MB read/written."""
    counters = ["size_on_disk_mb", "num_of_reads", "io_stall_read_ms", "bytes_read", "num_of_writes",
                "io_stall_write_ms", "bytes_written"]
    d = snapshot_delta(files, ["database_id", "file_id"], counters, ts=ts, server=server,
                       carry=["type_desc", "physical_name"], min_minutes=min_minutes, max_minutes=max_minutes,
                       monotonic=["num_of_reads", "num_of_writes"])
    return d.select(
        server, "database_id", "file_id", ts, "type_desc", "physical_name", "elapsed_seconds",
        F.col("size_on_disk_mb_delta").alias("size_growth_mb"),
        F.col("io_stall_read_ms_delta").alias("io_stall_read_ms"),
        F.col("num_of_reads_delta").alias("num_of_reads"),
        F.round(try_ratio("io_stall_read_ms_delta", "num_of_reads_delta", 0.0), 4).alias("avg_read_stall_ms"),
        F.round(F.col("bytes_read_delta") / 1048576.0, 4).alias("mb_read"),
        F.col("io_stall_write_ms_delta").alias("io_stall_write_ms"),
        F.col("num_of_writes_delta").alias("num_of_writes"),
        F.round(try_ratio("io_stall_write_ms_delta", "num_of_writes_delta", 0.0), 4).alias("avg_write_stall_ms"),
        F.round(F.col("bytes_written_delta") / 1048576.0, 4).alias("mb_written"),
    )


def two_sample_report(snapshots: DataFrame, start_ts, end_ts, *, cores: int = 1, server: str = "server_name",
                      metric: str = "metric", ts: str = "check_ts", value: str = "cum_value",
                      count: str = "cum_count", signal: str = "cum_signal", digits: int = 4) -> DataFrame:
    """SD-5: wait report between two samples.

    Instead of joining the snapshot table to itself, both samples are read in
    one filtered scan and folded with conditional sums per (server, metric);
    only rows whose count and wait both grew are kept.
    """
    s = snapshots.filter(F.col(ts).isin(F.lit(start_ts), F.lit(end_ts)))
    at_end = F.col(ts) == F.lit(end_ts)

    def diff(c):
        return (F.sum(F.when(at_end, F.col(c)).otherwise(-F.col(c)))).cast("long")

    g = s.groupBy(server, metric).agg(
        diff(value).alias("wait_ms"), diff(count).alias("waits"), diff(signal).alias("signal_ms"),
        F.count(F.lit(1)).alias("__n"))
    seconds = datediff_boundary("second", F.lit(start_ts), F.lit(end_ts))
    g = g.filter((F.col("__n") == 2) & (F.col("waits") > 0) & (F.col("wait_ms") > 0))
    return g.select(
        server, metric,
        seconds.alias("seconds_sampled"),
        F.round(F.col("wait_ms") / 1000.0, digits).alias("wait_seconds"),
        F.round(try_ratio("wait_ms", "waits", 0.0), digits).alias("avg_ms_per_wait"),
        F.round(F.col("wait_ms") / 1000.0 / F.lit(cores) / seconds, digits).alias("per_core_per_second"),
        F.round(F.col("signal_ms") / 1000.0, digits).alias("signal_seconds"),
        F.round(try_ratio(F.col("signal_ms") * 100.0, "wait_ms", 0.0), digits).alias("pct_signal"),
        F.col("waits").alias("number_of_waits"),
    )


def stall_ranking(file_deltas: DataFrame, unit: Column, name: str, *, server: str = "server_name", n: int | None = None) -> DataFrame:
    """SD-6: read and write stall per ``unit`` (file or drive), ranked per
    server; the read and write patterns come from one aggregate and are
    unpivoted, not re-scanned."""
    g = file_deltas.groupBy(server, unit.alias(name)).agg(
        F.sum("io_stall_read_ms").cast("long").alias("read_stall"), F.sum("num_of_reads").cast("long").alias("reads"),
        F.sum("io_stall_write_ms").cast("long").alias("write_stall"),
        F.sum("num_of_writes").cast("long").alias("writes"))
    u = g.select(server, name, F.expr(
        "stack(2, 'READ', read_stall, reads, 'WRITE', write_stall, writes) AS (pattern, stall_ms, ios)"))
    u = u.withColumn("avg_stall_ms", F.round(try_ratio("stall_ms", "ios", 0.0), 4))
    w = Window.partitionBy(server, "pattern").orderBy(F.col("avg_stall_ms").desc(), F.col(name))
    u = u.withColumn("stall_rank", F.row_number().over(w).cast("long"))
    return u if n is None else u.filter(F.col("stall_rank") <= n)


def file_stall_ranking(file_deltas: DataFrame, **kw) -> DataFrame:
    """SD-6 per file."""
    return stall_ranking(file_deltas, F.col("physical_name"), "physical_name", **kw)


def drive_stall_ranking(file_deltas: DataFrame, **kw) -> DataFrame:
    """SD-6 per drive."""
    from ..functions.scalar import drive_of

    return stall_ranking(file_deltas, drive_of("physical_name"), "drive", **kw)


def slow_files(file_deltas: DataFrame, *, threshold_ms: float = 100.0, min_stall_ms: int = 1000,
               server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-9: data-file reads (check 11) and log-file writes (check 12) whose
    average latency in the sample reaches ``threshold_ms``."""
    from .findings import as_findings

    d = file_deltas
    reads = d.filter((F.col("type_desc") == "ROWS") & (F.col("num_of_reads") > 0)
                     & (F.col("io_stall_read_ms") > min_stall_ms)
                     & (F.floor(F.col("io_stall_read_ms") / F.col("num_of_reads")) >= threshold_ms))
    writes = d.filter((F.col("type_desc") == "LOG") & (F.col("num_of_writes") > 0)
                      & (F.col("io_stall_write_ms") > min_stall_ms)
                      & (F.floor(F.col("io_stall_write_ms") / F.col("num_of_writes")) >= threshold_ms))
    r = as_findings(reads, check_id=11, priority=50, group="Server Performance", finding="Slow Data File Reads",
                    details=F.concat(F.lit("File: "), F.col("physical_name"), F.lit("; reads: "),
                                     F.col("num_of_reads").cast("string")),
                    value=F.floor(F.col("io_stall_read_ms") / F.col("num_of_reads")), server=server,
                    database=F.col("database_id").cast("string"), ts=ts)
    w = as_findings(writes, check_id=12, priority=50, group="Server Performance", finding="Slow Log File Writes",
                    details=F.concat(F.lit("File: "), F.col("physical_name"), F.lit("; writes: "),
                                     F.col("num_of_writes").cast("string")),
                    value=F.floor(F.col("io_stall_write_ms") / F.col("num_of_writes")), server=server,
                    database=F.col("database_id").cast("string"), ts=ts)
    return r.unionByName(w)


def ratio_alert(deltas: DataFrame, numerator: str, denominator: str, *, min_numerator: float = 75,
                per_second: float = 10, metric: str = "metric", value: str = "cum_value_delta",
                server: str = "server_name", ts: str = "check_ts", check_id: int = 15,
                finding: str = "Compilations/Sec High") -> DataFrame:
    """SD-10: numerator counter high in absolute terms and either fast
    (``> per_second`` x elapsed) or above the denominator counter.  The two
    counters are pivoted side by side per sample with conditional sums."""
    from .findings import as_findings

    d = deltas.filter(F.col(metric).isin(numerator, denominator))
    g = d.groupBy(server, ts).agg(
        F.sum(F.when(F.col(metric) == numerator, F.col(value))).alias("num"),
        F.sum(F.when(F.col(metric) == denominator, F.col(value))).alias("den"),
        F.max("elapsed_seconds").alias("secs"))
    hit = g.filter((F.col("num") > min_numerator) & F.col("den").isNotNull()
                   & ((F.col("num") > F.lit(per_second) * F.col("secs")) | (F.col("num") > F.col("den"))))
    return as_findings(hit, check_id=check_id, priority=50, group="Query Problems", finding=finding,
                       details=F.concat(F.lit("numerator: "), F.col("num").cast("string"), F.lit("; denominator: "),
                                        F.col("den").cast("string")),
                       value=F.col("num"), server=server, ts=ts)


def counter_alerts(deltas: DataFrame, rules: DataFrame, *, metric: str = "metric", value: str = "cum_value_delta",
                   server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-11: table-driven increment alerts.  ``rules`` has ``metric,
    threshold, check_id, priority, findings_group, finding``; one equi-join
    replaces one query per rule."""
    from .findings import as_findings

    j = deltas.join(rules.withColumnRenamed("metric", "__rule_metric"),
                    deltas[metric] == F.col("__rule_metric"), "inner").filter(F.col(value) > F.col("threshold"))
    return as_findings(j, check_id=F.col("check_id"), priority=F.col("priority"), group=F.col("findings_group"),
                       finding=F.col("finding"),
                       details=F.concat(F.lit("delta during the sample: "), F.col(value).cast("string")),
                       value=F.col(value), server=server, ts=ts)


def cumulative_share(snapshots: DataFrame, *, server: str = "server_name", metric: str = "metric",
                     ts: str = "check_ts", value: str = "cum_value", signal: str = "cum_signal",
                     min_share_pct: float = 0.0) -> DataFrame:
    """SD-13: since-start report per server from the latest snapshot: hours
    sampled, wait hours, minutes of wait per hour, share of the server's
    total, signal share.  Latest value per series via ``max_by`` (no sort),
    server total via a grouped aggregate joined back (no unpartitioned window)."""
    last = snapshots.groupBy(server, metric).agg(
        F.max_by(F.col(value), F.col(ts)).alias("wait_ms"), F.max_by(F.col(signal), F.col(ts)).alias("signal_ms"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    tot = last.groupBy(server).agg(F.sum("wait_ms").alias("server_wait_ms"),
                                   F.min("first_ts").alias("srv_first"), F.max("last_ts").alias("srv_last"))
    j = last.join(tot, server)
    hours = datediff_boundary("hour", F.col("srv_first"), F.col("srv_last"))
    out = j.select(
        server, metric,
        hours.alias("hours_sampled"),
        F.round(F.col("wait_ms") / 3600000.0, 4).alias("wait_hours"),
        F.round(try_ratio(F.col("wait_ms") / 60000.0, hours), 4).alias("wait_minutes_per_hour"),
        F.round(try_ratio(F.col("wait_ms") * 100.0, "server_wait_ms", 0.0), 4).alias("pct_of_total"),
        F.round(try_ratio(F.col("signal_ms") * 100.0, "wait_ms", 0.0), 4).alias("pct_signal"),
    )
    return out.filter(F.col("pct_of_total") >= min_share_pct)


def point_in_time_summary(snapshots: DataFrame, *, server: str = "server_name", ts: str = "check_ts",
                          value: str = "cum_value", count: str = "cum_count", signal: str = "cum_signal") -> DataFrame:
    """SD-14: per server at its latest snapshot: total wait, signal vs
    resource share, average wait per task."""
    latest = snapshots.groupBy(server).agg(F.max(ts).alias("__ts"))
    s = snapshots.join(latest, (snapshots[server] == latest[server]) & (snapshots[ts] == latest["__ts"]), "left_semi")
    g = s.groupBy(server).agg(F.sum(value).cast("long").alias("wait_ms"), F.sum(count).cast("long").alias("tasks"),
                              F.sum(signal).cast("long").alias("signal_ms"))
    return g.select(
        server, "wait_ms", "tasks", "signal_ms",
        (F.col("wait_ms") - F.col("signal_ms")).alias("resource_ms"),
        F.round(try_ratio(F.col("signal_ms") * 100.0, "wait_ms", 0.0), 4).alias("signal_pct"),
        F.round(try_ratio((F.col("wait_ms") - F.col("signal_ms")) * 100.0, "wait_ms", 0.0), 4).alias("resource_pct"),
        F.round(try_ratio("wait_ms", "tasks", 0.0), 4).alias("avg_wait_ms"),
    )


def counter_ratio(snapshots: DataFrame, numerator: str, base: str, *, server: str = "server_name",
                  metric: str = "metric", ts: str = "check_ts", value: str = "cum_value") -> DataFrame:
    """SD-15: hit ratio = numerator ÷ base x 100 at every snapshot (conditional
    sums instead of a self-join)."""
    s = snapshots.filter(F.col(metric).isin(numerator, base))
    g = s.groupBy(server, ts).agg(F.sum(F.when(F.col(metric) == numerator, F.col(value))).alias("num"),
                                  F.sum(F.when(F.col(metric) == base, F.col(value))).alias("den"))
    return g.select(server, ts, F.round(try_ratio(F.col("num") * 100.0, "den"), 4).alias("ratio_pct"))


def window_review(deltas: DataFrame, since, until, *, n: int = 5, server: str = "server_name",
                  metric: str = "metric", ts: str = "check_ts", value: str = "cum_value_delta") -> DataFrame:
    """SD-16: review of ``[since, until)``: top ``n`` metrics per check time
    by delta and each metric's rank over the whole window."""
    d = deltas.filter((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)))
    per_ts = top_per_group(d.select(server, ts, metric, F.col(value).alias("delta")), [server, ts],
                           [F.col("delta").desc(), F.col(metric)], n, "rank_in_sample")
    tot = d.groupBy(server, metric).agg(F.sum(value).cast("long").alias("window_total"))
    w = Window.partitionBy(server).orderBy(F.col("window_total").desc(), F.col(metric))
    tot = tot.withColumn("rank_in_window", F.rank().over(w).cast("long"))
    return per_ts.join(tot, [server, metric])


def findings_review(findings: DataFrame, since, until, *, max_priority: int = 50, ts: str = "check_ts") -> DataFrame:
    """SD-16: findings of ``[since, until]`` up to ``max_priority``, counted per
    server, priority, group and finding with their first and last occurrence."""
    f = findings.filter((F.col(ts) >= F.lit(since)) & (F.col(ts) <= F.lit(until)) & F.col("priority").between(1, max_priority)
                        & (F.col("check_id") > -1))
    return f.groupBy("server_name", "priority", "findings_group", "finding").agg(
        F.count(F.lit(1)).cast("long").alias("total_occurrences"), F.min(ts).alias("first_occurrence"), F.max(ts).alias("last_occurrence"))


def files_review(file_deltas: DataFrame, since, until, *, n: int = 5, server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-16: the ``n`` files of each server with the slowest reads and with the
    slowest writes in ``[since, until]``."""
    return file_stall_ranking(file_deltas.filter((F.col(ts) >= F.lit(since)) & (F.col(ts) <= F.lit(until))), server=server, n=n)


def counters_review(perf: DataFrame, since, until, *, server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-16: counters of ``[since, until]``: every sample's value, and the counter's smallest, largest and last value in the window."""
    d = perf.filter((F.col(ts) >= F.lit(since)) & (F.col(ts) <= F.lit(until)))
    key = [server, "object_name", "counter_name", "instance_name"]
    g = d.groupBy(*key).agg(F.min("cntr_value").alias("window_min"), F.max("cntr_value").alias("window_max"),
                            F.max_by("cntr_value", ts).alias("window_last"))
    return d.select(*key, ts, "cntr_value").join(g, key)


def ranked_queries_review(stats: DataFrame, since, until, *, metrics: Sequence[str], key: Sequence[str], n: int = 5,
                          server: str = "server_name", ts: str = "check_ts") -> DataFrame:
    """SD-16: for every sort order the ``n`` largest queries of each check time in ``[since, until]`` with their rank there and
    among all rows so chosen.  The metrics are unpivoted, so one window serves all sort orders; the overall rank sees the chosen
    rows only."""
    d = stats.filter((F.col(ts) >= F.lit(since)) & (F.col(ts) <= F.lit(until)))
    long = d.select(server, ts, *key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [server, ts, *key], list(metrics), "sort_order", "value")
    order = [F.col("value").desc(), *[F.col(c) for c in key]]
    top = long.withColumn("time_frame_rank", F.row_number().over(Window.partitionBy(server, "sort_order", ts).orderBy(*order)).cast("long"))
    top = top.filter(F.col("time_frame_rank") <= n)
    overall = F.row_number().over(Window.partitionBy(server, "sort_order").orderBy(F.col("value").desc(), F.col(ts), *[F.col(c) for c in key]))
    return top.withColumn("overall_rank", overall.cast("long"))


PERF_AVERAGE_BULK = 1073874176
PERF_LARGE_RAW_BASE = 1073939712
PERF_AVERAGE_FRACTION = 537003264
PERF_BULK_COUNT = (272696576, 272696320)
PERF_RAW_COUNT = (65792, 65536)


def counter_values_by_type(perf: DataFrame, *, server: str = "server_name", ts: str = "check_ts",
                           max_minutes: int | None = 60) -> DataFrame:
    """SD-17: perfmon value by counter type.

    ``perf``: ``server, check_ts, object_name, counter_name, instance_name,
    cntr_type, cntr_value`` (cumulative).  Deltas first (no reset rule, as in
    the reference), then one pass decides per type; average-bulk and
    fraction counters are divided by their "... base" counter via an
    equi-join on (server, object, instance, stripped name, check time).
    """
    d = snapshot_delta(perf, ["object_name", "counter_name", "instance_name"], ["cntr_value"], ts=ts, server=server,
                       carry=["cntr_type", "cntr_value"], drop_resets=False, max_minutes=max_minutes)
    t, delta = F.col("cntr_type"), F.col("cntr_value_delta")
    name = F.lower(F.col("counter_name"))
    stripped = F.trim(F.when(t == PERF_LARGE_RAW_BASE, F.regexp_replace(name, "base.*$", "")).when(
        t == PERF_AVERAGE_BULK, F.regexp_replace(name, r"\(.*$", "")).otherwise(name))
    # one pass: a counter meets its base in the group of the stripped name (a few rows)
    row = F.struct("counter_name", "cntr_type", "cntr_value", "cntr_value_delta", "elapsed_seconds")
    g = d.groupBy(server, "object_name", "instance_name", ts, stripped.alias("__join")).agg(
        F.max(F.when((t == PERF_LARGE_RAW_BASE) & (delta != 0), delta)).alias("__den"),
        F.collect_list(F.when(t != PERF_LARGE_RAW_BASE, row)).alias("__rows"))
    u = g.select(server, "object_name", "instance_name", ts, "__den", F.explode("__rows").alias("r"))
    kind, change = F.col("r.cntr_type"), F.col("r.cntr_value_delta")
    ratio = F.when(change != 0, change / F.col("__den"))
    value = (F.when(kind == PERF_AVERAGE_FRACTION, F.round(ratio, 3))
             .when(kind == PERF_AVERAGE_BULK, F.round(ratio, 6))
             .when(kind.isin(*PERF_BULK_COUNT) & (change != 0), F.round(try_ratio("r.cntr_value_delta", "r.elapsed_seconds"), 6))
             .when(kind.isin(*PERF_RAW_COUNT), F.col("r.cntr_value").cast("double")))
    return u.select(server, "object_name", "instance_name", ts, F.col("r.counter_name").alias("counter_name"), value.alias("value")).filter(
        F.col("value").isNotNull())
