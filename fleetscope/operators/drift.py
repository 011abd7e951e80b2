"""Configuration drift, version support and fleet configuration rules
(DR-1 ... DR-4, FC-4 ... FC-7).

Config snapshots: ``server_name, name, value, value_in_use``; defaults:
``name, default_value``.  Joins are on the option name (defaults are one
row per option, so AQE broadcasts them after measuring); NULLs compare with
the null-safe ``<=>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary, try_ratio
from .defaults import CONFIG_DEFAULTS, DATABASE_DEFAULTS
from .findings import as_findings


def config_defaults(spark) -> DataFrame:
    """``name, default_value, check_id``: the vendor's server defaults."""
    return spark.createDataFrame(CONFIG_DEFAULTS, "name string, default_value long, check_id int")


def database_defaults(spark) -> DataFrame:
    """``option, expected_value, check_id, priority, finding``: the vendor's database defaults."""
    return spark.createDataFrame(DATABASE_DEFAULTS, "option string, expected_value string, check_id int, priority int, finding string")


def mode_defaults(config: DataFrame, *, name: str = "name", value: str = "value") -> DataFrame:
    """Most common value per option across the fleet (ties -> smallest value),
    to find servers that differ from the rest."""
    c = config.groupBy(name, value).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy(name).agg(F.max_by(F.col(value), F.struct(F.col("n"), -F.col(value))).alias("default_value"))
    return best


def config_drift(config: DataFrame, defaults: DataFrame) -> DataFrame:
    """DR-1: options whose running value is none of their defaults (one finding
    per option, with the option's own check id) and options whose configured
    value is not the running value (rule 81).  ``defaults``: ``name,
    default_value, check_id``; an option may have several rows."""
    d = defaults.groupBy("name").agg(F.collect_set("default_value").alias("__ok"), F.min("default_value").alias("default_value"),
                                     F.min("check_id").alias("check_id"))
    nd = config.join(d, "name").filter(F.col("value_in_use").isNull() | ~F.array_contains("__ok", F.col("value_in_use")))
    a = as_findings(nd, check_id=F.col("check_id"), priority=200, group="Non-Default Server Config", finding=F.col("name"),
                    details=F.concat(F.lit("running "), F.col("value_in_use").cast("string"), F.lit(", default "),
                                     F.col("default_value").cast("string")), value=F.col("value_in_use"))
    ni = config.filter(~F.col("value").eqNullSafe(F.col("value_in_use")))
    b = as_findings(ni, check_id=81, priority=200, group="Non-Active Server Config",
                    finding="Config Not Running at Set Value",
                    details=F.concat(F.col("name"), F.lit(": set "), F.col("value").cast("string"), F.lit(", running "),
                                     F.col("value_in_use").cast("string")), value=F.col("value_in_use"))
    return a.unionByName(b)


def option_drift(options: DataFrame, expected: DataFrame, *, keys: Sequence[str] = ("server_name", "database_name"),
                 option_cols: Sequence[str] | None = None) -> DataFrame:
    """DR-2 / AG-9: wide database-option rows unpivoted to ``(option,
    value)`` in one pass and compared with ``expected(option,
    expected_value, check_id, priority, finding)``."""
    k = list(keys)
    cols = list(option_cols) if option_cols else [c for c in options.columns if c not in k]
    long = options.select(*k, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        k, cols, "option", "value")
    j = long.join(expected, "option", "inner").filter(~F.col("value").eqNullSafe(F.col("expected_value")))
    return as_findings(j, check_id=F.col("check_id"), priority=F.col("priority"), group="Non-Default Database Config",
                       finding=F.col("finding"), details=F.concat(F.col("option"), F.lit(" = "), F.col("value")),
                       database="database_name")


def config_changes(before: DataFrame, after: DataFrame, *, keys: Sequence[str] = ("server_name", "name"),
                   value: str = "value") -> DataFrame:
    """DR-3: added / removed / changed options between two snapshots (full
    outer join on the key)."""
    k = list(keys)
    b = before.select(*k, F.col(value).alias("old_value"))
    a = after.select(*k, F.col(value).alias("new_value"), F.lit(True).alias("__in_after"))
    j = b.withColumn("__in_before", F.lit(True)).join(a, k, "full_outer")
    status = (F.when(F.col("__in_before").isNull(), "added").when(F.col("__in_after").isNull(), "removed")
              .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed"))
    return j.select(*k, "old_value", "new_value", status.alias("status")).filter(F.col("status").isNotNull())


def version_support(servers: DataFrame, builds: DataFrame, lifecycle: DataFrame, as_of) -> DataFrame:
    """DR-4 / JN-8: each server's build matched as-of to the latest known
    build at or below it on the same major version, then the support dates
    of the major version.  The build catalogue becomes intervals (a build up to the next
    one of its major), so servers join it by major and range and are never sorted
    together.  ``builds``: ``major, build, cu_name``; ``lifecycle``: ``major,
    product, mainstream_end, extended_end``."""
    spans = builds.select(F.col("major").alias("__m"), F.col("build").alias("__from"), F.col("cu_name").alias("matched_cu"),
                          F.lead("build").over(Window.partitionBy("major").orderBy("build")).alias("__to"))
    s = servers.select("server_name", "major", "build")
    inside = (F.col("build") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("build") < F.col("__to")))
    m = s.join(spans, (F.col("major") == F.col("__m")) & inside, "left").join(lifecycle, "major", "left")
    return m.select("server_name", "major", "build", F.coalesce("matched_cu", F.lit("unknown build")).alias("cu_name"),
                    "product", "mainstream_end", "extended_end",
                    (F.col("extended_end") < F.lit(as_of)).alias("out_of_support"),
                    (F.col("mainstream_end") < F.lit(as_of)).alias("past_mainstream"))


def simultaneous_jobs(schedules: DataFrame, *, ts: str = "next_run_ts") -> DataFrame:
    """FC-4 (rule 123): start times shared by more than one job."""
    g = schedules.groupBy("server_name", ts).agg(F.count_distinct("job_name").cast("long").alias("jobs"),
                                                 F.array_sort(F.collect_set("job_name")).alias("job_names"))
    return g.filter(F.col("jobs") > 1)


def normalized_log_events(logs: DataFrame, *, text: str = "text", ts: str = "ts", user: str = "user_name") -> DataFrame:
    """FC-5: log text with digits normalised to ``#``; first/last seen and
    occurrences per (normalised text, user).  Whole texts; the grouping key
    is the normalised text itself."""
    n = logs.select(F.regexp_replace(F.col(text), r"[0-9]+", "#").alias("normalized"), F.col(ts).alias("ts"),
                    F.col(user).alias("user_name"))
    return n.groupBy("normalized", "user_name").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).cast("long").alias("occurrences"))


def recent_errors(events: DataFrame, as_of, *, days: int = 7, severity: str = "severity") -> DataFrame:
    """FC-6: error events in the last ``days`` days per server and severity."""
    e = events.filter(F.col("ts") >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    e = e.filter(F.col("ts") <= F.lit(as_of))
    return e.groupBy("server_name", severity).agg(F.count(F.lit(1)).cast("long").alias("errors"),
                                                   F.max("ts").alias("last_error"))


def deadlock_rate(events: DataFrame, starts: DataFrame, as_of, *, per_day: float = 10.0) -> DataFrame:
    """FC-7 (rule 124): deadlocks per day of uptime, flagged above ``per_day``."""
    c = events.groupBy("server_name").agg(F.count(F.lit(1)).cast("long").alias("deadlocks"))
    j = c.join(starts, "server_name")
    days = F.greatest(datediff_boundary("day", F.col("start_ts"), F.lit(as_of)), F.lit(1))
    rate = F.round(try_ratio("deadlocks", days), 4)
    return j.select("server_name", "deadlocks", days.alias("uptime_days"), rate.alias("deadlocks_per_day"),
                    (rate > per_day).alias("flagged"))
