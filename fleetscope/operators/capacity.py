"""Capacity, growth and burn-rate analytics (CAP-*).

File inventory columns: ``server_name, database_id, file_id, type_desc
(ROWS/LOG), physical_name, size_pages, used_pages, max_size_pages (-1 =
unlimited), growth, is_percent_growth, created_ts``; 8 KB pages.
Size history: ``server_name, database_name, record_ts, size_mb``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import band, datediff_boundary, drive_of, try_ratio

PAGE_MB = 8.0 / 1024.0


def _mb(col: str):
    return F.round(F.col(col) * PAGE_MB, 2)


def database_space(files: DataFrame, as_of) -> DataFrame:
    """CAP-1 / PRJ-1: size, used, free and % used per database, age in days."""
    g = files.groupBy("server_name", "database_id").agg(
        F.sum("size_pages").alias("size_pages"), F.sum("used_pages").alias("used_pages"),
        F.min("created_ts").alias("created_ts"))
    return g.select(
        "server_name", "database_id", _mb("size_pages").alias("size_mb"), _mb("used_pages").alias("used_mb"),
        F.round((F.col("size_pages") - F.col("used_pages")) * PAGE_MB, 2).alias("free_mb"),
        F.round(try_ratio(F.col("used_pages") * 100.0, "size_pages", 0.0), 2).alias("pct_used"),
        datediff_boundary("day", F.col("created_ts"), F.lit(as_of)).alias("age_days"))


def growth_rates(history: DataFrame, *, method: str = "minmax", key: Sequence[str] = ("server_name", "database_name"),
                 ts: str = "record_ts", size: str = "size_mb") -> DataFrame:
    """CAP-2: first/last record, total, daily and monthly (x30) growth.

    ``method='minmax'`` is the reference's ``MAX(size) - MIN(size)`` (a
    shrink reads as growth); ``'endpoints'`` uses last minus first size."""
    k = list(key)
    g = history.groupBy(*k).agg(
        F.min(ts).alias("first_record"), F.max(ts).alias("latest_record"),
        F.max(size).alias("max_size"), F.min(size).alias("min_size"),
        F.max_by(F.col(size), F.col(ts)).alias("last_size"), F.min_by(F.col(size), F.col(ts)).alias("first_size"))
    days = datediff_boundary("day", F.col("first_record"), F.col("latest_record"))
    total = (F.col("max_size") - F.col("min_size")) if method == "minmax" else (F.col("last_size") - F.col("first_size"))
    daily = try_ratio(total, days)
    return g.select(
        *k, "first_record", "latest_record", days.alias("days_recorded"),
        F.round("max_size", 2).alias("latest_size_mb"), F.round("min_size", 2).alias("earliest_size_mb"),
        F.round(total, 2).alias("total_growth_mb"), F.round(daily, 2).alias("daily_growth_mb"),
        F.round(daily * 30, 2).alias("monthly_growth_mb"))


def growth_forecast(history: DataFrame, *, high: float = 0.10, medium: float = 0.05, days_ahead: int = 30,
                    **kw) -> DataFrame:
    """CAP-3: projected size in ``days_ahead`` days and a HIGH/MEDIUM/LOW band
    on monthly growth ÷ current size."""
    g = growth_rates(history, **kw)
    ratio = try_ratio("monthly_growth_mb", "latest_size_mb")
    return g.select(
        "server_name", "database_name", F.col("latest_size_mb").alias("current_size_mb"),
        F.col("monthly_growth_mb").alias("estimated_monthly_growth_mb"),
        F.round(F.col("latest_size_mb") + F.col("daily_growth_mb") * days_ahead, 2).alias("projected_size_mb"),
        band(ratio, [(">", high, "HIGH"), (">", medium, "MEDIUM")], "LOW").alias("growth_band"))


def files_near_capacity(files: DataFrame, *, critical: float = 90.0, warning: float = 80.0) -> DataFrame:
    """CAP-4: files with a max size: % of max used, band, and at-max flag."""
    f = files.filter(F.col("max_size_pages") > 0)
    pct = F.round(F.col("size_pages") * 100.0 / F.col("max_size_pages"), 2)
    return f.select("server_name", "database_id", "file_id", "physical_name", pct.alias("pct_of_max"),
                    band(pct, [(">", critical, "CRITICAL"), (">", warning, "WARNING")], "OK").alias("status"),
                    (F.col("size_pages") >= F.col("max_size_pages")).alias("at_max_size"))


def log_space(files: DataFrame) -> DataFrame:
    """CAP-5: log size, used and % used per database."""
    g = files.filter(F.col("type_desc") == "LOG").groupBy("server_name", "database_id").agg(
        F.sum("size_pages").alias("s"), F.sum("used_pages").alias("u"))
    return g.select("server_name", "database_id", _mb("s").alias("log_size_mb"), _mb("u").alias("log_used_mb"),
                    F.round(try_ratio(F.col("u") * 100.0, "s", 0.0), 2).alias("log_pct_used"))


def io_by_drive(file_io: DataFrame, as_of, *, path: str = "physical_name") -> DataFrame:
    """CAP-6: I/O totals per drive and operations per hour since the first
    sample (drive parsed with a regex; the reference's reverse/charindex
    idiom does not return the drive)."""
    g = file_io.groupBy("server_name", drive_of(path).alias("drive")).agg(
        F.sum("num_of_reads").cast("long").alias("reads"), F.sum("num_of_writes").cast("long").alias("writes"),
        F.round(F.sum("bytes_read") / 1048576.0, 2).alias("mb_read"),
        F.round(F.sum("bytes_written") / 1048576.0, 2).alias("mb_written"),
        F.min("first_ts").alias("since"))
    hours = datediff_boundary("hour", F.col("since"), F.lit(as_of))
    return g.select("server_name", "drive", "reads", "writes", "mb_read", "mb_written",
                    F.round(try_ratio(F.col("reads") + F.col("writes"), hours), 4).alias("ops_per_hour"))


def scratch_space_ranking(usage: DataFrame, *, n: int = 10) -> DataFrame:
    """CAP-7: sessions by scratch (tempdb-like) space: user, internal, total
    MB; top ``n`` with the session id as tie-break."""
    u = usage.select("server_name", "session_id", _mb("user_pages").alias("user_mb"),
                     _mb("internal_pages").alias("internal_mb"),
                     F.round((F.col("user_pages") + F.col("internal_pages")) * PAGE_MB, 2).alias("total_mb"))
    return u.orderBy(F.col("total_mb").desc(), F.col("session_id")).limit(n)


def memory_by_clerk(clerks: DataFrame) -> DataFrame:
    """CAP-8 / AG-10: memory per clerk type with server and fleet subtotals (rollup)."""
    return clerks.rollup("server_name", "clerk_type").agg(F.round(F.sum("pages_kb") / 1024.0, 2).alias("memory_mb"))


def plan_cache_totals(plans: DataFrame) -> DataFrame:
    """CAP-8: plan count, total MB, average use count per object type."""
    return plans.groupBy("objtype").agg(F.count(F.lit(1)).cast("long").alias("plans"),
                                        F.round(F.sum("size_bytes") / 1048576.0, 2).alias("size_mb"),
                                        F.round(F.avg("usecounts"), 2).alias("avg_use_count"))


def table_sizes(partition_stats: DataFrame, *, n: int | None = 20) -> DataFrame:
    """CAP-9: reserved/used MB, rows and true bytes per row per table (the
    reference's "BytesPerRow" is MB per row)."""
    g = partition_stats.groupBy("server_name", "database_name", "table_name").agg(
        F.sum("reserved_pages").alias("r"), F.sum("used_pages").alias("u"), F.sum("row_count").cast("long").alias("rows"))
    out = g.select("server_name", "database_name", "table_name", _mb("r").alias("reserved_mb"), _mb("u").alias("used_mb"),
                   "rows", F.round(try_ratio(F.col("u") * 8192.0, "rows"), 2).alias("bytes_per_row"))
    if n is None:
        return out
    return out.orderBy(F.col("reserved_mb").desc(), "server_name", "database_name", "table_name").limit(n)


def runaway_queries(requests: DataFrame, *, cpu_ms: int = 60000, reads: int = 1000000, writes: int = 100000) -> DataFrame:
    """CAP-10: requests over any of the CPU, reads or writes thresholds."""
    return requests.filter((F.col("cpu_ms") > cpu_ms) | (F.col("reads") > reads) | (F.col("writes") > writes)).select(
        "*", F.concat_ws(", ", F.when(F.col("cpu_ms") > cpu_ms, F.lit("cpu")), F.when(F.col("reads") > reads, F.lit("reads")),
                         F.when(F.col("writes") > writes, F.lit("writes"))).alias("reasons"))


def unused_space_ranking(files: DataFrame, *, n: int = 10) -> DataFrame:
    """CAP-12: data files by allocated-but-unused MB, top ``n``."""
    f = files.filter(F.col("type_desc") == "ROWS").select(
        "server_name", "database_id", "file_id", _mb("size_pages").alias("allocated_mb"), _mb("used_pages").alias("used_mb"),
        F.round((F.col("size_pages") - F.col("used_pages")) * PAGE_MB, 2).alias("unused_mb"),
        F.round(try_ratio((F.col("size_pages") - F.col("used_pages")) * 100.0, "size_pages", 0.0), 2).alias("unused_pct"))
    return f.orderBy(F.col("unused_mb").desc(), "server_name", "database_id", "file_id").limit(n)


def growth_settings(files: DataFrame) -> DataFrame:
    """CAP-13: growth type and amount, max-size label, and the 1 MB / percent
    growth findings (rules 158 / 82)."""
    growth = F.when(F.col("is_percent_growth"), F.concat(F.col("growth").cast("string"), F.lit("%"))).otherwise(
        F.concat(F.round(F.col("growth") * PAGE_MB, 2).cast("string"), F.lit(" MB")))
    max_label = F.when(F.col("max_size_pages") == -1, F.lit("Unlimited")).otherwise(
        F.concat(F.round(F.col("max_size_pages") * PAGE_MB, 2).cast("string"), F.lit(" MB")))
    issue = (F.when(F.col("is_percent_growth"), F.lit("File growth set to percent"))
             .when(F.col("growth") == 128, F.lit("File growth set to 1MB")))
    return files.select("server_name", "database_id", "file_id", "type_desc",
                        F.when(F.col("is_percent_growth"), "Percent").otherwise("MB").alias("growth_type"),
                        growth.alias("growth_setting"), max_label.alias("max_size"), issue.alias("issue"))


def uneven_groups(files: DataFrame, *, group: Sequence[str] = ("server_name", "database_id", "data_space_id")) -> DataFrame:
    """FC-1: filegroups whose data files differ in size or growth setting (``count(distinct) > 1``)."""
    g = files.filter(F.col("type_desc") == "ROWS").groupBy(*group).agg(F.count_distinct("size_pages").cast("long").alias("distinct_sizes"),
                                  F.count_distinct("growth", "is_percent_growth").cast("long").alias("distinct_growths"),
                                  F.count(F.lit(1)).cast("long").alias("files"))
    return g.filter((F.col("distinct_sizes") > 1) | (F.col("distinct_growths") > 1))


def multiple_logs_per_drive(files: DataFrame) -> DataFrame:
    """FC-2: more than one log file of a database on one drive."""
    g = files.filter(F.col("type_desc") == "LOG").groupBy("server_name", "database_id", drive_of("physical_name")
                                                          .alias("drive")).agg(
        F.count(F.lit(1)).cast("long").alias("log_files"))
    return g.filter(F.col("log_files") > 1)


def backups_on_data_drives(backup_files: DataFrame, files: DataFrame) -> DataFrame:
    """FC-2 (rule 93): backups written to a drive that holds database files
    (equi-join on server + drive after a distinct of data drives)."""
    drives = files.select("server_name", drive_of("physical_name").alias("drive")).distinct()
    b = backup_files.select("*", drive_of("device_path").alias("drive"))
    return b.join(drives, ["server_name", "drive"], "left_semi")


def slow_storage_by_drive(file_io: DataFrame, *, threshold_ms: float = 200.0) -> DataFrame:
    """FC-3 (rules 36/37): average read or write stall per drive above ``threshold_ms``."""
    g = file_io.groupBy("server_name", drive_of("physical_name").alias("drive")).agg(
        F.sum("io_stall_read_ms").alias("rs"), F.sum("num_of_reads").alias("r"),
        F.sum("io_stall_write_ms").alias("ws"), F.sum("num_of_writes").alias("w"))
    g = g.select("server_name", "drive", F.round(try_ratio("rs", "r", 0.0), 4).alias("avg_read_stall_ms"),
                 F.round(try_ratio("ws", "w", 0.0), 4).alias("avg_write_stall_ms"))
    return g.filter((F.col("avg_read_stall_ms") > threshold_ms) | (F.col("avg_write_stall_ms") > threshold_ms))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Latest row per key (``max_by`` over a struct of the other columns)."""
    rest = [c for c in df.columns if c not in keys]
    w = F.max_by(F.struct(*rest), F.col(ts)).alias("__l")
    return df.groupBy(*keys).agg(w, F.min(ts).alias("first_ts")).select(*keys, "__l.*", "first_ts")
