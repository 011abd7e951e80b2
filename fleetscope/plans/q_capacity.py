"""Registered queries: capacity, growth and file configuration (CAP-*, FC-1..3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import blocking as blk
from ..operators import capacity as cap
from . import fixtures as fx
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


AS_OF = dt.datetime(2001, 12, 1)
AS_OF_SQL = "TIMESTAMP '2001-12-01 00:00:00'"


def file_latest(spark, sf_dir):
    return cap.latest_per_key(fx.f3_files(spark, sf_dir), ["server_name", "database_id", "file_id"], "check_ts")


def inventory(spark, sf_dir):
    f = file_latest(spark, sf_dir)
    size = F.col("size_on_disk_mb") * 128
    fid = F.col("file_id")
    drive = F.element_at(F.array(F.lit("C:"), F.lit("D:"), F.lit("E:")), ((fid % 3) + 1).cast("int"))
    return f.select(
        "server_name", "database_id", "file_id",
        F.when(fid % 3 == 1, "LOG").otherwise("ROWS").alias("type_desc"),
        F.concat(drive, F.lit("\\data\\db"), F.col("database_id").cast("string"), F.lit("_"), fid.cast("string"))
        .alias("physical_name"),
        size.cast("long").alias("size_pages"), (size - size % 97).cast("long").alias("used_pages"),
        F.when(fid % 4 == 0, F.lit(-1)).otherwise(size + F.col("database_id") * 1000).cast("long").alias("max_size_pages"),
        F.when(fid % 2 == 0, F.lit(10)).otherwise(F.lit(128) * (fid % 3 + 1)).cast("long").alias("growth"),
        (fid % 2 == 0).alias("is_percent_growth"), F.col("first_ts").alias("created_ts"))


_LATEST = ofx.with_(ofx.f3_files()) + """
, fl AS (SELECT server_name, database_id, file_id, arg_max(size_on_disk_mb, check_ts) AS size_on_disk_mb,
                arg_max(num_of_reads, check_ts) AS num_of_reads, arg_max(num_of_writes, check_ts) AS num_of_writes,
                arg_max(bytes_read, check_ts) AS bytes_read, arg_max(bytes_written, check_ts) AS bytes_written,
                arg_max(io_stall_read_ms, check_ts) AS io_stall_read_ms, arg_max(io_stall_write_ms, check_ts) AS io_stall_write_ms,
                arg_max(physical_name, check_ts) AS physical_name, min(check_ts) AS first_ts
         FROM f3f GROUP BY ALL),
inv AS (SELECT server_name, database_id, file_id, CASE WHEN file_id % 3 = 1 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
               (['C:', 'D:', 'E:'])[file_id % 3 + 1] || '\\data\\db' || CAST(database_id AS VARCHAR) || '_' || CAST(file_id AS VARCHAR) AS physical_name,
               size_on_disk_mb * 128 AS size_pages, size_on_disk_mb * 128 - (size_on_disk_mb * 128) % 97 AS used_pages,
               CASE WHEN file_id % 4 = 0 THEN -1 ELSE size_on_disk_mb * 128 + database_id * 1000 END AS max_size_pages,
               CASE WHEN file_id % 2 = 0 THEN 10 ELSE 128 * (file_id % 3 + 1) END AS growth,
               file_id % 2 = 0 AS is_percent_growth, first_ts AS created_ts
        FROM fl)"""


@reg("cap01_database_space", _LATEST + f"""
, g AS (SELECT server_name, database_id, sum(size_pages) AS s, sum(used_pages) AS u, min(created_ts) AS c FROM inv GROUP BY ALL)
SELECT server_name, database_id, round(s * 8.0 / 1024, 2) AS size_mb, round(u * 8.0 / 1024, 2) AS used_mb,
       round((s - u) * 8.0 / 1024, 2) AS free_mb, round(CASE WHEN s = 0 THEN 0 ELSE u * 100.0 / s END, 2) AS pct_used,
       date_diff('day', c, {AS_OF_SQL}) AS age_days FROM g""")
def q_cap01(spark, sf_dir):
    return cap.database_space(inventory(spark, sf_dir), AS_OF)


def size_history(spark, sf_dir):
    f = fx.f3_files(spark, sf_dir)
    return f.groupBy("server_name", F.concat(F.lit("db"), F.col("database_id").cast("string")).alias("database_name"),
                     F.col("check_ts").alias("record_ts")).agg(F.sum("size_on_disk_mb").cast("double").alias("size_mb"))


_HIST = ofx.with_(ofx.f3_files()) + """
, h AS (SELECT server_name, 'db' || CAST(database_id AS VARCHAR) AS database_name, check_ts AS record_ts,
               CAST(sum(size_on_disk_mb) AS DOUBLE) AS size_mb FROM f3f GROUP BY ALL),
gr AS (SELECT server_name, database_name, min(record_ts) AS first_record, max(record_ts) AS latest_record,
              date_diff('day', min(record_ts), max(record_ts)) AS days_recorded,
              round(max(size_mb), 2) AS latest_size_mb, round(min(size_mb), 2) AS earliest_size_mb,
              round(max(size_mb) - min(size_mb), 2) AS total_growth_mb,
              round((max(size_mb) - min(size_mb)) / nullif(date_diff('day', min(record_ts), max(record_ts)), 0), 2) AS daily_growth_mb,
              round((max(size_mb) - min(size_mb)) / nullif(date_diff('day', min(record_ts), max(record_ts)), 0) * 30, 2) AS monthly_growth_mb
       FROM h GROUP BY ALL)"""


@reg("cap02_growth_rates", _HIST + " SELECT * FROM gr")
def q_cap02(spark, sf_dir):
    return cap.growth_rates(size_history(spark, sf_dir))


@reg("cap03_growth_forecast", _HIST + """
SELECT server_name, database_name, latest_size_mb AS current_size_mb, monthly_growth_mb AS estimated_monthly_growth_mb,
       round(latest_size_mb + daily_growth_mb * 30, 2) AS projected_size_mb,
       CASE WHEN monthly_growth_mb / nullif(latest_size_mb, 0) > 0.04 THEN 'HIGH'
            WHEN monthly_growth_mb / nullif(latest_size_mb, 0) > 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS growth_band
FROM gr""")
def q_cap03(spark, sf_dir):
    return cap.growth_forecast(size_history(spark, sf_dir), high=0.04, medium=0.02)


@reg("cap04_files_near_capacity", _LATEST + """
SELECT server_name, database_id, file_id, physical_name, round(size_pages * 100.0 / max_size_pages, 2) AS pct_of_max,
       CASE WHEN round(size_pages * 100.0 / max_size_pages, 2) > 90 THEN 'CRITICAL'
            WHEN round(size_pages * 100.0 / max_size_pages, 2) > 80 THEN 'WARNING' ELSE 'OK' END AS status,
       size_pages >= max_size_pages AS at_max_size
FROM inv WHERE max_size_pages > 0""")
def q_cap04(spark, sf_dir):
    return cap.files_near_capacity(inventory(spark, sf_dir))


@reg("cap05_log_space", _LATEST + """
SELECT server_name, database_id, round(sum(size_pages) * 8.0 / 1024, 2) AS log_size_mb,
       round(sum(used_pages) * 8.0 / 1024, 2) AS log_used_mb,
       round(CASE WHEN sum(size_pages) = 0 THEN 0 ELSE sum(used_pages) * 100.0 / sum(size_pages) END, 2) AS log_pct_used
FROM inv WHERE type_desc = 'LOG' GROUP BY ALL""")
def q_cap05(spark, sf_dir):
    return cap.log_space(inventory(spark, sf_dir))


@reg("cap06_io_by_drive", _LATEST + f"""
, g AS (SELECT server_name, regexp_extract(physical_name, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1) AS drive,
               CAST(sum(num_of_reads) AS BIGINT) AS reads, CAST(sum(num_of_writes) AS BIGINT) AS writes,
               round(sum(bytes_read) / 1048576.0, 2) AS mb_read, round(sum(bytes_written) / 1048576.0, 2) AS mb_written,
               min(first_ts) AS since FROM fl GROUP BY ALL)
SELECT server_name, drive, reads, writes, mb_read, mb_written,
       round((reads + writes) / nullif(date_diff('hour', since, {AS_OF_SQL}), 0), 4) AS ops_per_hour FROM g""")
def q_cap06(spark, sf_dir):
    return cap.io_by_drive(file_latest(spark, sf_dir), AS_OF)


@reg("cap07_scratch_space_ranking", ofx.with_(ofx.f2()) + """
SELECT server_name, session_id, round((cpu_ms % 10000) * 8.0 / 1024, 2) AS user_mb,
       round((wait_duration_ms % 5000) * 8.0 / 1024, 2) AS internal_mb,
       round(((cpu_ms % 10000) + (wait_duration_ms % 5000)) * 8.0 / 1024, 2) AS total_mb
FROM f2 ORDER BY total_mb DESC, session_id LIMIT 10""")
def q_cap07(spark, sf_dir):
    s = fx.f2_sessions(spark, sf_dir)
    u = s.select("server_name", "session_id", (F.col("cpu_ms") % 10000).alias("user_pages"),
                 (F.col("wait_duration_ms") % 5000).alias("internal_pages"))
    return cap.scratch_space_ranking(u, n=10)


@reg("cap08_memory_by_clerk", """
SELECT 'srv' || CAST(user_id % 4 AS VARCHAR) AS server_name, 'MEMORYCLERK_' || upper(event_type) AS clerk_type,
       round(sum(CAST(round(value * 100) AS BIGINT)) / 1024.0, 2) AS memory_mb
FROM events GROUP BY ROLLUP (1, 2)""")
def q_cap08(spark, sf_dir):
    ev = fx._t(spark, sf_dir, "events")
    clerks = ev.select(F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("server_name"),
                       F.concat(F.lit("MEMORYCLERK_"), F.upper("event_type")).alias("clerk_type"),
                       fx.cents("value").alias("pages_kb"))
    return cap.memory_by_clerk(clerks)


@reg("cap08_plan_cache_totals", ofx.with_(ofx.f4_query_stats()) + """
SELECT CASE query_id % 3 WHEN 0 THEN 'Adhoc' WHEN 1 THEN 'Prepared' ELSE 'Proc' END AS objtype,
       CAST(count(*) AS BIGINT) AS plans, round(sum(cpu) / 1048576.0, 2) AS size_mb, round(avg(executions), 2) AS avg_use_count
FROM f4 GROUP BY ALL""")
def q_cap08p(spark, sf_dir):
    f = fx.f4_query_stats(spark, sf_dir)
    plans = f.select(F.when(F.col("query_id") % 3 == 0, "Adhoc").when(F.col("query_id") % 3 == 1, "Prepared")
                     .otherwise("Proc").alias("objtype"), F.col("cpu").alias("size_bytes"),
                     F.col("executions").alias("usecounts"))
    return cap.plan_cache_totals(plans)


@reg("cap09_table_sizes", ofx.with_(ofx.f5()) + """
, g AS (SELECT server_name, database_name, table_name, sum(size_mb * 128) AS r, sum(size_mb * 100) AS u,
               CAST(sum(row_count) AS BIGINT) AS rows FROM f5 GROUP BY ALL)
SELECT server_name, database_name, table_name, round(r * 8.0 / 1024, 2) AS reserved_mb, round(u * 8.0 / 1024, 2) AS used_mb,
       rows, round(u * 8192.0 / nullif(rows, 0), 2) AS bytes_per_row
FROM g ORDER BY reserved_mb DESC, server_name, database_name, table_name LIMIT 20""")
def q_cap09(spark, sf_dir):
    f = fx.f5_indexes(spark, sf_dir)
    ps = f.select("server_name", "database_name", "table_name", (F.col("size_mb") * 128).alias("reserved_pages"),
                  (F.col("size_mb") * 100).alias("used_pages"), "row_count")
    return cap.table_sizes(ps, n=20)


@reg("cap10_runaway_queries", ofx.with_(ofx.f2()) + """
, r AS (SELECT server_name, session_id, cpu_ms, wait_duration_ms * 100 AS reads, open_tran_count * 60000 AS writes FROM f2)
SELECT *, concat_ws(', ', CASE WHEN cpu_ms > 40000000 THEN 'cpu' END, CASE WHEN reads > 1000000 THEN 'reads' END,
                        CASE WHEN writes > 100000 THEN 'writes' END) AS reasons
FROM r WHERE cpu_ms > 40000000 OR reads > 1000000 OR writes > 100000""")
def q_cap10(spark, sf_dir):
    s = fx.f2_sessions(spark, sf_dir)
    r = s.select("server_name", "session_id", "cpu_ms", (F.col("wait_duration_ms") * 100).alias("reads"),
                 (F.col("open_tran_count") * 60000).alias("writes"))
    return cap.runaway_queries(r, cpu_ms=40000000)


@reg("cap11_cpu_efficiency", ofx.with_(ofx.f2()) + """
SELECT server_name, session_id, cpu_ms, cpu_ms + wait_duration_ms * 1000 AS elapsed_ms,
       round(cpu_ms / nullif(cpu_ms + wait_duration_ms * 1000, 0), 6) AS cpu_efficiency FROM f2""")
def q_cap11(spark, sf_dir):
    s = fx.f2_sessions(spark, sf_dir).select("server_name", "session_id", "cpu_ms", (
        F.col("cpu_ms") + F.col("wait_duration_ms") * 1000).alias("elapsed_ms"))
    return blk.cpu_efficiency(s)


@reg("cap12_unused_space_ranking", _LATEST + """
SELECT server_name, database_id, file_id, round(size_pages * 8.0 / 1024, 2) AS allocated_mb,
       round(used_pages * 8.0 / 1024, 2) AS used_mb, round((size_pages - used_pages) * 8.0 / 1024, 2) AS unused_mb,
       round(CASE WHEN size_pages = 0 THEN 0 ELSE (size_pages - used_pages) * 100.0 / size_pages END, 2) AS unused_pct
FROM inv WHERE type_desc = 'ROWS' ORDER BY unused_mb DESC, server_name, database_id, file_id LIMIT 10""")
def q_cap12(spark, sf_dir):
    return cap.unused_space_ranking(inventory(spark, sf_dir))


@reg("cap13_growth_settings", _LATEST + """
SELECT server_name, database_id, file_id, type_desc, CASE WHEN is_percent_growth THEN 'Percent' ELSE 'MB' END AS growth_type,
       CASE WHEN is_percent_growth THEN CAST(growth AS VARCHAR) || '%'
            ELSE CAST(round(growth * 8.0 / 1024, 2) AS VARCHAR) || ' MB' END AS growth_setting,
       CASE WHEN max_size_pages = -1 THEN 'Unlimited' ELSE CAST(round(max_size_pages * 8.0 / 1024, 2) AS VARCHAR) || ' MB' END AS max_size,
       CASE WHEN is_percent_growth THEN 'File growth set to percent' WHEN growth = 128 THEN 'File growth set to 1MB' END AS issue
FROM inv""")
def q_cap13(spark, sf_dir):
    return cap.growth_settings(inventory(spark, sf_dir))


@reg("fc01_uneven_file_groups", _LATEST + """
SELECT server_name, database_id, file_id % 2 + 1 AS data_space_id, CAST(count(DISTINCT size_pages) AS BIGINT) AS distinct_sizes,
       CAST(count(DISTINCT (growth, is_percent_growth)) AS BIGINT) AS distinct_growths, CAST(count(*) AS BIGINT) AS files
FROM inv WHERE type_desc = 'ROWS' GROUP BY ALL HAVING count(DISTINCT size_pages) > 1 OR count(DISTINCT (growth, is_percent_growth)) > 1""")
def q_fc01(spark, sf_dir):
    return cap.uneven_groups(inventory(spark, sf_dir).withColumn("data_space_id", F.col("file_id") % 2 + 1))


@reg("fc02_multiple_logs_per_drive", _LATEST + """
SELECT server_name, database_id, regexp_extract(physical_name, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1) AS drive,
       CAST(count(*) AS BIGINT) AS log_files
FROM inv WHERE type_desc = 'LOG' GROUP BY ALL HAVING count(*) > 1""")
def q_fc02(spark, sf_dir):
    return cap.multiple_logs_per_drive(inventory(spark, sf_dir))


@reg("fc02_backups_on_data_drives", _LATEST + ", " + ofx.f3_backups().strip() + """
, bf AS (SELECT server_name, database_name, backup_set_id,
                (['C:', 'D:', 'E:', 'F:'])[backup_set_id % 4 + 1] || '\\backup\\' || database_name || '.bak' AS device_path FROM f3)
SELECT bf.*, regexp_extract(device_path, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1) AS drive FROM bf
WHERE EXISTS (SELECT 1 FROM inv WHERE inv.server_name = bf.server_name
              AND regexp_extract(inv.physical_name, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1)
                  = regexp_extract(bf.device_path, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1))""")
def q_fc02b(spark, sf_dir):
    b = fx.f3_backups(spark, sf_dir)
    bf = b.select("server_name", "database_name", "backup_set_id", F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ["C:", "D:", "E:", "F:"]]), (F.col("backup_set_id") % 4 + 1).cast("int")),
        F.lit("\\backup\\"), F.col("database_name"), F.lit(".bak")).alias("device_path"))
    return cap.backups_on_data_drives(bf, inventory(spark, sf_dir))


@reg("fc03_slow_storage_by_drive", _LATEST + """
, g AS (SELECT server_name, regexp_extract(physical_name, '^([A-Za-z]:|[/\\\\]*[^/\\\\]+)', 1) AS drive,
               sum(io_stall_read_ms) AS rs, sum(num_of_reads) AS r, sum(io_stall_write_ms) AS ws, sum(num_of_writes) AS w
        FROM fl GROUP BY ALL),
h AS (SELECT server_name, drive, round(CASE WHEN r = 0 THEN 0 ELSE rs / r END, 4) AS avg_read_stall_ms,
             round(CASE WHEN w = 0 THEN 0 ELSE ws / w END, 4) AS avg_write_stall_ms FROM g)
SELECT * FROM h WHERE avg_read_stall_ms > 50 OR avg_write_stall_ms > 50""")
def q_fc03(spark, sf_dir):
    return cap.slow_storage_by_drive(file_latest(spark, sf_dir), threshold_ms=50)
