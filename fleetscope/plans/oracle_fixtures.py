"""The fixture projections of :mod:`fleetscope.plans.fixtures` in DuckDB SQL.

Each function returns the body of one CTE list (``name AS (...)``, comma
separated) that the oracle queries prepend with ``WITH``.
"""

from __future__ import annotations


def f1(variant: str = "plain", name: str = "f1") -> str:
    part = "server_name, metric" + (", CAST(h AS DATE)" if variant == "restart" else "")
    where = "WHERE hour(h) % 7 <> 0" if variant == "gappy" else ""
    return f"""
{name}_ev AS (
  SELECT 'srv' || CAST(user_id % 4 AS VARCHAR) AS server_name, event_type AS metric,
         date_trunc('hour', ts) AS h, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
{name}_hourly AS (
  SELECT server_name, metric, h, sum(cents) AS v, count(*) AS n, sum(floor(cents / 4)) AS s
  FROM {name}_ev GROUP BY server_name, metric, h),
{name}_grid AS (
  SELECT p.server_name, p.metric, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS h
  FROM (SELECT DISTINCT server_name, metric FROM {name}_ev) p,
       (SELECT min(h) AS lo, max(h) AS hi FROM {name}_ev) b),
{name}_dense AS (
  SELECT g.server_name, g.metric, g.h, coalesce(x.v, 0) AS v, coalesce(x.n, 0) AS n, coalesce(x.s, 0) AS s
  FROM {name}_grid g LEFT JOIN {name}_hourly x
    ON g.server_name = x.server_name AND g.metric = x.metric AND g.h = x.h),
{name} AS (
  SELECT server_name, h AS check_ts, metric,
         CAST(sum(v) OVER w AS BIGINT) AS cum_value,
         CAST(sum(n) OVER w AS BIGINT) AS cum_count,
         CAST(sum(s) OVER w AS BIGINT) AS cum_signal
  FROM {name}_dense {where}
  WINDOW w AS (PARTITION BY {part} ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def f2(name: str = "f2") -> str:
    return f"""
{name} AS (
  SELECT 'srv0' AS server_name, o_orderkey + 1 AS session_id,
         CAST(CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_orderkey / 4) + 1 ELSE 0 END AS BIGINT) AS blocking_session_id,
         CAST(o_orderkey % 60000 AS BIGINT) AS wait_duration_ms,
         CASE WHEN o_orderkey % 4 <> 0 THEN 'LCK_M_' || (['S', 'U', 'X', 'IX'])[CAST(o_custkey % 4 AS INTEGER) + 1] END AS wait_type,
         CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'sleeping' ELSE 'suspended' END AS status,
         'login' || CAST(o_custkey % 25 AS VARCHAR) AS login_name,
         'db' || CAST(o_custkey % 50 AS VARCHAR) AS database_name,
         CAST(o_orderkey % 3 AS BIGINT) AS open_tran_count,
         o_orderpriority AS program_name,
         o_orderdate + to_seconds(o_orderkey % 86400) AS start_ts,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cpu_ms
  FROM orders)"""


def f3_backups(name: str = "f3") -> str:
    return f"""
{name}_base AS (
  SELECT 'srv' || CAST(o_custkey % 2 AS VARCHAR) AS server_name,
         'db' || CAST(o_custkey % 50 AS VARCHAR) AS database_name,
         CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS type,
         o_orderdate + to_seconds(o_orderkey % 86400) AS backup_finish_date,
         o_orderdate + to_seconds(o_orderkey % 86400) - to_seconds(o_orderkey % 3600) AS backup_start_date,
         CAST(epoch(o_orderdate + to_seconds(o_orderkey % 86400)) AS BIGINT) * 1000000000 + o_orderkey AS backup_set_id,
         CAST(round(o_totalprice * 100) AS BIGINT) AS backup_size,
         CAST(CASE WHEN o_orderkey % 17 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT)
              ELSE floor(CAST(round(o_totalprice * 100) AS BIGINT) * 6 / 10) END AS BIGINT) AS compressed_backup_size,
         o_orderpriority AS user_name,
         CASE WHEN o_orderkey % 10 = 0 THEN 'BULK_LOGGED' WHEN o_orderkey % 10 = 1 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model,
         o_orderkey % 7 <> 0 AS has_backup_checksums, o_orderkey % 101 = 0 AS is_damaged,
         o_orderkey % 211 = 0 AS is_password_protected, o_orderkey % 53 = 0 AS is_snapshot,
         o_orderkey % 37 = 0 AS is_readonly, o_orderkey % 41 = 0 AS is_single_user, o_orderkey % 19 = 0 AS is_encrypted,
         CAST(100 + (o_orderkey % 3) * 10 AS INTEGER) AS compatibility_level
  FROM orders),
{name} AS (
  SELECT server_name, database_name, type, backup_start_date, backup_finish_date, backup_set_id,
         backup_size, compressed_backup_size, user_name,
         (row_number() OVER w - 1) * 100 AS first_lsn, row_number() OVER w * 100 AS last_lsn,
         recovery_model, has_backup_checksums, is_damaged, is_password_protected, is_snapshot,
         is_readonly, is_single_user, is_encrypted, compatibility_level
  FROM {name}_base
  WINDOW w AS (PARTITION BY server_name, database_name ORDER BY backup_finish_date, backup_set_id))"""


def f3_files(name: str = "f3f") -> str:
    return f"""
{name}_g AS (
  SELECT l_suppkey % 2 AS srv, l_suppkey % 20 AS database_id, l_linenumber AS file_id,
         date_trunc('month', l_shipdate) AS check_ts,
         count(*) AS reads, sum(CAST(l_quantity AS BIGINT) * 10) AS stall_r,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS bytes_r,
         sum(CAST(l_linenumber AS BIGINT)) AS writes,
         sum(CAST(round(l_tax * 100) AS BIGINT) * 40) AS stall_w,
         sum(CAST(round(l_discount * 100) AS BIGINT) * 1000) AS bytes_w
  FROM lineitem GROUP BY ALL),
{name} AS (
  SELECT 'srv' || CAST(srv AS VARCHAR) AS server_name, check_ts,
         CAST(database_id AS BIGINT) AS database_id, CAST(file_id AS BIGINT) AS file_id,
         CASE WHEN file_id = 1 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
         (['C:', 'D:', 'E:'])[file_id % 3 + 1] || '\\data\\db' || CAST(database_id AS VARCHAR) || '_' ||
           CAST(file_id AS VARCHAR) || CASE WHEN file_id = 1 THEN '.ldf' ELSE '.mdf' END AS physical_name,
         CAST(sum(reads) OVER w AS BIGINT) AS size_on_disk_mb,
         CAST(sum(reads) OVER w AS BIGINT) AS num_of_reads,
         CAST(sum(stall_r) OVER w AS BIGINT) AS io_stall_read_ms,
         CAST(sum(bytes_r) OVER w AS BIGINT) AS bytes_read,
         CAST(sum(writes) OVER w AS BIGINT) AS num_of_writes,
         CAST(sum(stall_w) OVER w AS BIGINT) AS io_stall_write_ms,
         CAST(sum(bytes_w) OVER w AS BIGINT) AS bytes_written
  FROM {name}_g
  WINDOW w AS (PARTITION BY srv, database_id, file_id ORDER BY check_ts
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def f4_query_stats(name: str = "f4") -> str:
    return f"""
{name} AS (
  SELECT l_partkey AS query_id, l_suppkey AS plan_id, date_trunc('month', l_shipdate) AS interval_ts,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS executions,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cpu,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS reads,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS writes,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS duration,
         min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS min_cpu,
         max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS max_cpu,
         CAST(count(*) AS BIGINT) AS n_rows
  FROM lineitem GROUP BY l_partkey, l_suppkey, date_trunc('month', l_shipdate))"""


def f4_principals(name: str = "f4p") -> str:
    return f"""
{name} AS (
  SELECT c_name AS member, n_name AS role FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_name AS member, r_name AS role FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def f5(name: str = "f5") -> str:
    return f"""
{name}_use AS (SELECT l_partkey, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY l_partkey),
{name} AS (
  SELECT 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name,
         p_brand AS table_name, p_partkey AS index_id, 'ix_' || CAST(p_partkey AS VARCHAR) AS index_name,
         list_concat([p_type], string_split(p_name, ' ')) AS keys,
         CASE WHEN p_partkey % 5 = 0 THEN ['p_comment'] ELSE CAST([] AS VARCHAR[]) END AS includes,
         CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE coalesce(n_lines, 0) END AS BIGINT) AS user_seeks,
         CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE floor(coalesce(qty, 0) / 10) END AS BIGINT) AS user_scans,
         CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE coalesce(n_lines, 0) % 3 END AS BIGINT) AS user_lookups,
         CAST(CASE WHEN p_partkey % 6 = 0 THEN coalesce(qty, 0) * 1000 ELSE coalesce(qty, 0) END AS BIGINT) AS user_updates,
         CAST(p_size AS BIGINT) AS size_mb, p_retailprice AS cost,
         p_partkey % 7 = 0 AS is_unique, p_partkey % 11 = 0 AS is_disabled,
         CAST(CASE WHEN p_partkey % 9 = 0 THEN 70 ELSE 100 END AS BIGINT) AS fill_factor,
         CAST(CASE WHEN p_partkey % 50 = 0 THEN 0 WHEN p_partkey % 50 = 1 THEN 1 ELSE 2 END AS INTEGER) AS index_type,
         p_partkey % 97 = 0 AS is_hypothetical, p_partkey % 21 = 0 AS is_primary_key,
         TIMESTAMP '2001-06-01' - to_days(CAST(p_partkey % 30 AS INTEGER)) AS create_ts,
         TIMESTAMP '2001-06-01' - to_days(CAST(p_partkey % 30 AS INTEGER) - CAST(p_partkey % 3 AS INTEGER)) AS modify_ts,
         CAST(coalesce(n_lines, 0) * 1000 AS BIGINT) AS row_lock_wait_ms,
         CAST(coalesce(qty, 0) * 10 AS BIGINT) AS page_lock_wait_ms,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS lock_count,
         CAST(CASE WHEN p_partkey % 50 = 0 THEN coalesce(qty, 0) ELSE 0 END AS BIGINT) AS forwarded_fetches,
         CAST(p_size AS BIGINT) * 1000 AS row_count
  FROM part LEFT JOIN {name}_use ON p_partkey = l_partkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def f1_perfmon(name: str = "f1p") -> str:
    return f1("plain", name + "_src") + f""",
{name} AS (
  SELECT server_name, check_ts, 'Fleet:Events' AS object_name, '_Total' AS instance_name,
         metric || suffix AS counter_name, CAST(cntr_type AS BIGINT) AS cntr_type, CAST(cntr_value AS BIGINT) AS cntr_value
  FROM (
    SELECT server_name, check_ts, metric, ' total' AS suffix, 272696576 AS cntr_type, cum_value AS cntr_value FROM {name}_src
    UNION ALL SELECT server_name, check_ts, metric, ' avg (ms)', 1073874176, cum_value FROM {name}_src
    UNION ALL SELECT server_name, check_ts, metric, ' avg base', 1073939712, cum_count FROM {name}_src
    UNION ALL SELECT server_name, check_ts, metric, ' ratio', 537003264, cum_signal FROM {name}_src
    UNION ALL SELECT server_name, check_ts, metric, ' ratio base', 1073939712, cum_value FROM {name}_src
    UNION ALL SELECT server_name, check_ts, metric, ' current', 65792, cum_count FROM {name}_src))"""


def f4_hourly(name: str = "f4h") -> str:
    return f"""
{name} AS (
  SELECT user_id % 20 AS query_id, user_id % 40 AS plan_id, date_trunc('hour', ts) AS interval_ts,
         CAST(count(*) AS BIGINT) AS count_executions,
         sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS avg_duration,
         sum(floor(CAST(round(value * 100) AS BIGINT) / 4)) / count(*) AS avg_cpu,
         sum(CAST(round(value * 100) AS BIGINT) % 7) / count(*) AS avg_logical_io_reads,
         sum(CAST(round(value * 100) AS BIGINT) % 11) / count(*) AS avg_logical_io_writes,
         sum(CAST(round(value * 100) AS BIGINT) % 15) / count(*) AS avg_physical_io_reads,
         sum(CAST(round(value * 100) AS BIGINT) % 19) / count(*) AS avg_query_max_used_memory,
         sum(CAST(round(value * 100) AS BIGINT) % 23) / count(*) AS avg_rowcount,
         sum(CAST(round(value * 100) AS BIGINT) % 27) / count(*) AS avg_clr_time,
         sum(CAST(round(value * 100) AS BIGINT) % 31) / count(*) AS avg_log_bytes_used,
         sum(CAST(round(value * 100) AS BIGINT) % 35) / count(*) AS avg_tempdb_space_used,
         sum(CAST(round(value * 100) AS BIGINT) % 39) / count(*) AS avg_num_physical_io_reads
  FROM events GROUP BY ALL)"""
