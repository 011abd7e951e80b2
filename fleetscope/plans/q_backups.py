"""Registered queries: backup and replica chains (BK-*, JN-8/9/14, AG-6/8) on F3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import backups as bk
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


F3 = ofx.with_(ofx.f3_backups())
SECS = "date_diff('second', backup_start_date, backup_finish_date)"


@reg("bk01_throughput_by_type", F3 + f"""
, b AS (SELECT server_name, database_name, type,
               backup_size / (CASE WHEN {SECS} = 0 THEN 1 ELSE {SECS} END) / 1048576.0 AS mbps,
               backup_size / 1048576.0 AS size_mb, compressed_backup_size / 1048576.0 AS csize_mb
        FROM f3 WHERE NOT is_damaged),
g AS (SELECT server_name, database_name, type, round(avg(mbps), 4) AS mbps_avg, round(min(mbps), 4) AS mbps_min,
             round(max(mbps), 4) AS mbps_max, round(avg(size_mb), 4) AS size_mb_avg, round(min(size_mb), 4) AS size_mb_min,
             round(max(size_mb), 4) AS size_mb_max, round(avg(csize_mb), 4) AS compressed_mb_avg
      FROM b GROUP BY ALL)
SELECT f.server_name, f.database_name,
       f.mbps_avg AS full_mbps_avg, f.mbps_min AS full_mbps_min, f.mbps_max AS full_mbps_max,
       f.size_mb_avg AS full_size_mb_avg, f.size_mb_min AS full_size_mb_min, f.size_mb_max AS full_size_mb_max,
       f.compressed_mb_avg AS full_compressed_mb_avg,
       d.mbps_avg AS diff_mbps_avg, d.mbps_min AS diff_mbps_min, d.mbps_max AS diff_mbps_max,
       d.size_mb_avg AS diff_size_mb_avg, d.size_mb_min AS diff_size_mb_min, d.size_mb_max AS diff_size_mb_max,
       d.compressed_mb_avg AS diff_compressed_mb_avg,
       l.mbps_avg AS log_mbps_avg, l.mbps_min AS log_mbps_min, l.mbps_max AS log_mbps_max,
       l.size_mb_avg AS log_size_mb_avg, l.size_mb_min AS log_size_mb_min, l.size_mb_max AS log_size_mb_max,
       l.compressed_mb_avg AS log_compressed_mb_avg
FROM g f
LEFT JOIN g d ON f.server_name = d.server_name AND f.database_name = d.database_name AND d.type = 'I'
LEFT JOIN g l ON f.server_name = l.server_name AND f.database_name = l.database_name AND l.type = 'L'
WHERE f.type = 'D'""")
def q_bk01(spark, sf_dir):
    return bk.throughput_by_type(fx.f3_backups(spark, sf_dir))


_GAPS = """
, gaps AS (
  SELECT b.server_name, b.database_name, b.backup_set_id, b.backup_finish_date,
         p.backup_set_id AS prior_backup_set_id, p.backup_finish_date AS prior_finish_date,
         date_diff('second', p.backup_finish_date, b.backup_finish_date) AS gap_seconds
  FROM f3 b JOIN f3 p ON p.server_name = b.server_name AND p.database_name = b.database_name
       AND p.backup_finish_date < b.backup_finish_date AND p.backup_set_id < b.backup_set_id
  QUALIFY row_number() OVER (PARTITION BY b.server_name, b.database_name, b.backup_set_id
                             ORDER BY p.backup_finish_date DESC, p.backup_set_id DESC) = 1)"""


@reg("bk02_rpo_gaps", F3 + _GAPS + " SELECT * FROM gaps")
def q_bk02g(spark, sf_dir):
    return bk.rpo_gaps(fx.f3_backups(spark, sf_dir))


@reg("bk02_rpo_worst", F3 + _GAPS + """
SELECT g.*, round(gap_seconds / 60.0, 4) AS rpo_worst_minutes FROM gaps g
WHERE NOT EXISTS (SELECT 1 FROM gaps b WHERE b.server_name = g.server_name AND b.database_name = g.database_name
                  AND b.gap_seconds > g.gap_seconds)""")
def q_bk02(spark, sf_dir):
    return bk.rpo_worst(fx.f3_backups(spark, sf_dir))


_RP = F3 + f"""
, fulls AS (SELECT server_name, database_name, last_lsn AS full_last_lsn, backup_set_id AS full_backup_set_id,
                   {SECS} AS full_time_seconds, round(backup_size / 1048576.0, 4) AS full_size_mb,
                   lead(last_lsn) OVER (PARTITION BY server_name, database_name ORDER BY last_lsn) AS next_full_lsn
            FROM f3 WHERE type = 'D'),
mem AS (SELECT f.server_name, f.database_name, f.full_last_lsn, r.type, r.first_lsn, r.last_lsn, r.backup_set_id,
               r.backup_start_date, r.backup_finish_date, r.backup_size
        FROM fulls f JOIN f3 r ON r.server_name = f.server_name AND r.database_name = f.database_name
             AND r.type <> 'D' AND r.last_lsn > f.full_last_lsn
             AND (f.next_full_lsn IS NULL OR r.last_lsn < f.next_full_lsn)),
lm AS (SELECT server_name, database_name, full_last_lsn, max(last_lsn) AS log_last_lsn FROM mem WHERE type = 'L' GROUP BY ALL),
dd AS (SELECT m.server_name, m.database_name, m.full_last_lsn,
              arg_max(m.last_lsn, m.last_lsn) AS diff_last_lsn, arg_max(m.backup_set_id, m.last_lsn) AS diff_backup_set_id,
              arg_max(date_diff('second', m.backup_start_date, m.backup_finish_date), m.last_lsn) AS diff_time_seconds,
              arg_max(round(m.backup_size / 1048576.0, 4), m.last_lsn) AS diff_size_mb
       FROM mem m LEFT JOIN lm USING (server_name, database_name, full_last_lsn)
       WHERE m.type = 'I' AND (lm.log_last_lsn IS NULL OR m.last_lsn < lm.log_last_lsn) GROUP BY ALL),
rp AS (SELECT f.*, lm.log_last_lsn, dd.diff_last_lsn, dd.diff_backup_set_id, dd.diff_time_seconds, dd.diff_size_mb
       FROM fulls f LEFT JOIN lm USING (server_name, database_name, full_last_lsn)
       LEFT JOIN dd USING (server_name, database_name, full_last_lsn)),
lt AS (SELECT rp.server_name, rp.database_name, rp.full_last_lsn,
              CAST(sum(date_diff('second', m.backup_start_date, m.backup_finish_date)) AS BIGINT) AS log_time_seconds,
              round(sum(m.backup_size) / 1048576.0, 4) AS log_size_mb, CAST(count(*) AS BIGINT) AS log_backups
       FROM rp JOIN mem m ON m.server_name = rp.server_name AND m.database_name = rp.database_name
            AND m.full_last_lsn = rp.full_last_lsn AND m.type = 'L'
            AND m.first_lsn >= coalesce(rp.diff_last_lsn, rp.full_last_lsn) AND m.first_lsn <= rp.log_last_lsn
       GROUP BY ALL),
pts AS (
SELECT rp.server_name, rp.database_name, rp.full_last_lsn, full_backup_set_id, full_time_seconds, full_size_mb,
       diff_backup_set_id, diff_last_lsn, diff_time_seconds, diff_size_mb, log_last_lsn,
       coalesce(log_backups, 0) AS log_backups, coalesce(log_time_seconds, 0) AS log_time_seconds,
       coalesce(log_size_mb, 0.0) AS log_size_mb,
       round(full_size_mb + coalesce(diff_size_mb, 0.0) + coalesce(log_size_mb, 0.0), 4) AS rto_size_mb,
       CAST(full_time_seconds + coalesce(diff_time_seconds, 0) + coalesce(log_time_seconds, 0) AS BIGINT) AS rto_time_seconds
FROM rp LEFT JOIN lt USING (server_name, database_name, full_last_lsn))"""


@reg("bk03_recovery_points", _RP + " SELECT * FROM pts")
def q_bk03(spark, sf_dir):
    return bk.recovery_points(fx.f3_backups(spark, sf_dir))


@reg("bk04_rto_worst", _RP + """
SELECT *, round(rto_time_seconds / 60.0, 4) AS rto_worst_minutes FROM pts
QUALIFY row_number() OVER (PARTITION BY server_name, database_name ORDER BY rto_size_mb DESC, full_last_lsn DESC) = 1""")
def q_bk04(spark, sf_dir):
    return bk.rto_worst(bk.recovery_points(fx.f3_backups(spark, sf_dir)))


@reg("bk05_recoverability", F3 + f"""
SELECT server_name, database_name, min(backup_finish_date) AS first_full, max(backup_finish_date) AS last_full,
       round(arg_min(backup_size, (backup_finish_date, backup_set_id)) / 1048576.0, 4) AS first_full_size_mb,
       round(arg_max(backup_size, (backup_finish_date, backup_set_id)) / 1048576.0, 4) AS last_full_size_mb,
       round(avg(backup_size / (CASE WHEN {SECS} = 0 THEN 1 ELSE {SECS} END) / 1048576.0), 4) AS avg_mbps,
       round(avg(backup_size / 1048576.0), 4) AS avg_size_mb, round(avg({SECS}), 4) AS avg_duration_seconds,
       CAST(count(*) AS BIGINT) AS full_backups
FROM f3 WHERE type = 'D' GROUP BY ALL""")
def q_bk05(spark, sf_dir):
    return bk.recoverability(fx.f3_backups(spark, sf_dir))


AS_OF = dt.datetime(2001, 6, 15)
_OFF = "((year(backup_finish_date) - 2001) * 12 + month(backup_finish_date) - 6)"


@reg("bk06_size_trend_pivot", F3 + f"""
, t AS (SELECT server_name, database_name, {_OFF} AS off, backup_size / 1048576.0 AS mb FROM f3
        WHERE type = 'D' AND backup_finish_date <= TIMESTAMP '2001-06-15' AND {_OFF} >= -12)
SELECT server_name, database_name, """ + ", ".join(
    f"round(avg(CASE WHEN off = {v} THEN mb END), 4) AS m{abs(v)}" for v in range(-12, 1)) + """
FROM t GROUP BY ALL""")
def q_bk06(spark, sf_dir):
    return bk.size_trend(fx.f3_backups(spark, sf_dir), AS_OF, months=12)


@reg("bk07_backup_rules", F3 + """
, per_user AS (SELECT server_name, database_name, user_name, count(*) AS n FROM f3 GROUP BY ALL),
common AS (SELECT user_name FROM f3 GROUP BY user_name ORDER BY count(*) DESC, user_name LIMIT 1),
x AS (
  SELECT server_name, database_name, 1 AS id, 'Non-Agent backups taken' AS finding, n, 'backups by ' || user_name AS descr FROM per_user
  WHERE user_name NOT LIKE '%Agent%' AND user_name NOT LIKE '%AGENT%' AND n > 1
    AND NOT EXISTS (SELECT 1 FROM common WHERE common.user_name = per_user.user_name)
  UNION ALL SELECT server_name, database_name, 2, 'Compatibility level changing', count(DISTINCT compatibility_level), 'compatibility levels'
  FROM f3 GROUP BY ALL HAVING count(DISTINCT compatibility_level) > 2
  UNION ALL SELECT server_name, database_name, 3, 'Password backups', count(*), 'password-protected backups' FROM f3
  WHERE is_password_protected GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 4, 'Snapshot backups', count(*), 'snapshot backups' FROM f3 WHERE is_snapshot GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 5, 'Read only state backups', count(*), 'backups while read only' FROM f3 WHERE is_readonly GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 6, 'Single user mode backups', count(*), 'backups in single user mode' FROM f3
  WHERE is_single_user GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 7, 'No CHECKSUMS', count(*), 'backups without checksums' FROM f3
  WHERE NOT has_backup_checksums GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 8, 'Damaged backups', count(*), 'damaged backups' FROM f3 WHERE is_damaged GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 9, 'Encrypted backups', count(*), 'encrypted backups' FROM f3 WHERE is_encrypted GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 10, 'Bulk logged backups', count(*), 'backups in bulk-logged recovery' FROM f3
  WHERE recovery_model = 'BULK_LOGGED' GROUP BY ALL
  UNION ALL SELECT server_name, database_name, 11, 'Recovery model switched', count(DISTINCT recovery_model), 'recovery models'
  FROM f3 GROUP BY ALL HAVING count(DISTINCT recovery_model) > 1
  UNION ALL SELECT server_name, database_name, 12, 'Uncompressed backups', count(*), 'uncompressed full backups in the last 30 days' FROM f3
  WHERE type = 'D' AND backup_size = compressed_backup_size AND backup_finish_date >= TIMESTAMP '2001-06-15' - INTERVAL 30 DAY GROUP BY ALL)
SELECT server_name, database_name, CAST(NULL AS TIMESTAMP) AS check_ts, CAST(id AS INTEGER) AS check_id, CAST(100 AS INTEGER) AS priority,
       'Backup' AS findings_group, finding, CAST(n AS VARCHAR) || ' ' || descr AS details, CAST(n AS DOUBLE) AS value FROM x""")
def q_bk07(spark, sf_dir):
    return bk.backup_rule_findings(fx.f3_backups(spark, sf_dir), AS_OF)


@reg("bk08_big_diffs_and_logs", F3 + """
, g AS (SELECT server_name, database_name, avg(CASE WHEN type = 'D' THEN backup_size END) / 1048576.0 AS f,
               avg(CASE WHEN type = 'I' THEN backup_size END) / 1048576.0 AS d,
               avg(CASE WHEN type = 'L' THEN backup_size END) / 1048576.0 AS l FROM f3 GROUP BY ALL)
SELECT server_name, database_name, round(f, 4) AS avg_full_mb, round(d * 100.0 / f, 4) AS diff_pct_of_full,
       round(l * 100.0 / f, 4) AS log_pct_of_full
FROM g WHERE f > 18 AND (round(d * 100.0 / f, 4) >= 100 OR round(l * 100.0 / f, 4) >= 100)""")
def q_bk08(spark, sf_dir):
    return bk.big_diffs_and_logs(fx.f3_backups(spark, sf_dir), diff_pct=100, log_pct=100, min_full_mb=18)


BK9_AS_OF = dt.datetime(2001, 7, 1)


def databases(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("srv"), (F.col("c_custkey") % 2).cast("string")).alias("server_name"),
                    F.concat(F.lit("db"), (F.col("c_custkey") % 60).cast("string")).alias("database_name")).distinct()


@reg("bk09_missing_backups", F3 + """
, dbs AS (SELECT DISTINCT 'srv' || CAST(c_custkey % 2 AS VARCHAR) AS server_name,
                 'db' || CAST(c_custkey % 60 AS VARCHAR) AS database_name FROM customer),
l AS (SELECT server_name, database_name, max(CASE WHEN type = 'D' THEN backup_finish_date END) AS last_full,
             max(CASE WHEN type = 'L' THEN backup_finish_date END) AS last_log,
             arg_max(recovery_model, (backup_finish_date, backup_set_id)) AS recovery_model FROM f3 GROUP BY ALL),
j AS (SELECT dbs.*, l.last_full, l.last_log, l.recovery_model FROM dbs LEFT JOIN l USING (server_name, database_name))
SELECT server_name, database_name, last_full, last_log,
       CASE WHEN last_full IS NULL THEN 'never backed up'
            WHEN last_full < TIMESTAMP '2001-07-01' - INTERVAL 720 HOUR THEN 'no recent full'
            ELSE 'full recovery without log backups' END AS problem
FROM j WHERE last_full IS NULL OR last_full < TIMESTAMP '2001-07-01' - INTERVAL 720 HOUR
          OR (recovery_model = 'FULL' AND last_log IS NULL)""")
def q_bk09(spark, sf_dir):
    return bk.missing_backups(databases(spark, sf_dir), fx.f3_backups(spark, sf_dir), BK9_AS_OF, max_age_hours=720)


STOP_AT = dt.datetime(2000, 6, 15, 12, 0)


@reg("bk10_restore_sequence", F3 + """
, bf AS (SELECT * FROM f3 WHERE backup_finish_date <= TIMESTAMP '2000-06-15 12:00:00'),
fu AS (SELECT server_name, database_name, arg_max(backup_set_id, (backup_finish_date, backup_set_id)) AS full_id,
              arg_max(last_lsn, (backup_finish_date, backup_set_id)) AS full_lsn FROM bf WHERE type = 'D' GROUP BY ALL),
di AS (SELECT bf.server_name, bf.database_name, arg_max(backup_set_id, (backup_finish_date, backup_set_id)) AS diff_id,
              arg_max(last_lsn, (backup_finish_date, backup_set_id)) AS diff_lsn
       FROM bf JOIN fu USING (server_name, database_name) WHERE type = 'I' AND first_lsn >= full_lsn GROUP BY ALL),
base AS (SELECT fu.*, di.diff_id, coalesce(di.diff_lsn, fu.full_lsn) AS from_lsn FROM fu LEFT JOIN di USING (server_name, database_name)),
lg AS (SELECT f3.server_name, f3.database_name, f3.backup_set_id, f3.type, f3.last_lsn, f3.backup_finish_date
       FROM f3 JOIN base USING (server_name, database_name) WHERE type = 'L' AND first_lsn >= from_lsn),
en AS (SELECT server_name, database_name, min(last_lsn) AS end_lsn FROM lg
       WHERE backup_finish_date >= TIMESTAMP '2000-06-15 12:00:00' GROUP BY ALL),
steps AS (SELECT server_name, database_name, full_id AS backup_set_id, 'D' AS type, full_lsn AS last_lsn FROM base
          UNION ALL SELECT server_name, database_name, diff_id, 'I', from_lsn FROM base WHERE diff_id IS NOT NULL
          UNION ALL SELECT lg.server_name, lg.database_name, lg.backup_set_id, lg.type, lg.last_lsn
          FROM lg LEFT JOIN en USING (server_name, database_name) WHERE en.end_lsn IS NULL OR lg.last_lsn <= en.end_lsn)
SELECT *, row_number() OVER (PARTITION BY server_name, database_name ORDER BY last_lsn, backup_set_id) AS step FROM steps""")
def q_bk10(spark, sf_dir):
    return bk.restore_sequence(fx.f3_backups(spark, sf_dir), STOP_AT)


def replicas(spark, sf_dir):
    b = fx.f3_backups(spark, sf_dir)
    return b.groupBy("database_name", F.col("user_name").alias("replica")).agg(
        F.max("backup_finish_date").alias("last_commit")).withColumn(
        "role", F.when(F.col("replica") == "1-URGENT", "PRIMARY").otherwise("SECONDARY"))


@reg("bk11_replica_lag", F3 + """
, r AS (SELECT database_name, user_name AS replica, max(backup_finish_date) AS last_commit,
               CASE WHEN user_name = '1-URGENT' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role FROM f3 GROUP BY ALL)
SELECT s.database_name, s.replica, date_diff('second', s.last_commit, p.last_commit) AS lag_seconds,
       CASE WHEN date_diff('second', s.last_commit, p.last_commit) > 86400 THEN 'FALLING BEHIND'
            WHEN date_diff('second', s.last_commit, p.last_commit) > 0 THEN 'LAGGING' ELSE 'IN SYNC' END AS status
FROM r s JOIN r p ON s.database_name = p.database_name AND p.role = 'PRIMARY' WHERE s.role = 'SECONDARY'""")
def q_bk11(spark, sf_dir):
    return bk.replica_lag(replicas(spark, sf_dir), max_lag_seconds=86400)


@reg("bk11_restore_latency", F3 + """
, r AS (SELECT user_name AS secondary_server, database_name AS secondary_database, max(backup_finish_date) AS last_restored_date FROM f3 WHERE type = 'L' GROUP BY ALL),
t AS (SELECT *, CAST(length(secondary_database) * 10000 AS BIGINT) AS restore_threshold_minutes,
             date_diff('minute', last_restored_date, TIMESTAMP '1999-01-01') AS minutes_since_restore FROM r)
SELECT secondary_server, secondary_database, restore_threshold_minutes, last_restored_date, minutes_since_restore,
       CASE WHEN minutes_since_restore > restore_threshold_minutes THEN 'ALERT - Restore threshold exceeded' ELSE 'OK' END AS status FROM t""")
def q_bk11r(spark, sf_dir):
    r = fx.f3_backups(spark, sf_dir).filter("type = 'L'").groupBy(F.col("user_name").alias("secondary_server"), F.col("database_name").alias("secondary_database")).agg(
        F.max("backup_finish_date").alias("last_restored_date"))
    r = r.withColumn("restore_threshold_minutes", (F.length("secondary_database") * 10000).cast("long"))
    return bk.restore_latency(r, dt.datetime(1999, 1, 1))


@reg("bk11_unsynchronized_replicas", F3 + """
, r AS (SELECT database_name, user_name AS replica, max(backup_set_id) % 5 AS s FROM f3 GROUP BY ALL)
SELECT database_name, replica, CASE s WHEN 1 THEN 'SYNCHRONIZING' WHEN 2 THEN 'NOT SYNCHRONIZING' ELSE 'REVERTING' END AS synchronization_state
FROM r WHERE s BETWEEN 1 AND 3""")
def q_bk11u(spark, sf_dir):
    s = F.max("backup_set_id") % 5
    r = fx.f3_backups(spark, sf_dir).groupBy("database_name", F.col("user_name").alias("replica")).agg(
        F.element_at(F.array(*[F.lit(x) for x in ("SYNCHRONIZED", "SYNCHRONIZING", "NOT SYNCHRONIZING", "REVERTING", None)]), (s + 1).cast("int"))
        .alias("synchronization_state"))
    return bk.unsynchronized_replicas(r)


@reg("bk12_incremental_history_copy", F3 + """
SELECT * FROM f3 n WHERE NOT EXISTS (SELECT 1 FROM f3 e WHERE e.backup_finish_date < TIMESTAMP '1999-01-01'
                                     AND e.server_name = n.server_name AND e.backup_set_id = n.backup_set_id)""")
def q_bk12(spark, sf_dir):
    b = fx.f3_backups(spark, sf_dir)
    return bk.new_history_rows(b, b.filter(F.col("backup_finish_date") < F.lit(dt.datetime(1999, 1, 1))))


JOB_AS_OF = dt.datetime(2001, 7, 31)


def job_runs(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("job"), (F.col("o_custkey") % 20).cast("string")).alias("job_name"),
                    k.alias("run_id"),
                    (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                               (k % 86400).cast("decimal(18,6)"))).alias("run_ts"),
                    (k % 5).cast("int").alias("run_status"))


@reg("bk13_job_history", """
WITH r AS (SELECT 'job' || CAST(o_custkey % 20 AS VARCHAR) AS job_name, o_orderkey AS run_id,
                  o_orderdate + to_seconds(o_orderkey % 86400) AS run_ts, CAST(o_orderkey % 5 AS INTEGER) AS run_status
           FROM orders)
SELECT job_name, run_id, run_ts,
       row_number() OVER (PARTITION BY job_name ORDER BY run_ts DESC, run_id DESC) AS run_rank,
       CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled'
                       WHEN 4 THEN 'In Progress' ELSE 'Unknown' END AS status,
       run_ts >= TIMESTAMP '2001-07-31' - INTERVAL 1 DAY AS within_24h
FROM r QUALIFY run_rank <= 5""")
def q_bk13(spark, sf_dir):
    return bk.job_history(job_runs(spark, sf_dir), JOB_AS_OF, n=5)
