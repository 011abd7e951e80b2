"""Registered queries: drift (DR-*), fleet rules (FC-4..7), security (SEC-*,
PRJ-7) and data quality (DQ-*) on F4/F8/F9."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import quality as dq
from ..operators import security as sec
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


# ---------------------------------------------------------------- F8 config
def f8_config(spark, sf_dir):
    s = fx._t(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    opts = [
        ("max degree of parallelism", k % 8),
        ("cost threshold for parallelism", 5 + (n % 3) * 20),
        ("max server memory (MB)", F.when(k % 4 == 0, F.lit(2147483647)).otherwise(4096 * (n % 4 + 1))),
        ("optimize for ad hoc workloads", k % 2),
        ("backup compression default", n % 2),
    ]
    arr = F.array(*[F.struct(F.lit(name).alias("name"), v.cast("long").alias("value")) for name, v in opts])
    e = s.select(F.concat(F.lit("srv"), k.cast("string")).alias("server_name"), k.alias("k"), F.explode(arr).alias("o"))
    return e.select("server_name", "o.name", "o.value",
                    F.when(F.col("k") % 9 == 0, F.col("o.value") + 1).otherwise(F.col("o.value")).alias("value_in_use"))


F8_SQL = """f8 AS (
  SELECT server_name, name, value, CASE WHEN k % 9 = 0 THEN value + 1 ELSE value END AS value_in_use FROM (
    SELECT 'srv' || CAST(s_suppkey AS VARCHAR) AS server_name, s_suppkey AS k, 'max degree of parallelism' AS name,
           CAST(s_suppkey % 8 AS BIGINT) AS value FROM supplier
    UNION ALL SELECT 'srv' || CAST(s_suppkey AS VARCHAR), s_suppkey, 'cost threshold for parallelism',
           CAST(5 + (s_nationkey % 3) * 20 AS BIGINT) FROM supplier
    UNION ALL SELECT 'srv' || CAST(s_suppkey AS VARCHAR), s_suppkey, 'max server memory (MB)',
           CAST(CASE WHEN s_suppkey % 4 = 0 THEN 2147483647 ELSE 4096 * (s_nationkey % 4 + 1) END AS BIGINT) FROM supplier
    UNION ALL SELECT 'srv' || CAST(s_suppkey AS VARCHAR), s_suppkey, 'optimize for ad hoc workloads',
           CAST(s_suppkey % 2 AS BIGINT) FROM supplier
    UNION ALL SELECT 'srv' || CAST(s_suppkey AS VARCHAR), s_suppkey, 'backup compression default',
           CAST(s_nationkey % 2 AS BIGINT) FROM supplier)),
dflt(name, default_value, id) AS (VALUES ('backup compression default', 0, 1073), ('cost threshold for parallelism', 5, 1012),
      ('max degree of parallelism', 0, 1029), ('max server memory (MB)', 2147483647, 1031), ('optimize for ad hoc workloads', 0, 1041))"""


DR01_BODY = """
SELECT server_name, CAST(NULL AS VARCHAR) AS database_name, CAST(NULL AS TIMESTAMP) AS check_ts,
       CAST(id AS INTEGER) AS check_id, CAST(200 AS INTEGER) AS priority, 'Non-Default Server Config' AS findings_group,
       f8.name AS finding, 'running ' || CAST(value_in_use AS VARCHAR) || ', default ' || CAST(default_value AS VARCHAR) AS details,
       CAST(value_in_use AS DOUBLE) AS value
FROM f8 JOIN dflt USING (name) WHERE value_in_use IS DISTINCT FROM default_value
UNION ALL
SELECT server_name, NULL, NULL, 81, 200, 'Non-Active Server Config', 'Config Not Running at Set Value',
       name || ': set ' || CAST(value AS VARCHAR) || ', running ' || CAST(value_in_use AS VARCHAR), CAST(value_in_use AS DOUBLE)
FROM f8 WHERE value IS DISTINCT FROM value_in_use"""


def dr01_cte() -> str:
    """DR-1 finding rows as a CTE named ``fnd``."""
    return "WITH " + F8_SQL + ", fnd AS (" + DR01_BODY.strip() + ")\n"


@reg("dr01_config_drift", "WITH " + F8_SQL + DR01_BODY)
def q_dr01(spark, sf_dir):
    c = f8_config(spark, sf_dir)
    return dr.config_drift(c, dr.config_defaults(spark))


# database options of the fixture: every option is off its default in one database of (5 + its position)
DB_OPTIONS = ["is_supplemental_logging_enabled", "snapshot_isolation_state", "is_auto_create_stats_incremental_on", "is_ansi_null_default_on",
              "is_recursive_triggers_on", "is_trustworthy_on", "is_broker_enabled", "is_honor_broker_priority_on", "is_parameterization_forced",
              "is_query_store_on", "is_cdc_enabled", "containment", "target_recovery_time_in_seconds", "delayed_durability",
              "is_memory_optimized_elevate_to_snapshot_on", "is_accelerated_database_recovery_on"]


def db_options(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer")
    d = F.col("c_custkey") % 50
    return c.select(F.concat(F.lit("srv"), (F.col("c_custkey") % 2).cast("string")).alias("server_name"),
                    F.concat(F.lit("db"), d.cast("string")).alias("database_name"),
                    *[F.when(d % (5 + i) == 0, "1").otherwise("0").alias(o) for i, o in enumerate(DB_OPTIONS)]).distinct()


@reg("dr02_database_option_drift", """
WITH o AS (SELECT DISTINCT c_custkey % 2 AS s, c_custkey % 50 AS d FROM customer),
e(option, position, check_id, finding) AS (VALUES
  ('is_supplemental_logging_enabled', 0, 131, 'Supplemental Logging Enabled'), ('snapshot_isolation_state', 1, 132, 'Snapshot Isolation Enabled'),
  ('is_auto_create_stats_incremental_on', 2, 134, 'Auto Create Stats Incremental Enabled'),
  ('is_ansi_null_default_on', 3, 135, 'ANSI NULL Default Enabled'), ('is_recursive_triggers_on', 4, 136, 'Recursive Triggers Enabled'),
  ('is_trustworthy_on', 5, 137, 'Trustworthy Enabled'), ('is_broker_enabled', 6, 230, 'Broker Enabled'),
  ('is_honor_broker_priority_on', 7, 231, 'Honor Broker Priority Enabled'), ('is_parameterization_forced', 8, 138, 'Forced Parameterization Enabled'),
  ('is_query_store_on', 9, 139, 'Query Store Enabled'), ('is_cdc_enabled', 10, 140, 'Change Data Capture Enabled'),
  ('containment', 11, 141, 'Containment Enabled'), ('target_recovery_time_in_seconds', 12, 142, 'Target Recovery Time Changed'),
  ('delayed_durability', 13, 143, 'Delayed Durability Enabled'), ('is_memory_optimized_elevate_to_snapshot_on', 14, 144, 'Memory Optimized Enabled'),
  ('is_accelerated_database_recovery_on', 15, 145, 'Acclerated Database Recovery Enabled'))
SELECT 'srv' || CAST(s AS VARCHAR) AS server_name, 'db' || CAST(d AS VARCHAR) AS database_name, CAST(NULL AS TIMESTAMP) AS check_ts,
       CAST(check_id AS INTEGER) AS check_id, CAST(210 AS INTEGER) AS priority, 'Non-Default Database Config' AS findings_group, finding,
       option || ' = 1' AS details, CAST(NULL AS DOUBLE) AS value
FROM o, e WHERE d % (5 + position) = 0""")
def q_dr02(spark, sf_dir):
    return dr.option_drift(db_options(spark, sf_dir), dr.database_defaults(spark))


def f8_after(spark, sf_dir):
    c = f8_config(spark, sf_dir).withColumn("k", F.substring("server_name", 4, 10).cast("long"))
    changed = c.filter(F.col("k") % 7 != 0).withColumn(
        "value", F.when(F.col("k") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    added = c.filter((F.col("k") % 11 == 0) & (F.col("name") == "max degree of parallelism")).select(
        "server_name", F.lit("xp_cmdshell").alias("name"), F.lit(1).cast("long").alias("value"), "value_in_use", "k")
    return changed.unionByName(added).drop("k")


@reg("dr03_config_changes", "WITH " + F8_SQL + """
, c AS (SELECT *, CAST(substr(server_name, 4) AS BIGINT) AS k FROM f8),
a AS (SELECT server_name, name, CASE WHEN k % 5 = 0 THEN value + 1 ELSE value END AS value FROM c WHERE k % 7 <> 0
      UNION ALL SELECT server_name, 'xp_cmdshell', 1 FROM c WHERE k % 11 = 0 AND name = 'max degree of parallelism'),
j AS (SELECT coalesce(b.server_name, a.server_name) AS server_name, coalesce(b.name, a.name) AS name,
             b.value AS old_value, a.value AS new_value,
             CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed'
                  WHEN b.value IS DISTINCT FROM a.value THEN 'changed' END AS status
      FROM f8 b FULL OUTER JOIN a ON b.server_name = a.server_name AND b.name = a.name)
SELECT * FROM j WHERE status IS NOT NULL""")
def q_dr03(spark, sf_dir):
    return dr.config_changes(f8_config(spark, sf_dir), f8_after(spark, sf_dir))


# Public product lifecycle (major version, product, mainstream end, extended end).
LIFECYCLE = [
    (11, "SQL Server 2012", dt.datetime(2017, 7, 11), dt.datetime(2022, 7, 12)),
    (12, "SQL Server 2014", dt.datetime(2019, 7, 9), dt.datetime(2024, 7, 9)),
    (13, "SQL Server 2016", dt.datetime(2021, 7, 13), dt.datetime(2026, 7, 14)),
    (14, "SQL Server 2017", dt.datetime(2022, 10, 11), dt.datetime(2027, 10, 12)),
    (15, "SQL Server 2019", dt.datetime(2025, 2, 28), dt.datetime(2030, 1, 8)),
    (16, "SQL Server 2022", dt.datetime(2028, 1, 11), dt.datetime(2033, 1, 11)),
]
VERSION_AS_OF = dt.datetime(2025, 6, 1)


# Released builds of each major version (first release, service packs, cumulative updates).
BUILDS = {
    11: [(2100, "RTM"), (3000, "SP1"), (5058, "SP2"), (6020, "SP3"), (7001, "SP4")],
    12: [(2000, "RTM"), (4100, "SP1"), (5000, "SP2"), (6024, "SP3")],
    13: [(1601, "RTM"), (2149, "RTM CU1"), (2164, "RTM CU2"), (2186, "RTM CU3"), (2193, "RTM CU4"), (2197, "RTM CU5"), (2204, "RTM CU6"),
         (2210, "RTM CU7"), (2213, "RTM CU8"), (2216, "RTM CU9"), (4001, "SP1"), (5026, "SP2"), (6300, "SP3")],
    14: [(1000, "RTM"), (3006, "CU1"), (3008, "CU2"), (3015, "CU3"), (3022, "CU4"), (3023, "CU5"), (3025, "CU6"), (3026, "CU7"), (3029, "CU8"),
         (3030, "CU9"), (3037, "CU10"), (3038, "CU11"), (3045, "CU12"), (3048, "CU13"), (3076, "CU14"), (3162, "CU15"), (3223, "CU16"),
         (3238, "CU17"), (3257, "CU18"), (3294, "CU20"), (3335, "CU21"), (3356, "CU22"), (3381, "CU23"), (3391, "CU24"), (3401, "CU25"),
         (3411, "CU26"), (3421, "CU27"), (3430, "CU28"), (3436, "CU29"), (3451, "CU30"), (3456, "CU31")],
    15: [(2000, "RTM"), (4003, "CU1"), (4013, "CU2"), (4023, "CU3"), (4033, "CU4"), (4043, "CU5"), (4053, "CU6"), (4063, "CU7"), (4073, "CU8"),
         (4102, "CU9"), (4123, "CU10"), (4138, "CU11"), (4153, "CU12"), (4178, "CU13"), (4188, "CU14"), (4198, "CU15"), (4223, "CU16"),
         (4249, "CU17"), (4261, "CU18"), (4298, "CU19"), (4312, "CU20"), (4316, "CU21"), (4322, "CU22"), (4335, "CU23"), (4345, "CU24"),
         (4355, "CU25"), (4365, "CU26"), (4375, "CU27"), (4385, "CU28"), (4405, "CU29"), (4415, "CU30"), (4420, "CU31"), (4430, "CU32")],
    16: [(1000, "RTM"), (4003, "CU1"), (4015, "CU2"), (4025, "CU3"), (4035, "CU4"), (4045, "CU5"), (4055, "CU6"), (4065, "CU7"), (4075, "CU8"),
         (4085, "CU9"), (4095, "CU10"), (4105, "CU11"), (4115, "CU12"), (4125, "CU13"), (4135, "CU14"), (4145, "CU15"), (4165, "CU16"),
         (4175, "CU17"), (4185, "CU18"), (4195, "CU19"), (4205, "CU20"), (4215, "CU21"), (4225, "CU22")],
}


def build_catalog(spark):
    """The released builds as a table (a caller with a longer list passes its own)."""
    return spark.createDataFrame([(m, b, n) for m, rows in BUILDS.items() for b, n in rows], "major int, build long, cu_name string")


@reg("dr04_version_support", """
WITH s AS (SELECT 'srv' || CAST(s_suppkey AS VARCHAR) AS server_name, CAST(11 + s_suppkey % 6 AS INTEGER) AS major,
                  CAST(1000 + (s_suppkey * 37) % 5500 AS BIGINT) AS build FROM supplier),
b(major, build, cu_name) AS (VALUES """ + ", ".join(f"({m}, {b}, '{n}')" for m, rows in BUILDS.items() for b, n in rows) + """),
l(major, product, mainstream_end, extended_end) AS (VALUES """ + ", ".join(
    f"({m}, '{p}', TIMESTAMP '{a:%Y-%m-%d}', TIMESTAMP '{e:%Y-%m-%d}')" for m, p, a, e in LIFECYCLE) + """),
m AS (SELECT s.*, b.cu_name FROM s ASOF LEFT JOIN b ON s.major = b.major AND s.build >= b.build)
SELECT server_name, m.major, build, coalesce(cu_name, 'unknown build') AS cu_name, product, mainstream_end, extended_end,
       extended_end < TIMESTAMP '2025-06-01' AS out_of_support, mainstream_end < TIMESTAMP '2025-06-01' AS past_mainstream
FROM m LEFT JOIN l ON CAST(m.major AS INTEGER) = l.major""")
def q_dr04(spark, sf_dir):
    s = fx._t(spark, sf_dir, "supplier")
    servers = s.select(F.concat(F.lit("srv"), F.col("s_suppkey").cast("string")).alias("server_name"),
                       (11 + F.col("s_suppkey") % 6).cast("int").alias("major"),
                       (1000 + (F.col("s_suppkey") * 37) % 5500).cast("long").alias("build"))
    life = spark.createDataFrame(LIFECYCLE, "major int, product string, mainstream_end timestamp_ntz, "
                                            "extended_end timestamp_ntz")
    return dr.version_support(servers, build_catalog(spark), F.broadcast(life), VERSION_AS_OF)


@reg("fc04_simultaneous_jobs", """
WITH s AS (SELECT 'srv' || CAST(o_custkey % 3 AS VARCHAR) AS server_name, 'job' || CAST(o_orderkey % 40 AS VARCHAR) AS job_name,
                  date_trunc('hour', o_orderdate + to_seconds(o_orderkey % 86400)) AS next_run_ts FROM orders)
SELECT server_name, next_run_ts, CAST(count(DISTINCT job_name) AS BIGINT) AS jobs, list_sort(list_distinct(list(job_name))) AS job_names
FROM s GROUP BY ALL HAVING count(DISTINCT job_name) > 1""")
def q_fc04(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = o.select(F.concat(F.lit("srv"), (F.col("o_custkey") % 3).cast("string")).alias("server_name"),
                 F.concat(F.lit("job"), (k % 40).cast("string")).alias("job_name"),
                 F.date_trunc("hour", F.col("o_orderdate") + F.make_dt_interval(
                     F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))).alias("next_run_ts"))
    return dr.simultaneous_jobs(s)


@reg("fc05_normalized_log_events", """
WITH l AS (SELECT regexp_replace(text, '[0-9]+', '#', 'g') AS normalized, source AS user_name,
                  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts FROM documents)
SELECT normalized, user_name, min(ts) AS first_seen, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS occurrences
FROM l GROUP BY ALL""")
def q_fc05(spark, sf_dir):
    d = fx._t(spark, sf_dir, "documents")
    logs = d.select("text", F.col("source").alias("user_name"), (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
                                                                   + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id")))
                    .alias("ts"))
    return dr.normalized_log_events(logs)


def error_events(spark, sf_dir):
    ev = fx._t(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ev.select(F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("server_name"), "ts",
                     F.when(F.col("value") > 50, 20).when(F.col("value") > 10, 16).otherwise(10).alias("severity"))


ERR_SQL = """err AS (SELECT 'srv' || CAST(user_id % 4 AS VARCHAR) AS server_name, ts,
                     CASE WHEN value > 50 THEN 20 WHEN value > 10 THEN 16 ELSE 10 END AS severity
              FROM events WHERE event_type = 'error')"""


@reg("fc06_recent_errors", "WITH " + ERR_SQL + """
SELECT server_name, severity, CAST(count(*) AS BIGINT) AS errors, max(ts) AS last_error FROM err
WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-30' GROUP BY ALL""")
def q_fc06(spark, sf_dir):
    return dr.recent_errors(error_events(spark, sf_dir), dt.datetime(2024, 1, 30), days=7)


@reg("fc07_deadlock_rate", "WITH " + ERR_SQL + """
, st AS (SELECT 'srv' || CAST(user_id % 4 AS VARCHAR) AS server_name, min(ts) AS start_ts FROM events GROUP BY ALL),
c AS (SELECT server_name, CAST(count(*) AS BIGINT) AS deadlocks FROM err GROUP BY ALL)
SELECT c.server_name, deadlocks, greatest(date_diff('day', start_ts, TIMESTAMP '2024-01-31'), 1) AS uptime_days,
       round(deadlocks / greatest(date_diff('day', start_ts, TIMESTAMP '2024-01-31'), 1), 4) AS deadlocks_per_day,
       round(deadlocks / greatest(date_diff('day', start_ts, TIMESTAMP '2024-01-31'), 1), 4) > 10 AS flagged
FROM c JOIN st USING (server_name)""")
def q_fc07(spark, sf_dir):
    ev = fx._t(spark, sf_dir, "events")
    starts = ev.groupBy(F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("server_name")).agg(
        F.min("ts").alias("start_ts"))
    return dr.deadlock_rate(error_events(spark, sf_dir), starts, dt.datetime(2024, 1, 31))


# ---------------------------------------------------------------- security
def permissions(spark, sf_dir):
    n = fx._t(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("grantee"),
                    F.concat(F.lit("tbl"), (F.col("n_nationkey") % 5).cast("string")).alias("object_name"),
                    F.element_at(F.array(*[F.lit(x) for x in ["SELECT", "INSERT", "UPDATE", "DELETE", "EXECUTE"]]),
                                 (F.col("n_nationkey") % 5 + 1).cast("int")).alias("permission"),
                    F.when(F.col("n_regionkey") % 2 == 0, "GRANT").otherwise("DENY").alias("state"))


PERM_SQL = """perm AS (SELECT n_name AS role, 'tbl' || CAST(n_nationkey % 5 AS VARCHAR) AS object_name,
                      (['SELECT', 'INSERT', 'UPDATE', 'DELETE', 'EXECUTE'])[n_nationkey % 5 + 1] AS permission,
                      CASE WHEN n_regionkey % 2 = 0 THEN 'GRANT' ELSE 'DENY' END AS state FROM nation)"""


@reg("sec01_permission_listing", ofx.with_(ofx.f4_principals(), PERM_SQL) + """
SELECT member, f4p.role, object_name, permission, state FROM f4p LEFT JOIN perm ON f4p.role = perm.role""")
def q_sec01(spark, sf_dir):
    return sec.permission_listing(fx.f4_principals(spark, sf_dir), permissions(spark, sf_dir))


CLOSURE_SQL = """WITH RECURSIVE e AS (
  SELECT DISTINCT * FROM (SELECT c_name AS member, n_name AS role FROM customer JOIN nation ON c_nationkey = n_nationkey
                          UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)),
cl(member, role, depth) AS (
  SELECT member, role, CAST(1 AS BIGINT) FROM e
  UNION ALL SELECT cl.member, e.role, cl.depth + 1 FROM cl JOIN e ON cl.role = e.member WHERE cl.depth < (SELECT count(DISTINCT member) + 1 FROM e))
"""


@reg("sec02_role_closure", CLOSURE_SQL + """
SELECT member, role, min(depth) AS depth FROM cl GROUP BY ALL""")
def q_sec02(spark, sf_dir):
    return sec.role_closure(fx.f4_principals(spark, sf_dir))


@reg("sec03_high_risk_principals", CLOSURE_SQL + """
SELECT DISTINCT * FROM (
  SELECT member AS principal, 'member of ' || role AS reason FROM cl WHERE role IN ('EUROPE', 'ASIA')
  UNION ALL SELECT c_name, 'disabled login' FROM customer WHERE c_acctbal < 0)""")
def q_sec03(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer")
    logins = c.select(F.col("c_name").alias("login_name"), (F.col("c_acctbal") < 0).alias("is_disabled"))
    return sec.high_risk_principals(sec.role_closure(fx.f4_principals(spark, sf_dir)), logins,
                                    admin_roles=("EUROPE", "ASIA"))


@reg("sec04_orphaned_users", """
SELECT c_name AS user_name, c_custkey AS user_id FROM customer
WHERE NOT EXISTS (SELECT 1 FROM events WHERE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') = c_name)""")
def q_sec04(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer")
    users = c.select(F.col("c_name").alias("user_name"), F.col("c_custkey").alias("user_id"))
    # a login exists for everyone who is seen in the event log
    logins = fx._t(spark, sf_dir, "events").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("login_name")).distinct()
    return sec.orphaned_users(users, logins)


@reg("prj07_row_level_security", """
WITH r AS (SELECT o_orderkey, 'login' || CAST(o_custkey % 25 AS VARCHAR) AS owner, o_totalprice FROM orders),
ent AS (SELECT DISTINCT 'login' || CAST((c_custkey % 25) - (c_custkey % 25) % 5 AS VARCHAR) AS viewer,
               'login' || CAST(c_custkey % 25 AS VARCHAR) AS owner FROM customer)
SELECT DISTINCT * FROM r WHERE owner = 'login5' OR owner IN (SELECT owner FROM ent WHERE viewer = 'login5')""")
def q_prj07(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("login"), (F.col("o_custkey") % 25).cast("string")).alias("owner"),
                    "o_totalprice")
    c = fx._t(spark, sf_dir, "customer")
    m = F.col("c_custkey") % 25
    ent = c.select(F.concat(F.lit("login"), (m - m % 5).cast("string")).alias("viewer"),
                   F.concat(F.lit("login"), m.cast("string")).alias("owner")).distinct()
    return sec.visible_rows(rows, ent, owner="owner", context="login5")


# ---------------------------------------------------------------- quality
@reg("dq01_table_profile", """
SELECT table_name, column_name, rows, non_null, rows - non_null AS nulls FROM (
  UNPIVOT (SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS rows,
                  CAST(count(c_custkey) AS BIGINT) AS c_custkey, CAST(count(c_name) AS BIGINT) AS c_name,
                  CAST(count(c_nationkey) AS BIGINT) AS c_nationkey, CAST(count(c_acctbal) AS BIGINT) AS c_acctbal,
                  CAST(count(c_mktsegment) AS BIGINT) AS c_mktsegment FROM customer)
  ON c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment INTO NAME column_name VALUE non_null)""")
def q_dq01(spark, sf_dir):
    return dq.table_profile(fx._t(spark, sf_dir, "customer"), table="customer")


@reg("dq02_orphan_rows", """
SELECT 'fk_orders_customer' AS constraint_name, CAST(count(*) AS BIGINT) AS orphan_rows FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'fk_lineitem_part', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'fk_lineitem_supplier', CAST(count(*) AS BIGINT) FROM lineitem
  WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def q_dq02(spark, sf_dir):
    t = lambda n: fx._t(spark, sf_dir, n)
    return (dq.orphan_counts(t("orders"), t("customer"), fk="o_custkey", pk="c_custkey", name="fk_orders_customer")
            .unionByName(dq.orphan_counts(t("lineitem"), t("part"), fk="l_partkey", pk="p_partkey",
                                          name="fk_lineitem_part"))
            .unionByName(dq.orphan_counts(t("lineitem"), t("supplier"), fk="l_suppkey", pk="s_suppkey",
                                          name="fk_lineitem_supplier")))


@reg("dq03_column_listing", """
SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, data_type, is_nullable,
       CAST(CASE column_name WHEN 'c_custkey' THEN k WHEN 'c_name' THEN n WHEN 'c_nationkey' THEN t WHEN 'c_acctbal' THEN b
                             ELSE o END AS BIGINT) AS non_null_rows
FROM information_schema.columns, (SELECT count(c_custkey) AS k, count(c_name) AS n, count(c_nationkey) AS t, count(c_acctbal) AS b,
       count(*) AS o FROM customer) WHERE table_name = 'customer'""")
def q_dq03(spark, sf_dir):
    return dq.column_listing(spark, fx._t(spark, sf_dir, "customer"), table="customer")


@reg("dq04_orphaned_files", ofx.with_(ofx.f3_files()) + """
SELECT * FROM f3f WHERE NOT EXISTS (
  SELECT 1 FROM supplier WHERE 'srv' || CAST(s_suppkey % 2 AS VARCHAR) = f3f.server_name AND s_suppkey % 15 = f3f.database_id)""")
def q_dq04(spark, sf_dir):
    s = fx._t(spark, sf_dir, "supplier")
    dbs = s.select(F.concat(F.lit("srv"), (F.col("s_suppkey") % 2).cast("string")).alias("server_name"),
                   (F.col("s_suppkey") % 15).alias("database_id")).distinct()
    return dq.orphaned_files(fx.f3_files(spark, sf_dir), dbs)


@reg("dq05_index_size_estimate", ofx.with_(ofx.f5()) + """
SELECT table_name, index_name, row_count,
       CAST(list_sum(list_transform(keys, lambda k: length(k) + 8)) AS BIGINT) AS key_bytes,
       round(row_count * (list_sum(list_transform(keys, lambda k: length(k) + 8)) + 11) / 1048576.0, 4) AS estimated_mb
FROM f5""")
def q_dq05(spark, sf_dir):
    return dq.index_size_estimate(fx.f5_indexes(spark, sf_dir))


def customer_after(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 11 != 0).withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


DQ06_SQL = """
WITH a AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
                  c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey,
       CASE WHEN a.c_custkey IS NULL THEN 'missing_in_right' WHEN b.c_custkey IS NULL THEN 'missing_in_left'
            ELSE 'changed' END AS status
FROM customer b FULL OUTER JOIN a ON b.c_custkey = a.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR b.c_acctbal IS DISTINCT FROM a.c_acctbal
   OR b.c_name IS DISTINCT FROM a.c_name OR b.c_nationkey IS DISTINCT FROM a.c_nationkey
   OR b.c_mktsegment IS DISTINCT FROM a.c_mktsegment"""


@reg("dq06_compare_by_digest", DQ06_SQL)
def q_dq06d(spark, sf_dir):
    return dq.compare_by_digest(fx._t(spark, sf_dir, "customer"), customer_after(spark, sf_dir), key=["c_custkey"])


@reg("dq06_table_compare", DQ06_SQL)
def q_dq06(spark, sf_dir):
    return dq.compare_tables(fx._t(spark, sf_dir, "customer"), customer_after(spark, sf_dir), key=["c_custkey"])


INV_TABLES = ["customer", "orders", "part", "supplier", "nation"]


def _inv_sql() -> str:
    parts = []
    cols = {"customer": (5, ["c_name", "c_mktsegment"]), "orders": (6, ["o_orderstatus", "o_orderpriority"]),
            "part": (6, ["p_name", "p_brand", "p_type"]), "supplier": (4, ["s_name"]), "nation": (3, ["n_name"])}
    for t in INV_TABLES:
        n, strs = cols[t]
        b = " + ".join(f"coalesce(octet_length(CAST({c} AS BLOB)), 0)" for c in strs)
        parts.append(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS rows, CAST({n} AS BIGINT) AS columns, "
                     f"CAST(coalesce(sum({b}), 0) AS BIGINT) AS string_bytes FROM {t}")
    return "\nUNION ALL ".join(parts)


@reg("dq07_inventory", _inv_sql())
def q_dq07(spark, sf_dir):
    return dq.inventory({t: fx._t(spark, sf_dir, t) for t in INV_TABLES})


@reg("dq07_object_counts", """
WITH o AS (SELECT 'db' || p_partkey % 7 AS database_name, (['U', 'V', 'P', 'FN', 'TR'])[p_size % 5 + 1] AS object_type FROM part)
SELECT database_name, object_type, count(*) AS objects, CAST(sum(count(*)) OVER (PARTITION BY database_name) AS BIGINT) AS total_objects
FROM o GROUP BY database_name, object_type""")
def q_dq07c(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("U", "V", "P", "FN", "TR")])
    objects = fx._t(spark, sf_dir, "part").select(F.concat(F.lit("db"), (F.col("p_partkey") % 7).cast("string")).alias("database_name"),
                                                  F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")).alias("object_type"))
    return dq.object_counts(objects)


@reg("dq07_deprecated_references", """
SELECT source, feature, CAST(count(*) AS BIGINT) AS reference_count
FROM documents, (VALUES ('password='), ('token ='), ('Licensed under'), ('Public License')) f(feature)
WHERE contains(text, feature) GROUP BY ALL""")
def q_dq07b(spark, sf_dir):
    return dq.deprecated_references(fx._t(spark, sf_dir, "documents"), ["password=", "token =", "Licensed under", "Public License"],
                                    group=["source"])
