"""Registered queries: the health rules (RL-1, DR-2) on facts derived from customers (databases), orders (files),
suppliers (servers) and parts (alerts).  The oracles state every rule on the raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from ..operators.rules import run_rules
from . import fixtures as fx

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


NAME = "CASE k % 50 WHEN 1 THEN 'master' WHEN 2 THEN 'model' WHEN 3 THEN 'msdb' WHEN 4 THEN 'tempdb' WHEN 5 THEN 'ReportServer' ELSE concat('db', k) END"
PATH = (r"CASE k % 9 WHEN 0 THEN 'C:\data\f.mdf' WHEN 1 THEN 'c:\f.mdf' WHEN 2 THEN '\\share\f.mdf' WHEN 3 THEN 'http://store/f.mdf' ELSE 'D:\f.mdf' END")


def databases(spark, sf_dir):
    c = fx._t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    k = F.col("k")

    def every(m, r=0):
        return k % m == r

    return c.select(
        F.concat(F.lit("srv"), F.col("n").cast("string")).alias("server_name"), F.expr(NAME).alias("database_name"),
        every(29).alias("is_auto_close_on"), every(23).alias("is_auto_shrink_on"), (k % 7).alias("state"), (k % 3).alias("page_verify_option"),
        (~every(31)).alias("is_auto_create_stats_on"), (~every(37)).alias("is_auto_update_stats_on"), every(41).alias("is_auto_update_stats_async_on"),
        every(43).alias("is_parameterization_forced"), every(47).alias("is_published"), every(53).alias("is_subscribed"),
        every(59).alias("is_merge_published"), every(61).alias("is_distributor"), every(67).alias("is_date_correlation_on"), every(17).alias("is_encrypted"),
        F.when(every(19), None).when(every(13), "bob").otherwise("sa").alias("owner_name"), F.when(every(2), "sa").otherwise("bob").alias("usual_owner"),
        (F.lit(80) + (k % 9) * 10).alias("compatibility_level"), F.when(every(11), "Greek_CI").otherwise("Latin1_CI").alias("collation_name"),
        F.lit("Latin1_CI").alias("tempdb_collation"), F.when(every(71), k).alias("source_database_id"), every(73).alias("is_change_tracking_on"),
        (k % 3).alias("query_store_desired"), (k % 4 % 3).alias("query_store_actual"), (~every(5)).alias("query_store_waits"),
        F.when(every(8), "ALL").otherwise("AUTO").alias("query_store_capture"), ((k % 4) * 60).alias("target_recovery_seconds"),
        every(83).alias("is_read_only"), every(89).alias("is_in_standby"),
        every(79).alias("is_read_committed_snapshot_on"))


def files(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k = F.col("k")
    return o.select(
        F.concat(F.lit("srv"), (F.col("c") % 40).cast("string")).alias("server_name"), F.expr(NAME.replace("k %", "c %").replace("'db', k", "'db', c")).alias("database_name"),
        F.expr(PATH.replace("\\", "\\\\")).alias("physical_name"), (k % 5 == 0).alias("is_read_only"), F.when(k % 4 == 0, k * 100).when(k % 4 == 1, 268435456).otherwise(-1).alias("max_size"),
        F.when(k % 7 < 4, 0).when(k % 7 < 6, 1).otherwise(2).alias("kind"), F.when(k % 6 == 0, 0).otherwise(128 * (k % 3)).alias("growth"),
        (k % 10 == 7).alias("is_percent_growth"), ((k % 200) * 1000).alias("size"), (F.col("c") % 3 == 0).alias("is_snapshot"))


def servers(spark, sf_dir):
    s = fx._t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")

    def every(m, r=0):
        return k % m == r

    edition = F.element_at(F.array(*[F.lit(x) for x in ("Standard Edition (64-bit)", "Enterprise Edition (64-bit)", "Developer Edition (64-bit)", "Express Edition (64-bit)",
                                                        "Enterprise Evaluation Edition (64-bit)", "Standard Edition")]), (k % 6 + 1).cast("int"))
    return s.select(
        F.concat(F.lit("srv"), k.cast("string")).alias("server_name"), edition.alias("edition"), every(7).alias("resource_governor_enabled"),
        ((k % 5 + 1) * 1048576).alias("physical_memory_kb"), ((k % 9) * 1024).alias("max_server_memory_mb"), ((k % 20) * 100000).alias("available_memory_kb"),
        every(3).alias("is_clustered"), F.when(~every(11), F.concat(F.lit("srv"), k.cast("string"))).alias("configured_name"), every(2).alias("remote_admin_connections"),
        F.when(every(13), 2).otherwise(0).alias("offline_schedulers"), F.when(every(14), 1).otherwise(0).alias("offline_memory_nodes"),
        (~every(4)).alias("backup_compression_default"), (k % 3).alias("uncompressed_full_backups"), (k % 3).alias("numa_nodes"), every(15).alias("priority_boost"), ((k % 3) * 15000000000).alias("total_memory_kb"),
        ((k % 5) * 3000000000).alias("free_memory_kb"), F.when(every(8), "Stopped").otherwise("Running").alias("agent_status"), every(16).alias("buffer_pool_extension"),
        F.when(every(5), 50).otherwise(5).alias("cost_threshold"), (k % 2).alias("max_dop"), (k % 32).alias("cpu_count"), ((k % 6) * 1024).alias("min_server_memory_mb"),
        every(6).alias("instant_file_initialization"), F.when(every(9), "Balanced").otherwise("High performance").alias("power_plan"),
        (k * 3 % 700).alias("hours_since_restart"), every(10).alias("is_virtual"), every(17).alias("is_container"), F.when(every(18), k * 8).otherwise(0).alias("locked_page_kb"))


def alerts(spark, sf_dir):
    p = fx._t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    return p.select(
        F.concat(F.lit("srv"), (k % 97).cast("string")).alias("server_name"), F.concat(F.lit("alert"), k.cast("string")).alias("alert_name"), (k % 5 != 0).alias("enabled"),
        F.when(k % 3 == 0, None).otherwise(k % 2).alias("has_notification"), F.when(k % 4 == 0, k).alias("job_id"), (F.lit(800) + k % 240).alias("message_id"),
        (k % 130).alias("severity"), (k % 7).alias("include_event_description"))


_ROW = ("SELECT {0} AS server_name, {1} AS database_name, CAST(NULL AS TIMESTAMP) AS check_ts, CAST({2} AS INTEGER) AS check_id, CAST({3} AS INTEGER) AS priority, "
        "'{4}' AS findings_group, '{5}' AS finding, CAST({7} AS VARCHAR) AS details, CAST({8} AS DOUBLE) AS value FROM {9} WHERE {6}")


def _sql(table, database, *rows, server="'srv' || n"):
    return "\nUNION ALL ".join(_ROW.format(server, database, *r, table) for r in rows)


SYS = "k % 50 IN (1, 2, 3, 4)"


@reg("rl01_database_health", f"WITH d AS (SELECT c_custkey AS k, c_nationkey AS n, {NAME} AS db FROM customer)\n" + _sql(
    "d", "db",
    (12, 10, "Performance", "Auto-Close Enabled", "k % 29 = 0", "db", "NULL"),
    (13, 10, "Performance", "Auto-Shrink Enabled", "k % 23 = 0 AND k % 7 <> 6", "db", "NULL"),
    (14, 50, "Reliability", "Page Verification Not Optimal", "k % 3 <> 2 AND k % 50 <> 4 AND k % 7 NOT IN (1, 6)", "db", "k % 3"),
    (15, 110, "Performance", "Auto-Create Stats Disabled", "k % 31 = 0", "db", "NULL"),
    (16, 110, "Performance", "Auto-Update Stats Disabled", "k % 37 = 0", "db", "NULL"),
    (17, 150, "Performance", "Stats Updated Asynchronously", "k % 41 = 0", "db", "NULL"),
    (18, 150, "Performance", "Forced Parameterization On", "k % 43 = 0", "db", "NULL"),
    (19, 200, "Informational", "Replication In Use", "0 IN (k % 47, k % 53, k % 59, k % 61)", "db", "NULL"),
    (20, 200, "Informational", "Date Correlation On", "k % 67 = 0", "db", "NULL"),
    (21, 200, "Informational", "Database Encrypted", "k % 17 = 0", "db", "NULL"),
    # owner: none for each 19th, bob for each other 13th, else sa; usual owner sa (bob on odd rows), sa on system databases
    (55, 230, "Security", "Database Owner <> SA",
     f"k % 19 <> 0 AND ((k % 13 = 0 AND ({SYS} OR k % 2 = 0)) OR (k % 13 <> 0 AND NOT {SYS} AND k % 2 = 1))", "CASE WHEN k % 13 = 0 THEN 'bob' ELSE 'sa' END", "NULL"),
    (213, 230, "Security", "Database Owner is Unknown", "k % 19 = 0", "db", "NULL"),
    (62, 200, "Performance", "Old Compatibility Level", "k % 9 IN (0, 1)", "db", "80 + (k % 9) * 10"),
    (76, 200, "Informational", "Collation different than tempdb", "k % 11 = 0 AND k % 50 NOT IN (1, 2, 3, 5)", "'Greek_CI'", "NULL"),
    (77, 170, "Reliability", "Database Snapshot Online", "k % 71 = 0", "db", "NULL"),
    (102, 20, "Reliability", "Databases in Unusual States", "k % 7 >= 2", "db", "k % 7"),
    (112, 100, "Performance", "Change Tracking Enabled", "k % 73 = 0", "db", "NULL"),
    (163, 200, "Performance", "Query Store Disabled", f"k % 3 = 0 AND NOT {SYS} AND k % 50 <> 5", "db", "NULL"),
    (262, 200, "Performance", "Query Store Wait Stats Disabled", "k % 3 > 0 AND k % 5 = 0", "db", "NULL"),
    (263, 200, "Performance", "Query Store Effectively Disabled", "k % 3 > 0 AND k % 4 <> 2", "db", "NULL"),
    (264, 200, "Performance", "Undesired Query Store State", "k % 3 > 0 AND k % 3 <> (CASE k % 4 WHEN 3 THEN 0 ELSE k % 4 END)", "db", "NULL"),
    (265, 200, "Performance", "Query Store Unusually Configured", "k % 3 > 0 AND k % 8 = 0", "'ALL'", "NULL"),
    (257, 50, "Performance", "Recovery Interval Not Optimal", f"k % 4 <> 1 AND NOT {SYS} AND k % 83 > 0 AND k % 89 > 0", "db", "(k % 4) * 60"),
    (133, 210, "Non-Default Database Config", "Read Committed Snapshot Isolation Enabled", "k % 79 = 0", "db", "NULL")))
def q_databases(spark, sf_dir):
    return run_rules(databases(spark, sf_dir), health.DATABASE_RULES)


_FILES = f"""WITH f AS (SELECT o_orderkey AS k, o_custkey AS c, 'srv' || (o_custkey % 40) AS srv,
  {NAME.replace('k %', 'o_custkey %').replace("'db', k", "'db', o_custkey")} AS db, {PATH.replace('k %', 'o_orderkey %')} AS path,
  CASE WHEN o_orderkey % 7 < 4 THEN 0 WHEN o_orderkey % 7 < 6 THEN 1 ELSE 2 END AS kind, (o_orderkey % 200) * 1000 AS size FROM orders),
g AS (SELECT srv, db, sum(CASE WHEN kind = 0 THEN size ELSE 0 END) AS data, max(size) FILTER (kind = 1) AS log, max(size) FILTER (kind = 0) AS hi,
             min(size) FILTER (kind = 0) AS lo, count(*) FILTER (kind = 0) AS n, bool_or(c % 3 = 0) AS snap FROM f GROUP BY srv, db)
"""


@reg("rl01_file_health", _FILES + _sql(
    "f", "db",
    (24, 170, "File Configuration", "System Database on C Drive", "k % 9 < 2 AND c % 50 IN (1, 2, 3)", "path", "NULL"),
    (25, 20, "Reliability", "TempDB on C Drive", "k % 9 < 2 AND c % 50 = 4", "path", "NULL"),
    (26, 20, "Reliability", "User Databases on C Drive", "k % 9 < 2 AND c % 50 NOT IN (1, 2, 3, 4)", "path", "NULL"),
    (80, 170, "Reliability", "Max File Size Set", "k % 5 <> 0 AND k % 4 = 0 AND k % 7 <> 6 AND k % 6 <> 0 AND k % 3 > 0 AND k * 100 <> 268435456", "path", "k * 100"),
    (82, 170, "File Configuration", "File growth set to percent", "k % 10 = 7 AND size > 128000", "path", "size"),
    (158, 170, "File Configuration", "File growth set to 1MB", "k % 10 <> 7 AND k % 3 = 1 AND size > 128000", "path", "size"),
    (148, 170, "Reliability", "Database Files on Network File Shares", "k % 9 = 2", "path", "NULL"),
    (149, 170, "Reliability", "Database Files Stored in Azure", "k % 9 = 3", "path", "NULL"), server="srv") + "\nUNION ALL " + _sql(
    "g", "db",
    (75, 50, "Reliability", "Transaction Log Larger than Data File", "log > 125000 AND log > data AND NOT snap",
     "log || ' pages of log, ' || CAST(data AS BIGINT) || ' of data'", "log"),
    (40, 170, "File Configuration", "TempDB Only Has 1 Data File", "db = 'tempdb' AND n = 1", "db", "NULL"),
    (175, 170, "File Configuration", "TempDB Has >16 Data Files", "db = 'tempdb' AND n > 16", "db", "n"),
    (183, 170, "File Configuration", "TempDB Unevenly Sized Data Files", "db = 'tempdb' AND (hi - lo) / 131072.0 > 1", "db", "hi - lo"), server="srv"))
def q_files(spark, sf_dir):
    return health.health_findings(files=files(spark, sf_dir))


_EDITION = ("(['Standard Edition (64-bit)', 'Enterprise Edition (64-bit)', 'Developer Edition (64-bit)', 'Express Edition (64-bit)', "
            "'Enterprise Evaluation Edition (64-bit)', 'Standard Edition'])[k % 6 + 1]")


@reg("rl01_server_health", f"WITH s AS (SELECT s_suppkey AS k, 'srv' || s_suppkey AS srv, s_suppkey AS n FROM supplier), e AS (SELECT *, {_EDITION} AS ed FROM s)\n" + _sql(
    "e", "CAST(NULL AS VARCHAR)",
    (10, 100, "Performance", "Resource Governor Enabled", "k % 7 = 0", "srv", "NULL"),
    (50, 100, "Performance", "Max Memory Set Too High", "k % 5 + 1 < k % 9",
     "(k % 9) * 1024 || ' MB allowed, ' || (k % 5 + 1) * 1048576 || ' KB installed'", "(k % 9) * 1024"),
    (51, 1, "Performance", "Memory Dangerously Low", "k % 20 < 3", "srv", "(k % 20) * 100000"),
    (53, 200, "Informational", "Cluster Node", "k % 3 = 0", "srv", "NULL"),
    (70, 200, "Informational", "@@Servername not set", "k % 11 = 0", "srv", "NULL"),
    (97, 100, "Performance", "Unusual SQL Server Edition", "k % 6 = 3", "ed", "NULL"),
    (100, 170, "Reliability", "Remote DAC Disabled", "k % 2 = 1", "srv", "NULL"),
    (101, 10, "Performance", "CPU Schedulers Offline", "k % 13 = 0", "srv", "2"),
    (110, 10, "Performance", "Memory Nodes Offline", "k % 14 = 0", "srv", "1"),
    (116, 200, "Informational", "Backup Compression Default Off", "k % 4 = 0 AND k % 3 > 0", "srv", "k % 3"),
    (126, 5, "Reliability", "Priority Boost Enabled", "k % 15 = 0", "srv", "NULL"),
    (154, 10, "Performance", "32-bit SQL Server Installed", "k % 6 = 5", "ed", "NULL"),
    (165, 50, "Performance", "Too Much Free Memory", "k % 3 = 2 AND k % 5 >= 3 AND k % 6 NOT IN (0, 5)", "srv", "(k % 5) * 3000000000"),
    (167, 250, "Server Info", "Agent is Currently Offline", "k % 8 = 0", "'Stopped'", "NULL"),
    (173, 200, "Licensing", "Non-Production License", "k % 6 = 2", "ed", "NULL"),
    (174, 200, "Performance", "Buffer Pool Extensions Enabled", "k % 16 = 0", "srv", "NULL"),
    (188, 200, "Performance", "Default Parallelism Settings", "k % 5 <> 0", "'cost threshold for parallelism'", "5"),
    (188, 200, "Performance", "Default Parallelism Settings", "k % 2 = 0 AND (k % 3 = 2 OR k % 32 > 8)", "'max degree of parallelism'", "0"),
    (190, 200, "Performance", "Non-Dynamic Memory", "k % 6 = k % 9", "srv", "(k % 6) * 1024"),
    (192, 50, "Performance", "Instant File Initialization Not Enabled", "k % 6 <> 0", "srv", "NULL"),
    (193, 250, "Server Info", "Instant File Initialization Enabled", "k % 6 = 0", "srv", "NULL"),
    (211, 250, "Server Info", "Power Plan", "k % 9 = 0", "'Balanced'", "NULL"),
    (221, 10, "Reliability", "Server restarted in last 24 hours", "k * 3 % 700 <= 24", "srv", "k * 3 % 700"),
    (229, 1, "Reliability", "Evaluation Edition", "k % 6 = 4", "ed", "NULL"),
    (103, 250, "Server Info", "Virtual Server", "k % 10 = 0", "srv", "NULL"),
    (214, 250, "Server Info", "Container", "k % 17 = 0", "srv", "NULL"),
    (166, 250, "Server Info", "Locked Pages in Memory Enabled", "k % 18 = 0 AND k > 0", "srv", "k * 8"), server="srv"))
def q_servers(spark, sf_dir):
    return health.health_findings(servers=servers(spark, sf_dir))


@reg("rl01_agent_health", """WITH a AS (SELECT p_partkey AS k, p_partkey % 97 AS n FROM part),
g AS (SELECT n, count(*) FILTER (k % 5 <> 0 AND (k % 3 = 0 OR k % 2 = 0) AND k % 4 <> 0) AS silent, count(*) FILTER (k % 240 IN (23, 24, 25)) AS damage,
             count(*) FILTER (k % 130 BETWEEN 19 AND 25) AS severe FROM a GROUP BY n)
""" + _sql("a", "CAST(NULL AS VARCHAR)",
           (98, 200, "Monitoring", "Alerts Disabled", "k % 5 = 0", "'alert' || k", "NULL"),
           (219, 200, "Monitoring", "Alerts Without Event Descriptions", "k % 5 <> 0 AND k % 7 = 0", "'alert' || k", "NULL")) + "\nUNION ALL " + _sql(
    "g", "CAST(NULL AS VARCHAR)",
    (30, 200, "Monitoring", "Not All Alerts Configured", "severe < 7", "'srv' || n", "severe"),
    (59, 200, "Monitoring", "Alerts Configured without Follow Up", "silent > 0", "'srv' || n", "silent"),
    (96, 200, "Monitoring", "No Alerts for Corruption", "damage = 0", "'srv' || n", "NULL"),
    (61, 200, "Monitoring", "No Alerts for Sev 19-25", "severe = 0", "'srv' || n", "NULL")))
def q_agent(spark, sf_dir):
    return health.health_findings(alerts=alerts(spark, sf_dir))


@reg("rl01_job_login_object_health", r"""WITH j AS (SELECT o_orderkey AS k, 'srv' || o_custkey % 40 AS srv FROM orders),
l AS (SELECT c_custkey AS k, 'srv' || c_nationkey AS srv, CASE c_custkey % 10 WHEN 0 THEN 'sa' WHEN 1 THEN 'NT SERVICE\x' ELSE 'login' || c_custkey END AS login FROM customer),
o AS (SELECT p_partkey AS k, 'srv' || p_partkey % 9 AS srv, (['master', 'msdb', 'model', 'app'])[p_partkey % 4 + 1] AS db, 'obj' || p_partkey AS obj FROM part)
""" + _sql("j", "CAST(NULL AS VARCHAR)",
           (6, 230, "Security", "Jobs Owned By Users", "k % 3 > 0 AND k % 7 = 0", "'Job job' || k || ' is owned by bob'", "NULL"),
           (57, 230, "Security", "SQL Agent Job Runs at Startup", "k % 2 = 0 AND k % 11 = 0", "'job' || k", "NULL"),
           (79, 100, "Performance", "Shrink Database Job", "k % 13 IN (0, 1)", "'job' || k", "NULL"),
           (94, 200, "Monitoring", "Agent Jobs Without Failure Emails", "k % 3 > 0 AND k % 5 = 0 AND k % 17 > 0", "'job' || k", "NULL"), server="srv")
     + "\nUNION ALL " + _sql("l", "CAST(NULL AS VARCHAR)",
                             (4, 230, "Security", "Sysadmins", "k % 4 = 0 AND k % 10 > 1 AND k % 6 > 0", "login", "NULL"),
                             (5, 230, "Security", "Security Admins", "k % 5 = 1 AND k % 10 > 0 AND k % 6 > 0", "login", "NULL"),
                             (104, 230, "Security", "Control Server Permissions", "k % 19 = 0 AND k % 6 > 0", "login", "NULL"), server="srv")
     + "\nUNION ALL " + _sql("o", "db",
                             (27, 200, "Informational", "Tables in the Master Database", "k % 3 > 0 AND db = 'master' AND k % 5 > 0", "obj", "NULL"),
                             (28, 200, "Informational", "Tables in the MSDB Database", "k % 3 > 0 AND db = 'msdb' AND k % 5 > 0", "obj", "NULL"),
                             (29, 200, "Informational", "Tables in the Model Database", "k % 3 > 0 AND db = 'model' AND k % 5 > 0", "obj", "NULL"),
                             (7, 230, "Security", "Stored Procedure Runs at Startup", "k % 3 = 0 AND db = 'master' AND k % 8 = 0", "obj", "NULL"), server="srv"))
def q_jobs(spark, sf_dir):
    k = F.col("k")

    def name(prefix):
        return F.concat(F.lit(prefix), k.cast("string"))

    def either(m, yes, no):
        return F.when(k % m == 0, yes).otherwise(no)

    jobs = fx._t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("srv"), (F.col("o_custkey") % 40).cast("string")).alias("server_name")).select(
        "server_name", name("job").alias("job_name"), (k % 3 > 0).alias("enabled"), either(7, "bob", "sa").alias("owner_name"), F.lit("sa").alias("usual_owner"),
        (k % 2 == 0).alias("schedule_enabled"), either(11, 64, 4).alias("schedule_freq_type"),
        F.when(k % 13 == 0, "DBCC SHRINKFILE(1)").when(k % 13 == 1, "DBCC SHRINKDATABASE(db)").otherwise("BACKUP").alias("step_command"),
        either(5, 0, 3).alias("notify_email_operator"), F.lit(0).alias("notify_page_operator"), F.lit(0).alias("notify_netsend_operator"),
        either(17, "Report Server", "Maintenance").alias("category"))
    logins = fx._t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("srv"), F.col("c_nationkey").cast("string")).alias("server_name")).select(
        "server_name", F.when(k % 10 == 0, "sa").when(k % 10 == 1, "NT SERVICE\\x").otherwise(name("login")).alias("login_name"), (k % 4 == 0).alias("is_sysadmin"),
        (k % 5 == 1).alias("is_securityadmin"), (k % 19 == 0).alias("has_control_server"), (k % 6 == 0).alias("denied"))
    dbs = F.element_at(F.array(*[F.lit(x) for x in ("master", "msdb", "model", "app")]), (k % 4 + 1).cast("int"))
    objects = fx._t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(
        F.concat(F.lit("srv"), (k % 9).cast("string")).alias("server_name"), dbs.alias("database_name"), name("obj").alias("object_name"),
        either(3, "P", "U").alias("object_type"), (k % 5 == 0).alias("is_ms_shipped"), (k % 8 == 0).alias("runs_at_startup"))
    return health.health_findings(jobs=jobs, logins=logins, system_objects=objects)
