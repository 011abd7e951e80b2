"""Health rules of servers, databases, files and the agent (RL-1, DR-2).

Rules are data, one list for each fact table; a list is evaluated in one scan of its table
(:func:`~fleetscope.operators.rules.run_rules`).  Rules that count over a database's files or a server's alerts run over the
small per-group facts of :func:`file_groups` and :func:`agent_facts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Rule, run_rules

SYSTEM_DATABASES = "('master', 'model', 'msdb', 'tempdb')"
#: databases whose query store nobody switches on
NO_QUERY_STORE = "('master', 'model', 'msdb', 'rdsadmin', 'tempdb', 'DWConfiguration', 'DWDiagnostics', 'DWQueue', 'ReportServer', 'ReportServerTempDB')"

# Check id, priority, group, finding; predicate and detail over the facts.
#: facts of a database: its catalog row, the query store's states (0 off, 1 read only, 2 read and write) and the server's defaults
DATABASE_RULES = [
    Rule(12, 10, "Performance", "Auto-Close Enabled", "is_auto_close_on", "database_name"),
    Rule(13, 10, "Performance", "Auto-Shrink Enabled", "is_auto_shrink_on AND state <> 6", "database_name"),
    Rule(14, 50, "Reliability", "Page Verification Not Optimal", "page_verify_option < 2 AND database_name <> 'tempdb' AND state NOT IN (1, 6)",
         "database_name", "page_verify_option"),
    Rule(15, 110, "Performance", "Auto-Create Stats Disabled", "NOT is_auto_create_stats_on", "database_name"),
    Rule(16, 110, "Performance", "Auto-Update Stats Disabled", "NOT is_auto_update_stats_on", "database_name"),
    Rule(17, 150, "Performance", "Stats Updated Asynchronously", "is_auto_update_stats_async_on", "database_name"),
    Rule(18, 150, "Performance", "Forced Parameterization On", "is_parameterization_forced", "database_name"),
    Rule(19, 200, "Informational", "Replication In Use", "is_published OR is_subscribed OR is_merge_published OR is_distributor", "database_name"),
    Rule(20, 200, "Informational", "Date Correlation On", "is_date_correlation_on", "database_name"),
    Rule(21, 200, "Informational", "Database Encrypted", "is_encrypted", "database_name"),
    Rule(55, 230, "Security", "Database Owner <> SA",
         f"owner_name <> CASE WHEN database_name IN {SYSTEM_DATABASES} THEN 'sa' ELSE usual_owner END", "owner_name"),
    Rule(213, 230, "Security", "Database Owner is Unknown", "owner_name IS NULL", "database_name"),
    Rule(62, 200, "Performance", "Old Compatibility Level", "compatibility_level <= 90", "database_name", "compatibility_level"),
    Rule(76, 200, "Informational", "Collation different than tempdb",
         "database_name NOT IN ('master', 'model', 'msdb') AND database_name NOT LIKE 'ReportServer%' AND collation_name <> tempdb_collation", "collation_name"),
    Rule(77, 170, "Reliability", "Database Snapshot Online", "source_database_id IS NOT NULL", "database_name"),
    Rule(102, 20, "Reliability", "Databases in Unusual States", "state > 1", "database_name", "state"),
    Rule(112, 100, "Performance", "Change Tracking Enabled", "is_change_tracking_on", "database_name"),
    Rule(163, 200, "Performance", "Query Store Disabled", f"query_store_desired = 0 AND database_name NOT IN {NO_QUERY_STORE}", "database_name"),
    Rule(262, 200, "Performance", "Query Store Wait Stats Disabled", "query_store_desired <> 0 AND NOT query_store_waits", "database_name"),
    Rule(263, 200, "Performance", "Query Store Effectively Disabled", "query_store_desired <> 0 AND query_store_actual <> 2", "database_name"),
    Rule(264, 200, "Performance", "Undesired Query Store State", "query_store_desired <> 0 AND query_store_actual <> query_store_desired", "database_name"),
    Rule(265, 200, "Performance", "Query Store Unusually Configured", "query_store_desired <> 0 AND query_store_capture <> 'AUTO'", "query_store_capture"),
    Rule(257, 50, "Performance", "Recovery Interval Not Optimal",
         f"target_recovery_seconds <> 60 AND database_name NOT IN {SYSTEM_DATABASES} AND NOT is_read_only AND NOT is_in_standby",
         "database_name", "target_recovery_seconds"),
    Rule(133, 210, "Non-Default Database Config", "Read Committed Snapshot Isolation Enabled", "is_read_committed_snapshot_on", "database_name"),
]

#: facts of a database file: sizes and growth in pages of 8 KB, kind 0 data, 1 log, 2 stream
FILE_RULES = [
    Rule(24, 170, "File Configuration", "System Database on C Drive",
         "upper(left(physical_name, 1)) = 'C' AND database_name IN ('master', 'model', 'msdb')", "physical_name"),
    Rule(25, 20, "Reliability", "TempDB on C Drive", "upper(left(physical_name, 1)) = 'C' AND database_name = 'tempdb'", "physical_name"),
    Rule(26, 20, "Reliability", "User Databases on C Drive",
         f"upper(left(physical_name, 1)) = 'C' AND database_name NOT IN {SYSTEM_DATABASES}", "physical_name"),
    Rule(80, 170, "Reliability", "Max File Size Set", "NOT is_read_only AND max_size NOT IN (-1, 268435456) AND kind <> 2 AND growth > 0",
         "physical_name", "max_size"),
    Rule(82, 170, "File Configuration", "File growth set to percent", "is_percent_growth AND size > 128000", "physical_name", "size"),
    Rule(158, 170, "File Configuration", "File growth set to 1MB", "NOT is_percent_growth AND growth = 128 AND size > 128000", "physical_name", "size"),
    Rule(148, 170, "Reliability", "Database Files on Network File Shares", r"startswith(physical_name, '\\\\')", "physical_name"),
    Rule(149, 170, "Reliability", "Database Files Stored in Azure", "physical_name LIKE 'http://%'", "physical_name"),
]

#: facts of all files of a database (:func:`file_groups`)
FILE_GROUP_RULES = [
    Rule(75, 50, "Reliability", "Transaction Log Larger than Data File", "largest_log > 125000 AND largest_log > data_pages AND NOT is_snapshot",
         "concat(largest_log, ' pages of log, ', data_pages, ' of data')", "largest_log"),
    Rule(40, 170, "File Configuration", "TempDB Only Has 1 Data File", "database_name = 'tempdb' AND data_files = 1", "database_name"),
    Rule(175, 170, "File Configuration", "TempDB Has >16 Data Files", "database_name = 'tempdb' AND data_files > 16", "database_name", "data_files"),
    Rule(183, 170, "File Configuration", "TempDB Unevenly Sized Data Files",
         "database_name = 'tempdb' AND (largest_data - smallest_data) * 8 / (1024 * 1024) > 1", "database_name", "largest_data - smallest_data"),
]

#: facts of a server: properties, settings in use, memory in KB
SERVER_RULES = [
    Rule(10, 100, "Performance", "Resource Governor Enabled", "resource_governor_enabled", "server_name"),
    Rule(50, 100, "Performance", "Max Memory Set Too High", "physical_memory_kb < max_server_memory_mb * 1024",
         "concat(max_server_memory_mb, ' MB allowed, ', physical_memory_kb, ' KB installed')", "max_server_memory_mb"),
    Rule(51, 1, "Performance", "Memory Dangerously Low", "available_memory_kb < 262144", "server_name", "available_memory_kb"),
    Rule(53, 200, "Informational", "Cluster Node", "is_clustered", "server_name"),
    Rule(70, 200, "Informational", "@@Servername not set", "configured_name IS NULL", "server_name"),
    Rule(97, 100, "Performance", "Unusual SQL Server Edition",
         "NOT edition RLIKE 'Standard|Enterprise|Data Center|Developer|Business Intelligence'", "edition"),
    Rule(100, 170, "Reliability", "Remote DAC Disabled", "NOT remote_admin_connections", "server_name"),
    Rule(101, 10, "Performance", "CPU Schedulers Offline", "offline_schedulers > 0", "server_name", "offline_schedulers"),
    Rule(110, 10, "Performance", "Memory Nodes Offline", "offline_memory_nodes > 0", "server_name", "offline_memory_nodes"),
    Rule(116, 200, "Informational", "Backup Compression Default Off",
         "NOT backup_compression_default AND uncompressed_full_backups > 0", "server_name", "uncompressed_full_backups"),
    Rule(126, 5, "Reliability", "Priority Boost Enabled", "priority_boost", "server_name"),
    Rule(154, 10, "Performance", "32-bit SQL Server Installed", "edition NOT LIKE '%64%'", "edition"),
    Rule(165, 50, "Performance", "Too Much Free Memory",
         "total_memory_kb > 20480000000 AND total_memory_kb * 0.3 <= free_memory_kb AND edition NOT LIKE '%Standard%'", "server_name", "free_memory_kb"),
    Rule(167, 250, "Server Info", "Agent is Currently Offline", "agent_status <> 'Running'", "agent_status"),
    Rule(173, 200, "Licensing", "Non-Production License", "edition LIKE '%Developer%'", "edition"),
    Rule(174, 200, "Performance", "Buffer Pool Extensions Enabled", "buffer_pool_extension", "server_name"),
    Rule(188, 200, "Performance", "Default Parallelism Settings", "cost_threshold = 5", "'cost threshold for parallelism'", "cost_threshold"),
    Rule(188, 200, "Performance", "Default Parallelism Settings", "max_dop = 0 AND (numa_nodes > 1 OR cpu_count > 8)", "'max degree of parallelism'", "max_dop"),
    Rule(190, 200, "Performance", "Non-Dynamic Memory", "min_server_memory_mb = max_server_memory_mb", "server_name", "min_server_memory_mb"),
    Rule(192, 50, "Performance", "Instant File Initialization Not Enabled", "NOT instant_file_initialization", "server_name"),
    Rule(193, 250, "Server Info", "Instant File Initialization Enabled", "instant_file_initialization", "server_name"),
    Rule(211, 250, "Server Info", "Power Plan", "power_plan <> 'High performance'", "power_plan"),
    Rule(221, 10, "Reliability", "Server restarted in last 24 hours", "hours_since_restart <= 24", "server_name", "hours_since_restart"),
    Rule(229, 1, "Reliability", "Evaluation Edition", "edition LIKE '%Evaluation%'", "edition"),
    Rule(103, 250, "Server Info", "Virtual Server", "is_virtual", "server_name"),
    Rule(214, 250, "Server Info", "Container", "is_container", "server_name"),
    Rule(166, 250, "Server Info", "Locked Pages in Memory Enabled", "locked_page_kb > 0", "server_name", "locked_page_kb"),
]

#: facts of a server's agent (:func:`agent_facts`)
AGENT_RULES = [
    Rule(30, 200, "Monitoring", "Not All Alerts Configured", "severe_alerts < 7", "server_name", "severe_alerts"),
    Rule(59, 200, "Monitoring", "Alerts Configured without Follow Up", "alerts_enabled_silent > 0", "server_name", "alerts_enabled_silent"),
    Rule(96, 200, "Monitoring", "No Alerts for Corruption", "corruption_alerts = 0", "server_name"),
    Rule(61, 200, "Monitoring", "No Alerts for Sev 19-25", "severe_alerts = 0", "server_name"),
]

#: facts of an alert
ALERT_RULES = [
    Rule(98, 200, "Monitoring", "Alerts Disabled", "NOT enabled", "alert_name"),
    Rule(219, 200, "Monitoring", "Alerts Without Event Descriptions", "enabled AND include_event_description = 0", "alert_name"),
]

#: facts of an agent job: owner, whom it notifies (operator numbers, 0 none), its schedule, and whether a step shrinks files
JOB_RULES = [
    Rule(6, 230, "Security", "Jobs Owned By Users", "enabled AND owner_name <> usual_owner", "concat('Job ', job_name, ' is owned by ', owner_name)"),
    Rule(57, 230, "Security", "SQL Agent Job Runs at Startup", "schedule_enabled AND schedule_freq_type = 64", "job_name"),
    Rule(79, 100, "Performance", "Shrink Database Job", "step_command LIKE '%SHRINKDATABASE%' OR step_command LIKE '%SHRINKFILE%'", "job_name"),
    Rule(94, 200, "Monitoring", "Agent Jobs Without Failure Emails",
         "enabled AND notify_email_operator = 0 AND notify_page_operator = 0 AND notify_netsend_operator = 0 AND category <> 'Report Server'", "job_name"),
]

#: facts of a login
LOGIN_RULES = [
    Rule(4, 230, "Security", "Sysadmins",
         r"is_sysadmin AND login_name NOT IN ('sa', 'l_certSignSmDetach') AND NOT denied AND NOT startswith(login_name, 'NT SERVICE\\')", "login_name"),
    Rule(5, 230, "Security", "Security Admins", "is_securityadmin AND login_name <> 'sa' AND NOT denied", "login_name"),
    Rule(104, 230, "Security", "Control Server Permissions", "has_control_server AND NOT denied", "login_name"),
]

#: facts of a user table or procedure in a system database
SYSTEM_OBJECT_RULES = [
    Rule(27, 200, "Informational", "Tables in the Master Database", "object_type = 'U' AND database_name = 'master' AND NOT is_ms_shipped", "object_name"),
    Rule(28, 200, "Informational", "Tables in the MSDB Database", "object_type = 'U' AND database_name = 'msdb' AND NOT is_ms_shipped", "object_name"),
    Rule(29, 200, "Informational", "Tables in the Model Database", "object_type = 'U' AND database_name = 'model' AND NOT is_ms_shipped", "object_name"),
    Rule(7, 230, "Security", "Stored Procedure Runs at Startup", "object_type = 'P' AND database_name = 'master' AND runs_at_startup", "object_name"),
]


def file_groups(files: DataFrame, *, keys: Sequence[str] = ("server_name", "database_name")) -> DataFrame:
    """Per database: pages of data, largest log and data file, smallest data file, number of data files, whether it is a snapshot."""
    size = F.col("size")
    data, log = F.when(F.col("kind") == 0, size), F.when(F.col("kind") == 1, size)
    return files.groupBy(*keys).agg(
        F.coalesce(F.sum(data), F.lit(0)).alias("data_pages"), F.max(log).alias("largest_log"), F.max(data).alias("largest_data"),
        F.min(data).alias("smallest_data"), F.count(data).alias("data_files"), F.bool_or("is_snapshot").alias("is_snapshot"))


def agent_facts(alerts: DataFrame) -> DataFrame:
    """Per server: enabled alerts that notify nobody and start nothing, alerts for damaged pages, alerts for severities 19 to 25."""
    return alerts.groupBy("server_name").agg(
        F.count_if(F.col("enabled") & (F.coalesce(F.col("has_notification"), F.lit(0)) == 0) & F.col("job_id").isNull()).alias("alerts_enabled_silent"),
        F.count_if(F.col("message_id").isin(823, 824, 825)).alias("corruption_alerts"),
        F.count_if(F.col("severity").between(19, 25)).alias("severe_alerts"))


def health_findings(*, databases: DataFrame | None = None, files: DataFrame | None = None, servers: DataFrame | None = None,
                    alerts: DataFrame | None = None, jobs: DataFrame | None = None, logins: DataFrame | None = None,
                    system_objects: DataFrame | None = None) -> DataFrame:
    """RL-1: findings of all health rules over the fact tables that are given."""
    parts = []
    if databases is not None:
        parts.append(run_rules(databases, DATABASE_RULES))
    if files is not None:
        parts += [run_rules(files, FILE_RULES), run_rules(file_groups(files), FILE_GROUP_RULES)]
    if servers is not None:
        parts.append(run_rules(servers, SERVER_RULES, database=None))
    if alerts is not None:
        parts += [run_rules(alerts, ALERT_RULES, database=None), run_rules(agent_facts(alerts), AGENT_RULES, database=None)]
    for facts, rules in ((jobs, JOB_RULES), (logins, LOGIN_RULES)):
        if facts is not None:
            parts.append(run_rules(facts, rules, database=None))
    if system_objects is not None:
        parts.append(run_rules(system_objects, SYSTEM_OBJECT_RULES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
