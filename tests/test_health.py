"""Every health rule fires on a row made for it and stays silent on a row in order."""

import pytest
from pyspark.sql import types as T

from fleetscope.operators import health
from fleetscope.operators.rules import run_rules

KINDS = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType()}


def frame(spark, rows):
    names = list(rows[0])
    kind = {n: next((KINDS[type(r[n])] for r in rows if r[n] is not None), T.StringType()) for n in names}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], T.StructType([T.StructField(n, kind[n]) for n in names]))


GOOD_DATABASE = {
    "server_name": "s", "database_name": "app", "is_auto_close_on": False, "is_auto_shrink_on": False, "state": 0, "page_verify_option": 2,
    "is_auto_create_stats_on": True, "is_auto_update_stats_on": True, "is_auto_update_stats_async_on": False, "is_parameterization_forced": False,
    "is_published": False, "is_subscribed": False, "is_merge_published": False, "is_distributor": False, "is_date_correlation_on": False,
    "is_encrypted": False, "owner_name": "sa", "usual_owner": "sa", "compatibility_level": 160, "collation_name": "L", "tempdb_collation": "L",
    "source_database_id": None, "is_change_tracking_on": False, "query_store_desired": 2, "query_store_actual": 2, "query_store_waits": True,
    "query_store_capture": "AUTO", "target_recovery_seconds": 60, "is_read_only": False, "is_in_standby": False, "is_read_committed_snapshot_on": False}
BAD_DATABASE = {
    12: {"is_auto_close_on": True}, 13: {"is_auto_shrink_on": True}, 14: {"page_verify_option": 1}, 15: {"is_auto_create_stats_on": False},
    16: {"is_auto_update_stats_on": False}, 17: {"is_auto_update_stats_async_on": True}, 18: {"is_parameterization_forced": True},
    19: {"is_subscribed": True}, 20: {"is_date_correlation_on": True}, 21: {"is_encrypted": True}, 55: {"owner_name": "bob"}, 213: {"owner_name": None},
    62: {"compatibility_level": 90}, 76: {"collation_name": "G"}, 77: {"source_database_id": 7}, 102: {"state": 3}, 112: {"is_change_tracking_on": True},
    163: {"query_store_desired": 0, "query_store_actual": 0}, 262: {"query_store_waits": False}, 263: {"query_store_actual": 1, "query_store_desired": 1},
    264: {"query_store_actual": 2, "query_store_desired": 1}, 265: {"query_store_capture": "ALL"}, 257: {"target_recovery_seconds": 0},
    133: {"is_read_committed_snapshot_on": True}}
GOOD_FILE = {"server_name": "s", "database_name": "app", "physical_name": "D:\\f.mdf", "is_read_only": False, "max_size": -1, "kind": 0, "growth": 8192,
             "is_percent_growth": False, "size": 200000, "is_snapshot": False}
BAD_FILE = {24: {"physical_name": "c:\\x", "database_name": "msdb"}, 25: {"physical_name": "C:\\x", "database_name": "tempdb"}, 26: {"physical_name": "C:\\x"},
            80: {"max_size": 5}, 82: {"is_percent_growth": True}, 158: {"growth": 128}, 148: {"physical_name": "\\\\share\\x"}, 149: {"physical_name": "http://x"}}
GOOD_SERVER = {
    "server_name": "s", "edition": "Enterprise Edition (64-bit)", "resource_governor_enabled": False, "physical_memory_kb": 1 << 30, "max_server_memory_mb": 1024,
    "available_memory_kb": 1 << 24, "is_clustered": False, "configured_name": "s", "remote_admin_connections": True, "offline_schedulers": 0,
    "offline_memory_nodes": 0, "backup_compression_default": True, "uncompressed_full_backups": 0, "numa_nodes": 1, "priority_boost": False, "total_memory_kb": 1, "free_memory_kb": 0,
    "agent_status": "Running", "buffer_pool_extension": False, "cost_threshold": 50, "max_dop": 8, "cpu_count": 16, "min_server_memory_mb": 0,
    "instant_file_initialization": True, "power_plan": "High performance", "hours_since_restart": 900, "is_virtual": False, "is_container": False, "locked_page_kb": 0}
BAD_SERVER = {
    10: {"resource_governor_enabled": True}, 50: {"physical_memory_kb": 1000}, 51: {"available_memory_kb": 1000}, 53: {"is_clustered": True},
    70: {"configured_name": None}, 97: {"edition": "Express (64-bit)"}, 100: {"remote_admin_connections": False}, 101: {"offline_schedulers": 1},
    110: {"offline_memory_nodes": 1}, 116: {"backup_compression_default": False, "uncompressed_full_backups": 3}, 126: {"priority_boost": True}, 154: {"edition": "Enterprise Edition"},
    165: {"total_memory_kb": 30_000_000_000, "free_memory_kb": 9_000_000_000}, 167: {"agent_status": "Stopped"}, 173: {"edition": "Developer (64-bit)"},
    174: {"buffer_pool_extension": True}, 188: {"max_dop": 0}, 190: {"min_server_memory_mb": 1024}, 192: {"instant_file_initialization": False},
    211: {"power_plan": "Balanced"}, 221: {"hours_since_restart": 24}, 229: {"edition": "Enterprise Evaluation (64-bit)"}, 103: {"is_virtual": True},
    214: {"is_container": True}, 166: {"locked_page_kb": 8}}
GOOD_ALERT = {"server_name": "s", "alert_name": "a", "enabled": True, "has_notification": 1, "job_id": None, "message_id": 1, "severity": 1, "include_event_description": 1}


GOOD_JOB = {"server_name": "s", "job_name": "j", "enabled": True, "owner_name": "sa", "usual_owner": "sa", "schedule_enabled": True, "schedule_freq_type": 4,
            "step_command": "BACKUP", "notify_email_operator": 1, "notify_page_operator": 0, "notify_netsend_operator": 0, "category": "x"}
BAD_JOB = {6: {"owner_name": "bob"}, 57: {"schedule_freq_type": 64}, 79: {"step_command": "DBCC SHRINKFILE(1)"}, 94: {"notify_email_operator": 0}}
GOOD_LOGIN = {"server_name": "s", "login_name": "l", "is_sysadmin": False, "is_securityadmin": False, "has_control_server": False, "denied": False}
BAD_LOGIN = {4: {"is_sysadmin": True}, 5: {"is_securityadmin": True}, 104: {"has_control_server": True}}
GOOD_OBJECT = {"server_name": "s", "database_name": "app", "object_name": "o", "object_type": "U", "is_ms_shipped": False, "runs_at_startup": True}
BAD_OBJECT = {27: {"database_name": "master"}, 28: {"database_name": "msdb"}, 29: {"database_name": "model"}, 7: {"database_name": "master", "object_type": "P"}}


def test_logins_that_may_be_sysadmins(spark):
    rows = [{**GOOD_LOGIN, "is_sysadmin": True, "login_name": n, "denied": d} for n, d in (
        ("sa", False), ("NT SERVICE\\x", False), ("l_certSignSmDetach", False), ("bob", True), ("eve", False))]
    assert [r["details"] for r in run_rules(frame(spark, rows), health.LOGIN_RULES, database=None).collect()] == ["eve"]


@pytest.mark.parametrize(("rules", "good", "bad", "silent"), [
    (health.JOB_RULES, GOOD_JOB, BAD_JOB, set()), (health.LOGIN_RULES, GOOD_LOGIN, BAD_LOGIN, set()), (health.SYSTEM_OBJECT_RULES, GOOD_OBJECT, BAD_OBJECT, set()),
    (health.DATABASE_RULES, GOOD_DATABASE, BAD_DATABASE, set()), (health.FILE_RULES, GOOD_FILE, BAD_FILE, set()),
    (health.SERVER_RULES, GOOD_SERVER, BAD_SERVER, {193}), (health.ALERT_RULES, GOOD_ALERT, {98: {"enabled": False}, 219: {"include_event_description": 0}}, set())])
def test_each_rule_fires_on_its_row(spark, rules, good, bad, silent):
    assert {r.check_id for r in rules} - silent == set(bad)
    key = "server_name"
    rows = [{**good, key: "good"}, *({**good, **change, key: str(i)} for i, change in bad.items())]
    got = run_rules(frame(spark, rows), rules, database=None).collect()
    fired = {}
    for r in got:
        if r["check_id"] not in silent:
            fired.setdefault(r["server_name"], set()).add(r["check_id"])
    assert "good" not in fired
    for i in bad:
        assert i in fired[str(i)], i
    assert len({(r.check_id, r.predicate) for r in rules}) == len(rules)


def test_rules_over_groups(spark):
    def f(db, kind, size, **more):
        return {**GOOD_FILE, "database_name": db, "kind": kind, "size": size, **more}

    files = [f("tempdb", 0, 10, server_name="one"), *(f("tempdb", 0, 10, server_name="many") for _ in range(17)), f("tempdb", 0, 10, server_name="odd"),
             f("tempdb", 0, 500_000, server_name="odd"), f("app", 1, 200_000), f("app", 0, 1000), f("snap", 1, 200_000, is_snapshot=True)]
    got = {(r["server_name"], r["database_name"], r["check_id"]) for r in run_rules(health.file_groups(frame(spark, files)), health.FILE_GROUP_RULES).collect()}
    assert got == {("one", "tempdb", 40), ("many", "tempdb", 175), ("odd", "tempdb", 183), ("s", "app", 75)}
    alerts = [GOOD_ALERT, {**GOOD_ALERT, "server_name": "t", "message_id": 823}, {**GOOD_ALERT, "server_name": "t", "severity": 20},
              {**GOOD_ALERT, "server_name": "u", "has_notification": None, "message_id": 824, "severity": 25}]
    got = {(r["server_name"], r["check_id"]) for r in run_rules(health.agent_facts(frame(spark, alerts)), health.AGENT_RULES, database=None).collect()}
    assert got == {("s", 96), ("s", 61), ("s", 30), ("t", 30), ("u", 30), ("u", 59)}


def test_every_descriptive_rule_fires_on_the_catalog(spark):
    import __spark_entry__ as entry

    got = {r["check_id"] for r in entry.queries()["ix15_descriptive_catalog_rules"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {32, 34, 60, 61, 62, 63, 64, 65, 69, 70, 71, 73, 74, 92, 94, 99, 121, 122, 123, 124, 125}


def test_lock_edges_take_names_from_the_catalog(spark):
    from fleetscope.operators.deadlocks import label_by_partition

    edges = spark.createDataFrame([(1, 5, 10, "db.dbo.t"), (2, 5, 10, None), (3, 6, 10, None), (4, 5, 11, None)], "event_id int, db_id int, hobt_id long, object_name string")
    catalog = spark.createDataFrame([(5, 10, "dbo", "orders"), (6, 99, "dbo", "x")], "db_id int, partition_id long, schema_name string, table_name string")
    got = {r["event_id"]: r["object_name"] for r in label_by_partition(edges, catalog).collect()}
    assert got == {1: "db.dbo.t", 2: "dbo.orders", 3: None, 4: None}
