"""Hand-made edge frames (no oracle): resets, gaps, missing keys, cycles."""

import datetime as dt

from pyspark.sql import functions as F

from fleetscope.operators import backups as bk
from fleetscope.operators import blocking as blk
from fleetscope.operators import snapshots as sd

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


SCHEMA = "server_name string, check_ts timestamp_ntz, metric string, cum_value long, cum_count long"


def deltas(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.metric, r.check_ts): r for r in sd.snapshot_delta(df, ["metric"], ["cum_value", "cum_count"], **kw)
            .collect()}


def test_counter_reset_dropped(spark):
    rows = [("s", ts(0), "w", 100, 10), ("s", ts(10), "w", 150, 12), ("s", ts(20), "w", 5, 1)]
    out = deltas(spark, rows)
    assert set(out) == {("w", ts(10))}
    assert out[("w", ts(10))].cum_value_delta == 50


def test_gap_boundaries(spark):
    # 0 and 61 minute gaps are dropped; 1 and 60 kept; minute boundaries, not elapsed
    rows = [("s", ts(0), "a", 1, 1), ("s", ts(0, 30), "a", 2, 1),          # same minute: gap 0
            ("s", ts(1, 1), "a", 3, 1),                                    # 00:00:30 -> 00:01:01 = 1 boundary
            ("s", ts(61, 1), "a", 4, 1),                                   # 60 boundaries
            ("s", ts(122, 0), "a", 5, 1)]                                  # 61 boundaries
    out = deltas(spark, rows)
    assert set(out) == {("a", ts(1, 1)), ("a", ts(61, 1))}
    assert out[("a", ts(1, 1))].elapsed_minutes == 1
    assert out[("a", ts(61, 1))].elapsed_minutes == 60


def test_key_missing_at_previous_snapshot(spark):
    rows = [("s", ts(0), "a", 1, 1), ("s", ts(0), "b", 1, 1),
            ("s", ts(10), "a", 2, 2),                       # b missing here
            ("s", ts(20), "a", 3, 3), ("s", ts(20), "b", 5, 5)]
    strict = deltas(spark, rows)
    loose = deltas(spark, rows, strict=False, max_minutes=None)
    assert ("b", ts(20)) not in strict
    assert loose[("b", ts(20))].cum_value_delta == 4


def test_single_snapshot_and_null_key(spark):
    rows = [("s", ts(0), None, 1, 1), ("s", ts(5), None, 3, 2), ("t", ts(0), "a", 1, 1)]
    out = deltas(spark, rows)
    assert list(out) == [(None, ts(5))]


def test_blocking_cycles(spark):
    rows = [("s", 1, 2), ("s", 2, 1),      # two-node cycle
            ("s", 3, 3),                   # self block
            ("s", 4, 0), ("s", 5, 4), ("s", 6, 5), ("s", 7, 99)]  # chain; 99 only appears as blocker
    df = spark.createDataFrame(rows, "server_name string, session_id long, blocking_session_id long")
    out = {r.session_id: r for r in blk.blocking_chains(df).collect()}
    assert out[1].is_cycle and out[2].is_cycle and out[3].is_cycle
    assert (out[6].root_blocker, out[6].chain_level) == (4, 2)
    assert (out[7].root_blocker, out[7].chain_level) == (99, 1)
    assert out[99].chain_level == 0 and not out[99].is_cycle


def test_zero_second_backup_counts_as_one_second(spark):
    rows = [("s", "d", "D", T0, T0, 1, 1048576 * 10, 1048576 * 5, "u", 0, 100)]
    df = spark.createDataFrame(rows, "server_name string, database_name string, type string, "
                                     "backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, "
                                     "backup_set_id long, backup_size long, compressed_backup_size long, "
                                     "user_name string, first_lsn long, last_lsn long")
    r = bk.throughput_by_type(df).collect()[0]
    assert r.full_mbps_avg == 10.0


def test_database_never_backed_up(spark):
    dbs = spark.createDataFrame([("s", "d1"), ("s", "d2")], "server_name string, database_name string")
    rows = [("s", "d1", "D", T0, T0, 1, 1, 1, "u", 0, 100, "SIMPLE")]
    b = spark.createDataFrame(rows, "server_name string, database_name string, type string, "
                                    "backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, "
                                    "backup_set_id long, backup_size long, compressed_backup_size long, "
                                    "user_name string, first_lsn long, last_lsn long, recovery_model string")
    out = {r.database_name: r.problem for r in bk.missing_backups(dbs, b, T0 + dt.timedelta(hours=1)).collect()}
    assert out == {"d2": "never backed up"}


def test_no_cartesian_in_core_plans(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    for name in ["sd01_snapshot_delta_restart", "bk03_recovery_points", "qs01_share_of_total", "blk01_blocked_with_blocker"]:
        plan = qs[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_bucketed_lag_crosses_day_boundary(spark):
    # 23:50 -> 00:10 is a 20-minute gap across the day bucket
    rows = [("s", dt.datetime(2024, 1, 1, 23, 50), "a", 10, 1), ("s", dt.datetime(2024, 1, 2, 0, 10), "a", 30, 2),
            ("s", dt.datetime(2024, 1, 5, 0, 10), "a", 50, 3)]        # after three empty days
    out = deltas(spark, rows, max_minutes=None)
    assert out[("a", dt.datetime(2024, 1, 2, 0, 10))].cum_value_delta == 20
    assert out[("a", dt.datetime(2024, 1, 5, 0, 10))].prev_ts == dt.datetime(2024, 1, 2, 0, 10)
    plain = deltas(spark, rows, max_minutes=None, bucket=None)
    assert {k: v.cum_value_delta for k, v in out.items()} == {k: v.cum_value_delta for k, v in plain.items()}


def test_rule_engine_single_scan(spark):
    from fleetscope.operators.rules import Rule, run_rules

    df = spark.createDataFrame([("s", "d", 5), ("s", "e", 50)], "server_name string, database_name string, v long")
    rules = [Rule(1, 10, "g", "big", "v > 10", "concat('v=', v)", "v"), Rule(2, 20, "g", "any", "v > 0")]
    out = sorted((r.database_name, r.check_id) for r in run_rules(df, rules).collect())
    assert out == [("d", 2), ("e", 1), ("e", 2)]
    plan = run_rules(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_skip_list_null_wildcards(spark):
    from fleetscope.operators.rules import apply_skip_list

    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "database_name string, check_id int")
    skips = spark.createDataFrame([("a", 1), (None, 3), ("b", None)], "database_name string, check_id int")
    assert sorted(tuple(r) for r in apply_skip_list(f, skips).collect()) == [("a", 2)]


def test_malformed_xml_and_json_are_tolerated(spark):
    from fleetscope.operators.deadlocks import processes
    from fleetscope.operators.documents import json_paths
    from fleetscope.sources.events import parse_deadlocks

    good = ('<deadlock><victim-list><victimProcess id="p1"/></victim-list><process-list>'
            '<process id="p1" spid="51" waittime="10"/><process id="p2" spid="52" waittime="20"/>'
            '</process-list><resource-list/></deadlock>')
    rows = [(1, T0, good), (2, T0, "<deadlock><process-list><process id="), (3, T0, "not xml at all")]
    df = spark.createDataFrame(rows, "event_id long, event_ts timestamp_ntz, event_xml string")
    got = sorted((r.event_id, r.process_id, r.is_victim) for r in processes(parse_deadlocks(df)).collect())
    assert got == [(1, "p1", True), (1, "p2", False)]
    j = spark.createDataFrame([('{"k": 5}',), ("{bad json",), (None,)], "props string")
    out = sorted((r.k is None, r.k) for r in json_paths(j, doc="props", paths={"k": ("$.k", "long")}).collect())
    assert out == [(False, 5), (True, None), (True, None)]


def test_time_window_is_pushed_into_the_scan(spark):
    from fleetscope.sources.tables import read_snapshots

    df = read_snapshots(spark, "/root/testdata/sf0.001/events.parquet", since=dt.datetime(2024, 1, 10),
                        until=dt.datetime(2024, 1, 17), ts="ts").select("ts", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_rule_engine_reads_the_fact_table_once(spark):
    import __spark_entry__ as entry

    # one scan of the facts, however many rules; rules over groups add one
    for name, scans in (("rl01_database_health", 1), ("rl01_server_health", 1), ("rl01_file_health", 2), ("rl01_agent_health", 2)):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == scans, name


def test_middle_tile_matches_ntile_for_any_range_size(spark):
    from pyspark.sql import Window

    from fleetscope.operators.relational import middle_tile_mean

    rows = [(k, float((i * 37) % 11), i) for k in range(1, 9) for i in range(k)]
    df = spark.createDataFrame(rows, "k long, v double, t long")
    w = Window.partitionBy("k").orderBy("v", "t")
    ref = df.withColumn("tile", F.ntile(3).over(w)).filter("tile = 2").groupBy("k").agg(
        F.round(F.avg("v"), 4).alias("m"), F.count("*").alias("c"))
    want = {(r.k, r.m, r.c) for r in ref.collect()}
    for n in (1, 2, 1000):
        got = {(r.k, r.middle_mean, r.middle_rows)
               for r in middle_tile_mean(df, keys=["k"], value="v", order_tie="t", ranges=n).collect()}
        assert got == want
