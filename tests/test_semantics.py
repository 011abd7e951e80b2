"""Small frames for semantics that the fixture tables hardly reach."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from fleetscope.operators import backups as bk
from fleetscope.operators import blocking as blk
from fleetscope.operators import catalog as ix
from fleetscope.operators import plandocs as pd
from fleetscope.operators import quality as dq
from fleetscope.operators import relational as rel
from fleetscope.operators import security as sec
from fleetscope.operators import vectors as vec
from fleetscope.operators.waits import is_benign, wait_category


def test_role_closure_deep_chain_and_cycle(spark):
    rows = [(f"r{i}", f"r{i + 1}") for i in range(200)] + [("a", "b"), ("b", "c"), ("c", "a"), (None, "a")]
    got = {(r["member"], r["role"]): r["depth"] for r in sec.role_closure(spark.createDataFrame(rows, "member string, role string")).collect()}
    assert len(got) == 200 * 201 // 2 + 9
    assert got["r0", "r200"] == 200 and got["a", "a"] == 3 and got["a", "b"] == 1


def test_top_k_blocks_ties_and_zero_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (100, 2):
        got = [tuple(r) for r in vec.top_k_search(v, v, k=2, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(0, 0, 0.0, 1), (0, 1, 0.0, 2), (1, 0, 0.0, 1), (1, 1, 0.0, 2), (2, 2, 0.0, 1), (2, 0, 1.0, 2),
                       (5, 0, 0.0, 1), (5, 1, 0.0, 2)]


def test_rank_keeps_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, 10 if i < 3 else 5) for i in range(6)], "id int, v int")
    got = rel.global_rank(df, metric="v", value="v", n=4).collect()
    assert sorted((r["id"], r["v_rank"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 4), (4, 4), (5, 4)]


def test_compare_sees_a_null_that_moves(spark):
    schema = "k int, a string, b string"
    left = spark.createDataFrame([(1, None, "x"), (2, "y", "z"), (None, "n", "n")], schema)
    right = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "q", None)], schema)
    got = {(r["k"], r["status"]) for r in dq.compare_tables(left, right, key=["k"]).collect()}
    assert got == {(1, "changed"), (None, "missing_in_right"), (3, "missing_in_left")}


def test_each_missing_index_group_is_a_request(spark):
    group = '<MissingIndexGroup Impact="{}"><MissingIndex Table="[{}]"><ColumnGroup Usage="EQUALITY"><Column Name="[{}]"/></ColumnGroup></MissingIndex></MissingIndexGroup>'
    xml = "<ShowPlanXML><MissingIndexes>" + group.format(30, "t1", "a") + group.format(50, "t2", "b") + "</MissingIndexes></ShowPlanXML>"
    got = pd.missing_index_suggestions(spark.createDataFrame([(1, xml)], "plan_id int, plan_xml string")).collect()
    assert sorted((r["table_name"], r["equality_columns"], r["max_impact"]) for r in got) == [("[t1]", "[a]", 30.0), ("[t2]", "[b]", 50.0)]


def test_parameters_are_read_as_units(spark):
    xml = ('<P><ParameterList><ColumnReference Column="@p1" ParameterRuntimeValue="(1)"/>'
           '<ColumnReference Column="@p2" ParameterCompiledValue="(2)" ParameterRuntimeValue="(2)"></ColumnReference>'
           '<ColumnReference Column="@p3" ParameterCompiledValue="(&gt;3)" ParameterRuntimeValue="(4)"/></ParameterList></P>')
    got = pd.parameter_mismatches(spark.createDataFrame([(1, xml)], "plan_id int, plan_xml string")).collect()
    assert [tuple(r) for r in got] == [(1, "@p3", "(>3)", "(4)")]


def test_identity_range(spark):
    rows = [("int", -2147483648, -5, 1), ("int", 1, 2147483640, 1), ("tinyint", 1, None, 250), ("smallint", -1, -32000, -1), ("bigint", 1, 5, 1)]
    df = spark.createDataFrame(rows, "type_name string, seed_value long, last_value long, increment_value long")
    got = {(r["type_name"], r["increment_value"]): r["pct_remaining"] for r in ix.key_exhaustion(df, max_remaining_pct=1000).collect()
           if r["seed_value"] != -2147483648}
    assert got == {("int", 1): 0.0, ("tinyint", 250): 1.6, ("smallint", -1): 2.3}
    assert [r["type_name"] for r in ix.key_exhaustion(df).collect()].count("int") == 1


def test_wide_identity_types_on_request(spark):
    rows = [("bigint", 1, 9_000_000_000_000_000_000, 1, 19), ("bigint", -1, -4_611_686_018_427_387_904, -1, 19), ("decimal", 1, 950, 1, 3),
            ("numeric", 1, 10, 1, 9), ("float", 1, 5, 1, 5)]
    df = spark.createDataFrame(rows, "type_name string, seed_value long, last_value long, increment_value long, precision int")
    got = {(r["type_name"], r["increment_value"]): r["pct_remaining"] for r in ix.key_exhaustion(df, max_remaining_pct=99, judge_wide=True).collect()}
    assert got == {("bigint", 1): 2.4, ("bigint", -1): 50.0, ("decimal", 1): 4.9}
    assert ix.key_exhaustion(df, max_remaining_pct=1000).collect() == []


def test_backups_in_one_second_share_their_predecessor(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "d", 1, t), ("s", "d", 2, t + dt.timedelta(hours=1)), ("s", "d", 3, t + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "server_name string, database_name string, backup_set_id long, backup_finish_date timestamp_ntz")
    got = bk.rpo_worst(df).orderBy("backup_set_id").collect()
    assert [(r["backup_set_id"], r["prior_backup_set_id"], r["gap_seconds"]) for r in got] == [(2, 1, 3600), (3, 1, 3600)]


def test_lead_blockers_need_a_lock_wait(spark):
    rows = [("s", 1, 0, 0, None), ("s", 2, 1, 50000, "LCK_M_X"), ("s", 3, 0, 0, None), ("s", 4, 3, 50000, "PAGELATCH_EX")]
    df = spark.createDataFrame(rows, "server_name string, session_id long, blocking_session_id long, wait_duration_ms long, wait_type string")
    assert [r["session_id"] for r in blk.lead_blockers(df).collect()] == [1]


def test_wait_categories(spark):
    df = spark.createDataFrame([("LCK_M_SCH_S",), ("RESOURCE_SEMAPHORE_QUERY_COMPILE",), ("WAITFOR",), ("ODD",), (None,)], "w string")
    got = df.select(wait_category(F.col("w")), is_benign(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [("Lock", False), ("Compilation", False), ("User Wait", True), ("Other", False), ("Other", False)]


@pytest.mark.parametrize(("category", "names"), [
    ("Full Text Search", "FT_RESTART_CRAWL FT_IFTSHC_MUTEX MSSEARCH PWAIT_RESOURCE_SEMAPHORE_FT_PARALLEL_QUERY_SYNC"),
    ("Idle", "SLEEP_DBSTARTUP SLEEP_TASK SQLTRACE_WAIT_ENTRIES SQLTRACE_BUFFER_FLUSH XE_TIMER_EVENT FT_IFTS_SCHEDULER_IDLE_WAIT LOGMGR_QUEUE SOS_WORK_DISPATCHER"),
    ("Replication", "HADR_SYNC_COMMIT PARALLEL_REDO_FLOW_CONTROL PWAIT_HADRSIM PWAIT_HADR_JOIN REPL_CACHE_ACCESS REPLICA_WRITES DPT_ENTRY_LOCK FCB_REPLICA_READ"),
    ("Transaction", "DTC DTCNEW_TM MSQL_XACT_MUTEX TRAN_MARKLATCH_EX TRANSACTION_MUTEX XACTLOCKINFO"), ("Tracing", "SQLTRACE_SHUTDOWN TRACEWRITE QUERY_TRACEOUT"),
    ("Tran Log IO", "CHKPT LOGMGR LOGMGR_FLUSH LOGBUFFER WRITELOG LOG_RATE_GOVERNOR"), ("Log Rate Governor", "HADR_THROTTLE_LOG_RATE_GOVERNOR"),
    ("Parallelism", "CXPACKET CXCONSUMER EXCHANGE"), ("Other", "DIRTY_PAGE_POLL QDS_SHUTDOWN_QUEUE CXSYNC_PORT"), ("Mirroring", "DBMIRROR_SEND DBMIRRORING_CMD"),
    ("User Wait", "BROKER_RECEIVE_WAITFOR WAITFOR WAIT_FOR_RESULTS"), ("Service Broker", "BROKER_TRANSMITTER BROKER_INIT"), ("SQL CLR", "CLR_CRST SQLCLR_ASSEMBLY")])
def test_waits_of_each_category(spark, category, names):
    df = spark.createDataFrame([(n,) for n in names.split()], "w string")
    assert {r[0] for r in df.select(wait_category(F.col("w"))).collect()} == {category}


def test_pivot_does_not_depend_on_row_order(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("b", "y", 2)], "k string, p string, v int")
    got = rel.dynamic_pivot(df, keys=["k"], pivot="p", value=F.max("v")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 3, None), ("b", None, 2)]


def test_plan_operators_know_where_they_stand(spark):
    """Two statements, prefixed names, flags of nested operators; broken and null documents have no facts."""
    from fleetscope.operators.plantree import plan_facts

    udf = '<p:UserDefinedFunction FunctionName="f"/>'
    computed = '<p:ComputeScalar><p:DefinedValues><p:DefinedValue><p:ColumnReference ComputedColumn="1"/></p:DefinedValue></p:DefinedValues></p:ComputeScalar>'
    xml = ('<p:ShowPlanXML xmlns:p="u"><p:StmtSimple StatementSubTreeCost="2"><p:RelOp PhysicalOp="A" LogicalOp="Inner Join">' + computed +
           '<p:RelOp PhysicalOp="B"><p:RelOp PhysicalOp="C" EstimateRows="2" EstimateRewinds="300"/></p:RelOp><p:RelOp PhysicalOp="D">' + udf +
           '</p:RelOp></p:RelOp></p:StmtSimple><p:StmtSimple StatementSubTreeCost="3"><p:RelOp PhysicalOp="E" LogicalOp="Table-valued function"/>'
           '</p:StmtSimple></p:ShowPlanXML>')
    df = spark.createDataFrame([(1, xml), (2, xml[:-9]), (3, None), (4, "<x/>")], "plan_id int, plan_xml string")
    facts = {r["plan_id"]: r["facts"] for r in plan_facts(df).collect()}
    assert [(o["op"], o["parent"], o["root"], o["function_below"]) for o in facts[1]["operators"]] == [
        ("A", None, 0, True), ("B", 0, 0, False), ("C", 1, 0, False), ("D", 0, 0, True), ("E", None, 4, False)]
    assert facts[2] is None and facts[3] is None and facts[4]["operators"] == []
    got = {r["plan_id"]: r for r in pd.plan_features(df).collect()}
    assert (got[1]["statement_cost"], got[1]["operator_count"]) == (5.0, 5.0)
    assert got[1]["computed_column_function"] and got[1]["busy_loops"]
    assert not got[1]["function_join"]      # the function stands in another statement than the join
    assert got[3]["statement_cost"] is None and got[4]["operator_count"] == 0.0
    plan = pd.plan_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "xpath" not in plan
