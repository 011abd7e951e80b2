"""Deadlock reports: what is shuffled holds no document text, each document is parsed once, for the fields in use."""

import datetime as dt

import pytest

from fleetscope.operators import deadlocks as dl
from fleetscope.plans import fixture_f6 as f6
from fleetscope.plans import q_deadlocks as qd
from fleetscope.plans import q_relational as qr
from fleetscope.plans.fixture_f6 import f6_events
from fleetscope.sources.events import parse_deadlocks

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("f6"))
    at = dt.datetime(1998, 3, 4)
    lines = [(k, k * 7 + j, j if k % 5 else None, j + 1, float(j + 1), 100.5, 0.0, 0.0, "RN"[j % 2], "O", at) for k in range(1, 13) for j in range(k % 7 + 1)]
    lines += [lines[-1], (12, None, 3, 9, None, 1.0, 0.0, 0.0, None, "O", None), (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", at)]
    spark.createDataFrame(lines, LINE).write.parquet(f"{d}/lineitem.parquet")
    orders = [(k, k * 3, at if k != 9 else None) for k in range(1, 13)] + [(4, 12, at), (8, 24, at + dt.timedelta(days=1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    return d


def test_documents_are_rendered_after_the_lines_are_gathered(spark, sf_dir):
    ev = f6_events(spark, sf_dir)
    gathered = [x for x in plan(ev).split("\n") if x.lstrip(" +-:").startswith(("Aggregate", "Window", "Sort"))]
    assert gathered and not any("executionStack" in x for x in gathered)
    got = {(r["event_id"], r["event_ts"]): r["event_xml"] for r in ev.collect()}
    assert {k for k, _ in got} == {1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12}      # 7 has one line
    assert len([k for k in got if k[0] == 8]) == 2                         # one document for each date of the order
    assert got[9, None] is None                                            # a wrapped event without a time has no document
    four = next(x for k, x in got.items() if k[0] == 4)
    assert four.count("<process ") == 10 and four.count("<victimProcess ") == 1 and 'id="process4_10"' in four


def test_a_document_is_parsed_once_for_the_fields_in_use(spark, sf_dir):
    queries = qd.QUERIES
    for name in ("dl09_lock_mode_breakdown", "dl11_wait_by_object", "dl12_special_participants", "dl06_deadlocks_by_object", "dl13_incident_report"):
        p = plan(queries[name](spark, sf_dir))
        assert p.count("from_xml") == 2, name           # one for each root of a document
    assert "_transactionname" not in plan(queries["dl08_login_app_host"](spark, sf_dir))
    whole = dl.processes(parse_deadlocks(f6_events(spark, sf_dir)))
    some = qd.procs(spark, sf_dir, "process_id", "is_victim", "wait_time_ms")
    assert some.columns == ["event_id", "event_ts", "process_id", "wait_time_ms", "is_victim"]
    want = whole.select(some.columns)
    # an amount that is no number (line 9 of order 12 has none) spoils the same documents for every report
    ends = qd.edges(spark, sf_dir, "object_name")
    assert ends.select("event_id").distinct().count() == dl.lock_edges(parse_deadlocks(f6_events(spark, sf_dir))).select("event_id").distinct().count()
    assert some.exceptAll(want).isEmpty() and want.exceptAll(some).isEmpty()


def test_parties_join_as_processes_and_edges(spark):
    def doc(key, procs, edges):
        ps = "".join(f'<process id="{i}" waittime="{w}" status="{s}" currentdbname="d" waitresource="{r}: 1"/>' for i, w, s, r in procs)
        rs = "".join(f'<keylock objectname="{o}"><owner-list>{"".join(f"<owner id={chr(34)}{x}{chr(34)}/>" for x in a)}</owner-list>'
                     f'<waiter-list>{"".join(f"<waiter id={chr(34)}{x}{chr(34)}/>" for x in b)}</waiter-list></keylock>' for o, a, b in edges)
        return key, None, f"<deadlock><process-list>{ps}</process-list><resource-list>{rs}</resource-list></deadlock>"

    docs = [doc(1, [("a", 5, "sleeping", "KEY"), ("b", 7, "background", "PAGE"), ("c", 9, "x", "KEY")], [("t", "a", "b"), ("t", "b", "a"), ("u", "a", "")]),
            doc(1, [("z", 1, "x", "RID")], [("t", "a", "z")]), doc(2, [("a", 11, "sleeping", "KEY")], [("t", "q", "aa")]),
            doc(None, [("a", 1, "sleeping", "KEY")], [("t", "a", "a")])]
    ev = spark.createDataFrame(docs, "event_id long, event_ts timestamp_ntz, event_xml string")
    columns = ["process_id", "status", "transaction_name", "wait_resource", "wait_time_ms", "database_name"]
    rows = dl.parties(parse_deadlocks(ev, schema=dl.document_schema(process=columns, resource=["object_name"])), columns)
    assert {tuple(r) for r in dl.process_objects(rows).select("event_id", "process_id", "object_name").collect()} == {
        (1, "a", "t"), (1, "b", "t"), (1, "z", "t"), (2, "a", "t")}
    assert [tuple(r) for r in dl.lock_type_breakdown(rows).collect()] == [("d", "t", "2 KEY, 1 PAGE, 1 RID")]
    assert [tuple(r)[:3] for r in dl.wait_by_object(rows).collect()] == [("t", 5 + 7 + 1 + 11, 2)]
    assert {(r["finding"], r["value"]) for r in dl.special_participants(rows).collect()} == {
        ("Total deadlocks involving sleeping sessions", 2.0), ("Total deadlocks involving background processes", 1.0)}


def test_written_documents_are_compressed(spark, sf_dir):
    got = qr.QUERIES["src02_xml_event_files"](spark, sf_dir)
    assert got.count() == dl.processes(parse_deadlocks(f6_events(spark, sf_dir))).count()
    assert got.inputFiles() and all(f.endswith(".gz") for f in got.inputFiles())


def exchanges(df):
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in p.split("\n") if "Exchange hashpartitioning" in x]


def test_lines_are_dealt_over_partitions_of_bounded_size(spark, sf_dir, monkeypatch):
    def rows(df):
        return sorted(map(repr, df.collect()))

    whole = {name: rows(qd.QUERIES[name](spark, sf_dir)) for name in ("dl07_isolation_levels", "dl04_denoised_edges")}
    monkeypatch.setattr(f6, "LINES_EACH", 2)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 2)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for build in (f6.f6_lines, f6.f6_keys):
        sides = [x for x in exchanges(build(spark, sf_dir)) if "REPARTITION_BY_NUM" in x]
        assert len(sides) == 2 and all(f", {n})" in x for x in sides)
    assert len(exchanges(f6.f6_lines(spark, sf_dir))) == 2                 # joined and gathered where they were dealt to
    assert {name: rows(qd.QUERIES[name](spark, sf_dir)) for name in whole} == whole


@pytest.mark.parametrize("name", ["dl11_wait_by_database", "dl08_login_app_host", "dl10_proc_counts", "dl06_deadlocks_by_database",
                                  "dl10_agent_job_counts", "dl06_deadlocks_by_object", "dl02_frames", "dl05_object_labels"])
def test_events_stay_where_their_lines_were_dealt_to(spark, sf_dir, monkeypatch, name):
    want = sorted(map(repr, qd.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(f6, "LINES_EACH", 2)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 2)
    df = qd.QUERIES[name](spark, sf_dir)
    moved = exchanges(df)
    lines, groups = ([x for x in moved if ("REPARTITION_BY_NUM" in x) == dealt] for dealt in (True, False))
    assert len(lines) == 2 and all(f", {n})" in x for x in lines)
    # distinct events are counted there too: only the counts of a report's groups are exchanged
    assert not any("event_id" in x for x in groups) and len(groups) == (name not in ("dl02_frames", "dl05_object_labels"))
    assert want and sorted(map(repr, df.collect())) == want


def test_edges_stay_where_they_are_for_a_small_catalog(spark):
    edges = spark.createDataFrame([(1, 1, 7, None), (2, 1, 8, None), (3, 1, 7, "a.b"), (4, None, 7, None)],
                                  "event_id long, db_id long, hobt_id long, object_name string")
    catalog = spark.createDataFrame([(1, 7, "dbo", "t7"), (2, 8, "dbo", "t8")], "db_id long, partition_id long, schema_name string, table_name string")
    want = {1: "dbo.t7", 2: None, 3: "a.b", 4: None}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = dl.label_by_partition(edges, catalog), dl.label_by_partition(edges, catalog, broadcast_rows=1)
        assert not exchanges(small) and len(exchanges(large)) == 2
        assert {r["event_id"]: r["object_name"] for r in small.collect()} == {r["event_id"]: r["object_name"] for r in large.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
