"""Plain documents are read column by column and mean what ``from_xml`` makes of them; the others are left to it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import deadlocks as dl
from fleetscope.plans import q_deadlocks as qd
from fleetscope.plans.fixture_f6 import f6_documents, f6_events
from fleetscope.sources.events import DEADLOCK_PATHS, DEADLOCK_SCHEMA, deadlock_struct, parse_deadlocks
from fleetscope.sources.plainxml import read_plain


def ps(x):
    return f"<deadlock><process-list>{x}</process-list></deadlock>"


PLAIN = [
    "<deadlock/>", "<deadlock></deadlock>", ps('<process id="a" spid="007" waittime="-4" priority="0"/>'),
    ps('\n  <process id = "a"\tstatus=" x " logused=" 5 ">\n<inputbuf>\n  say x \n</inputbuf>\n</process >\n'),
    ps('<process id="a"><executionStack><frame procname="p" line="3"/><frame procname="q" line="1">select 1</frame></executionStack></process>'),
    '<event name="n" timestamp="t"><data name="d"><value>' + ps('<process id="q" other="1"><foo><process id="z"/></foo></process>') + "</value></data></event>",
    '<event name="n"><data name="d"><value><text>t</text></value></data></event>',
    '<deadlock><resource-list><keylock objectname="a.b.c" dbid="1"><owner-list><owner id="1"/><owner id="2" mode="X"/></owner-list><waiter-list/></keylock>'
    '<hobtlock><owner-list><owner id="9"/></owner-list></hobtlock><keylock/><ridlock mode="S"/></resource-list></deadlock>']
LEFT = [
    None, "", "x", "<deadlock>", ps('<process id="a" spid="x"/>'), ps('<process id="a" spid=""/>'), ps('<process id="a" waittime="99999999999999999999"/>'),
    ps('<process id="a" id="b"/>'), ps('<process ID="a"/>'), ps('<Process id="a"/>'), ps('<process id="a&lt;b"/>'), ps("<process id='a'/>"),
    ps('<process id="a"><inputbuf/></process>'), ps('<process id="a"><inputbuf>x<b/>y</inputbuf></process>'), ps('<process id="a"><!-- c --></process>'),
    ps('<process id="a"><inputbuf><![CDATA[x < y]]></inputbuf></process>'), '<?xml version="1.0"?>' + ps('<process id="a"/>'), ps('<process id="a"/>') + "tail",
    ps('<process id="a"></b>'), ps('<process id="a"/>').replace("</process-list>", ""), ps('<process id="a"/>').replace("deadlock>", "deadlocks>"),
    "<deadlock><process-list/><process-list/></deadlock>", ps('<process id="a\nb"/>'), ps('<process id="a"spid="4"/>'), ps('text<process id="a"/>'),
    ps('<process id="a"><inputbuf>say "x"</inputbuf></process>')]


@pytest.mark.parametrize("schema", [DEADLOCK_SCHEMA, dl.document_schema(resource=list(dl.RESOURCE_FIELDS)), dl.document_schema(process=["process_id", "is_victim"])],
                         ids=["whole", "resources", "processes"])
def test_plain_documents_mean_what_the_parser_makes_of_them(spark, schema):
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate(PLAIN + LEFT)], "event_id long, event_ts timestamp_ntz, event_xml string").coalesce(1)
    read = read_plain(F.col("event_xml"), schema, DEADLOCK_PATHS)
    got = df.select("event_id", read.alias("r")).select("event_id", "r.read", F.col("r.left").alias("left"), "r.found").collect()
    assert {r["event_id"] for r in got if r["read"]} >= set(range(len(PLAIN)))
    assert all(r["left"] is None if r["read"] else r["left"] == (PLAIN + LEFT)[r["event_id"]] for r in got)
    want = df.select("event_id", deadlock_struct(F.col("event_xml"), schema).alias("deadlock"))
    parsed = parse_deadlocks(df, schema=schema, batches=True).select("event_id", "deadlock")
    assert sorted(map(repr, parsed.collect())) == sorted(map(repr, want.collect()))


def test_deadlock_reports_read_their_documents_plainly(spark, tmp_path):
    at = dt.datetime(1998, 3, 4)
    lines = [(k, k * 7 + j if k % 4 else None, j if k % 5 else None, j + 1, float(j + 1), 100.5, 0.0, 0.0, "RN"[j % 2] if k % 3 else None, "O", at)
             for k in range(1, 9) for j in range(2 + k % 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k * 3 if k != 6 else None, at) for k in range(1, 9)] + [(3, 9, at + dt.timedelta(days=1)), (2, 7, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    ev = f6_documents(spark, str(tmp_path))
    assert sorted(map(repr, ev.collect())) == sorted(map(repr, f6_events(spark, str(tmp_path)).collect()))
    assert ev.select(read_plain(F.col("event_xml"), DEADLOCK_SCHEMA, DEADLOCK_PATHS)["read"].alias("r")).distinct().collect() == [(True,)]
    df = qd.QUERIES["dl05_object_labels"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # documents are rendered and read in one pass over Arrow batches; only what is left of them comes to the parser
    assert plan.count("ArrowEvalPython") == 1 and plan.count("render(") == 1 and "executionStack>" not in plan
    want = dl.label_objects(qd.edges(spark, str(tmp_path)))
    assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect())) and not want.isEmpty()


PROCESS = ["process_id", "spid", "wait_time_ms", "is_victim"]


@pytest.mark.parametrize("name, module", [("src02_xml_event_files", "q_relational"), ("str04_deadlock_stream_dedup", "q_streaming")])
def test_documents_of_files_and_streams_are_rendered_once_and_read_plainly(spark, tmp_path, monkeypatch, name, module):
    import importlib

    from fleetscope.sources import events

    at = dt.datetime(1998, 3, 4)
    lines = [(k, k * 7 + j, j, j + 1, float(j + 1), 100.5, 0.0, 0.0, "R", "O", at) for k in range(1, 9) for j in range(2 + k % 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k * 3, at + dt.timedelta(days=200 * k)) for k in range(1, 9)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(
        f"{tmp_path}/orders.parquet")
    plans = importlib.import_module(f"fleetscope.plans.{module}")
    calls = {"documents": 0, "read": 0}

    def spy(key, f):
        def g(*args, **kw):
            calls[key] += 1
            return f(*args, **kw)
        return g

    monkeypatch.setattr(plans, "f6_documents", spy("documents", plans.f6_documents))
    monkeypatch.setattr(events, "read_plain", spy("read", events.read_plain))
    got = plans.QUERIES[name](spark, str(tmp_path)).select(PROCESS)
    want = dl.processes(parse_deadlocks(f6_events(spark, str(tmp_path)))).select(PROCESS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == len(lines)
    assert calls == {"documents": 1, "read": 2 if name.startswith("src02") else 1}
