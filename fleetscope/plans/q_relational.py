"""Registered queries: generic relational operators, sources, sinks and the
rule-engine utilities (JN-*, AG-7, WN-2/4/8, PRJ-4/5, ST-5, SRC-1/2/5,
SNK-3/4, RL-2/3/4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import catalog as ix
from ..operators import deadlocks as dl
from ..operators import drift as dr
from ..operators import relational as rel
from ..operators import rules as rl
from ..sinks.history import render_lines, report_lines
from ..sources.events import DEADLOCK_SCHEMA, EVENT_SCHEMA, element_struct, read_events
from ..sources.tables import read_snapshots, union_sources
from ..session import scratch_path
from . import fixtures as fx
from . import oracle_fixtures as ofx
from .fixture_f6 import f6_documents
from .q_catalog import ix_findings_cte
from .q_deadlocks import F6 as F6_SQL
from .q_deadlocks import PROC_COLS
from .q_governance import F8_SQL, dr01_cte, f8_config
from .q_snapshots import _CAL, _DELTA_SELECT, _deltas

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@reg("jn02_unused_left_join", """
SELECT d.doc_id, source, CAST(coalesce(u.n, 0) AS BIGINT) AS uses
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) u ON d.doc_id = u.doc_id
WHERE u.n IS NULL OR u.n = 0""")
def q_jn02(spark, sf_dir):
    d = fx._t(spark, sf_dir, "documents").select("doc_id", "source")
    u = fx._t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = d.join(u, "doc_id", "left").filter(F.col("n").isNull() | (F.col("n") == 0))
    return j.select("doc_id", "source", F.coalesce("n", F.lit(0)).cast("long").alias("uses"))


@reg("jn03_hinted_hash_join", """
SELECT o_orderkey, c_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_jn03(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = fx._t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return rel.hinted_join(o, c, ["c_custkey"], strategy="shuffle_hash")


@reg("jn08_asof_latest_full_backup", ofx.with_(ofx.f3_backups()) + """
, l AS (SELECT 'db' || CAST(o_custkey % 50 AS VARCHAR) AS database_name, o_orderkey, o_orderdate FROM orders),
r AS (SELECT database_name, backup_finish_date, backup_set_id FROM f3 WHERE type = 'D')
SELECT l.database_name, o_orderkey, o_orderdate, r.backup_set_id, r.backup_finish_date
FROM l ASOF LEFT JOIN r ON l.database_name = r.database_name AND l.o_orderdate > r.backup_finish_date""")
def q_jn08(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders").select(
        F.concat(F.lit("db"), (F.col("o_custkey") % 50).cast("string")).alias("database_name"), "o_orderkey", "o_orderdate")
    fulls = fx.f3_backups(spark, sf_dir).filter(F.col("type") == "D").select(
        "database_name", "backup_finish_date", "backup_set_id")
    out = rel.asof_join(o, fulls, by=["database_name"], left_ts="o_orderdate", right_ts="backup_finish_date",
                        right_cols=["backup_set_id", "backup_finish_date"], strict=True)
    return out


SESSIONS_SQL = """WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
s AS (SELECT user_id, sid, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end FROM g GROUP BY ALL)
"""


@reg("jn09_range_join_sessions", SESSIONS_SQL + """
SELECT g.event_id, g.user_id, g.ts, s.session_start, s.session_end FROM g JOIN s USING (user_id, sid)""")
def q_jn09(spark, sf_dir):
    ev = fx._t(spark, sf_dir, "events")
    sess = ev.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    sess = sess.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                       F.col("w.end").cast("timestamp_ntz").alias("session_end"))
    return rel.range_join(ev.select("event_id", "user_id", "ts"), sess, by=["user_id"], point="ts",
                          start="session_start", end="session_end")


@reg("jn13_outer_apply_explode", ofx.with_(ofx.f5()) + """
SELECT index_id, unnest(CASE WHEN len(includes) = 0 THEN [NULL::VARCHAR] ELSE includes END) AS include_column FROM f5""")
def q_jn13(spark, sf_dir):
    return fx.f5_indexes(spark, sf_dir).select("index_id", F.explode_outer("includes").alias("include_column"))


@reg("ag07_dynamic_pivot", "WITH " + F8_SQL + """
SELECT server_name, max(CASE WHEN name = 'backup compression default' THEN value END) AS "backup compression default",
       max(CASE WHEN name = 'cost threshold for parallelism' THEN value END) AS "cost threshold for parallelism",
       max(CASE WHEN name = 'max degree of parallelism' THEN value END) AS "max degree of parallelism",
       max(CASE WHEN name = 'max server memory (MB)' THEN value END) AS "max server memory (MB)",
       max(CASE WHEN name = 'optimize for ad hoc workloads' THEN value END) AS "optimize for ad hoc workloads"
FROM f8 GROUP BY server_name""")
def q_ag07(spark, sf_dir):
    c = f8_config(spark, sf_dir)
    return rel.dynamic_pivot(c, keys=["server_name"], pivot="name", value=F.max("value"))


@reg("wn02_global_rank_topk", ofx.with_(ofx.f4_query_stats()) + """
, p AS (SELECT query_id, plan_id, CAST(sum(cpu) AS BIGINT) AS total_cpu FROM f4 GROUP BY ALL),
t AS (SELECT *, rank() OVER (ORDER BY total_cpu DESC) AS cpu_rank FROM p)
SELECT * FROM t WHERE cpu_rank <= 20""")
def q_wn02(spark, sf_dir):
    p = fx.f4_query_stats(spark, sf_dir).groupBy("query_id", "plan_id").agg(F.sum("cpu").cast("long").alias("total_cpu"))
    return rel.global_rank(p, metric="cpu", value="total_cpu", n=20)


@reg("wn04_ntile_middle_mean", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")") + """
, t AS (SELECT server_name, metric, cum_value_delta,
               ntile(3) OVER (PARTITION BY server_name, metric ORDER BY cum_value_delta, check_ts) AS tile FROM d)
SELECT server_name, metric, round(avg(cum_value_delta), 4) AS middle_mean, CAST(count(*) AS BIGINT) AS middle_rows
FROM t WHERE tile = 2 GROUP BY ALL""")
def q_wn04(spark, sf_dir):
    return rel.middle_tile_mean(_deltas(spark, sf_dir, "plain"), keys=["server_name", "metric"], value="cum_value_delta",
                                order_tie="check_ts")


@reg("wn08_first_last_seen", """
SELECT *, min(ts) OVER (PARTITION BY event_type) AS first_seen, max(ts) OVER (PARTITION BY event_type) AS last_seen
FROM events""")
def q_wn08(spark, sf_dir):
    return rel.first_last_seen(fx._t(spark, sf_dir, "events"), key="event_type", ts="ts")


@reg("prj04_optional_filters", ofx.with_(ofx.f2()) + """
SELECT * FROM f2 WHERE status = 'sleeping' AND database_name IN ('db1', 'db2')""")
def q_prj04(spark, sf_dir):
    return rel.optional_filters(fx.f2_sessions(spark, sf_dir),
                                {"status": "sleeping", "login_name": None, "database_name": ["db1", "db2"]})


@reg("prj05_exclude_benign", ofx.with_(ofx.f1("plain"), _CAL, "d AS (" + _DELTA_SELECT + ")") + """
SELECT * FROM d WHERE metric NOT IN ('view', 'signup')""")
def q_prj05(spark, sf_dir):
    return rel.exclude_values(_deltas(spark, sf_dir, "plain"), "metric", ["view", "signup"])


@reg("st05_distinct_databases", ofx.with_(ofx.f3_backups()) + "SELECT DISTINCT server_name, database_name FROM f3")
def q_st05(spark, sf_dir):
    return fx.f3_backups(spark, sf_dir).select("server_name", "database_name").distinct()


@reg("src01_read_snapshots_window", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'""")
def q_src01(spark, sf_dir):
    return read_snapshots(spark, f"{sf_dir}/events.parquet", since=dt.datetime(2024, 1, 10),
                          until=dt.datetime(2024, 1, 17), ts="ts")


@reg("src02_xml_event_files", F6_SQL + f"""
SELECT {PROC_COLS.replace('event_id, event_ts, ', 'CAST(NULL AS BIGINT) AS event_id, CASE WHEN event_id % 2 = 1 THEN event_ts END AS event_ts, ')} FROM f6""")
def q_src02(spark, sf_dir):
    root = scratch_path(spark, "src02")
    # event files are XML documents (a root element wrapping the rows): the rendered
    # documents are parsed and written back through the XML writer, wrapped events and
    # bare deadlocks (which carry no timestamp) in files of their own; compressed, as the text is
    # several times the size of its tables; lines are gathered and documents rendered once for both
    f6_documents(spark, sf_dir).select("event_xml", F.ltrim("event_xml").startswith("<deadlock").alias("bare")).write.option(
        "compression", "zstd").parquet(f"{root}/rendered")
    docs = spark.read.parquet(f"{root}/rendered")
    out = None
    for tag, schema in (("event", EVENT_SCHEMA), ("deadlock", DEADLOCK_SCHEMA)):
        part = docs.filter(F.col("bare") if tag == "deadlock" else ~F.col("bare"))
        part.select(element_struct(F.col("event_xml"), schema, tag).alias("e")).select("e.*").write.format("xml") \
            .option("rootTag", f"{tag}s").option("rowTag", tag).option("compression", "gzip").save(f"{root}/{tag}")
        got = dl.processes(read_events(spark, f"{root}/{tag}", row_tag=tag)).drop("frames")
        out = got if out is None else out.unionByName(got)
    return out


@reg("src05_union_sources", ofx.with_(ofx.f3_backups()) + """
SELECT server_name, database_name, backup_set_id, backup_size, NULL::BIGINT AS compressed_backup_size,
       NULL::BIGINT AS first_lsn, NULL::BIGINT AS last_lsn, 'full' AS source FROM f3 WHERE type = 'D'
UNION ALL SELECT server_name, database_name, backup_set_id, NULL, compressed_backup_size, NULL, NULL, 'diff'
FROM f3 WHERE type = 'I'
UNION ALL SELECT server_name, database_name, backup_set_id, NULL, NULL, first_lsn, last_lsn, 'log' FROM f3 WHERE type = 'L'""")
def q_src05(spark, sf_dir):
    b = fx.f3_backups(spark, sf_dir)
    k = ["server_name", "database_name", "backup_set_id"]
    return union_sources({
        "full": b.filter(F.col("type") == "D").select(*k, "backup_size"),
        "diff": b.filter(F.col("type") == "I").select(*k, "compressed_backup_size"),
        "log": b.filter(F.col("type") == "L").select(*k, "first_lsn", "last_lsn")}, tag="source")


SKIPS = [("db0", 22), (None, 41), ("db2", None)]


def _ix_findings(spark, sf_dir):
    return ix.index_findings(fx.f5_indexes(spark, sf_dir), as_of="2001-06-01 00:00:00", uptime_days=0.5)


@reg("rl02_skip_list", ix_findings_cte() + """
SELECT * FROM fnd WHERE NOT (database_name = 'db0' AND check_id = 22) AND check_id <> 41 AND database_name <> 'db2'""")
def q_rl02(spark, sf_dir):
    skips = spark.createDataFrame(SKIPS, "database_name string, check_id int")
    return rl.apply_skip_list(_ix_findings(spark, sf_dir), skips)


@reg("rl03_priority_summary", ix_findings_cte() + """
SELECT priority, findings_group, CAST(count(*) AS BIGINT) AS occurrences,
       CAST(count(DISTINCT finding) AS BIGINT) AS distinct_findings FROM fnd GROUP BY ALL""")
def q_rl03(spark, sf_dir):
    return rl.priority_summary(_ix_findings(spark, sf_dir))


@reg("rl04_filter_findings", ix_findings_cte() + """
SELECT * FROM fnd WHERE priority <= 150 AND findings_group NOT IN ('Indexes Worth Reviewing')""")
def q_rl04(spark, sf_dir):
    return rl.filter_findings(_ix_findings(spark, sf_dir), max_priority=150, exclude_groups=["Indexes Worth Reviewing"])


def _dr01(spark, sf_dir):
    c = f8_config(spark, sf_dir)
    return dr.config_drift(c, dr.config_defaults(spark))


@reg("snk03_markdown_report", dr01_cte() + """
, o AS (SELECT *, lag(priority) OVER w AS prev, row_number() OVER w AS line_no FROM fnd
        WINDOW w AS (PARTITION BY server_name ORDER BY priority, findings_group, finding, database_name, details))
SELECT server_name, line_no,
       CASE WHEN prev IS NULL OR prev <> priority THEN '## Priority ' || CAST(priority AS VARCHAR) || chr(10) ELSE '' END ||
       '- **' || findings_group || '** ' || finding ||
       CASE WHEN database_name IS NOT NULL THEN ' (' || database_name || ')' ELSE '' END ||
       CASE WHEN details IS NOT NULL THEN ': ' || details ELSE '' END AS markdown
FROM o""")
def q_snk03(spark, sf_dir):
    return report_lines(_dr01(spark, sf_dir))


@reg("snk04_render_csv", dr01_cte() + """
SELECT concat_ws(',', CASE WHEN server_name IS NULL THEN '' ELSE '"' || replace(server_name, '"', '""') || '"' END,
                      CASE WHEN check_id IS NULL THEN '' ELSE '"' || CAST(check_id AS VARCHAR) || '"' END,
                      CASE WHEN finding IS NULL THEN '' ELSE '"' || replace(finding, '"', '""') || '"' END,
                      CASE WHEN details IS NULL THEN '' ELSE '"' || replace(details, '"', '""') || '"' END) AS line
FROM fnd""")
def q_snk04(spark, sf_dir):
    return render_lines(_dr01(spark, sf_dir), "CSV", columns=["server_name", "check_id", "finding", "details"])


@reg("snk04_render_xml", dr01_cte() + """
SELECT '<row>' || CASE WHEN server_name IS NULL THEN '' ELSE '<server_name>' || server_name || '</server_name>' END
       || CASE WHEN finding IS NULL THEN '' ELSE '<finding>' || replace(replace(finding, '&', '&amp;'), '<', '&lt;') || '</finding>' END
       || CASE WHEN check_id IS NULL THEN '' ELSE '<check_id>' || CAST(check_id AS VARCHAR) || '</check_id>' END || '</row>' AS line
FROM fnd""")
def q_snk04x(spark, sf_dir):
    return render_lines(_dr01(spark, sf_dir), "XML", columns=["server_name", "finding", "check_id"])
