"""Registered queries: deadlock documents (SRC-3/4, DL-1 ... DL-13, JN-10/13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deadlocks as dl
from ..sources.events import parse_deadlocks
from . import fixtures as fx
from .fixture_f6 import f6_documents, f6_events, f6_keys

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


F6 = """WITH f6l AS (
  SELECT l.*, o_custkey, o_orderdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS i,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
f6 AS (
  SELECT l_orderkey AS event_id, o_orderdate + to_seconds(l_orderkey % 86400) AS event_ts, i, n,
         'process' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS process_id, i + 50 AS spid,
         CAST(l_quantity AS BIGINT) * 100 AS wait_time_ms,
         (['S', 'U', 'X', 'IX'])[l_partkey % 4 + 1] AS lock_mode,
         CASE WHEN i % 7 = 0 THEN 'background' WHEN i % 5 = 0 THEN 'sleeping' ELSE 'suspended' END AS status,
         CASE WHEN l_partkey % 8 = 0 THEN 'SQLAgent - TSQL JobStep (Job 0x' || hex(l_suppkey) || ' : Step ' || CAST(i AS VARCHAR) || ')'
              ELSE 'app' || CAST(l_suppkey % 5 AS VARCHAR) END AS client_app,
         'host' || CAST(l_suppkey % 7 AS VARCHAR) AS host_name,
         'login' || CAST(o_custkey % 25 AS VARCHAR) AS login_name,
         (['read committed (2)', 'serializable (4)', 'repeatable read (3)'])[l_linenumber % 3 + 1] AS isolation_level,
         'db' || CAST(o_custkey % 50 AS VARCHAR) AS database_name,
         CAST(floor(l_extendedprice) AS BIGINT) AS log_used,
         CASE WHEN l_partkey % 9 = 0 THEN 'implicit_transaction' ELSE 'user_transaction' END AS transaction_name,
         CASE WHEN l_returnflag = 'R' THEN 'SELECT * FROM tbl' || CAST(l_suppkey % 10 AS VARCHAR)
              ELSE 'UPDATE tbl' || CAST(l_suppkey % 10 AS VARCHAR) || ' SET x = 1' END AS input_buffer,
         CASE WHEN l_partkey % 10 = 3 THEN 'adhoc'
              ELSE 'db' || CAST(o_custkey % 50 AS VARCHAR) || '.dbo.usp_proc' || CAST(l_partkey % 20 AS VARCHAR) END AS proc_name,
         (['KEY', 'PAGE', 'OBJECT', 'RID', 'ROWGROUP', 'APPLICATION'])[i % 6 + 1] || ': ' || CAST(o_custkey % 50 AS VARCHAR) || ':'
           || CAST(l_partkey AS VARCHAR) AS wait_resource,
         i % 3 - 1 AS priority, i % 4 AS transaction_count, o_orderdate + to_seconds(l_orderkey % 86400) AS last_batch_started,
         o_orderdate + to_seconds(l_orderkey % 86400) AS last_batch_completed, (i + 50) * 2 AS client_option_1,
         (i + 50) * 3 AS client_option_2,
         CAST(l_linenumber AS BIGINT) AS proc_line, i = n AS is_victim,
         (['keylock', 'pagelock', 'objectlock', 'ridlock', 'rowgrouplock', 'exchangeEvent'])[i % 6 + 1] AS lock_kind,
         'db' || CAST(o_custkey % 50 AS VARCHAR) || '.dbo.tbl' || CAST(l_suppkey % 10 AS VARCHAR) AS object_name,
         CASE WHEN i % 6 = 3 THEN NULL ELSE 'ix_' || CAST(l_partkey % 5 AS VARCHAR) END AS index_name,
         o_custkey % 50 AS db_id,
         'process' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(i % n + 1 AS VARCHAR) AS waiter_id
  FROM f6l WHERE n >= 2),
edges AS (SELECT event_id, event_ts, lock_kind, object_name, index_name, db_id, lock_mode AS resource_mode,
                 process_id AS owner_id, lock_mode AS owner_mode, waiter_id, 'U' AS waiter_mode FROM f6),
po AS (SELECT DISTINCT event_id, process_id, object_name, wait_resource, wait_time_ms, database_name FROM (
         SELECT f6.event_id, f6.process_id, e.object_name, f6.wait_resource, f6.wait_time_ms, f6.database_name
         FROM f6 JOIN edges e ON f6.event_id = e.event_id AND f6.process_id = e.owner_id
         UNION ALL
         SELECT f6.event_id, f6.process_id, e.object_name, f6.wait_resource, f6.wait_time_ms, f6.database_name
         FROM f6 JOIN edges e ON f6.event_id = e.event_id AND f6.process_id = e.waiter_id))
"""

PROC_COLS = ("event_id, event_ts, process_id, spid, wait_time_ms, lock_mode, status, client_app, host_name, login_name, "
             "isolation_level, database_name, log_used, transaction_name, input_buffer, wait_resource, priority, transaction_count, "
             "last_batch_started, last_batch_completed, client_option_1, client_option_2, is_victim")


def parsed(spark, sf_dir, **columns):
    """Events parsed from their XML documents (SRC-3/4), inside the query, for the columns in use."""
    return parse_deadlocks(f6_events(spark, sf_dir), schema=dl.document_schema(**columns))


def procs(spark, sf_dir, *columns):
    return dl.processes(parsed(spark, sf_dir, process=columns), columns)


def edges(spark, sf_dir, *columns):
    return dl.lock_edges(parsed(spark, sf_dir, resource=columns or list(dl.RESOURCE_FIELDS)))


def parties(spark, sf_dir, *columns):
    """Processes and edges from one parse."""
    columns = ["process_id", *columns]
    return dl.parties(parsed(spark, sf_dir, process=columns, resource=["object_name"]), columns)


@reg("dl01_processes", F6 + f"SELECT {PROC_COLS} FROM f6")
def q_dl01(spark, sf_dir):
    # DL-1 itself shreds straight from the XML documents
    return procs(spark, sf_dir, *[c for c in dl.PROCESS_FIELDS if c != "frames"])


@reg("dl02_frames", F6 + """
SELECT event_id, event_ts, process_id, database_name, CAST(1 AS BIGINT) AS frame_no, proc_name, proc_line AS line FROM f6
UNION ALL
SELECT event_id, event_ts, process_id, database_name, 2, 'unknown', 1 FROM f6""")
def q_dl02(spark, sf_dir):
    return dl.frames(procs(spark, sf_dir, "process_id", "database_name", "frames"))


@reg("dl03_lock_edges", F6 + "SELECT * FROM edges")
def q_dl03(spark, sf_dir):
    return edges(spark, sf_dir)


@reg("dl04_denoised_edges", F6 + """
SELECT * FROM edges WHERE owner_id <> waiter_id
QUALIFY row_number() OVER (PARTITION BY event_id, object_name, owner_id, waiter_id
                           ORDER BY lock_kind, owner_mode, waiter_mode) = 1""")
def q_dl04(spark, sf_dir):
    return dl.denoise_edges(edges(spark, sf_dir))


_LABEL = """SELECT *, split_part(object_name, '.', 1) AS object_database, split_part(object_name, '.', 2) AS object_schema,
       string_split(object_name, '.')[-1] AS object_table,
       CASE WHEN lock_kind = 'ridlock' OR index_name IS NULL THEN 'HEAP' ELSE index_name END AS index_label FROM edges"""


@reg("dl05_object_labels", F6 + _LABEL)
def q_dl05(spark, sf_dir):
    # no row of an edge is gathered again, so documents are rendered and read in Arrow batches
    schema = dl.document_schema(resource=list(dl.RESOURCE_FIELDS))
    return dl.label_objects(dl.lock_edges(parse_deadlocks(f6_documents(spark, sf_dir), schema=schema, batches=True)))


@reg("dl05_objects_by_partition_id", F6 + """
, e AS (SELECT *, event_id % 1000 AS hobt_id, event_id % 3 = 0 AS unnamed FROM edges)
SELECT event_id, event_ts, lock_kind, index_name, db_id, resource_mode, owner_id, owner_mode, waiter_id, waiter_mode, hobt_id,
       CASE WHEN NOT unnamed THEN object_name WHEN hobt_id < 900 AND (db_id + hobt_id) % 2 = 0 THEN 'dbo.tbl' || hobt_id END AS object_name FROM e""")
def q_dl05p(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("hobt_id", F.col("event_id") % 1000).withColumn(
        "object_name", F.when(F.col("event_id") % 3 != 0, F.col("object_name")))
    # the catalog of the databases that occur: a partition id of each database stands for a table, some ids are unknown
    ids = fx._t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 900).alias("partition_id")).distinct()
    catalog = ids.withColumn("db_id", F.explode(F.sequence(F.lit(0), F.lit(60)))).filter((F.col("db_id") + F.col("partition_id")) % 2 == 0).select(
        "db_id", "partition_id", F.lit("dbo").alias("schema_name"), F.concat(F.lit("tbl"), F.col("partition_id").cast("string")).alias("table_name"))
    return dl.label_by_partition(e, catalog)


@reg("dl06_deadlocks_by_database", F6 + """
SELECT database_name, CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM f6 GROUP BY ALL""")
def q_dl06a(spark, sf_dir):
    return dl.totals_by_database(procs(spark, sf_dir, "database_name"))


@reg("dl06_select_deadlocks_by_database", F6 + """
SELECT split_part(object_name, '.', 1) AS database_name, CAST(count(DISTINCT event_id) AS BIGINT) AS select_deadlocks FROM edges
WHERE resource_mode IN ('S', 'IS') OR owner_mode IN ('S', 'IS') GROUP BY ALL""")
def q_dl06b(spark, sf_dir):
    return dl.selects_by_database(edges(spark, sf_dir, "object_name", "index_name", "resource_mode"))


@reg("dl06_deadlocks_by_object", F6 + ", lab AS (" + _LABEL + """)
SELECT object_name, index_label, CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM lab GROUP BY ALL""")
def q_dl06c(spark, sf_dir):
    return dl.totals_by_object(edges(spark, sf_dir, "object_name", "index_name"))


@reg("dl07_isolation_levels", F6 + """
SELECT database_name, CASE WHEN starts_with(isolation_level, 'serializable') THEN 4 ELSE 5 END AS check_id,
       CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks
FROM f6 WHERE starts_with(isolation_level, 'serializable') OR starts_with(isolation_level, 'repeatable read') GROUP BY ALL""")
def q_dl07(spark, sf_dir):
    return dl.by_isolation_level(procs(spark, sf_dir, "database_name", "isolation_level"))


@reg("dl08_login_app_host", F6 + """
SELECT database_name, login_name, client_app, host_name, CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks
FROM f6 GROUP BY ALL""")
def q_dl08(spark, sf_dir):
    return dl.by_login_app_host(procs(spark, sf_dir, "database_name", "login_name", "client_app", "host_name"))


@reg("dl09_lock_mode_breakdown", F6 + """
, g AS (SELECT database_name, object_name, split_part(wait_resource, ':', 1) AS kind, CAST(count(DISTINCT event_id) AS BIGINT) AS n
        FROM po GROUP BY ALL)
SELECT database_name, object_name, string_agg(CAST(n AS VARCHAR) || ' ' || kind, ', ' ORDER BY kind, n) AS lock_types
FROM g GROUP BY database_name, object_name""")
def q_dl09(spark, sf_dir):
    return dl.lock_type_breakdown(parties(spark, sf_dir, "wait_resource", "wait_time_ms", "database_name"))


@reg("dl10_proc_counts", F6 + """
, fr AS (SELECT event_id, database_name, proc_name FROM f6 UNION ALL SELECT event_id, database_name, 'unknown' FROM f6)
SELECT database_name, proc_name, CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM fr
WHERE proc_name <> 'adhoc' GROUP BY ALL""")
def q_dl10(spark, sf_dir):
    return dl.proc_counts(dl.frames(procs(spark, sf_dir, "process_id", "database_name", "frames")))


@reg("dl10_agent_job_counts", F6 + """
, j AS (SELECT event_id, regexp_extract(client_app, 'SQLAgent - TSQL JobStep \\(Job (0x[0-9A-Fa-f]+) : Step (\\d+)\\)', 1) AS job_id,
               CAST(regexp_extract(client_app, 'SQLAgent - TSQL JobStep \\(Job (0x[0-9A-Fa-f]+) : Step (\\d+)\\)', 2) AS BIGINT) AS step_id
        FROM f6 WHERE starts_with(client_app, 'SQLAgent'))
SELECT job_id, step_id, CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM j WHERE job_id <> '' GROUP BY ALL""")
def q_dl10b(spark, sf_dir):
    return dl.agent_job_counts(procs(spark, sf_dir, "client_app"))


@reg("dl11_wait_by_object", F6 + """
, j AS (SELECT DISTINCT e.event_id, e.waiter_id, e.object_name, f6.wait_time_ms
        FROM edges e JOIN f6 ON f6.event_id = e.event_id AND f6.process_id = e.waiter_id),
g AS (SELECT object_name, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_ms,
             CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM j GROUP BY ALL)
SELECT *, printf('%dd %02d:%02d:%02d', total_wait_ms // 1000 // 86400, (total_wait_ms // 1000 % 86400) // 3600,
                 (total_wait_ms // 1000 % 3600) // 60, total_wait_ms // 1000 % 60) AS total_wait FROM g""")
def q_dl11(spark, sf_dir):
    return dl.wait_by_object(parties(spark, sf_dir, "wait_time_ms"))


@reg("dl11_wait_by_database", F6 + """
, g AS (SELECT database_name, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_ms,
               CAST(count(DISTINCT event_id) AS BIGINT) AS deadlocks FROM f6 GROUP BY ALL)
SELECT *, printf('%dd %02d:%02d:%02d', total_wait_ms // 1000 // 86400, (total_wait_ms // 1000 % 86400) // 3600,
                 (total_wait_ms // 1000 % 3600) // 60, total_wait_ms // 1000 % 60) AS total_wait FROM g""")
def q_dl11b(spark, sf_dir):
    return dl.wait_by_database(procs(spark, sf_dir, "database_name", "wait_time_ms"))


@reg("dl12_special_participants", F6 + """
, u AS (SELECT 14 AS check_id, 'Total parallel deadlocks' AS finding, count(DISTINCT event_id) AS n FROM edges WHERE lock_kind = 'exchangeEvent'
        UNION ALL SELECT 15, 'Total deadlocks involving sleeping sessions', count(DISTINCT event_id) FROM f6 WHERE status = 'sleeping'
        UNION ALL SELECT 15, 'Total deadlocks involving background processes', count(DISTINCT event_id) FROM f6 WHERE status = 'background'
        UNION ALL SELECT 14, 'Total implicit transaction deadlocks', count(DISTINCT event_id) FROM f6
                  WHERE transaction_name = 'implicit_transaction')
SELECT CAST(NULL AS VARCHAR) AS server_name, CAST(NULL AS VARCHAR) AS database_name, CAST(NULL AS TIMESTAMP) AS check_ts,
       CAST(check_id AS INTEGER) AS check_id, CAST(100 AS INTEGER) AS priority, 'Deadlocks' AS findings_group, finding,
       CAST(n AS VARCHAR) || ' deadlocks' AS details, CAST(n AS DOUBLE) AS value FROM u WHERE n > 0""")
def q_dl12(spark, sf_dir):
    return dl.special_participants(parties(spark, sf_dir, "status", "transaction_name"))


@reg("dl13_incident_report", F6 + """
, inc AS (SELECT event_id, event_ts, dense_rank() OVER (ORDER BY event_ts, event_id) AS incident
          FROM (SELECT DISTINCT event_id, event_ts FROM f6))
SELECT f6.event_id, f6.event_ts, process_id, database_name, login_name, is_victim,
       row_number() OVER (PARTITION BY f6.event_id ORDER BY is_victim DESC, process_id) AS participant, inc.incident
FROM f6 JOIN inc ON f6.event_id = inc.event_id""")
def q_dl13(spark, sf_dir):
    return dl.incident_report(procs(spark, sf_dir, "process_id", "database_name", "login_name", "is_victim"), events=f6_keys(spark, sf_dir))
