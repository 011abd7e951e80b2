"""Registered queries: rule-table checks on session snapshots (BLK-8) and
descriptive catalog findings (IX-15), both through the single-scan engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ix
from ..operators.rules import Rule, run_rules
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


# BLK-8 session rules (check id, priority, group, finding, predicate, details).
SESSION_RULES = [
    Rule(1, 1, "Maintenance Tasks Running", "Backup Running", "command LIKE 'BACKUP%'",
         "concat('session ', session_id, ' running ', command)", "wait_duration_ms"),
    Rule(2, 1, "Maintenance Tasks Running", "DBCC CHECK* Running", "command LIKE 'DBCC%'",
         "concat('session ', session_id, ' running ', command)", "wait_duration_ms"),
    Rule(3, 1, "Maintenance Tasks Running", "Restore Running", "command LIKE 'RESTORE%'",
         "concat('session ', session_id, ' running ', command)", "wait_duration_ms"),
    Rule(8, 50, "Query Problems", "Sleeping Query with Open Transactions", "status = 'sleeping' AND open_tran_count > 0",
         "concat('session ', session_id, ' has ', open_tran_count, ' open transactions')", "open_tran_count"),
    Rule(9, 1, "Query Problems", "Query Rolling Back", "command = 'KILLED/ROLLBACK'",
         "concat('session ', session_id, ' is rolling back')", "wait_duration_ms"),
    Rule(37, 50, "Query Problems", "Implicit Transactions", "implicit_transactions AND open_tran_count > 0",
         "concat('session ', session_id, ' uses implicit transactions')", "open_tran_count"),
    Rule(46, 100, "Query Problems", "Query with a memory grant exceeding 15%", "granted_memory_kb > 0.15 * max_workspace_kb",
         "concat('session ', session_id, ' holds ', granted_memory_kb, ' KB')", "granted_memory_kb"),
]
#: over one row of counts per server
GRANT_RULES = [Rule(39, 50, "Server Performance", "Memory Grants Pending", "pending > 0", "concat(pending, ' grants pending')", "pending")]

_CMD = ("CASE program_name WHEN '1-URGENT' THEN 'KILLED/ROLLBACK' WHEN '2-HIGH' THEN 'BACKUP DATABASE' "
        "WHEN '3-MEDIUM' THEN 'DBCC CHECKDB' WHEN '4-NOT SPECIFIED' THEN 'RESTORE DATABASE' ELSE 'SELECT' END")


_FINDING = ("SELECT server_name, database_name, CAST(NULL AS TIMESTAMP) AS check_ts, CAST({0} AS INTEGER) AS check_id, "
            "CAST({1} AS INTEGER) AS priority, '{2}' AS findings_group, '{3}' AS finding, CAST({5} AS VARCHAR) AS details, "
            "CAST({6} AS DOUBLE) AS value FROM {7} WHERE {4}")


def _findings(table: str, *rows) -> str:
    """(id, priority, group, finding, predicate, details, value) rows as SQL."""
    return "\nUNION ALL ".join(_FINDING.format(*r, table) for r in rows)


@reg("blk08_session_rules", ofx.with_(ofx.f2()) + f"""
, s AS (SELECT *, {_CMD} AS command, session_id % 11 = 0 AS implicit_transactions, (session_id % 100) * 1000 AS granted_memory_kb FROM f2),
pend AS (SELECT server_name, CAST(NULL AS VARCHAR) AS database_name, count(*) AS pending FROM f2 WHERE session_id % 101 = 0 GROUP BY server_name)
""" + _findings(
    "s",
    (1, 1, "Maintenance Tasks Running", "Backup Running", "starts_with(command, 'BACKUP')",
     "'session ' || session_id || ' running ' || command", "wait_duration_ms"),
    (2, 1, "Maintenance Tasks Running", "DBCC CHECK* Running", "starts_with(command, 'DBCC')",
     "'session ' || session_id || ' running ' || command", "wait_duration_ms"),
    (3, 1, "Maintenance Tasks Running", "Restore Running", "starts_with(command, 'RESTORE')",
     "'session ' || session_id || ' running ' || command", "wait_duration_ms"),
    (46, 100, "Query Problems", "Query with a memory grant exceeding 15%", "session_id % 100 > 90",
     "'session ' || session_id || ' holds ' || granted_memory_kb || ' KB'", "granted_memory_kb"),
    (8, 50, "Query Problems", "Sleeping Query with Open Transactions", "status = 'sleeping' AND open_tran_count >= 1",
     "'session ' || session_id || ' has ' || open_tran_count || ' open transactions'", "open_tran_count"),
    (9, 1, "Query Problems", "Query Rolling Back", "command = 'KILLED/ROLLBACK'", "'session ' || session_id || ' is rolling back'",
     "wait_duration_ms"),
    (37, 50, "Query Problems", "Implicit Transactions", "implicit_transactions AND open_tran_count >= 1",
     "'session ' || session_id || ' uses implicit transactions'", "open_tran_count")) + "\nUNION ALL " + _findings(
    "pend", (39, 50, "Server Performance", "Memory Grants Pending", "pending > 0", "pending || ' grants pending'", "pending")))
def q_blk08(spark, sf_dir):
    s = fx.f2_sessions(spark, sf_dir).select("*", F.expr(_CMD).alias("command"),
                                             (F.col("session_id") % 11 == 0).alias("implicit_transactions"),
                                             ((F.col("session_id") % 100) * 1000).alias("granted_memory_kb"), F.lit(600_000).alias("max_workspace_kb"))
    pending = s.groupBy("server_name").agg(F.count_if(F.col("session_id") % 101 == 0).alias("pending"))
    return run_rules(s, SESSION_RULES).unionByName(run_rules(pending, GRANT_RULES, database=None))


_KIND = ("CASE WHEN keys[1] = 'LARGE' THEN 'NC COLUMNSTORE' WHEN keys[1] = 'STANDARD' AND index_id % 6 = 0 THEN 'CLUSTERED COLUMNSTORE' "
         "WHEN keys[1] = 'SMALL' AND index_id % 3 = 0 THEN 'XML' WHEN keys[1] = 'PROMO' AND index_id % 5 = 1 THEN 'SPATIAL' "
         "WHEN keys[1] = 'ECONOMY' AND index_id % 7 = 2 THEN 'MEMORY' ELSE 'ROWSTORE' END")
ADP = "Abnormal Design Pattern"


@reg("ix15_descriptive_catalog_rules", ofx.with_(ofx.f5()) + f"""
, c AS (SELECT *, {_KIND} AS index_kind, CASE WHEN index_id % 17 = 0 OR (index_type < 2 AND table_name LIKE '%3') THEN 'month' END AS part_key FROM f5),
t AS (SELECT server_name, database_name, table_name, max(part_key) AS table_key FROM c WHERE index_type IN (0, 1) GROUP BY ALL),
i AS (SELECT c.*, table_key FROM c LEFT JOIN t USING (server_name, database_name, table_name)),
d AS (SELECT server_name, database_name FROM f5 GROUP BY ALL HAVING NOT bool_or(database_name = 'db1' AND index_id % 23 = 0) AND NOT bool_or(database_name = 'db2' AND index_id % 29 = 0)),
k AS (SELECT server_name, database_name, table_name, count(*) AS n, count(*) FILTER (index_id % 31 = 0) AS oc, count(*) FILTER (index_id % 37 = 0) AS re,
             count(*) FILTER (index_id % 41 < 2) AS oi, count(*) FILTER (index_id % 43 = 0) AS cf, count(*) FILTER (index_id % 47 = 0) AS chk FROM f5 GROUP BY ALL)
""" + _findings(
    "i",
    (34, 80, ADP, "Filter Columns Not In Index Definition", "index_id % 19 = 3", "'col' || index_id % 5", "NULL"),
    (124, 80, ADP, "History Table With NonClustered Index", "ends_with(table_name, '5') AND index_type = 2", "index_name", "NULL"),
    (60, 150, ADP, "XML Index", "index_kind = 'XML'", "index_name", "NULL"),
    (61, 150, ADP, "NC Columnstore Index", "index_kind = 'NC COLUMNSTORE'", "index_name", "NULL"),
    (61, 150, ADP, "Clustered Columnstore Index", "index_kind = 'CLUSTERED COLUMNSTORE'", "index_name", "NULL"),
    (62, 150, ADP, "Spatial Index", "index_kind = 'SPATIAL'", "index_name", "NULL"),
    (63, 150, ADP, "Compressed Index", "index_id % 13 < 2", "index_name", "NULL"),
    (64, 150, ADP, "Partitioned Index", "part_key = 'month'", "index_name || ' by month'", "NULL"),
    (65, 150, ADP, "Non-Aligned Index on a Partitioned Table", "part_key IS NULL AND table_key IS NOT NULL", "index_name", "NULL"),
    (73, 150, ADP, "In-Memory OLTP", "index_kind = 'MEMORY'", "index_name", "NULL"),
    (121, 200, "Specialized Indexes", "Optimized For Sequential Keys", "index_id % 19 = 0", "index_name", "NULL")) + "\nUNION ALL " + _findings(
    "d", (32, 250, "Omitted Index Features", "No Filtered Indexes or Indexed Views", "TRUE", "database_name", "NULL")) + "\nUNION ALL " + _findings(
    "k",
    (69, 150, ADP, "Column Collation Does Not Match Database Collation", "oc > 0",
     "table_name || ' has ' || oc || CASE WHEN oc > 1 THEN ' columns' ELSE ' column' END || ' with a different collation'", "oc"),
    (70, 200, ADP, "Replicated Columns", "re > 0", "table_name || ': ' || re || ' of ' || n || CASE WHEN n > 1 THEN ' columns' ELSE ' column' END || ' replicated'", "re"),
    (74, 200, ADP, "Identity Column Using a Negative Seed or Increment Other Than 1", "oi > 0", "table_name", "oi"),
    (99, 100, "Forced Serialization", "Computed Column with Scalar UDF", "cf > 0", "table_name", "cf"),
    (94, 100, "Forced Serialization", "Check Constraint with Scalar UDF", "chk > 0", "table_name", "chk")) + "\nUNION ALL " + _findings(
    "f5",
    (71, 150, ADP, "Cascading Updates or Deletes", "index_id % 53 < 2 OR index_id % 59 = 0",
     "index_name || CASE WHEN index_id % 53 < 2 THEN ' ON DELETE CASCADE' ELSE '' END || CASE WHEN index_id % 59 = 0 THEN ' ON UPDATE SET_NULL' ELSE '' END", "NULL"),
    (92, 90, "Statistics Warnings", "Statistics With NO RECOMPUTE", "index_id % 61 = 0", "index_name", "NULL"),
    (125, 90, "Statistics Warnings", "Persisted Sampling Rates (Unexpected)", "index_id % 10 NOT IN (0, 5)", "index_name", "(index_id % 10) * 10"),
    (122, 10, "Resumable Indexing", "Resumable Index Operation Paused", "index_id % 67 = 1", "index_name || ' at ' || index_id % 100 || '%'", "index_id % 100"),
    (123, 10, "Resumable Indexing", "Resumable Index Operation Running", "index_id % 67 = 0", "index_name || ' at ' || index_id % 100 || '%'", "index_id % 100")))
def q_ix15(spark, sf_dir):
    f = fx.f5_indexes(spark, sf_dir)
    k, lead = F.col("index_id"), F.element_at("keys", 1)
    kind = (F.when(lead == "LARGE", "NC COLUMNSTORE").when((lead == "STANDARD") & (k % 6 == 0), "CLUSTERED COLUMNSTORE")
            .when((lead == "SMALL") & (k % 3 == 0), "XML").when((lead == "PROMO") & (k % 5 == 1), "SPATIAL")
            .when((lead == "ECONOMY") & (k % 7 == 2), "MEMORY").otherwise("ROWSTORE"))
    db = F.col("database_name")
    indexes = f.select(
        "*", kind.alias("index_kind"), F.when((k % 17 == 0) | ((F.col("index_type") < 2) & F.col("table_name").endswith("3")), "month").alias("partition_key"),
        F.when(k % 19 == 3, F.concat(F.lit("col"), (k % 5).cast("string"))).alias("filter_columns_not_in_index"),
        F.col("table_name").endswith("5").alias("is_history_table"), (k % 19 == 0).alias("optimize_sequential_key"),
        F.when(k % 13 == 0, "PAGE").when(k % 13 == 1, "ROW, NONE").otherwise("NONE").alias("data_compression"),
        F.when((db == "db1") & (k % 23 == 0), "x > 1").otherwise("").alias("filter_definition"), ((db == "db2") & (k % 29 == 0)).alias("is_indexed_view"))
    columns = f.select(
        "server_name", "database_name", "table_name", F.when(k % 31 == 0, "Greek").otherwise("Latin").alias("collation_name"), F.lit("Latin").alias("database_collation"),
        (k % 37 == 0).alias("is_replicated"), F.when(k % 41 == 0, -5).otherwise(1).alias("seed_value"), F.when(k % 41 == 1, 2).otherwise(1).alias("increment_value"),
        (k % 43 == 0).alias("computed_by_function"), (k % 47 == 0).alias("checked_by_function"))
    fks = f.select("server_name", "database_name", F.col("index_name").alias("fk_name"), F.when(k % 53 < 2, "CASCADE").otherwise("NO_ACTION").alias("on_delete"),
                   F.when(k % 59 == 0, "SET_NULL").otherwise("NO_ACTION").alias("on_update"))
    stats = f.select("server_name", "database_name", F.col("index_name").alias("stats_name"), (k % 61 == 0).alias("no_recompute"),
                     ((k % 10) * 10).cast("double").alias("persisted_sample_percent"))
    resumable = f.select("server_name", "database_name", "index_name", F.when(k % 67 < 2, k % 67).otherwise(9).alias("state"), (k % 100).alias("percent_complete"))
    return ix.descriptive_findings(indexes, columns, fks, stats, resumable, usual_sampling=50.0)


@reg("ix12_heap_findings", ofx.with_(ofx.f5()) + """
, h AS (SELECT server_name, database_name, table_name, sum(forwarded_fetches) AS fw, sum(index_id % 90) AS del FROM f5 WHERE index_type = 0 GROUP BY ALL),
p AS (SELECT f5.* FROM f5 WHERE index_type = 2 AND is_primary_key AND EXISTS (
        SELECT 1 FROM f5 b WHERE b.index_type = 0 AND b.server_name = f5.server_name AND b.database_name = f5.database_name AND b.table_name = f5.table_name))
""" + _findings("h", (49, 200, "Indexes Worth Reviewing", "Heaps with Deletes", "del > 0 AND fw < 500", "CAST(del AS BIGINT) || ' deletes against heap: ' || table_name", "del"))
     + "\nUNION ALL " + _findings("p", (47, 100, "Indexes Worth Reviewing", "Heap with a Nonclustered Primary Key", "TRUE", "index_name || ' on heap ' || table_name", "NULL")))
def q_ix12(spark, sf_dir):
    f = fx.f5_indexes(spark, sf_dir).withColumn("leaf_deletes", F.col("index_id") % 90)
    return ix.heap_findings(f, uptime_days=0.5)
