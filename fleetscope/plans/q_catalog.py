"""Registered queries: index / catalog analytics (IX-*, QS-16, RL-1) on F5."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import catalog as ix
from . import fixtures as fx
from . import fixtures_more as fm
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


F5 = ofx.with_(ofx.f5())
FIND = ("CAST(NULL AS TIMESTAMP) AS check_ts, CAST({cid} AS INTEGER) AS check_id, CAST({pr} AS INTEGER) AS priority, "
        "'{grp}' AS findings_group, '{fnd}' AS finding")

PART_USE = """pu AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
                   CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(qty, 0) AS BIGINT) AS qty
            FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT)) AS qty
                                 FROM lineitem GROUP BY l_partkey) u ON p_partkey = l_partkey)"""


def _f(cid, pr, grp, fnd):
    return FIND.format(cid=cid, pr=pr, grp=grp, fnd=fnd)


@reg("ix01_exact_duplicates", F5 + """
, d AS (SELECT server_name, database_name, table_name, keys, CAST(count(*) AS BIGINT) AS duplicate_count
        FROM f5 WHERE index_type IN (1, 2) AND NOT is_hypothetical AND NOT is_disabled AND NOT is_primary_key
        GROUP BY ALL HAVING count(*) > 1)
SELECT f5.server_name, f5.database_name, f5.table_name, index_id, index_name, f5.keys, duplicate_count
FROM f5 JOIN d ON f5.server_name = d.server_name AND f5.database_name = d.database_name
     AND f5.table_name = d.table_name AND f5.keys = d.keys
WHERE index_type IN (1, 2) AND NOT is_hypothetical AND NOT is_disabled AND NOT is_primary_key""")
def q_ix01(spark, sf_dir):
    return ix.exact_duplicates(fx.f5_indexes(spark, sf_dir))


@reg("ix02_approximate_duplicates", F5 + """
, c AS (SELECT server_name, database_name, table_name, index_id, index_name, keys, keys[1] AS leading_key,
               count(*) OVER (PARTITION BY server_name, database_name, table_name, keys[1]) AS siblings,
               count(*) OVER (PARTITION BY server_name, database_name, table_name, keys) AS same_keys FROM f5
      WHERE index_type IN (1, 2) AND NOT is_hypothetical AND NOT is_disabled AND NOT is_primary_key)
SELECT * FROM c WHERE siblings > 1 AND siblings > same_keys""")
def q_ix02(spark, sf_dir):
    return ix.approximate_duplicates(fx.f5_indexes(spark, sf_dir))


@reg("ix02_prefix_duplicates", F5 + """
, c AS (SELECT server_name, database_name, table_name, index_id, index_name, keys[1:1 + (index_id // 3) % 3] AS keys FROM f5
        WHERE index_type IN (1, 2) AND NOT is_hypothetical AND NOT is_disabled AND NOT is_primary_key)
SELECT a.*, b.index_id AS wider_index_id, b.index_name AS wider_index_name, b.keys AS wider_keys,
       count(*) OVER (PARTITION BY a.index_id) AS held_by
FROM c a JOIN c b ON a.server_name = b.server_name AND a.database_name = b.database_name AND a.table_name = b.table_name
  AND len(b.keys) > len(a.keys) AND b.keys[1:len(a.keys)] = a.keys
QUALIFY row_number() OVER (PARTITION BY a.index_id ORDER BY len(b.keys) DESC, b.index_id) = 1""")
def q_ix02p(spark, sf_dir):
    # key lists of one to three columns
    cut = F.slice("keys", F.lit(1), (F.floor(F.col("index_id") / 3) % 3 + 1).cast("int"))
    return ix.prefix_duplicates(fx.f5_indexes(spark, sf_dir).withColumn("keys", cut))


@reg("ix03_table_index_findings", F5 + f"""
, g AS (SELECT server_name, database_name, table_name, CAST(count(*) AS BIGINT) AS nc_indexes,
               CAST(count_if(len(keys) + len(includes) >= 4) AS BIGINT) AS wide,
               CAST(count_if(len(includes) > 0) AS BIGINT) AS with_includes
        FROM f5 WHERE index_type = 2 GROUP BY ALL)
SELECT server_name, database_name, {_f(20, 100, 'Over-Indexing', 'Many NC Indexes on a Single Table')},
       CAST(nc_indexes AS VARCHAR) || ' NC indexes on ' || table_name AS details, CAST(nc_indexes AS DOUBLE) AS value
FROM g WHERE nc_indexes >= 10
UNION ALL
SELECT server_name, NULL, {_f(21, 150, 'Over-Indexing', 'More Than 5 Percent NC Indexes Are Unused')},
       CAST(unused AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' unused', round(unused * 100.0 / n, 4)
FROM (SELECT server_name, count_if(user_seeks + user_scans + user_lookups = 0) AS unused, count(*) AS n FROM f5
      WHERE index_type = 2 AND NOT is_unique AND create_ts < TIMESTAMP '2001-06-01' - INTERVAL 7 DAY
        AND modify_ts < TIMESTAMP '2001-06-01' - INTERVAL 2 DAY GROUP BY ALL) WHERE unused * 100.0 / n >= 5
UNION ALL
SELECT server_name, database_name, {_f(23, 150, 'Over-Indexing', 'Approximate: Wide Indexes (7 or More Columns)')},
       CAST(wide AS VARCHAR) || ' wide indexes on ' || table_name, CAST(wide AS DOUBLE)
FROM g WHERE wide > 0
UNION ALL
SELECT server_name, database_name, {_f(31, 250, 'Omitted Index Features', 'Few Indexes Use Includes')},
       CAST(with_includes AS VARCHAR) || ' of ' || CAST(nc_indexes AS VARCHAR) || ' use includes', CAST(with_includes AS DOUBLE)
FROM g WHERE with_includes * 100.0 / nc_indexes < 25""")
def q_ix03(spark, sf_dir):
    return ix.table_index_findings(fx.f5_indexes(spark, sf_dir), dt.datetime(2001, 6, 1), wide=4, includes_pct=25.0)


_R = "(user_seeks + user_scans + user_lookups)"
_NC = "index_type = 2 AND NOT is_unique"


def _ix_rule_sql() -> str:
    parts = [
        (22, 10, "Over-Indexing", "Unused NC Index with High Writes", f"{_NC} AND {_R} = 0 AND user_updates >= 10000",
         "'Reads: 0, Writes: ' || CAST(user_updates AS VARCHAR) || ' on ' || index_name", "user_updates"),
        (29, 150, "Over-Indexing", "Unused NC Index with Low Writes", f"{_NC} AND {_R} = 0 AND user_updates < 10000",
         "'Reads: 0, Writes: ' || CAST(user_updates AS VARCHAR) || ' on ' || index_name", "user_updates"),
        (48, 100, "Over-Indexing", "NC index with High Writes:Reads",
         f"{_NC} AND {_R} > 0 AND {_R} < 10000 AND user_updates >= 10000 AND {_R} * 10 < user_updates",
         f"'Reads: ' || CAST({_R} AS VARCHAR) || ' Writes: ' || CAST(user_updates AS VARCHAR) || ' on ' || index_name",
         "user_updates"),
        (40, 100, "Indexes Worth Reviewing", "Low Fill Factor on Nonclustered Index", "index_type = 2 AND fill_factor <= 80",
         "'Fill factor ' || CAST(fill_factor AS VARCHAR) || ' on ' || index_name", "fill_factor"),
        (42, 100, "Indexes Worth Reviewing", "Disabled Index", "is_disabled", "index_name", "NULL"),
        (41, 100, "Indexes Worth Reviewing", "Hypothetical Index", "is_hypothetical", "index_name", "NULL"),
        (28, 100, "Over-Indexing", "Non-Unique Clustered Index", "index_type = 1 AND NOT is_unique", "index_name", "NULL"),
        (24, 100, "Over-Indexing", "Wide Clustered Index (>3 columns)", "index_type = 1 AND len(keys) > 3",
         "CAST(len(keys) AS VARCHAR) || ' key columns'", "len(keys)"),
        (43, 100, "Indexes Worth Reviewing", "Heap with Forwarded Fetches", "index_type = 0 AND forwarded_fetches / 0.5 > 1000",
         "CAST(forwarded_fetches AS VARCHAR) || ' forwarded fetches'", "forwarded_fetches"),
        (44, 100, "Indexes Worth Reviewing", "Large Active Heap", f"index_type = 0 AND {_R} > 0 AND row_count >= 100000",
         "CAST(row_count AS VARCHAR) || ' rows'", "row_count"),
        (45, 100, "Indexes Worth Reviewing", "Medium Active Heap",
         f"index_type = 0 AND {_R} > 0 AND row_count >= 10000 AND row_count < 100000",
         "CAST(row_count AS VARCHAR) || ' rows'", "row_count"),
        (46, 100, "Indexes Worth Reviewing", "Small Active Heap", f"index_type = 0 AND {_R} > 0 AND row_count < 10000",
         "CAST(row_count AS VARCHAR) || ' rows'", "row_count"),
        (66, 200, "Abnormal Design Pattern", "Recently Created Tables/Indexes (1 week)",
         "create_ts >= TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 7 DAY", "CAST(create_ts AS VARCHAR)", "NULL"),
        (67, 200, "Abnormal Design Pattern", "Recently Modified Tables/Indexes (2 days)",
         "modify_ts >= TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 2 DAY AND modify_ts > create_ts",
         "CAST(modify_ts AS VARCHAR)", "NULL"),
    ]
    sel = "\nUNION ALL ".join(
        f"SELECT server_name, database_name, {_f(c, p, g, n)}, {d} AS details, CAST({v} AS DOUBLE) AS value "
        f"FROM f5 WHERE {w}" for c, p, g, n, w, d, v in parts)
    return F5 + sel


def ix_findings_cte() -> str:
    """The IX-4 finding rows as a CTE named ``fnd`` (for the rule-engine queries)."""
    body = _ix_rule_sql()[len(F5):]
    return F5 + ", fnd AS (" + body + ")\n"


@reg("ix04_index_rule_findings", _ix_rule_sql())
def q_ix04(spark, sf_dir):
    return ix.index_findings(fx.f5_indexes(spark, sf_dir), as_of="2001-06-01 00:00:00", uptime_days=0.5)


MISSING_SQL = PART_USE + """,
mi AS (SELECT p_partkey AS missing_id, 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name,
              p_brand AS table_name, [p_type] AS equality_columns, n_lines * 100 AS user_seeks, p_partkey % 10 AS user_scans,
              p_retailprice / 10 AS avg_total_user_cost, CAST(p_partkey % 100 AS DOUBLE) AS avg_user_impact,
              p_partkey % 40 AS age_days
       FROM pu)"""


@reg("ix06_missing_index_benefit", "WITH " + MISSING_SQL + """
, m AS (SELECT *, round((user_seeks + user_scans) * avg_total_user_cost * avg_user_impact, 4) AS magic_benefit,
               round((user_seeks + user_scans) * avg_total_user_cost * avg_user_impact
                     / least(30.0, greatest(CAST(age_days AS DOUBLE), 1.0)), 4) AS benefit_per_day FROM mi)
SELECT * FROM m WHERE benefit_per_day >= 100000 ORDER BY magic_benefit DESC, table_name, missing_id LIMIT 20""")
def q_ix06(spark, sf_dir):
    return ix.missing_index_benefit(fm.f5_missing(spark, sf_dir), uptime_days=30)


@reg("ix07_index_definition_text", F5 + """
SELECT table_name, index_name, keys, includes,
       'CREATE INDEX [' || index_name || '] ON [' || table_name || '] (' ||
       array_to_string(list_transform(keys, lambda x: '[' || x || ']'), ', ') || ')' ||
       CASE WHEN len(includes) > 0 THEN ' INCLUDE (' || array_to_string(list_transform(includes, lambda x: '[' || x || ']'), ', ') || ')'
            ELSE '' END AS definition
FROM f5""")
def q_ix07(spark, sf_dir):
    return ix.index_definition(fx.f5_indexes(spark, sf_dir).select("table_name", "index_name", "keys", "includes"))


@reg("ix08_lock_hot_objects", F5 + """
, g AS (SELECT server_name, database_name, table_name, CAST(sum(row_lock_wait_ms) + sum(page_lock_wait_ms) AS BIGINT) AS lock_wait_ms,
               CAST(sum(lock_count) AS BIGINT) AS locks FROM f5 GROUP BY ALL)
SELECT *, round(CASE WHEN locks = 0 THEN 0 ELSE lock_wait_ms / locks END, 4) AS avg_wait_ms,
       CASE WHEN round(CASE WHEN locks = 0 THEN 0 ELSE lock_wait_ms / locks END, 4) >= 1100 THEN 11 ELSE 12 END AS check_id
FROM g WHERE lock_wait_ms > 300000""")
def q_ix08(spark, sf_dir):
    return ix.lock_hot_objects(fx.f5_indexes(spark, sf_dir), long_avg_ms=1100)


@reg("ix09_key_exhaustion", """
WITH i AS (SELECT 'srv0' AS server_name, 'tbl' || CAST(s_suppkey AS VARCHAR) AS table_name,
                  (['tinyint', 'smallint', 'int'])[s_suppkey % 3 + 1] AS type_name, CAST(1 AS BIGINT) AS seed_value,
                  CAST(CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE 1 END AS BIGINT) AS increment_value,
                  CAST(floor(CAST((CAST([255, 32767, 2147483647] AS BIGINT[]))[s_suppkey % 3 + 1] AS BIGINT) * ((s_acctbal + 1000) / 11000)) AS BIGINT) AS l
           FROM supplier),
j AS (SELECT server_name, table_name, type_name, seed_value, increment_value,
             CASE WHEN increment_value > 0 THEN l ELSE -l END AS last_value FROM i),
k AS (SELECT *, round(CASE type_name
        WHEN 'int' THEN CASE WHEN increment_value >= 0 THEN 2147483647 - (coalesce(last_value, seed_value) + increment_value)
                             ELSE abs(-2147483647 - (coalesce(last_value, seed_value) + increment_value)) END / 2147483647.0::DOUBLE * 100
        WHEN 'smallint' THEN CASE WHEN increment_value >= 0 THEN 32768 - (coalesce(last_value, seed_value) + increment_value)
                             ELSE abs(-32768 - (coalesce(last_value, seed_value) + increment_value)) END / 32768.0::DOUBLE * 100
        WHEN 'tinyint' THEN CASE WHEN increment_value >= 0 THEN 255 - (coalesce(last_value, seed_value) + increment_value)
                             ELSE abs(0 - (coalesce(last_value, seed_value) + increment_value)) END / 255.0::DOUBLE * 100 END, 1) AS pct_remaining FROM j)
SELECT server_name, table_name, type_name, seed_value, increment_value, last_value, pct_remaining FROM k WHERE pct_remaining <= 30""")
def q_ix09(spark, sf_dir):
    return ix.key_exhaustion(fm.f5_identities(spark, sf_dir))


STATS_SQL = PART_USE + """,
st AS (SELECT 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name, p_brand AS table_name,
              'st_' || CAST(p_partkey AS VARCHAR) AS stats_name,
              TIMESTAMP '2001-06-01' - to_days(CAST(p_partkey % 30 + (p_partkey % 2) * 60 AS INTEGER)) AS last_updated,
              CAST(p_size AS BIGINT) * 1000 AS rows, qty * 50 AS modification_counter,
              CAST(floor(CAST(p_size AS BIGINT) * 1000 * (p_partkey % 20) / 100) AS BIGINT) AS rows_sampled
       FROM pu)"""
AS_OF = dt.datetime(2001, 6, 1)


@reg("ix10_statistics_findings", "WITH " + STATS_SQL + f"""
, s AS (SELECT *, date_diff('day', last_updated, TIMESTAMP '2001-06-01') AS days_since_update,
               round(rows_sampled * 100.0 / rows, 4) AS pct_sampled FROM st)
SELECT server_name, database_name, {_f(90, 90, 'Statistics Warnings', 'Statistics Not Updated Recently')},
       stats_name || ': ' || CAST(days_since_update AS VARCHAR) || ' days' AS details, CAST(modification_counter AS DOUBLE) AS value
FROM s WHERE days_since_update >= 30 AND modification_counter * 100.0 >= rows * 10.0 AND rows >= 10000
UNION ALL
SELECT server_name, database_name, {_f(91, 90, 'Statistics Warnings', 'Low Sampling Rates')}, stats_name, pct_sampled
FROM s WHERE (rows >= 10000 AND rows < 1000000 AND rows_sampled * 100.0 / rows < 10)
          OR (rows >= 1000000 AND rows_sampled * 100.0 / rows < 1)""")
def q_ix10(spark, sf_dir):
    return ix.statistics_findings(fm.f5_stats(spark, sf_dir), AS_OF)


@reg("qs16_stale_stats_by_database", "WITH " + STATS_SQL + """
SELECT server_name, database_name, round(avg(modification_counter), 4) AS avg_modifications,
       CAST(count(*) AS BIGINT) AS stats_count
FROM st WHERE last_updated >= TIMESTAMP '2001-06-01' - INTERVAL 7 DAY GROUP BY ALL
HAVING round(avg(modification_counter), 4) >= 10000""")
def q_qs16(spark, sf_dir):
    return ix.stale_stats_by_database(fm.f5_stats(spark, sf_dir), AS_OF, days=7, min_avg_mods=10000)


COLS_SQL = """cols AS (
  SELECT 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name,
         p_brand || '_' || CAST(p_partkey // 1000 AS VARCHAR) AS table_name, p_partkey AS column_id,
         CASE WHEN p_partkey % 7 = 0 THEN 'is_' || replace(p_name, ' ', '_')
              ELSE replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) END AS column_name,
         CASE p_type WHEN 'ECONOMY' THEN 'varchar' WHEN 'STANDARD' THEN 'int' WHEN 'PROMO' THEN 'nvarchar'
                     WHEN 'SMALL' THEN 'bigint' WHEN 'LARGE' THEN 'datetime' WHEN 'MEDIUM' THEN 'char' ELSE 'sql_variant' END AS data_type,
         CAST(CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'MEDIUM') THEN p_size * 10 ELSE 8 END AS BIGINT) AS max_length,
         p_partkey % 3 <> 0 AS is_nullable
  FROM part)"""


@reg("ix11_column_ratio_findings", "WITH " + COLS_SQL + f"""
, g AS (SELECT server_name, database_name, table_name, CAST(count(*) AS BIGINT) AS cols,
               CAST(count_if(is_nullable) AS BIGINT) AS nullable_cols,
               CAST(count_if(data_type IN ('char', 'varchar', 'nchar', 'nvarchar', 'text', 'ntext')) AS BIGINT) AS string_cols,
               CAST(sum(CASE WHEN max_length > 0 THEN max_length ELSE 0 END) AS BIGINT) AS row_bytes FROM cols GROUP BY ALL)
SELECT server_name, database_name, {_f(25, 200, 'Over-Indexing', 'High Ratio of Nulls')},
       CAST(nullable_cols AS VARCHAR) || ' of ' || CAST(cols AS VARCHAR) || ' columns nullable' AS details,
       CAST(nullable_cols AS DOUBLE) AS value FROM g WHERE cols > 3 AND cols - nullable_cols < 2
UNION ALL
SELECT server_name, database_name, {_f(27, 200, 'Over-Indexing', 'High Ratio of Strings')},
       CAST(string_cols AS VARCHAR) || ' of ' || CAST(cols AS VARCHAR) || ' columns are strings', CAST(string_cols AS DOUBLE)
FROM g WHERE cols > 3 AND cols - string_cols < 2
UNION ALL
SELECT server_name, database_name, {_f(26, 150, 'Over-Indexing', 'Wide Tables: 35+ cols or > 2000 non-LOB bytes')},
       CAST(cols AS VARCHAR) || ' columns, ' || CAST(row_bytes AS VARCHAR) || ' bytes', CAST(row_bytes AS DOUBLE)
FROM g WHERE cols >= 35 OR row_bytes >= 2000""")
def q_ix11(spark, sf_dir):
    return ix.column_ratio_findings(fm.f5_columns(spark, sf_dir))


@reg("ix14_unindexed_foreign_keys", F5 + """
, fk AS (SELECT 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name, p_brand AS table_name,
                'fk_' || CAST(p_partkey AS VARCHAR) AS fk_name,
                CASE WHEN p_partkey % 8 = 0 THEN p_type ELSE string_split(p_name, ' ')[2] END AS fk_column
         FROM part)
SELECT * FROM fk WHERE NOT EXISTS (SELECT 1 FROM f5 WHERE f5.server_name = fk.server_name
                                   AND f5.database_name = fk.database_name AND f5.table_name = fk.table_name
                                   AND f5.keys[1] = fk.fk_column)""")
def q_ix14(spark, sf_dir):
    return ix.unindexed_foreign_keys(fm.f5_fks(spark, sf_dir), fx.f5_indexes(spark, sf_dir))


@reg("ix14_unindexed_wide_foreign_keys", F5 + """
, fk AS (SELECT 'srv0' AS server_name, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name, p_brand AS table_name,
                'fk_' || CAST(p_partkey AS VARCHAR) AS fk_name, string_split(p_name, ' ') AS w, p_partkey % 4 AS m, p_type FROM part),
f AS (SELECT server_name, database_name, table_name, fk_name,
             CASE m WHEN 0 THEN [p_type] WHEN 1 THEN [w[1], p_type] WHEN 2 THEN [w[2], w[1], p_type] ELSE [w[2], p_type] END AS fk_columns FROM fk)
SELECT * FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f5 WHERE f5.server_name = f.server_name AND f5.database_name = f.database_name AND f5.table_name = f.table_name
    AND list_sort(f5.keys[1:len(f.fk_columns)]) = list_sort(f.fk_columns))""")
def q_ix14w(spark, sf_dir):
    return ix.unindexed_foreign_keys(fm.f5_wide_fks(spark, sf_dir), fx.f5_indexes(spark, sf_dir))


@reg("ix16_fragmentation_bands", """
SELECT p_brand AS table_name, p_partkey AS index_id, CAST(p_partkey % 50 AS DOUBLE) AS fragmentation_pct,
       CAST(p_size AS BIGINT) * 100 AS page_count,
       CASE WHEN (p_partkey % 50) < 10 THEN 'LOW' WHEN (p_partkey % 50) <= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS band,
       CASE WHEN (p_partkey % 50) < 10 THEN 'NONE' WHEN (p_partkey % 50) <= 30 THEN 'REORGANIZE' ELSE 'REBUILD' END AS action
FROM part WHERE CAST(p_size AS BIGINT) * 100 > 1000""")
def q_ix16(spark, sf_dir):
    return ix.fragmentation_bands(fm.f5_fragmentation(spark, sf_dir))


@reg("ix17_compression_runs", """
WITH p AS (SELECT 'tbl' || CAST(l_suppkey % 5 AS VARCHAR) AS table_name,
                  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS BIGINT) AS partition_number
           FROM lineitem GROUP BY ALL),
c AS (SELECT *, CASE WHEN partition_number % 7 < 3 THEN 'PAGE' WHEN partition_number % 7 < 5 THEN 'ROW' ELSE 'NONE' END AS compression FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY partition_number)
              - row_number() OVER (PARTITION BY table_name, compression ORDER BY partition_number) AS grp FROM c)
SELECT table_name, compression, min(partition_number) AS first_partition, max(partition_number) AS last_partition,
       CAST(count(*) AS BIGINT) AS partitions,
       CASE WHEN min(partition_number) = max(partition_number) THEN CAST(min(partition_number) AS VARCHAR)
            ELSE CAST(min(partition_number) AS VARCHAR) || '-' || CAST(max(partition_number) AS VARCHAR) END AS partition_range
FROM g GROUP BY table_name, compression, grp""")
def q_ix17(spark, sf_dir):
    return ix.compression_runs(fm.f5_partitions(spark, sf_dir))


@reg("ix18_table_ddl", "WITH " + COLS_SQL + """
SELECT server_name, database_name, table_name,
       'CREATE TABLE [' || table_name || '] (' || string_agg('[' || column_name || '] ' || data_type ||
         CASE WHEN data_type IN ('char', 'varchar', 'nchar', 'nvarchar', 'text', 'ntext') THEN '(' || CAST(max_length AS VARCHAR) || ')' ELSE '' END ||
         CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END, ', ' ORDER BY column_id) || ')' AS ddl
FROM cols GROUP BY server_name, database_name, table_name""")
def q_ix18(spark, sf_dir):
    return ix.table_ddl(fm.f5_columns(spark, sf_dir))


@reg("ix18_grant_statements", """
WITH p AS (SELECT o_orderkey % 200 AS obj, o_custkey % 40 AS who, (['SELECT', 'INSERT', 'EXECUTE'])[o_orderkey % 3 + 1] AS perm, o_orderkey % 5 AS st FROM orders)
SELECT 'GRANT ' || perm || ' ON [dbo].[obj' || obj || '] TO [user' || who || '];' AS grant_statement, 'user' || who AS principal_name, 'obj' || obj AS object_name
FROM p WHERE st > 0 AND obj % 4 <> 3 AND who < 35""")
def q_ix18g(spark, sf_dir):
    o = fx._t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    permissions = o.select((k % 200).alias("major_id"), (F.col("o_custkey") % 40).alias("grantee_principal_id"),
                           F.element_at(F.array(F.lit("SELECT"), F.lit("INSERT"), F.lit("EXECUTE")), (k % 3 + 1).cast("int")).alias("permission_name"),
                           F.when(k % 5 == 0, "DENY").otherwise("GRANT").alias("state_desc"))
    objects = o.select((k % 200).alias("object_id")).distinct().select(
        "object_id", F.concat(F.lit("obj"), F.col("object_id").cast("string")).alias("object_name"),
        F.element_at(F.array(*[F.lit(x) for x in ("U", "V", "P", "SQ")]), (F.col("object_id") % 4 + 1).cast("int")).alias("object_type"))
    principals = o.select((F.col("o_custkey") % 40).alias("principal_id")).distinct().filter("principal_id < 35").select(
        "principal_id", F.concat(F.lit("user"), F.col("principal_id").cast("string")).alias("principal_name"))
    return ix.grant_statements(permissions, principals, objects)


@reg("ix19_filter_candidate_columns", "WITH " + COLS_SQL + """
SELECT * FROM cols WHERE lower(column_name) LIKE 'is%' OR lower(column_name) LIKE '%archive%'
   OR lower(column_name) LIKE '%active%' OR lower(column_name) LIKE '%flag%'""")
def q_ix19(spark, sf_dir):
    return ix.filter_candidate_columns(fm.f5_columns(spark, sf_dir))
