"""Registered queries: plan documents (QS-3, QS-7, QS-8, QS-9, QS-10)."""

from __future__ import annotations

from ..operators import plandocs as pd
from .fixture_plans import OPS, plan_docs

QUERIES: dict = {}
ORACLE: dict = {}


def reg(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_OPS = "[" + ", ".join(f"'{o}'" for o in OPS) + "]"
PL = f"""WITH pl AS (
  SELECT l_orderkey, ({_OPS})[l_partkey % 12 + 1] AS op, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS cost,
         l_partkey % 11 = 0 AS warn, l_partkey, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
p AS (
  SELECT o_orderkey AS plan_id, 'qh' || CAST(o_custkey % 100 AS VARCHAR) AS query_hash, o_custkey, o_orderpriority,
         o_orderkey % 13 = 0 AS compile_timeout, o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 AS compile_memory_limit,
         bool_or(warn) AS implicit_conversion, o_orderpriority = '5-LOW' AS unparameterized,
         bool_or(op = 'Key Lookup') AS has_key_lookup, bool_or(op = 'Table Scan') AS has_table_scan,
         bool_or(op = 'Remote Query') AS has_remote_query,
         CAST(sum(cost) + 1 AS DOUBLE) AS statement_cost,
         CAST(sum(CASE WHEN op = 'Key Lookup' THEN cost ELSE 0 END) AS DOUBLE) AS key_lookup_cost,
         CAST(sum(CASE WHEN op = 'Sort' THEN cost ELSE 0 END) AS DOUBLE) AS sort_cost,
         CAST(sum(CASE WHEN op = 'Remote Query' THEN cost ELSE 0 END) AS DOUBLE) AS remote_query_cost,
         CAST(sum(CASE WHEN op = 'Index Spool' THEN cost ELSE 0 END) AS DOUBLE) AS index_spool_cost,
         CAST(sum(CASE WHEN op = 'Table Spool' THEN cost ELSE 0 END) AS DOUBLE) AS table_spool_cost,
         CAST(count(*) AS DOUBLE) AS operator_count, CAST(count_if(warn) AS DOUBLE) AS warning_count,
         CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS missing_index_count,
         bool_or(op = 'Hash Match') AS has_hash_match, bool_or(op = 'Merge Join') AS has_merge_join,
         bool_or(op = 'Adaptive Join') AS has_adaptive_join, bool_or(op = 'Table-valued function') AS has_table_valued_function,
         bool_or(op = 'Index Spool') AS has_index_spool, bool_or(op = 'Table Spool') AS has_table_spool,
         bool_or(op = 'Columnstore Index Scan') AS has_columnstore_scan,
         o_orderkey % 19 = 0 AS is_trivial, o_orderkey % 23 = 0 AS is_forced_serial, bool_or(l_partkey % 37 = 0) AS is_parallel,
         o_orderkey % 29 = 0 AS is_cursor, bool_or(l_partkey % 41 = 0 OR l_partkey % 67 = 0 OR l_partkey % 71 = 0) AS has_scalar_function, bool_or(l_partkey % 43 = 0) AS has_table_variable,
         bool_or(l_partkey % 47 = 0) AS is_many_to_many, bool_or(l_partkey % 61 = 0) AS no_join_predicate,
         bool_or(l_partkey % 53 = 0) AS spills_to_tempdb, bool_or(l_partkey % 59 = 0) AS no_column_statistics,
         bool_or(((l_partkey % 7) * 500 + l_partkey % 5 + 1) / 100.0 > floor(l_quantity)) AS busy_loops,
         bool_or(l_partkey % 9 = 0) AND bool_or(l_partkey % 9 <> 0 AND l_partkey % 14 = 1) AS function_join,
         -- a computed column with a function in the same operator or one inside it
         coalesce(min(n) FILTER (l_partkey % 31 = 0) <= max(n) FILTER (l_partkey % 41 = 0 OR l_partkey % 71 = 0), FALSE) AS computed_column_function,
         bool_or(l_partkey % 71 = 0) AS filter_function, bool_or(l_partkey % 73 = 0) AS is_spatial,
         bool_or(l_partkey % 83 = 0 OR l_partkey % 89 = 0)
           OR coalesce(min(n) FILTER (l_partkey % 9 = 0) <= max(n) FILTER (l_partkey % 101 = 0), FALSE) AS is_nonsargable,
         o_orderkey % 3 = 0 AND greatest(o_orderkey % 3, o_orderkey % 5) + 1 <= 4
           AND (o_orderkey % 4) * 75000 >= 100000 AS stale_statistics,
         bool_or(l_partkey % 79 = 0 AND l_partkey % 2 = 0) AS columnstore_row_mode,
         o_orderkey % 7 <> 0 AND 130 + (o_orderkey % 5) * 10 < 160 AS downlevel_estimator,
         o_orderkey % 103 = 0 AS has_row_level_security
  FROM pl JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority)
"""
FEATS = ("plan_id, query_hash, compile_timeout, compile_memory_limit, implicit_conversion, unparameterized, "
         "has_key_lookup, has_table_scan, has_remote_query, statement_cost, key_lookup_cost, sort_cost, "
         "remote_query_cost, index_spool_cost, table_spool_cost, operator_count, warning_count, missing_index_count, has_hash_match, "
         "has_merge_join, has_adaptive_join, has_table_valued_function, has_index_spool, has_table_spool, has_columnstore_scan, is_trivial, "
         "is_forced_serial, is_parallel, is_cursor, has_scalar_function, has_table_variable, is_many_to_many, no_join_predicate, "
         "spills_to_tempdb, no_column_statistics, busy_loops, function_join, computed_column_function, filter_function, is_spatial, is_nonsargable, "
         "stale_statistics, columnstore_row_mode, downlevel_estimator, has_row_level_security")

AS_OF = "2001-04-22 10:00:00"  # a week after the fourth month's update


@reg("qs08_plan_features", PL + f"SELECT {FEATS} FROM p")
def q_qs08(spark, sf_dir):
    return pd.plan_features(plan_docs(spark, sf_dir), as_of=AS_OF)


@reg("qs03_operator_cost_flags", PL + f"""
SELECT {FEATS},
       statement_cost >= 25 AND key_lookup_cost >= statement_cost * 0.5 AS expensive_key_lookup,
       statement_cost >= 25 AND sort_cost >= statement_cost * 0.5 AS expensive_sort,
       remote_query_cost > 0 AND remote_query_cost >= statement_cost * 0.05 AS expensive_remote,
       statement_cost > 10 AND index_spool_cost > 0 AND index_spool_cost >= statement_cost * 0.1 AS expensive_index_spool,
       statement_cost > 10 AND table_spool_cost > 0 AND table_spool_cost >= statement_cost / 4 AS expensive_table_spool
FROM p""")
def q_qs03(spark, sf_dir):
    return pd.operator_cost_flags(pd.plan_features(plan_docs(spark, sf_dir), as_of=AS_OF), ctp=50.0)


@reg("qs07_dml_operator_counts", f"""
WITH pl AS (SELECT l_orderkey, ({_OPS})[l_partkey % 12 + 1] AS op FROM lineitem),
q AS (SELECT 'qh' || CAST(o_custkey % 100 AS VARCHAR) AS query_hash, op FROM pl JOIN orders ON l_orderkey = o_orderkey)
SELECT query_hash,
""" + ",\n".join(f"       CAST(count_if(op = '{o}') AS BIGINT) AS {o.lower().replace(' ', '_')}" for o in pd.DML_OPS) + """
FROM q GROUP BY query_hash""")
def q_qs07(spark, sf_dir):
    return pd.dml_operator_counts(plan_docs(spark, sf_dir))


@reg("qs09_missing_index_suggestions", """
WITH m AS (SELECT '[tbl' || CAST(o_custkey % 10 AS VARCHAR) || ']' AS table_name,
                  '[c' || CAST(o_custkey % 3 AS VARCHAR) || ']' AS equality_columns,
                  CASE WHEN o_orderkey % 2 = 0 THEN '[d1]' ELSE '' END AS inequality_columns,
                  array_to_string(list_sort(['[inc' || CAST(o_orderkey % 2 AS VARCHAR) || ']', '[inc9]']), ', ') AS include_columns,
                  CAST(o_orderkey % 100 AS DOUBLE) AS impact
           FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT table_name, equality_columns, inequality_columns, include_columns, CAST(count(*) AS BIGINT) AS plans,
       round(avg(impact), 4) AS avg_impact, max(impact) AS max_impact FROM m GROUP BY ALL""")
def q_qs09(spark, sf_dir):
    return pd.missing_index_suggestions(plan_docs(spark, sf_dir))


@reg("qs10_parameter_mismatches", """
SELECT o_orderkey AS plan_id, '@p1' AS parameter, '(' || CAST(o_custkey % 7 AS VARCHAR) || ')' AS compiled_value,
       '(' || CAST(o_orderkey % 7 AS VARCHAR) || ')' AS runtime_value
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey % 7 <> o_orderkey % 7
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def q_qs10(spark, sf_dir):
    return pd.parameter_mismatches(plan_docs(spark, sf_dir))
