"""Plan-document analytics (QS-3, QS-7, QS-8, QS-9, QS-10).

All read the facts of :mod:`fleetscope.operators.plantree`, one parse of each document.  Features are table-driven:
one ``(name, kind, argument)`` row per feature, all evaluated in one projection over the operator array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import try_ratio
from .plantree import plan_facts

# Feature name, kind, argument (an operator or element name, an early-abort reason, a flag of an
# operator, or an attribute or element as the server writes it).
PLAN_FEATURES: list[tuple[str, str, str]] = [
    ("compile_timeout", "abort_reason", "TimeOut"),
    ("compile_memory_limit", "abort_reason", "MemoryLimitExceeded"),
    ("implicit_conversion", "has_element", "PlanAffectingConvert"),
    ("unparameterized", "lacks_element", "ParameterList"),
    ("has_key_lookup", "op_exists", "Key Lookup"),
    ("has_table_scan", "op_exists", "Table Scan"),
    ("has_remote_query", "op_exists", "Remote Query"),
    ("statement_cost", "fact", "statement_cost"),
    ("key_lookup_cost", "op_cost", "Key Lookup"),
    ("sort_cost", "op_cost", "Sort"),
    ("remote_query_cost", "op_cost", "Remote Query"),
    ("index_spool_cost", "op_cost", "Index Spool"),
    ("table_spool_cost", "op_cost", "Table Spool"),
    ("operator_count", "count_element", "RelOp"),
    ("warning_count", "count_element", "Warnings"),
    ("missing_index_count", "count_element", "MissingIndexGroup"),
    ("has_hash_match", "op_exists", "Hash Match"),
    ("has_merge_join", "op_exists", "Merge Join"),
    ("has_adaptive_join", "op_exists", "Adaptive Join"),
    ("has_table_valued_function", "op_exists", "Table-valued function"),
    ("has_index_spool", "op_exists", "Index Spool"),
    ("has_table_spool", "op_exists", "Table Spool"),
    ("has_columnstore_scan", "op_exists", "Columnstore Index Scan"),
    ("is_trivial", "mentions", 'StatementOptmLevel="TRIVIAL"'),
    ("is_forced_serial", "mentions", "NonParallelPlanReason="),
    ("is_parallel", "mentions", 'Parallel="1"'),
    ("is_cursor", "mentions", "<CursorPlan"),
    ("has_scalar_function", "mentions", "<UserDefinedFunction"),
    ("has_table_variable", "mentions", 'Table="[@'),
    ("is_many_to_many", "mentions", 'ManyToMany="1"'),
    ("no_join_predicate", "mentions", 'NoJoinPredicate="1"'),
    ("spills_to_tempdb", "mentions", "<SpillToTempDb"),
    ("no_column_statistics", "mentions", "<ColumnsWithNoStatistics"),
    ("busy_loops", "busy_loops", "100"),
    ("function_join", "function_join", "Table-valued function"),
    ("computed_column_function", "op_flags", "computed_column function_below"),
    ("filter_function", "op_flags", "filter_function"),
    ("is_spatial", "op_flags", "spatial"),
    ("is_nonsargable", "nonsargable", ""),
    ("stale_statistics", "stale_statistics", ""),
    ("columnstore_row_mode", "row_mode", "Row"),
    ("downlevel_estimator", "downlevel_estimator", ""),
    ("has_row_level_security", "fact", "row_level_security"),
]


def _feature(kind: str, arg: str, *, as_of: Column, server_version: int, stale_days: int, stale_rows: int) -> Column:
    facts = F.col("facts")
    ops = facts["operators"]

    def any_op(test) -> Column:
        return F.exists(ops, test)

    def joins(o: Column) -> Column:
        return F.coalesce(F.contains(o["logical"], F.lit("Join")), F.lit(False))

    if kind == "fact":
        return facts[arg]
    if kind == "has_element":
        return facts["elements"][arg] > 0
    if kind == "lacks_element":
        return facts["elements"][arg] == 0
    if kind == "count_element":
        return facts["elements"][arg].cast("double")
    if kind == "op_exists":
        return any_op(lambda o: o["op"].eqNullSafe(F.lit(arg)))
    if kind == "op_cost":
        return F.aggregate(ops, F.lit(0.0), lambda acc, o: acc + F.when(o["op"] == F.lit(arg), F.coalesce(o["cost"], F.lit(0.0)))
                           .otherwise(F.lit(0.0)))
    if kind == "mentions":  # looked up in the text before the parse
        return F.col(f"__m_{arg}")
    if kind == "abort_reason":
        return F.array_contains(facts["early_aborts"], F.lit(arg))
    if kind == "busy_loops":  # executed more than a hundred times as often as rows are expected
        return any_op(lambda o: F.coalesce(o["executions"] / float(arg) > o["rows"], F.lit(False)))
    if kind == "function_join":  # a table-valued function and a join under one top operator
        with_function = F.transform(F.filter(ops, lambda o: o["logical"].eqNullSafe(F.lit(arg))), lambda o: o["root"])
        return F.arrays_overlap(with_function, F.transform(F.filter(ops, joins), lambda o: o["root"]))
    if kind == "op_flags":
        first, *more = arg.split()
        return any_op(lambda o: o[first] & o[more[0]] if more else o[first])
    if kind == "nonsargable":
        return any_op(lambda o: o["function_on_column"] | o["leading_wildcard"] | (joins(o) & o["expression_below"]))
    if kind == "row_mode":
        return any_op(lambda o: o["columnstore"] & o["mode"].eqNullSafe(F.lit(arg)))
    if kind == "downlevel_estimator":
        return F.coalesce(facts["estimator"] < server_version * 10, F.lit(False))
    if kind == "stale_statistics":  # none newer than the limit and many changes on average
        stats = facts["statistics"]
        newest = F.array_max(F.transform(stats, lambda x: F.try_to_timestamp(F.substring(F.replace(x["updated"], F.lit("T"), F.lit(" ")), 1, 19))
                                         .cast("timestamp_ntz")))
        changed = F.aggregate(stats, F.lit(0).cast("long"), lambda acc, x: acc + x["modified"])
        return F.coalesce((newest <= as_of - F.make_dt_interval(F.lit(stale_days))) & (changed >= stale_rows * F.size(stats)), F.lit(False)) \
            & facts.isNotNull()
    raise ValueError(f"unknown feature kind {kind}")


def plan_features(plans: DataFrame, *, xml: str = "plan_xml", as_of: str = "9999-12-31 00:00:00", server_version: int = 16,
                  stale_days: int = 7, stale_rows: int = 100_000, features: Sequence[tuple[str, str, str]] = PLAN_FEATURES) -> DataFrame:
    """QS-8: one column per feature of ``features``, from one parse of each document.  ``as_of`` and ``server_version`` judge the
    age of statistics and of the cardinality estimator."""
    texts = list(dict.fromkeys(arg for _, kind, arg in features if kind == "mentions"))
    base = plan_facts(plans.select("*", *[F.contains(xml, F.lit(t)).alias(f"__m_{t}") for t in texts]), xml=xml)
    how = {"as_of": F.lit(as_of).cast("timestamp_ntz"), "server_version": server_version, "stale_days": stale_days, "stale_rows": stale_rows}
    return base.select(*[c for c in plans.columns if c != xml], *[_feature(k, a, **how).alias(n) for n, k, a in features])


def operator_cost_flags(features: DataFrame, *, ctp: float = 50.0) -> DataFrame:
    """QS-3: expensive key lookup / sort (>= 50 % of the plan and plan >=
    half the parallelism threshold), remote (>= 5 %), index spool (>= 10 %,
    plan > ctp/5), table spool (>= 25 %, plan > ctp/5)."""
    cost = F.col("statement_cost")
    return features.select(
        "*",
        ((cost >= ctp / 2) & (F.col("key_lookup_cost") >= cost * 0.5)).alias("expensive_key_lookup"),
        ((cost >= ctp / 2) & (F.col("sort_cost") >= cost * 0.5)).alias("expensive_sort"),
        ((F.col("remote_query_cost") > 0) & (F.col("remote_query_cost") >= cost * 0.05)).alias("expensive_remote"),
        ((cost > ctp / 5) & (F.col("index_spool_cost") > 0) & (F.col("index_spool_cost") >= cost * 0.1))
        .alias("expensive_index_spool"),
        ((cost > ctp / 5) & (F.col("table_spool_cost") > 0) & (F.col("table_spool_cost") >= cost / 4))
        .alias("expensive_table_spool"))


# Data-modification operators counted per query hash.
DML_OPS = ["Index Insert", "Index Update", "Index Delete", "Clustered Index Insert", "Clustered Index Update",
           "Clustered Index Delete", "Table Insert", "Table Update", "Table Delete"]


def dml_operator_counts(plans: DataFrame, *, xml: str = "plan_xml", key: str = "query_hash") -> DataFrame:
    """QS-7: counts of index/clustered/table insert-update-delete operators per query hash."""
    p = plan_facts(plans, xml=xml, keep=[key]).select(key, F.explode_outer("facts.operators.op").alias("op"))
    return p.groupBy(key).agg(*[F.count_if(F.col("op") == op).cast("long").alias(op.lower().replace(" ", "_")) for op in DML_OPS])


def missing_index_suggestions(plans: DataFrame, *, xml: str = "plan_xml") -> DataFrame:
    """QS-9: missing-index requests in plans grouped by (table, equality,
    inequality, include columns): requests, average and max impact.  Every
    group of a plan is a request of its own."""
    g = plan_facts(plans, xml=xml, keep=[]).select(F.explode_outer("facts.missing").alias("g")).filter(F.col("g").isNotNull())

    def cols(usage):
        return F.array_join(F.array_sort(f"g.{usage}"), ", ").alias(f"{usage}_columns")

    p = g.select(F.col("g.table").alias("table_name"), cols("equality"), cols("inequality"), cols("include"), "g.impact")
    return p.groupBy("table_name", "equality_columns", "inequality_columns", "include_columns").agg(
        F.count(F.lit(1)).cast("long").alias("plans"), F.round(F.avg("impact"), 4).alias("avg_impact"),
        F.max("impact").alias("max_impact"))


def parameter_mismatches(plans: DataFrame, *, xml: str = "plan_xml", keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """QS-10: parameters whose compiled value differs from the runtime value; one that lacks either value (an
    estimated plan) compares with nothing."""
    p = plan_facts(plans, xml=xml, keep=keys).select(*keys, F.explode_outer("facts.parameters").alias("p")).filter(F.col("p").isNotNull())
    return p.select(*keys, F.col("p.name").alias("parameter"), F.col("p.compiled").alias("compiled_value"),
                    F.col("p.runtime").alias("runtime_value")).filter(F.col("compiled_value") != F.col("runtime_value"))


def cost_share(features: DataFrame, op_col: str) -> Column:
    return F.round(try_ratio(F.col(op_col) * 100.0, "statement_cost", 0.0), 4)
