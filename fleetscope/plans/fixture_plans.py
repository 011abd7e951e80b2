"""Plan documents rendered from ``orders`` x ``lineitem`` (one plan per order,
one operator per line, each inside the one before); the oracle recomputes every feature from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import _t

# Physical operator per ``l_partkey % 12``.
OPS = ["Key Lookup", "Sort", "Table Scan", "Index Scan", "Clustered Index Seek", "Hash Match", "Remote Query",
       "Index Spool", "Table Spool", "Table Insert", "Index Update", "Clustered Index Delete"]
NS = "http://schemas.microsoft.com/sqlserver/2004/07/showplan"


# elements inside an operator, one in so many parts
INNER = [(31, '<ComputeScalar><DefinedValues><DefinedValue><ColumnReference ComputedColumn="1"/></DefinedValue></DefinedValues></ComputeScalar>'),
         (67, '<Filter><Predicate><ScalarOperator><Compare><ScalarOperator><UserDefinedFunction IsClrFunction="1"/></ScalarOperator></Compare></ScalarOperator></Predicate></Filter>'),
         (71, '<Filter><Predicate><ScalarOperator><Compare><ScalarOperator><UserDefinedFunction FunctionName="g"/></ScalarOperator></Compare></ScalarOperator></Predicate></Filter>'),
         (73, '<IndexScan Storage="RowStore"><Object IndexKind="Spatial"/></IndexScan>'),
         (79, '<IndexScan Storage="ColumnStore"/>'),
         (83, '<IndexScan><Predicate><ScalarOperator><Compare><ScalarOperator><Intrinsic FunctionName="isnull"/></ScalarOperator></Compare></ScalarOperator></Predicate></IndexScan>'),
         (89, '<IndexScan><Predicate><ScalarOperator><Intrinsic FunctionName="like"><ScalarOperator><Const ConstValue="N\'%x\'"/></ScalarOperator></Intrinsic></ScalarOperator></Predicate></IndexScan>'),
         (97, '<IndexScan><Predicate><ScalarOperator><Intrinsic FunctionName="like"><ScalarOperator><Const ConstValue="\'x%\'"/></ScalarOperator></Intrinsic></ScalarOperator></Predicate></IndexScan>'),
         (101, '<Nested><ScalarOperator ScalarString="[Expr1002]"/></Nested>'),
         (41, '<UserDefinedFunction FunctionName="f"/>'), (43, '<Object Table="[@t]"/>'), (47, '<Merge ManyToMany="1"/>'),
         (53, '<SpillToTempDb SpillLevel="1"/>'), (59, '<ColumnsWithNoStatistics/>'), (61, '<JoinWarning NoJoinPredicate="1"/>')]


def plan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    op = F.element_at(F.array(*[F.lit(x) for x in OPS]), (F.col("l_partkey") % 12 + 1).cast("int"))
    cost = F.floor(F.col("l_extendedprice") / 1000).cast("long")
    warn = F.when(F.col("l_partkey") % 11 == 0, F.lit('<Warnings><PlanAffectingConvert ConvertIssue="Seek Plan"/>'
                                                      '</Warnings>')).otherwise(F.lit(""))
    pk = F.col("l_partkey")
    more = F.concat(*[F.when(pk % m == 0, F.lit(text)).otherwise(F.lit("")) for m, text in INNER])
    logical = F.when(pk % 9 == 0, F.lit(' LogicalOp="Inner Join"')).when(pk % 14 == 1, F.lit(' LogicalOp="Table-valued function"')).otherwise(F.lit(""))
    estimates = F.concat(F.lit(' EstimateRows="'), F.floor("l_quantity").cast("string"), F.lit('" EstimateRewinds="'), ((pk % 7) * 500).cast("string"),
                         F.lit('" EstimateRebinds="'), (pk % 5).cast("string"), F.lit('" EstimatedExecutionMode="'),
                         F.when(pk % 2 == 0, F.lit("Row")).otherwise(F.lit("Batch")), F.lit('"'))
    relop = F.concat(F.lit('<RelOp PhysicalOp="'), op, F.lit('" EstimatedTotalSubtreeCost="'), cost.cast("string"), F.lit('"'),
                     F.when(pk % 37 == 0, F.lit(' Parallel="1"')).otherwise(F.lit("")), logical, estimates, F.lit(">"), warn, more)
    g = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             relop.alias("x")))).alias("ops"),
        F.sum(cost).alias("cost"))
    j = g.join(o, g.l_orderkey == o.o_orderkey)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    abort = (F.when(k % 13 == 0, F.lit(' StatementOptmEarlyAbortReason="TimeOut"'))
             .when(k % 17 == 0, F.lit(' StatementOptmEarlyAbortReason="MemoryLimitExceeded"')).otherwise(F.lit("")))
    missing = F.when(k % 5 == 0, F.concat(
        F.lit('<MissingIndexes><MissingIndexGroup Impact="'), (k % 100).cast("string"),
        F.lit('"><MissingIndex Table="[tbl'), (c % 10).cast("string"),
        F.lit(']"><ColumnGroup Usage="EQUALITY"><Column Name="[c'), (c % 3).cast("string"), F.lit(']"/></ColumnGroup>'),
        F.when(k % 2 == 0, F.lit('<ColumnGroup Usage="INEQUALITY"><Column Name="[d1]"/></ColumnGroup>')).otherwise(F.lit("")),
        F.lit('<ColumnGroup Usage="INCLUDE"><Column Name="[inc'), (k % 2).cast("string"),
        F.lit(']"/><Column Name="[inc9]"/></ColumnGroup></MissingIndex></MissingIndexGroup></MissingIndexes>'))
    ).otherwise(F.lit(""))
    params = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(
        F.lit('<ParameterList><ColumnReference Column="@p1" ParameterCompiledValue="('), (c % 7).cast("string"),
        F.lit(')" ParameterRuntimeValue="('), (k % 7).cast("string"),
        F.lit(')"/><ColumnReference Column="@p2" ParameterCompiledValue="(1)" ParameterRuntimeValue="(1)"/>'
              '</ParameterList>'))).otherwise(F.lit(""))
    stats = F.when(k % 3 == 0, F.concat(F.lit('<OptimizerStatsUsage>'), *[F.concat(
        F.lit('<StatisticsInfo LastUpdate="2001-0'), (k % m + 1).cast("string"), F.lit('-15T10:00:00.12" ModificationCount="'),
        ((k % 4) * step).cast("string"), F.lit('"/>')) for m, step in ((3, 60000), (5, 90000))], F.lit('</OptimizerStatsUsage>'))).otherwise(F.lit(""))
    doc = F.concat(
        F.lit(f'<ShowPlanXML xmlns="{NS}"><BatchSequence><Batch><Statements><StmtSimple StatementSubTreeCost="'),
        (F.col("cost") + 1).cast("string"), F.lit('"'), abort,
        F.when(k % 19 == 0, F.lit(' StatementOptmLevel="TRIVIAL"')).otherwise(F.lit("")),
        F.when(k % 23 == 0, F.lit(' NonParallelPlanReason="MaxDOPSetToOne"')).otherwise(F.lit("")),
        F.when(k % 7 != 0, F.concat(F.lit(' CardinalityEstimationModelVersion="'), (F.lit(130) + (k % 5) * 10).cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.when(k % 103 == 0, F.lit(' SecurityPolicyApplied="true"')).otherwise(F.lit("")), F.lit(">"),
        F.when(k % 29 == 0, F.lit("<CursorPlan/>")).otherwise(F.lit("")), F.lit("<QueryPlan>"), stats, missing, params,
        F.array_join(F.transform("ops", lambda x: x["x"]), ""), F.repeat(F.lit("</RelOp>"), F.size("ops")),
        F.lit("</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>"))
    return j.select(k.alias("plan_id"), F.concat(F.lit("qh"), (c % 100).cast("string")).alias("query_hash"),
                    doc.alias("plan_xml"))
