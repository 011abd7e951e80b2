"""One parse of a plan document (QS-3, QS-7, QS-8, QS-9, QS-10).

Operators nest arbitrarily deep, so neither a declared schema nor flat XPath calls can say which operator holds which.
Every document is read once, by a streaming parser over Arrow batches, into a struct of flat arrays: operators in document
order with the number of the operator they stand in, statistics, missing-index requests and parameters.  All questions
about plans are DataFrame expressions over that struct.

A null document, or one that is not well-formed, has null facts.  Prefixes of element names are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: ``parent`` and ``root`` are operator numbers, counted from 0 in document order; ``function_below`` and ``expression_below`` say
#: that the operator or one inside it has a scalar function or a computed expression
OPERATOR = ("struct<id:int,parent:int,root:int,op:string,logical:string,cost:double,rows:double,executions:double,mode:string,"
            "columnstore:boolean,spatial:boolean,computed_column:boolean,filter_function:boolean,function_on_column:boolean,"
            "leading_wildcard:boolean,function_below:boolean,expression_below:boolean>")
FACTS = (f"struct<statement_cost:double,early_aborts:array<string>,elements:map<string,int>,estimator:int,row_level_security:boolean,"
         f"operators:array<{OPERATOR}>,statistics:array<struct<updated:string,modified:bigint>>,"
         "missing:array<struct<table:string,equality:array<string>,inequality:array<string>,include:array<string>,impact:double>>,"
         "parameters:array<struct<name:string,compiled:string,runtime:string>>>")


def _reader(carried: int, kind):
    """Function over Arrow batches whose last column is the document, to facts of the Arrow type ``kind``; nested so that workers need not import this package."""
    seek = ("IndexScan", "Predicate", "ScalarOperator")
    compared = (*seek, "Compare", "ScalarOperator")
    filtered = ("Filter", "Predicate", "ScalarOperator", "Compare", "ScalarOperator", "UserDefinedFunction")
    defined = ("ComputeScalar", "DefinedValues", "DefinedValue", "ColumnReference")
    counted = ("Warnings", "PlanAffectingConvert", "ParameterList", "MissingIndexGroup", "RelOp")
    usages = {"EQUALITY": "equality", "INEQUALITY": "inequality", "INCLUDE": "include"}

    def number(text, default=None):
        try:
            return float(text)
        except (TypeError, ValueError):
            return default

    def facts(document):
        from xml.parsers import expat

        if document is None:
            return None
        out = {"statement_cost": 0.0, "early_aborts": [], "elements": dict.fromkeys(counted, 0), "estimator": None,
               "row_level_security": False, "operators": [], "statistics": [], "missing": [], "parameters": []}
        path: list[str] = []        # element names from the document's root
        open_ops: list[tuple] = []  # (operator, length of the path at it, likes seen, wildcard constants seen)
        group = {"impact": None, "usage": None}

        def start(name, attr):
            name = name.rpartition(":")[2]
            if name in out["elements"] and (name != "PlanAffectingConvert" or path[-1:] == ["Warnings"]):
                out["elements"][name] += 1
            if name == "RelOp":
                ops = out["operators"]
                parent = open_ops[-1][0] if open_ops else None
                op = {"id": len(ops), "parent": parent and parent["id"], "root": parent["root"] if parent else len(ops),
                      "op": attr.get("PhysicalOp"), "logical": attr.get("LogicalOp"), "cost": number(attr.get("EstimatedTotalSubtreeCost")),
                      "rows": number(attr.get("EstimateRows")), "mode": attr.get("EstimatedExecutionMode"),
                      "executions": number(attr.get("EstimateRewinds"), 0.0) + number(attr.get("EstimateRebinds"), 0.0) + 1.0,
                      **dict.fromkeys(("columnstore", "spatial", "computed_column", "filter_function", "function_on_column",
                                       "leading_wildcard", "function_below", "expression_below"), False)}
                ops.append(op)
                path.append(name)
                open_ops.append((op, len(path), [], []))
                return
            if open_ops:
                op, depth, likes, wild = open_ops[-1]
                here = (*path[depth:], name)
                if name == "UserDefinedFunction" and "IsClrFunction" not in attr:
                    op["function_below"] = True
                    op["filter_function"] |= here == filtered
                elif name == "ScalarOperator":
                    op["expression_below"] |= "Expr" in attr.get("ScalarString", "")
                elif name == "Object":
                    op["spatial"] |= attr.get("IndexKind") == "Spatial"
                elif name == "ColumnReference":
                    op["computed_column"] |= here == defined and attr.get("ComputedColumn") == "1"
                elif name == "IndexScan":
                    op["columnstore"] |= len(here) == 1 and attr.get("Storage") == "ColumnStore"
                elif name in ("Intrinsic", "IF") and here[:5] == compared:
                    op["function_on_column"] |= name == "IF" or "FunctionName" in attr
                if here[:3] == seek and name == "Intrinsic" and attr.get("FunctionName") == "like":
                    likes.append(1)
                if here[:3] == seek and name == "Const" and attr.get("ConstValue", "").removeprefix("N")[1:2] == "%":
                    wild.append(1)
            if name == "StmtSimple":
                out["statement_cost"] += number(attr.get("StatementSubTreeCost"), 0.0)
                if "StatementOptmEarlyAbortReason" in attr:
                    out["early_aborts"].append(attr["StatementOptmEarlyAbortReason"])
                version = number(attr.get("CardinalityEstimationModelVersion"))
                if version is not None:
                    out["estimator"] = int(version) if out["estimator"] is None else min(out["estimator"], int(version))
                out["row_level_security"] |= attr.get("SecurityPolicyApplied") == "true"
            elif name == "StatisticsInfo":
                out["statistics"].append({"updated": attr.get("LastUpdate"), "modified": int(number(attr.get("ModificationCount"), 0))})
            elif name == "MissingIndexGroup":
                group["impact"] = number(attr.get("Impact"))
            elif name == "MissingIndex":
                out["missing"].append({"table": attr.get("Table", ""), "equality": [], "inequality": [], "include": [], "impact": group["impact"]})
            elif name == "ColumnGroup":
                group["usage"] = usages.get(attr.get("Usage"))
            elif name == "Column" and path[-1:] == ["ColumnGroup"] and out["missing"] and group["usage"]:
                out["missing"][-1][group["usage"]].append(attr.get("Name"))
            elif name == "ColumnReference" and path[-1:] == ["ParameterList"]:
                out["parameters"].append({"name": attr.get("Column"), "compiled": attr.get("ParameterCompiledValue"),
                                          "runtime": attr.get("ParameterRuntimeValue")})
            path.append(name)

        def end(name):
            path.pop()
            if name.rpartition(":")[2] == "RelOp":
                op, _, likes, wild = open_ops.pop()
                op["leading_wildcard"] = bool(likes and wild)
                if open_ops:
                    for flag in ("function_below", "expression_below"):
                        open_ops[-1][0][flag] |= op[flag]

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse(document.encode("utf-8", "replace"), True)
        except expat.ExpatError:
            return None
        out["elements"] = list(out["elements"].items())
        return out

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = pa.array([facts(d) for d in b.column(carried).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:carried], found], [*b.schema.names[:carried], "facts"])

    return run


def plan_facts(plans: DataFrame, *, xml: str = "plan_xml", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the document) and ``facts``."""
    kept = [c for c in (plans.columns if keep is None else keep) if c != xml]
    src = plans.select(*kept, F.col(xml))
    facts = StructType.fromDDL(f"facts {FACTS}")["facts"].dataType
    return src.mapInArrow(_reader(len(kept), to_arrow_type(facts)), StructType([*src.schema.fields[:-1], StructField("facts", facts)]))
