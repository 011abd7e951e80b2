"""Rule engine (RL-1 ... RL-4).

A rule is data: ``(check_id, priority, findings_group, finding, predicate,
details, value)`` where ``predicate``/``details``/``value`` are Spark SQL
expressions over the fact table.  All rules of one fact table are evaluated
in a **single scan**: each rule becomes one ``CASE WHEN predicate THEN
struct(...)`` element of an array that is compacted and exploded -- a
map-only stage with no shuffle, however many rules there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDING_COLUMNS


@dataclass(frozen=True)
class Rule:
    check_id: int
    priority: int
    findings_group: str
    finding: str
    predicate: str
    details: str = "NULL"
    value: str = "NULL"


def run_rules(facts: DataFrame, rules: Sequence[Rule], *, server: str | None = "server_name",
              database: str | None = "database_name", ts: str | None = None) -> DataFrame:
    """RL-1: evaluate every rule on every fact row in one pass; returns
    FINDING_SCHEMA rows for the rules that fire."""
    items = []
    for r in rules:
        items.append(F.when(F.expr(r.predicate), F.struct(
            F.lit(r.check_id).cast("int").alias("check_id"),
            F.lit(r.priority).cast("int").alias("priority"),
            F.lit(r.findings_group).alias("findings_group"),
            F.lit(r.finding).alias("finding"),
            F.expr(r.details).cast("string").alias("details"),
            F.expr(r.value).cast("double").alias("value"))))
    keys = [
        (F.col(server).cast("string") if server else F.lit(None).cast("string")).alias("server_name"),
        (F.col(database).cast("string") if database else F.lit(None).cast("string")).alias("database_name"),
        (F.col(ts).cast("timestamp_ntz") if ts else F.lit(None).cast("timestamp_ntz")).alias("check_ts"),
    ]
    # explode_outer + filter: a plain explode lets the optimizer infer a
    # size() > 0 filter and push it below, evaluating every rule twice
    out = facts.select(*keys, F.explode_outer(F.array_compact(F.array(*items))).alias("f")).filter(
        F.col("f").isNotNull())
    return out.select("server_name", "database_name", "check_ts", "f.*").select(*FINDING_COLUMNS)


def apply_skip_list(findings: DataFrame, skips: DataFrame) -> DataFrame:
    """RL-2: drop findings listed in ``skips(database_name, check_id)``; a
    NULL ``database_name`` skips the check everywhere, a NULL ``check_id``
    skips the whole database.  Three equi anti joins instead of one
    OR-condition (which would be a nested-loop join)."""
    s = skips.select("database_name", "check_id")
    both = s.filter(F.col("database_name").isNotNull() & F.col("check_id").isNotNull())
    any_db = s.filter(F.col("database_name").isNull() & F.col("check_id").isNotNull()).select("check_id")
    any_check = s.filter(F.col("check_id").isNull() & F.col("database_name").isNotNull()).select("database_name")
    out = findings.join(both, ["database_name", "check_id"], "left_anti")
    out = out.join(any_db, ["check_id"], "left_anti")
    return out.join(any_check, ["database_name"], "left_anti").select(*findings.columns)


def priority_summary(findings: DataFrame) -> DataFrame:
    """RL-3: occurrences per priority and group (and distinct findings)."""
    return findings.groupBy("priority", "findings_group").agg(
        F.count(F.lit(1)).cast("long").alias("occurrences"),
        F.count_distinct("finding").cast("long").alias("distinct_findings"))


def filter_findings(findings: DataFrame, *, max_priority: int | None = None,
                    exclude_groups: Sequence[str] = ()) -> DataFrame:
    """RL-4: keep priorities up to ``max_priority`` (lower is more urgent) and
    drop excluded groups."""
    out = findings
    if max_priority is not None:
        out = out.filter(F.col("priority") <= max_priority)
    if exclude_groups:
        out = out.filter(~F.col("findings_group").isin(list(exclude_groups)))
    return out
