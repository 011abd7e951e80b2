"""JSON documents, statement text and event-sourced state (DOC-1 ... DOC-5,
PRJ-6, QS-14, SRC-6).  All JSON work is ``get_json_object`` / ``from_json``
/ ``to_json`` -- JVM expressions, no Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.scalar import statement_text


def json_paths(df: DataFrame, *, doc: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """DOC-1: typed values at JSON paths plus the number of top-level keys;
    ``paths`` maps output name -> (JSON path, Spark type)."""
    cols = [F.get_json_object(F.col(doc), p).cast(t).alias(n) for n, (p, t) in paths.items()]
    return df.select("*", *cols, F.size(F.json_object_keys(F.col(doc))).cast("long").alias("key_count"))


LINE_SCHEMA = ArrayType(StructType([StructField("line", LongType()), StructField("part", LongType()),
                                    StructField("qty", LongType()), StructField("price_cents", LongType())]))


def order_documents(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """DOC-3: one JSON document per order with its lines (``to_json`` of a
    struct holding the sorted line array); lines are bounded per order."""
    li = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("line", "part", "qty", "price_cents")))
                                       .alias("items"))
    j = orders.join(li, "order_id")
    return j.select("order_id", F.to_json(F.struct(F.col("order_id").alias("id"), F.col("status"),
                                                   F.col("items"))).alias("doc"))


def document_lines(docs: DataFrame, *, doc: str = "doc") -> DataFrame:
    """DOC-2: JSON array of line objects to typed rows with line totals."""
    items = F.from_json(F.get_json_object(F.col(doc), "$.items"), LINE_SCHEMA)
    e = docs.select("order_id", F.explode_outer(items).alias("i")).filter(F.col("i").isNotNull())
    return e.select("order_id", "i.line", "i.part", "i.qty", "i.price_cents",
                    (F.col("i.qty") * F.col("i.price_cents")).alias("line_total_cents"))


def current_state(events: DataFrame, *, entity: str, ts: str, tie: str, payload: str,
                  types: Sequence[str] | None = None, type_col: str = "event_type",
                  fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """DOC-4: event-sourced entity state: latest payload per entity (by
    time, then id) among the wanted event types, with extracted fields."""
    e = events if not types else events.filter(F.col(type_col).isin(list(types)))
    g = e.groupBy(entity).agg(F.max_by(F.struct(F.col(payload).alias("payload"), F.col(type_col).alias("last_type"),
                                                F.col(ts).alias("last_ts")), F.struct(F.col(ts), F.col(tie))).alias("s"),
                              F.count(F.lit(1)).cast("long").alias("events"))
    out = g.select(entity, "s.payload", "s.last_type", "s.last_ts", "events")
    for n, (p, t) in (fields or {}).items():
        out = out.withColumn(n, F.get_json_object("payload", p).cast(t))
    return out


def read_model(events: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """DOC-5: denormalised, pre-aggregated read model (counts, sums) kept
    apart from the write table; the streaming variant maintains it per
    micro-batch."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("events"),
                                     F.round(F.sum(value), 2).alias("total_value"))


def statements(df: DataFrame, *, text: str = "text", start: str = "start_off", end: str = "end_off") -> DataFrame:
    """PRJ-6: the current statement cut out of a batch text by byte offsets."""
    return df.withColumn("statement", statement_text(text, start, end))


# Fixed values: (label, LIKE pattern) for statement classification; first match wins.
WORKLOAD_PATTERNS = [("Write", "insert%"), ("Write", "update%"), ("Write", "delete%"), ("Write", "merge%"),
                     ("Read", "select%"), ("Maintenance", "alter index%"), ("Maintenance", "dbcc%")]


def classify_text(df: DataFrame, *, text: str = "text", patterns=WORKLOAD_PATTERNS, default: str = "Other") -> DataFrame:
    """QS-14 (by text): case-insensitive LIKE ladder on the trimmed text."""
    t = F.lower(F.ltrim(F.col(text)))
    expr = None
    for label, pat in patterns:
        c = t.like(pat)
        expr = F.when(c, F.lit(label)) if expr is None else expr.when(c, F.lit(label))
    return df.withColumn("workload", expr.otherwise(F.lit(default)))


def classify_stats(stats: DataFrame, *, per_day: str = "executions_per_day", latency: str = "avg_duration",
                   freq_high: float = 100.0, slow_ms: float = 1000.0) -> DataFrame:
    """QS-14 (by frequency/latency): OLTP = frequent and fast, Reporting =
    rare and slow, Batch = frequent and slow, else Ad hoc."""
    f, s = F.col(per_day) >= freq_high, F.col(latency) >= slow_ms
    return stats.withColumn("workload", F.when(f & ~s, "OLTP").when(~f & s, "Reporting").when(f & s, "Batch")
                            .otherwise("Ad hoc"))


def split_rows(df: DataFrame, *, col: str, sep: str, key: Sequence[str]) -> DataFrame:
    """SRC-6 / ST-8: delimited text to one trimmed, non-empty item per row with its position."""
    from ..sources.tables import explode_list

    return explode_list(df.select(*key, col), col, out="item", sep=sep).drop(col)

