"""Deadlock / extended-event XML sources (SRC-2, SRC-3, SRC-4).

The XML is parsed against a *declared* schema (no inference pass over
the data; attributes map to ``_name`` fields), inside the executors, so
parsing scales with the number of files / partitions: by ``from_xml``, or
plain documents column by column (:mod:`.plainxml`) and the others by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .plainxml import read_plain

LOCK_KINDS = ["keylock", "pagelock", "objectlock", "ridlock", "rowgrouplock", "exchangeEvent"]


def _s(*fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


FRAME = _s(("_procname", StringType()), ("_line", LongType()))
PROCESS = _s(
    ("_id", StringType()), ("_spid", LongType()), ("_waittime", LongType()), ("_lockMode", StringType()),
    ("_status", StringType()), ("_clientapp", StringType()), ("_hostname", StringType()),
    ("_loginname", StringType()), ("_isolationlevel", StringType()), ("_currentdbname", StringType()),
    ("_logused", LongType()), ("_transactionname", StringType()), ("_waitresource", StringType()),
    ("_priority", LongType()), ("_trancount", LongType()), ("_lastbatchstarted", StringType()),
    ("_lastbatchcompleted", StringType()), ("_clientoption1", LongType()), ("_clientoption2", LongType()),
    ("executionStack", _s(("frame", ArrayType(FRAME)))), ("inputbuf", StringType()),
)
PARTY = _s(("_id", StringType()), ("_mode", StringType()))
RESOURCE = _s(
    ("_objectname", StringType()), ("_indexname", StringType()), ("_dbid", LongType()), ("_mode", StringType()),
    ("owner-list", _s(("owner", ArrayType(PARTY)))), ("waiter-list", _s(("waiter", ArrayType(PARTY)))),
)
DEADLOCK_SCHEMA = _s(
    ("victim-list", _s(("victimProcess", ArrayType(_s(("_id", StringType())))))),
    ("process-list", _s(("process", ArrayType(PROCESS)))),
    ("resource-list", StructType([StructField(k, ArrayType(RESOURCE)) for k in LOCK_KINDS])),
)
EVENT_SCHEMA = _s(
    ("_name", StringType()), ("_timestamp", StringType()),
    ("data", _s(("_name", StringType()), ("value", _s(("deadlock", DEADLOCK_SCHEMA))))),
)


def deadlock_schema(*, process: Sequence[str] = (), resource: Sequence[str] = (), victims: bool = False) -> StructType:
    """The part of :data:`DEADLOCK_SCHEMA` that a report reads: these fields of each process and resource.  Converting values is
    most of a parse, so a document is parsed for the fields in use only.  Numbers of processes are always parsed: a value that is
    none spoils the same documents for every report."""
    def some(kind, names):
        return StructType([f for f in kind.fields if isinstance(f.dataType, LongType) or f.name in names])

    whole = {f.name: f for f in DEADLOCK_SCHEMA.fields}
    one = some(PROCESS, process)
    if "executionStack" not in process:
        one = one.add("executionStack", _s(("frame", ArrayType(some(FRAME, ())))))
    out = [whole["victim-list"]] if victims else []
    out.append(StructField("process-list", _s(("process", ArrayType(one)))))
    if resource:
        kind = some(RESOURCE, {*resource, "owner-list", "waiter-list"})
        out.append(StructField("resource-list", StructType([StructField(k, ArrayType(kind)) for k in LOCK_KINDS])))
    return StructType(out)


# where a document has its ``deadlock``
DEADLOCK_PATHS = [("deadlock",), ("event", "data", "value", "deadlock")]


def deadlock_struct(xml: Column, schema: StructType = DEADLOCK_SCHEMA) -> Column:
    """SRC-4: one parsed ``deadlock`` struct whatever the document root is:
    a bare ``<deadlock>`` or an ``<event>`` wrapping one."""
    bare = F.ltrim(xml).startswith("<deadlock")
    event = _s(("data", _s(("value", _s(("deadlock", schema))))))
    return F.when(bare, F.from_xml(xml, schema)).otherwise(
        F.from_xml(xml, event).getField("data").getField("value").getField("deadlock"))


def element_struct(xml: Column, schema: StructType, root: str) -> Column:
    """``from_xml`` of documents that mostly have the root ``root``; plain ones are read in Arrow batches."""
    plain = read_plain(xml, schema, [(root,)])
    if plain is None:
        return F.from_xml(xml, schema)
    return F.when(plain.getField("read"), plain.getField("found")).otherwise(F.from_xml(plain.getField("left"), schema))


def event_timestamp(xml: Column) -> Column:
    """Timestamp attribute of an ``<event>`` root (NULL for bare deadlocks)."""
    ts = F.from_xml(xml, _s(("_timestamp", StringType()))).getField("_timestamp")
    return F.to_timestamp_ntz(ts)


def parse_deadlocks(df: DataFrame, *, xml: str = "event_xml", ts: str | None = "event_ts",
                    schema: StructType = DEADLOCK_SCHEMA, batches: bool = False) -> DataFrame:
    """SRC-3: a table with an XML column (and optionally a timestamp column)
    to one parsed row per event; other columns are carried through.  ``schema``: what is
    parsed of a deadlock (:func:`deadlock_schema`).  ``batches``: plain documents are read in Arrow batches
    (:func:`~fleetscope.sources.plainxml.read_plain`) at a fraction of the time and ``from_xml`` parses the others, with
    the same result; Spark does not know of rows that come from a batch by which key they are partitioned."""
    keep = [c for c in df.columns if c != xml]
    plain = read_plain(F.col(xml), schema, DEADLOCK_PATHS) if batches else None
    if plain is None:
        parsed = deadlock_struct(F.col(xml), schema)
    else:
        parsed = F.when(plain.getField("read"), plain.getField("found")).otherwise(deadlock_struct(plain.getField("left"), schema))
    out = df.select(*keep, parsed.alias("deadlock"))
    if ts is None:
        out = out.withColumn("event_ts", event_timestamp(F.col(xml)))
    return out


def read_events(spark: SparkSession, path: str, *, row_tag: str = "event") -> DataFrame:
    """SRC-2: event files of XML events, one record per ``row_tag`` element,
    read by the XML data source with the declared schema."""
    schema = EVENT_SCHEMA if row_tag == "event" else DEADLOCK_SCHEMA
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    no_id = F.lit(None).cast("long").alias("event_id")
    if row_tag == "event":
        return df.select(no_id, F.to_timestamp_ntz("_timestamp").alias("event_ts"),
                         F.col("data.value.deadlock").alias("deadlock"))
    return df.select(no_id, F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.struct(*df.columns).alias("deadlock"))
