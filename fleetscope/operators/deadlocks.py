"""Deadlock event analytics (DL-1 ... DL-13).

Input: parsed events ``event_id, event_ts, deadlock`` (see
:mod:`fleetscope.sources.events`).  Shredding is map-only (``explode`` of
nested arrays); every report afterwards is an aggregate on its own key.
Per-object reports join processes to lock edges on ``(event, owner)`` and
``(event, waiter)`` separately and union them -- the reference's
``id = owner OR id = waiter`` join would otherwise be a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..functions.scalar import ms_to_dhms
from ..sources.events import LOCK_KINDS, deadlock_schema
from .findings import as_findings
from .relational import row_number_in_key

EV = ["event_id", "event_ts"]


# column of DL-1: field of a process in the document
PROCESS_FIELDS = {
    "process_id": "_id", "spid": "_spid", "wait_time_ms": "_waittime", "lock_mode": "_lockMode", "status": "_status",
    "client_app": "_clientapp", "host_name": "_hostname", "login_name": "_loginname", "isolation_level": "_isolationlevel",
    "database_name": "_currentdbname", "log_used": "_logused", "transaction_name": "_transactionname", "input_buffer": "inputbuf",
    "wait_resource": "_waitresource", "priority": "_priority", "transaction_count": "_trancount",
    "last_batch_started": "_lastbatchstarted", "last_batch_completed": "_lastbatchcompleted",
    "client_option_1": "_clientoption1", "client_option_2": "_clientoption2", "is_victim": "_id", "frames": "executionStack"}
RESOURCE_FIELDS = {"object_name": "_objectname", "index_name": "_indexname", "db_id": "_dbid", "resource_mode": "_mode"}


def document_schema(*, process: Sequence[str] = (), resource: Sequence[str] = ()) -> StructType:
    """What of a document is parsed for these columns of :func:`processes` and :func:`lock_edges`."""
    return deadlock_schema(process=[PROCESS_FIELDS[c] for c in process], resource=[RESOURCE_FIELDS[c] for c in resource],
                           victims="is_victim" in process)


def _fields(parsed: DataFrame, *path: str) -> list[str]:
    kind = parsed.schema["deadlock"].dataType
    for name in path:
        kind = kind[name].dataType
    return kind.elementType.fieldNames()


def _process_columns(p: F.Column, columns: Sequence[str]) -> list[F.Column]:
    out = []
    for name, field in PROCESS_FIELDS.items():
        if name in columns and name not in ("is_victim", "frames"):
            c = p.getField(field)
            out.append((F.to_timestamp_ntz(c) if name.startswith("last_batch") else c).alias(name))
    return out


def processes(parsed: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DL-1: one row per process with its attributes and a victim flag; ``columns``: these of them (:func:`document_schema`)."""
    d, wanted = F.col("deadlock"), list(PROCESS_FIELDS) if columns is None else columns
    ids = [F.transform(d.getField("victim-list").getField("victimProcess"), lambda v: v["_id"]).alias("__victims")] if "is_victim" in wanted else []
    p = parsed.select(*EV, *ids, F.explode_outer(d.getField("process-list").getField("process")).alias("p")).filter(
        F.col("p").isNotNull())  # explode_outer: no inferred filter re-parsing the document below the explode
    out = [*EV, *_process_columns(F.col("p"), wanted)]
    if "is_victim" in wanted:
        out.append(F.coalesce(F.array_contains("__victims", F.col("p._id")), F.lit(False)).alias("is_victim"))
    if "frames" in wanted:
        out.append(F.col("p.executionStack.frame").alias("frames"))
    return p.select(*out)


def frames(procs: DataFrame) -> DataFrame:
    """DL-2: execution-stack frames with their 1-based position."""
    f = procs.select(*EV, "process_id", "database_name", F.posexplode("frames").alias("pos", "f"))
    return f.select(*EV, "process_id", "database_name", (F.col("pos") + 1).cast("long").alias("frame_no"),
                    F.col("f._procname").alias("proc_name"), F.col("f._line").alias("line"))


def _once(parsed: DataFrame) -> DataFrame:
    """Each parsed document as a row of its own: what reads several of its fields is not merged into the parse, one parse for each."""
    return parsed.select(*EV, F.explode(F.array("deadlock")).alias("deadlock"))


def _resources(parsed: DataFrame) -> F.Column:
    """The six resource arrays of a document as one, each resource ``r`` tagged with its ``kind``."""
    rl = F.col("deadlock").getField("resource-list")
    empty = F.array().cast(parsed.schema["deadlock"].dataType["resource-list"].dataType[LOCK_KINDS[0]].dataType)
    def tag(kind):
        return lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("r"))

    return F.concat(*[F.transform(F.coalesce(rl.getField(k), empty), tag(k)) for k in LOCK_KINDS])


def parties(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Processes and lock edges of one parse: a row for each process (``p``, these columns of :func:`processes`) and for each end of a document's edges
    (``e``: lock kind, object, whether this end waits), by ``event_id, process_id``.  Reports that need both read each document once,
    and rows of an event stay where its document is."""
    d = F.col("deadlock")
    end = T.StructType().add("lock_kind", "string").add("object_name", "string").add("waits", "boolean")
    one = F.struct(*_process_columns(F.col("deadlock.process-list.process")[0], columns))
    attributes = parsed.select(one.alias("p")).schema["p"].dataType

    def ends(x):
        r = x["r"]
        owners, waiters = r["owner-list"]["owner"], r["waiter-list"]["waiter"]
        def row(waits):
            return lambda a: F.struct(a["_id"].alias("process_id"), F.lit(None).cast(attributes).alias("p"), F.struct(
                x["kind"].alias("lock_kind"), r["_objectname"].alias("object_name"), F.lit(waits).alias("waits")).cast(end).alias("e"))
        return F.when((F.size(owners) > 0) & (F.size(waiters) > 0), F.array_union(
            F.transform(owners, row(False)), F.transform(waiters, row(True))))

    procs = F.transform(d.getField("process-list").getField("process"), lambda p: F.struct(
        p["_id"].alias("process_id"), F.struct(*_process_columns(p, columns)).cast(attributes).alias("p"), F.lit(None).cast(end).alias("e")))
    edges = F.flatten(F.filter(F.transform(_resources(parsed), ends), lambda x: x.isNotNull()))
    row = T.ArrayType(T.StructType().add("process_id", "string").add("p", attributes).add("e", end))
    rows = F.concat(F.coalesce(procs.cast(row), F.array().cast(row)), F.coalesce(edges.cast(row), F.array().cast(row)))
    return _once(parsed).select("event_id", F.explode_outer(rows).alias("x")).filter(F.col("x").isNotNull()).select("event_id", "x.*")


def lock_edges(parsed: DataFrame) -> DataFrame:
    """DL-3: owner -> waiter edges of all lock kinds in one pass (the six
    resource arrays are tagged and concatenated, then exploded once; owners
    x waiters of one resource is the edge set of that resource)."""
    have = _fields(parsed, "resource-list", LOCK_KINDS[0])
    named = {n: f for n, f in RESOURCE_FIELDS.items() if f in have}
    res = _once(parsed).select(*EV, F.explode_outer(_resources(parsed)).alias("x")).filter(F.col("x").isNotNull())
    res = res.select(*EV, F.col("x.kind").alias("lock_kind"), *[F.col(f"x.r.{f}").alias(n) for n, f in named.items()],
                     F.col("x.r").getField("owner-list").getField("owner").alias("owners"),
                     F.col("x.r").getField("waiter-list").getField("waiter").alias("waiters"))
    e = res.select("*", F.explode("owners").alias("o")).select("*", F.explode("waiters").alias("w"))
    return e.select(*EV, "lock_kind", *named,
                    F.col("o._id").alias("owner_id"), F.col("o._mode").alias("owner_mode"),
                    F.col("w._id").alias("waiter_id"), F.col("w._mode").alias("waiter_mode"))


def denoise_edges(edges: DataFrame) -> DataFrame:
    """DL-4 / WN-11: drop self edges; of duplicate edges (same event, object,
    owner, waiter) keep the first by lock kind and modes."""
    e = edges.filter(F.col("owner_id") != F.col("waiter_id"))
    w = Window.partitionBy("event_id", "object_name", "owner_id", "waiter_id").orderBy(
        "lock_kind", "owner_mode", "waiter_mode")
    return e.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def label_objects(edges: DataFrame) -> DataFrame:
    """DL-5: database / schema / table from the object name and an index
    label, ``HEAP`` for RID locks or missing index names."""
    parts = F.split("object_name", r"\.")
    return edges.select(
        "*", F.element_at(parts, 1).alias("object_database"), F.element_at(parts, 2).alias("object_schema"),
        F.element_at(parts, -1).alias("object_table"),
        F.when((F.col("lock_kind") == "ridlock") | F.col("index_name").isNull(), F.lit("HEAP"))
        .otherwise(F.col("index_name")).alias("index_label"))


def label_by_partition(edges: DataFrame, partitions: DataFrame, *, broadcast_rows: int = 100_000) -> DataFrame:
    """DL-5: lock edges that name no object take schema and table from the catalog, by database and the lock's partition id
    (``hobt_id``); an id the catalog does not know stays without a name.  ``partitions``: ``db_id, partition_id, schema_name,
    table_name`` (one row per id).  The catalog is counted first: up to ``broadcast_rows`` it is sent to the edges, which then stay
    where their documents are; a larger one is joined by exchange."""
    p = partitions.select(F.col("db_id").alias("__db"), F.col("partition_id").alias("__p"), "schema_name", "table_name")
    if p.limit(broadcast_rows + 1).count() <= broadcast_rows:
        p = F.broadcast(p)
    j = edges.join(p, (F.col("db_id") == F.col("__db")) & (F.col("hobt_id") == F.col("__p")), "left")
    found = F.concat(F.col("schema_name"), F.lit("."), F.col("table_name"))
    return j.select(*[c for c in edges.columns if c != "object_name"], F.coalesce("object_name", found).alias("object_name"))


def _events_per(df: DataFrame, keys, name="deadlocks"):
    return df.groupBy(*keys).agg(F.count_distinct("event_id").cast("long").alias(name))


def totals_by_database(procs: DataFrame) -> DataFrame:
    """DL-6 check 1: deadlocks per database."""
    return _events_per(procs, ["database_name"])


def selects_by_database(edges: DataFrame) -> DataFrame:
    """DL-6 check 2: deadlocks with a reading lock (resource or owner mode S
    or IS) per database of the locked object."""
    reads = label_objects(edges).filter(F.col("resource_mode").isin("S", "IS") | F.col("owner_mode").isin("S", "IS"))
    return _events_per(reads.withColumnRenamed("object_database", "database_name"), ["database_name"], "select_deadlocks")


def totals_by_object(edges: DataFrame) -> DataFrame:
    """DL-6 check 3: deadlocks per object and index label."""
    return _events_per(label_objects(edges), ["object_name", "index_label"])


def by_isolation_level(procs: DataFrame) -> DataFrame:
    """DL-7 checks 4/5: deadlocks with a serializable / repeatable-read participant."""
    p = procs.withColumn("check_id", F.when(F.col("isolation_level").startswith("serializable"), F.lit(4))
                         .when(F.col("isolation_level").startswith("repeatable read"), F.lit(5)))
    return _events_per(p.filter(F.col("check_id").isNotNull()), ["database_name", "check_id"])


def by_login_app_host(procs: DataFrame) -> DataFrame:
    """DL-8 check 6: deadlocks per (database, login, application, host)."""
    return _events_per(procs, ["database_name", "login_name", "client_app", "host_name"])


def _joined(rows: DataFrame, processes: F.Column, ends: F.Column) -> DataFrame:
    """Equi-join of processes and edge ends of the rows of :func:`parties` on event and process: both sides of a key meet in one group."""
    g = rows.filter(F.col("event_id").isNotNull() & F.col("process_id").isNotNull()).groupBy("event_id", "process_id").agg(
        processes.alias("ps"), F.collect_set(F.when(ends, F.struct("e.object_name"))).alias("os"))
    return g.select("event_id", F.explode("ps").alias("p"), "os").select("event_id", "p.*", F.explode("os").alias("o")).select("*", "o.object_name").drop("o")


def process_objects(rows: DataFrame) -> DataFrame:
    """JN-10: processes with the objects they own or wait on, each process id and object of an event once
    (rows of :func:`parties`; an equi-join by process, never an OR join)."""
    return _joined(rows, F.array_compact(F.array(F.min("p"))), F.col("e").isNotNull())


def lock_type_breakdown(rows: DataFrame) -> DataFrame:
    """DL-9 check 7: per database and object ``"n TYPE, n TYPE"``: deadlocks per
    lock type (the wait resource up to its colon), sorted by type (rows of :func:`parties`)."""
    kind = F.split("wait_resource", ":").getItem(0)
    po = process_objects(rows).filter(F.col("object_name").isNotNull()).withColumn("lock_type", kind)
    g = po.groupBy("database_name", "object_name", "lock_type").agg(F.count_distinct("event_id").cast("long").alias("n"))
    s = g.groupBy("database_name", "object_name").agg(F.sort_array(F.collect_list(F.struct("lock_type", "n"))).alias("l"))
    return s.select("database_name", "object_name", F.array_join(F.transform(
        "l", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["lock_type"])), ", ").alias("lock_types"))


def proc_counts(frame_rows: DataFrame) -> DataFrame:
    """DL-10 check 9: deadlocks per procedure of the stack (ad hoc frames
    skipped; frames of unknown name are kept)."""
    return _events_per(frame_rows.filter(F.col("proc_name") != "adhoc"), ["database_name", "proc_name"])


def agent_job_counts(procs: DataFrame) -> DataFrame:
    """DL-10 check 13: deadlocks per agent job id and step parsed from the
    client application name."""
    pat = r"SQLAgent - TSQL JobStep \(Job (0x[0-9A-Fa-f]+) : Step (\d+)\)"
    p = procs.select("event_id", F.regexp_extract("client_app", pat, 1).alias("job_id"),
                     F.regexp_extract("client_app", pat, 2).cast("long").alias("step_id")).filter(F.col("job_id") != "")
    return _events_per(p, ["job_id", "step_id"])


def wait_by_object(rows: DataFrame) -> DataFrame:
    """DL-11 check 11: total wait of waiting processes per object, exact
    integer milliseconds and ``d hh:mm:ss`` (rows of :func:`parties`)."""
    j = _joined(rows, F.collect_list("p"), F.col("e.waits"))
    g = j.groupBy("object_name").agg(F.sum("wait_time_ms").cast("long").alias("total_wait_ms"),
                                     F.count_distinct("event_id").cast("long").alias("deadlocks"))
    return g.withColumn("total_wait", ms_to_dhms("total_wait_ms"))


def wait_by_database(procs: DataFrame) -> DataFrame:
    """DL-11 check 12: total wait per database."""
    g = procs.groupBy("database_name").agg(F.sum("wait_time_ms").cast("long").alias("total_wait_ms"),
                                           F.count_distinct("event_id").cast("long").alias("deadlocks"))
    return g.withColumn("total_wait", ms_to_dhms("total_wait_ms"))


# Check id and title of the totals.
TOTALS = [(14, "Total parallel deadlocks"), (15, "Total deadlocks involving sleeping sessions"),
          (15, "Total deadlocks involving background processes"), (14, "Total implicit transaction deadlocks")]


def special_participants(rows: DataFrame) -> DataFrame:
    """DL-12 checks 14/15: four totals over all deadlocks as findings: parallel
    (exchange events), with sleeping sessions, with background processes, in implicit transactions (rows of :func:`parties`)."""
    marks = [F.col("e.lock_kind") == "exchangeEvent", F.col("p.status") == "sleeping", F.col("p.status") == "background",
             F.col("p.transaction_name") == "implicit_transaction"]
    per = rows.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(*[F.bool_or(m).alias(f"m{k}") for k, m in enumerate(marks)])
    one = per.agg(*[F.count_if(f"m{k}").cast("long").alias(f"c{k}") for k in range(len(marks))])
    totals = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(t).alias("finding"), F.col(f"c{k}").alias("deadlocks"))
                       for k, (i, t) in enumerate(TOTALS)])
    u = one.select(F.explode(totals).alias("r")).select("r.*").filter(F.col("deadlocks") > 0)
    return as_findings(u, check_id=F.col("check_id"), priority=100, group="Deadlocks", finding=F.col("finding"),
                       details=F.concat(F.col("deadlocks").cast("string"), F.lit(" deadlocks")), value=F.col("deadlocks"),
                       server=None, database=None)


def incident_report(procs: DataFrame, *, events: DataFrame | None = None) -> DataFrame:
    """DL-13: incident number (dense rank of events by time, id) and
    participant ordinal within the incident, victim flag.

    The events are numbered over ranges of equal depth
    (:func:`~fleetscope.operators.relational.row_number_in_key`), so no task sorts all events and a burst of
    events inside one second is split like any other stretch.  ``events``: rows that name the same events (id and time),
    such as the rows the processes were shredded from; they are numbered without parsing a document."""
    ev = (procs if events is None else events).select(*EV).distinct()
    inc = row_number_in_key(ev, by=[], order="event_ts", tie=["event_id"]).select(*EV, F.col("__rn").alias("incident"))
    w = Window.partitionBy("event_id").orderBy(F.col("is_victim").desc(), F.col("process_id"))
    p = procs.select(*EV, "process_id", "database_name", "login_name", "is_victim",
                     F.row_number().over(w).cast("long").alias("participant"))
    return p.join(inc, EV)
