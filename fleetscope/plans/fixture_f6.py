"""deadlock event documents rendered from ``orders`` x ``lineitem``.

One order = one deadlock event, its lines = processes (numbered in
the order of every lineitem column, since ``(l_orderkey, l_linenumber)`` is
not unique), resource ``i`` is owned by process ``i`` and
waited on by process ``i % n + 1`` (a cycle), the last process is the
victim.  Even event ids use a bare ``<deadlock>`` root, odd ones an
``<event>`` wrapper, so both source shapes are exercised.  The oracle works
from the same numbered rows, so parse(render(rows)) = rows is what is tested.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import LOCK_KINDS
from .fixtures import _t

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


# lines that a task joins, sorts and gathers, about
LINES_EACH = 250_000
# events whose documents are rendered together
EVENTS_EACH = 1_000

WAIT_RESOURCES = ["KEY", "PAGE", "OBJECT", "RID", "ROWGROUP", "APPLICATION"]


def _said(c: Column) -> Column:
    """Text of a value in a document; NULL is said."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def _one_of(names: list[str], n: Column) -> Column:
    """The name at ``n`` (from 0); NULL takes the last."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.coalesce((n + 1).cast("int"), F.lit(-1)))


def _tag(name: str, attributes: dict[str, Column], end: str = ">") -> list[Column]:
    out = [F.lit(f"<{name}")]
    for a, c in attributes.items():
        out += [F.lit(f' {a}="'), c, F.lit('"')]
    return [*out, F.lit(end)]


def _pid(i: Column) -> Column:
    return F.concat(F.lit("process"), F.col("event_id").cast("string"), F.lit("_"), i.cast("string"))


def _lock_mode(x: Column) -> Column:
    return _one_of(["S", "U", "X", "IX"], x["l_partkey"] % 4)


def _db(x: Column) -> Column:
    return F.concat(F.lit("db"), (x["o_custkey"] % 50).cast("string"))


def _tbl(x: Column) -> Column:
    return (x["l_suppkey"] % 10).cast("string")


def _process(x: Column, i: Column) -> Column:
    """``<process>`` of the line ``x``, the ``i``-th of its event."""
    part, tbl, spid = x["l_partkey"], _tbl(x), i + 50
    at = _said(F.col("at"))
    said = {
        "id": _pid(i), "spid": spid, "waittime": x["l_quantity"].cast("long") * 100, "lockMode": _lock_mode(x),
        "status": F.when(i % 7 == 0, "background").when(i % 5 == 0, "sleeping").otherwise("suspended"),
        "clientapp": F.when(part % 8 == 0, F.concat(F.lit("SQLAgent - TSQL JobStep (Job 0x"), F.hex(x["l_suppkey"]), F.lit(" : Step "),
                                                   i.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("app"), (x["l_suppkey"] % 5).cast("string"))),
        "hostname": F.concat(F.lit("host"), (x["l_suppkey"] % 7).cast("string")),
        "loginname": F.concat(F.lit("login"), (x["o_custkey"] % 25).cast("string")),
        "isolationlevel": _one_of(["read committed (2)", "serializable (4)", "repeatable read (3)"], x["l_linenumber"] % 3),
        "currentdbname": _db(x), "logused": F.floor(x["l_extendedprice"]).cast("long"),
        "transactionname": F.when(part % 9 == 0, "implicit_transaction").otherwise("user_transaction"),
        "waitresource": F.concat(_one_of(WAIT_RESOURCES, i % 6), F.lit(": "), (x["o_custkey"] % 50).cast("string"), F.lit(":"),
                                 part.cast("string")),
        "priority": i % 3 - 1, "trancount": i % 4, "lastbatchstarted": at, "lastbatchcompleted": at,
        "clientoption1": spid * 2, "clientoption2": spid * 3}
    proc = F.when(part % 10 == 3, "adhoc").otherwise(F.concat(_db(x), F.lit(".dbo.usp_proc"), (part % 20).cast("string")))
    buffer = F.when(x["l_returnflag"] == "R", F.concat(F.lit("SELECT * FROM tbl"), tbl)).otherwise(
        F.concat(F.lit("UPDATE tbl"), tbl, F.lit(" SET x = 1")))
    return F.concat(*_tag("process", {a: _said(c) for a, c in said.items()}), F.lit("<executionStack>"),
                    *_tag("frame", {"procname": _said(proc), "line": _said(x["l_linenumber"])}, "/>"),
                    F.lit('<frame procname="unknown" line="1"/></executionStack><inputbuf>'), _said(buffer), F.lit("</inputbuf></process>"))


def _resource(x: Column, i: Column, n: Column) -> Column:
    """Resource that process ``i`` owns and process ``i % n + 1`` waits for; NULL if a value of it is."""
    kind = _one_of(LOCK_KINDS, i % 6)
    index = F.when(kind == "ridlock", F.lit("")).otherwise(
        F.coalesce(F.concat(F.lit(' indexname="ix_'), (x["l_partkey"] % 5).cast("string"), F.lit('"')), F.lit("")))
    return F.concat(
        F.lit("<"), kind, F.lit(' objectname="'), _db(x), F.lit(".dbo.tbl"), _tbl(x), F.lit('"'), index, F.lit(' dbid="'),
        (x["o_custkey"] % 50).cast("string"), F.lit('" mode="'), _lock_mode(x), F.lit('"><owner-list><owner id="'), _pid(i),
        F.lit('" mode="'), _lock_mode(x), F.lit('"/></owner-list><waiter-list><waiter id="'), _pid(i % n + 1),
        F.lit('" mode="U" requestType="wait"/></waiter-list></'), kind, F.lit(">"))


def _event_ts(date: Column) -> Column:
    return date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 86400).cast("decimal(18,6)"))


def _dealt(li: DataFrame, o: DataFrame) -> DataFrame:
    """Lines with their order, dealt by order over partitions of about :data:`LINES_EACH` lines, however few the session shuffles into:
    what a task sorts stays in its memory as the tables grow."""
    n = math.ceil(li.count() / LINES_EACH)
    n = max(n, li.sparkSession.sparkContext.defaultParallelism)
    li = li.filter(F.col("l_orderkey").isNotNull()).repartition(n, "l_orderkey")
    o = o.filter(F.col("o_orderkey").isNotNull()).repartition(n, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def f6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, event_ts, at, n, lines``: the lines of an event (numbered by ``i`` among the ``n`` of their order) as they are in
    the tables, so that what is shuffled and sorted holds no text of a document."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    g = _dealt(li, o).groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "o_custkey", "o_orderdate"))).alias("l"))
    g = g.filter(F.size("l") >= 2)
    # one event for each date of the order
    d = g.select("event_id", "l", F.explode(F.array_distinct(F.transform("l", lambda x: x["o_orderdate"]))).alias("date"))
    numbered = F.transform("l", lambda x, at: F.struct((at + 1).cast("long").alias("i"), x.alias("x")))
    ts = _event_ts(F.col("date"))
    return d.select("event_id", ts.alias("event_ts"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.size("l").cast("long").alias("n"),
                    F.filter(numbered, lambda y: y["x"]["o_orderdate"].eqNullSafe(F.col("date"))).alias("lines"))


def f6_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, event_ts`` of the events, without their lines."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    g = _dealt(li, o).groupBy(F.col("l_orderkey").alias("event_id"), F.col("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("c"))
    n = g.groupBy("event_id").agg(F.collect_list(F.struct("date")).alias("dates"), F.sum("c").alias("n")).filter(F.col("n") >= 2)
    return n.select("event_id", F.explode("dates").alias("d")).select("event_id", _event_ts(F.col("d.date")).alias("event_ts"))


def f6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, event_ts, event_xml`` -- one XML document per event."""
    n = F.col("n")
    victims = F.transform(F.filter("lines", lambda y: y["i"] == n), lambda y: F.concat(*_tag("victimProcess", {"id": _pid(y["i"])}, "/>")))
    deadlock = F.concat(
        F.lit("<deadlock><victim-list>"), F.array_join(victims, ""), F.lit("</victim-list><process-list>"),
        F.array_join(F.transform("lines", lambda y: _process(y["x"], y["i"])), ""), F.lit("</process-list><resource-list>"),
        F.array_join(F.transform("lines", lambda y: _resource(y["x"], y["i"], n)), ""), F.lit("</resource-list></deadlock>"))
    event = F.concat(F.lit('<event name="xml_deadlock_report" timestamp="'), F.col("at"), F.lit('"><data name="xml_report"><value>'), deadlock, F.lit("</value></data></event>"))
    return f6_lines(spark, sf_dir).select("event_id", "event_ts",
                                          F.when(F.col("event_id") % 2 == 0, deadlock).otherwise(event).alias("event_xml"))


def _rendered(event_id, at, n, lines):
    """Documents of events (Arrow arrays): the texts of all lines are put together column by column.  NULL of an attribute is said; a
    resource that lacks a value is left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def join(*pieces):
        return pc.binary_join_element_wise(*pieces, "")

    def number(c):
        return c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.is_valid().to_numpy(zero_copy_only=False)

    def text(x, valid=None):
        return pa.array(x, mask=None if valid is None else ~valid).cast(pa.string())

    def rest(x, k):
        """Text of the rest of a number and its validity."""
        return text(np.fmod(x[0], k), x[1])

    def one_of(names, x):
        """The name at ``x`` (from 0; below, from the end); NULL takes the last."""
        at, valid = x
        if (valid & (at == -1)).any():
            raise ValueError("a name at -1")
        return pa.array(names).take(pa.array(np.where(valid, np.where(at >= 0, at, at + 1), -1) % len(names)))

    def tag(name, attributes, end=">"):
        out = [f"<{name}"]
        for a, c in attributes.items():
            out += [f' {a}="', c, '"']
        return [*out, end]

    def together(texts, counts):
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "")

    counts = lines.value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lines)), counts)
    line = dict(zip(lines.type.value_type.names, lines.flatten().flatten()))
    part, supplier, customer, numbered = (number(line[c]) for c in ("l_partkey", "l_suppkey", "o_custkey", "l_linenumber"))
    i, many = number(line["i"])[0], n.to_numpy(zero_copy_only=False)[owner]
    when = at.take(pa.array(owner))
    key = event_id.cast(pa.string()).take(pa.array(owner))

    def process_id(x):
        return join("process", key, "_", text(x))

    def modulo(x, k):
        return np.fmod(x[0], k), x[1]

    pid, sixth, sure = process_id(i), i % 6, np.ones(len(i), bool)
    table, db_id = rest(supplier, 10), rest(customer, 50)
    db, lock_mode = join("db", db_id), one_of(["S", "U", "X", "IX"], modulo(part, 4))
    agent = part[1] & (np.fmod(part[0], 8) == 0)
    app = join("app", rest(supplier, 5))
    if agent.any():
        some = np.flatnonzero(agent)
        job, at_job = np.unique(supplier[0][some], return_inverse=True)
        job = pa.array([f"{x & 0xFFFFFFFFFFFFFFFF:X}" for x in job.tolist()]).take(pa.array(at_job, mask=~supplier[1][some]))
        job = join("SQLAgent - TSQL JobStep (Job 0x", job, " : Step ", text(i[some]), ")")
        app = pc.replace_with_mask(app, pa.array(agent), job)
    said = {
        "id": pid, "spid": text(i + 50), "waittime": line["wait_ms"].cast(pa.string()), "lockMode": lock_mode,
        "status": pa.array(["suspended", "sleeping", "background"]).take(pa.array(np.where(i % 7 == 0, 2, np.where(i % 5 == 0, 1, 0)))),
        "clientapp": app, "hostname": join("host", rest(supplier, 7)), "loginname": join("login", rest(customer, 25)),
        "isolationlevel": one_of(["read committed (2)", "serializable (4)", "repeatable read (3)"], modulo(numbered, 3)),
        "currentdbname": db, "logused": line["log_used"].cast(pa.string()),
        "transactionname": pa.array(["user_transaction", "implicit_transaction"]).take(pa.array((part[1] & (np.fmod(part[0], 9) == 0)).astype(np.int8))),
        "waitresource": join(one_of(WAIT_RESOURCES, (sixth, sure)), ": ", db_id, ":", text(*part)),
        "priority": text(i % 3 - 1), "trancount": text(i % 4), "lastbatchstarted": when, "lastbatchcompleted": when,
        "clientoption1": text((i + 50) * 2), "clientoption2": text((i + 50) * 3)}
    proc = pc.if_else(pa.array(part[1] & (np.fmod(part[0], 10) == 3)), "adhoc", join(db, ".dbo.usp_proc", rest(part, 20)))
    reads = pc.equal(line["l_returnflag"], "R").fill_null(False)
    buffer = join(pc.if_else(reads, "SELECT * FROM tbl", "UPDATE tbl"), table, pc.if_else(reads, "", " SET x = 1"))
    processes = join(*tag("process", {a: c.fill_null("null") for a, c in said.items()}), "<executionStack>",
                     *tag("frame", {"procname": proc.fill_null("null"), "line": text(*numbered).fill_null("null")}, "/>"),
                     '<frame procname="unknown" line="1"/></executionStack><inputbuf>', buffer.fill_null("null"), "</inputbuf></process>")

    kind = one_of(LOCK_KINDS, (sixth, sure))
    index = join(' indexname="ix_', rest(part, 5), '"').fill_null("")
    index = pc.if_else(pc.equal(kind, "ridlock"), "", index)
    resources = join("<", kind, ' objectname="', db, ".dbo.tbl", table, '"', index, ' dbid="', db_id, '" mode="', lock_mode, '"><owner-list><owner id="', pid,
                     '" mode="', lock_mode, '"/></owner-list><waiter-list><waiter id="', process_id(i % many + 1),
                     '" mode="U" requestType="wait"/></waiter-list></', kind, ">")
    whole = resources.is_valid().to_numpy(zero_copy_only=False)
    victim = i == many
    victims = together(join(*tag("victimProcess", {"id": pid.filter(pa.array(victim))}, "/>")), np.bincount(owner[victim], minlength=len(lines)))
    bare = pa.array(event_id.to_numpy(zero_copy_only=False) % 2 == 0)
    before = pc.if_else(bare, "", join('<event name="xml_deadlock_report" timestamp="', at, '"><data name="xml_report"><value>'))
    return join(before, "<deadlock><victim-list>", victims, "</victim-list><process-list>", together(processes, counts), "</process-list><resource-list>",
                together(resources.drop_null(), np.bincount(owner[whole], minlength=len(lines))), "</resource-list></deadlock>",
                pc.if_else(bare, "", "</value></data></event>"))


def f6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`f6_events`, rendered in Arrow batches at a fraction of the time.  Spark does not know of rows that come from
    such a batch by which key they are dealt, so reports that count events where their lines are take :func:`f6_events`."""
    lines = F.transform("lines", lambda y: F.struct(
        y["i"].alias("i"), *[y["x"][c].alias(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "o_custkey")],
        (y["x"]["l_quantity"].cast("long") * 100).alias("wait_ms"), F.floor(y["x"]["l_extendedprice"]).cast("long").alias("log_used")))

    def render(event_id, at, n, lines):
        import pyarrow as pa

        done = [_rendered(*(c.slice(lo, EVENTS_EACH) for c in (event_id, at, n, lines))) for lo in range(0, len(event_id), EVENTS_EACH)]
        return pa.concat_arrays(done) if done else pa.nulls(0, pa.string())

    document = F.arrow_udf(render, "string", F.ArrowUDFType.SCALAR)
    return f6_lines(spark, sf_dir).select("event_id", "event_ts", document("event_id", "at", "n", lines).alias("event_xml"))
