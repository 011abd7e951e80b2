"""Fixture projections F1-F10 of the driver's test tables.

Each builder maps the generic test tables onto one telemetry shape (see
FIXTURES.md).  The same projection is written once more in DuckDB SQL in
:mod:`fleetscope.plans.oracle_fixtures` so the oracle runs on identical input.
Operators never see these names; they receive plain DataFrames.

Rules: no randomness, no ``now()``, money and counters in integer cents,
timestamps are zone-less.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import row_number_in_key

from ..sources.tables import read_table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def epoch_seconds(ts) -> F.Column:
    """Seconds since 1970 of a zone-less timestamp (independent of session zone)."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts).cast("long")


def cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("long") if isinstance(c, str) else F.round(c * 100).cast("long")


# --------------------------------------------------------------------- F1
def f1_counters(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """Counter snapshots: one row per (server, hour, metric), cumulative.

    ``variant``: ``plain`` | ``restart`` (running sum restarts every day, i.e.
    a server restart at midnight) | ``gappy`` (hours with ``hour % 7 = 0``
    missing).
    """
    ev = _t(spark, sf_dir, "events").select(
        F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("server_name"),
        F.col("event_type").alias("metric"),
        F.date_trunc("hour", "ts").alias("h"),
        cents("value").alias("cents"),
    )
    hourly = ev.groupBy("server_name", "metric", "h").agg(
        F.sum("cents").alias("v"), F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("cents") / 4)).alias("s"))
    # one scalar subquery for both bounds, projected once
    bounds = ev.agg(F.struct(F.min("h").alias("lo"), F.max("h").alias("hi"))).scalar()
    pairs = ev.select("server_name", "metric").distinct().withColumn("__b", bounds)
    grid = pairs.select(
        "server_name", "metric",
        F.explode(F.sequence(F.col("__b.lo"), F.col("__b.hi"), F.expr("INTERVAL 1 HOUR"))).alias("h"))
    dense = grid.join(hourly, ["server_name", "metric", "h"], "left").select(
        "server_name", "metric", "h",
        F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("s", F.lit(0)).cast("long").alias("s"))
    part = ["server_name", "metric"] + ([F.to_date("h")] if variant == "restart" else [])
    w = Window.partitionBy(*part).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dense.select(
        "server_name", F.col("h").alias("check_ts"), "metric",
        F.sum("v").over(w).cast("long").alias("cum_value"),
        F.sum("n").over(w).cast("long").alias("cum_count"),
        F.sum("s").over(w).cast("long").alias("cum_signal"),
    )
    if variant == "gappy":
        out = out.filter(F.hour("check_ts") % 7 != 0)
    return out


# --------------------------------------------------------------------- F2
def f2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session snapshot with blocking edges (a forest, never self)."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    blocked = (k % 4) != 0
    return o.select(
        F.lit("srv0").alias("server_name"),
        (k + 1).alias("session_id"),
        F.when(blocked, F.floor(k / 4) + 1).otherwise(F.lit(0)).cast("long").alias("blocking_session_id"),
        (k % 60000).cast("long").alias("wait_duration_ms"),
        F.when(blocked, F.concat(F.lit("LCK_M_"), F.element_at(F.array(*[F.lit(x) for x in ["S", "U", "X", "IX"]]),
                                                                  ((F.col("o_custkey") % 4) + 1).cast("int"))))
        .alias("wait_type"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "sleeping")
        .otherwise("suspended").alias("status"),
        F.concat(F.lit("login"), (F.col("o_custkey") % 25).cast("string")).alias("login_name"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 50).cast("string")).alias("database_name"),
        (k % 3).cast("long").alias("open_tran_count"),
        F.col("o_orderpriority").alias("program_name"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)")))
        .alias("start_ts"),
        cents("o_totalprice").alias("cpu_ms"),
    )


# --------------------------------------------------------------------- F3
def f3_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backup history: about a third each of full (D), diff (I), log (L)."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    finish = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))
    typ = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "P", "I").otherwise("L")
    base = o.select(
        F.concat(F.lit("srv"), (F.col("o_custkey") % 2).cast("string")).alias("server_name"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 50).cast("string")).alias("database_name"),
        typ.alias("type"),
        finish.alias("backup_finish_date"),
        (finish - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 3600).cast("decimal(18,6)")))
        .alias("backup_start_date"),
        # ids rise with finish time, unique by order key
        (epoch_seconds(finish) * F.lit(1000000000) + k).alias("backup_set_id"),
        cents("o_totalprice").alias("backup_size"),
        F.when(k % 17 == 0, cents("o_totalprice")).otherwise(F.floor(cents("o_totalprice") * 6 / 10)).cast("long")
        .alias("compressed_backup_size"),
        F.col("o_orderpriority").alias("user_name"),
        k.alias("o_orderkey"),
        F.when(k % 10 == 0, "BULK_LOGGED").when(k % 10 == 1, "SIMPLE").otherwise("FULL").alias("recovery_model"),
        (k % 7 != 0).alias("has_backup_checksums"),
        (k % 101 == 0).alias("is_damaged"),
        (k % 211 == 0).alias("is_password_protected"),
        (k % 53 == 0).alias("is_snapshot"),
        (k % 37 == 0).alias("is_readonly"),
        (k % 41 == 0).alias("is_single_user"),
        (k % 19 == 0).alias("is_encrypted"),
        (F.lit(100) + (k % 3) * 10).cast("int").alias("compatibility_level"),
    )
    # ids rise with the finish time; numbered over ranges of equal depth, so no database's history is
    # sorted whole in one task
    base = row_number_in_key(base, by=["server_name", "database_name"], order="backup_set_id")
    rn = F.col("__rn")
    return base.select(
        "server_name", "database_name", "type", "backup_start_date", "backup_finish_date", "backup_set_id",
        "backup_size", "compressed_backup_size", "user_name",
        ((rn - 1) * 100).alias("first_lsn"), (rn * 100).alias("last_lsn"),
        "recovery_model", "has_backup_checksums", "is_damaged", "is_password_protected", "is_snapshot",
        "is_readonly", "is_single_user", "is_encrypted", "compatibility_level",
    )


def f3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File I/O snapshots: one row per (server, database, file, month), cumulative."""
    li = _t(spark, sf_dir, "lineitem")
    g = li.groupBy(
        (F.col("l_suppkey") % 2).alias("srv"), (F.col("l_suppkey") % 20).alias("database_id"),
        F.col("l_linenumber").alias("file_id"), F.date_trunc("month", "l_shipdate").alias("check_ts"),
    ).agg(
        F.count(F.lit(1)).alias("reads"),
        F.sum(F.col("l_quantity").cast("long") * 10).alias("stall_r"),
        F.sum(cents("l_extendedprice")).alias("bytes_r"),
        F.sum(F.col("l_linenumber").cast("long")).alias("writes"),
        F.sum(cents("l_tax") * 40).alias("stall_w"),
        F.sum(cents("l_discount") * 1000).alias("bytes_w"),
    )
    w = Window.partitionBy("srv", "database_id", "file_id").orderBy("check_ts").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    drive = F.element_at(F.array(F.lit("C:"), F.lit("D:"), F.lit("E:")), ((F.col("file_id") % 3) + 1).cast("int"))
    return g.select(
        F.concat(F.lit("srv"), F.col("srv").cast("string")).alias("server_name"),
        "check_ts",
        F.col("database_id").cast("long").alias("database_id"),
        F.col("file_id").cast("long").alias("file_id"),
        F.when(F.col("file_id") == 1, "LOG").otherwise("ROWS").alias("type_desc"),
        F.concat(drive, F.lit("\\data\\db"), F.col("database_id").cast("string"), F.lit("_"),
                 F.col("file_id").cast("string"), F.when(F.col("file_id") == 1, ".ldf").otherwise(".mdf"))
        .alias("physical_name"),
        F.sum("reads").over(w).cast("long").alias("size_on_disk_mb"),
        F.sum("reads").over(w).cast("long").alias("num_of_reads"),
        F.sum("stall_r").over(w).cast("long").alias("io_stall_read_ms"),
        F.sum("bytes_r").over(w).cast("long").alias("bytes_read"),
        F.sum("writes").over(w).cast("long").alias("num_of_writes"),
        F.sum("stall_w").over(w).cast("long").alias("io_stall_write_ms"),
        F.sum("bytes_w").over(w).cast("long").alias("bytes_written"),
    )


# --------------------------------------------------------------------- F4
def f4_query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-store style interval stats per (query, plan, month)."""
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("plan_id"),
        F.date_trunc("month", "l_shipdate").alias("interval_ts"),
    ).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("executions"),
        F.sum(cents("l_extendedprice")).alias("cpu"),
        F.sum(cents("l_discount")).alias("reads"),
        F.sum(cents("l_tax")).alias("writes"),
        F.sum(cents("l_extendedprice") + F.col("l_quantity").cast("long") * 1000).alias("duration"),
        F.min(cents("l_extendedprice")).alias("min_cpu"),
        F.max(cents("l_extendedprice")).alias("max_cpu"),
        F.count(F.lit(1)).alias("n_rows"),
    ).select("query_id", "plan_id", "interval_ts", "executions", "cpu", "reads", "writes", "duration",
             "min_cpu", "max_cpu", F.col("n_rows").cast("long").alias("n_rows"))


def f4_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member-of edges: customer -> nation role -> region role."""
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    cust = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_name").alias("member"), F.col("n_name").alias("role"))
    nat = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("member"),
                                                           F.col("r_name").alias("role"))
    return cust.unionByName(nat)


# --------------------------------------------------------------------- F5
def f5_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index catalog from ``part``; usage from ``lineitem`` aggregated per part."""
    p = _t(spark, sf_dir, "part")
    use = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    j = p.join(use, p.p_partkey == use.l_partkey, "left")
    pk = F.col("p_partkey")
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0)).cast("long")
    qty = F.coalesce(F.col("qty"), F.lit(0)).cast("long")
    return j.select(
        F.lit("srv0").alias("server_name"),
        F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
        F.col("p_brand").alias("table_name"),
        pk.alias("index_id"),
        F.concat(F.lit("ix_"), pk.cast("string")).alias("index_name"),
        F.concat(F.array(F.col("p_type")), F.split("p_name", " ")).alias("keys"),
        F.when(pk % 5 == 0, F.array(F.lit("p_comment"))).otherwise(F.array().cast("array<string>")).alias("includes"),
        F.when(pk % 4 == 0, F.lit(0)).otherwise(n_lines).cast("long").alias("user_seeks"),
        F.when(pk % 4 == 0, F.lit(0)).otherwise(F.floor(qty / 10)).cast("long").alias("user_scans"),
        F.when(pk % 4 == 0, F.lit(0)).otherwise(n_lines % 3).cast("long").alias("user_lookups"),
        F.when(pk % 6 == 0, qty * 1000).otherwise(qty).cast("long").alias("user_updates"),
        F.col("p_size").cast("long").alias("size_mb"),
        F.col("p_retailprice").alias("cost"),
        (pk % 7 == 0).alias("is_unique"),
        (pk % 11 == 0).alias("is_disabled"),
        F.when(pk % 9 == 0, F.lit(70)).otherwise(F.lit(100)).cast("long").alias("fill_factor"),
        F.when(pk % 50 == 0, F.lit(0)).when(pk % 50 == 1, F.lit(1)).otherwise(F.lit(2)).cast("int").alias("index_type"),
        (pk % 97 == 0).alias("is_hypothetical"),
        (pk % 21 == 0).alias("is_primary_key"),
        (F.lit(dt.datetime(2001, 6, 1)) - F.make_dt_interval((pk % 30).cast("int"))).cast("timestamp_ntz")
        .alias("create_ts"),
        (F.lit(dt.datetime(2001, 6, 1)) - F.make_dt_interval((pk % 30).cast("int") - (pk % 3).cast("int")))
        .cast("timestamp_ntz").alias("modify_ts"),
        (n_lines * 1000).alias("row_lock_wait_ms"),
        (qty * 10).alias("page_lock_wait_ms"),
        n_lines.alias("lock_count"),
        F.when(pk % 50 == 0, qty).otherwise(F.lit(0)).cast("long").alias("forwarded_fetches"),
        (F.col("p_size").cast("long") * 1000).alias("row_count"),
    )


def f1_perfmon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perfmon-style counters of every counter type, derived from F1."""
    f = f1_counters(spark, sf_dir, "plain")
    rows = F.explode(F.array(
        F.struct(F.concat("metric", F.lit(" total")).alias("counter_name"), F.lit(272696576).alias("cntr_type"),
                 F.col("cum_value").alias("cntr_value")),
        F.struct(F.concat("metric", F.lit(" avg (ms)")).alias("counter_name"), F.lit(1073874176).alias("cntr_type"),
                 F.col("cum_value").alias("cntr_value")),
        F.struct(F.concat("metric", F.lit(" avg base")).alias("counter_name"), F.lit(1073939712).alias("cntr_type"),
                 F.col("cum_count").alias("cntr_value")),
        F.struct(F.concat("metric", F.lit(" ratio")).alias("counter_name"), F.lit(537003264).alias("cntr_type"),
                 F.col("cum_signal").alias("cntr_value")),
        F.struct(F.concat("metric", F.lit(" ratio base")).alias("counter_name"), F.lit(1073939712).alias("cntr_type"),
                 F.col("cum_value").alias("cntr_value")),
        F.struct(F.concat("metric", F.lit(" current")).alias("counter_name"), F.lit(65792).alias("cntr_type"),
                 F.col("cum_count").alias("cntr_value")),
    )).alias("c")
    return f.select("server_name", "check_ts", F.lit("Fleet:Events").alias("object_name"),
                    F.lit("_Total").alias("instance_name"), rows).select(
        "server_name", "check_ts", "object_name", "instance_name", "c.counter_name",
        F.col("c.cntr_type").cast("long").alias("cntr_type"), F.col("c.cntr_value").cast("long").alias("cntr_value"))


def f4_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 as cumulative plan-cache counters (running sums per plan)."""
    f = f4_query_stats(spark, sf_dir)
    w = Window.partitionBy("query_id", "plan_id").orderBy("interval_ts").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return f.select("query_id", "plan_id", "interval_ts",
                    *[F.sum(c).over(w).cast("long").alias(c) for c in ["executions", "cpu", "reads", "writes",
                                                                          "duration"]])
