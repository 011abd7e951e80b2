"""More fixture projections (hourly query store, texts, configs, vectors)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import _t, cents


# the other averages of an interval
HOURLY_METRICS = ["avg_logical_io_reads", "avg_logical_io_writes", "avg_physical_io_reads", "avg_query_max_used_memory", "avg_rowcount",
                  "avg_clr_time", "avg_log_bytes_used", "avg_tempdb_space_used", "avg_num_physical_io_reads"]


def f4_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly query-store intervals from ``events``: plan = user % 40,
    query = user % 20 (each plan belongs to one query)."""
    ev = _t(spark, sf_dir, "events")
    c = cents("value")
    g = ev.groupBy((F.col("user_id") % 20).alias("query_id"), (F.col("user_id") % 40).alias("plan_id"),
                   F.date_trunc("hour", "ts").alias("interval_ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("dur"), F.sum(F.floor(c / 4)).alias("cpu"),
        *[F.sum(c % (7 + 4 * i)).alias(m) for i, m in enumerate(HOURLY_METRICS)])
    return g.select("query_id", "plan_id", "interval_ts", F.col("n").cast("long").alias("count_executions"),
                    (F.col("dur") / F.col("n")).alias("avg_duration"), (F.col("cpu") / F.col("n")).alias("avg_cpu"),
                    *[(F.col(m) / F.col("n")).alias(m) for m in HOURLY_METRICS])


def f4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text per query id (``part.p_name``)."""
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_text"))


def f2_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("srv0").alias("server_name"), (F.col("l_orderkey") + 1).alias("session_id"),
        F.concat(F.lit("KEY: "), F.col("l_partkey").cast("string")).alias("resource"),
        F.element_at(F.array(*[F.lit(x) for x in ["S", "X", "U", "IX"]]), (F.col("l_linenumber") % 4 + 1).cast("int"))
        .alias("request_mode"),
        F.when(F.col("l_linestatus") == "F", "GRANT").otherwise("WAIT").alias("request_status"))


def f2_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.lit("srv0").alias("server_name"), (F.col("l_orderkey") + 1).alias("session_id"),
                     F.concat(F.lit("W_"), F.col("l_returnflag")).alias("wait_type"),
                     (F.col("l_quantity").cast("long") * 100).alias("wait_duration_ms"))


def f2_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("srv0").alias("server_name"), (F.col("l_orderkey") % 500 + 1).alias("session_id"),
        F.concat(F.lit("db"), (F.col("l_suppkey") % 5).cast("string")).alias("database_name"),
        F.date_trunc("year", "l_shipdate").alias("request_start"), (F.col("l_partkey") % 10).alias("plan_handle"),
        F.col("l_shipdate").alias("observed_ts"), cents("l_extendedprice").alias("cpu_ms"),
        F.col("l_quantity").cast("long").alias("reads"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"))


def f2_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 100).alias("session_id"), F.lit(0).alias("request_id"),
                      (F.col("l_linenumber") % 3).alias("node_id"), F.col("l_linenumber").alias("thread_id")).agg(
        F.sum(F.col("l_quantity").cast("long") * 10).alias("row_count"))


def f2_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("node_id"),
                     F.col("l_quantity").cast("long").alias("estimated_rows"),
                     F.floor("l_extendedprice").cast("long").alias("actual_rows"))


def f2_second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    # a second view of twice the session id: every other session of the first source has a row here
    return o.select(
        F.lit("srv0").alias("server_name"), (k * 2 + 1).alias("session_id"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(k % 97 + 1).cast("long").alias("blocking_session_id"))


def _part_use(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    use = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return p.join(use, p.p_partkey == use.l_partkey, "left").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("qty", F.lit(0)).cast("long").alias("qty"))


def f5_missing(spark, sf_dir):
    pu = _part_use(spark, sf_dir)
    pk = F.col("p_partkey")
    return pu.select(pk.alias("missing_id"), F.lit("srv0").alias("server_name"),
                     F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
                     F.col("p_brand").alias("table_name"), F.array(F.col("p_type")).alias("equality_columns"),
                     (F.col("n_lines") * 100).alias("user_seeks"), (pk % 10).alias("user_scans"),
                     (F.col("p_retailprice") / 10).alias("avg_total_user_cost"),
                     (pk % 100).cast("double").alias("avg_user_impact"), (pk % 40).alias("age_days"))


def f5_identities(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    t = F.element_at(F.array(F.lit("tinyint"), F.lit("smallint"), F.lit("int")), (k % 3 + 1).cast("int"))
    mx = F.element_at(F.array(F.lit(255), F.lit(32767), F.lit(2147483647)), (k % 3 + 1).cast("int")).cast("long")
    frac = (F.col("s_acctbal") + 1000) / 11000
    inc = F.when(k % 5 == 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    last = F.floor(mx * frac).cast("long")
    return s.select(F.lit("srv0").alias("server_name"), F.concat(F.lit("tbl"), k.cast("string")).alias("table_name"),
                    t.alias("type_name"), F.lit(1).cast("long").alias("seed_value"), inc.alias("increment_value"),
                    F.when(inc > 0, last).otherwise(-last).alias("last_value"))


def f5_stats(spark, sf_dir):
    pu = _part_use(spark, sf_dir)
    pk = F.col("p_partkey")
    rows = F.col("p_size").cast("long") * 1000
    base = F.lit(dt.datetime(2001, 6, 1))
    return pu.select(F.lit("srv0").alias("server_name"), F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
                     F.col("p_brand").alias("table_name"), F.concat(F.lit("st_"), pk.cast("string")).alias("stats_name"),
                     (base - F.make_dt_interval((pk % 30 + (pk % 2) * 60).cast("int"))).cast("timestamp_ntz")
                     .alias("last_updated"),
                     rows.alias("rows"), (F.col("qty") * 50).alias("modification_counter"),
                     F.floor(rows * (pk % 20) / 100).cast("long").alias("rows_sampled"))


_TYPES = {"ECONOMY": "varchar", "STANDARD": "int", "PROMO": "nvarchar", "SMALL": "bigint", "LARGE": "datetime",
          "MEDIUM": "char"}


def f5_columns(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    dtype = F.lit("sql_variant")
    for k, v in _TYPES.items():
        dtype = F.when(F.col("p_type") == k, F.lit(v)).otherwise(dtype)
    name = F.regexp_replace("p_name", " ", "_")
    return p.select(F.lit("srv0").alias("server_name"), F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
                    # a table holds the parts of one brand and thousand, so tables grow in number, not in width
                    F.concat("p_brand", F.lit("_"), F.floor(pk / 1000).cast("string")).alias("table_name"), pk.alias("column_id"),
                    F.when(pk % 7 == 0, F.concat(F.lit("is_"), name)).otherwise(F.concat(name, F.lit("_"), pk.cast("string")))
                    .alias("column_name"), dtype.alias("data_type"),
                    F.when(dtype.isin("varchar", "nvarchar", "char"), F.col("p_size") * 10).otherwise(F.lit(8)).cast("long")
                    .alias("max_length"), (pk % 3 != 0).alias("is_nullable"))


def f5_fks(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(F.lit("srv0").alias("server_name"), F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
                    F.col("p_brand").alias("table_name"), F.concat(F.lit("fk_"), pk.cast("string")).alias("fk_name"),
                    F.when(pk % 8 == 0, F.col("p_type")).otherwise(F.element_at(F.split("p_name", " "), 2))
                    .alias("fk_column"))


def f5_wide_fks(spark, sf_dir):
    """Foreign keys of one to three columns, some in another order than the index."""
    p = _t(spark, sf_dir, "part")
    pk, words = F.col("p_partkey"), F.split("p_name", " ")
    cols = (F.when(pk % 4 == 0, F.array("p_type")).when(pk % 4 == 1, F.array(words[0], F.col("p_type")))
            .when(pk % 4 == 2, F.array(words[1], words[0], F.col("p_type"))).otherwise(F.array(words[1], F.col("p_type"))))
    return p.select(F.lit("srv0").alias("server_name"), F.concat(F.lit("db"), (pk % 3).cast("string")).alias("database_name"),
                    F.col("p_brand").alias("table_name"), F.concat(F.lit("fk_"), pk.cast("string")).alias("fk_name"), cols.alias("fk_columns"))


def f5_fragmentation(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(F.col("p_brand").alias("table_name"), pk.alias("index_id"),
                    ((pk % 50) * 1.0).alias("fragmentation_pct"), (F.col("p_size").cast("long") * 100).alias("page_count"))


def f5_partitions(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat(F.lit("tbl"), (F.col("l_suppkey") % 5).cast("string")).alias("table_name"),
                   ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("long").alias("partition_number")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return g.select("table_name", "partition_number",
                    F.when(F.col("partition_number") % 7 < 3, "PAGE").when(F.col("partition_number") % 7 < 5, "ROW")
                    .otherwise("NONE").alias("compression"))
