"""Sinks (history append, partition expiry, writer outputs) and stream/batch equivalence."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fleetscope.operators import snapshots as sd
from fleetscope.sinks.history import append_history, expire_partitions, render_lines, write_output
from fleetscope.session import scratch_path
from fleetscope.sinks.history import read_history
from fleetscope.sinks.readmodel import Measure, ReadModel
from fleetscope.streaming.deltas import STATE_STORE, stream_snapshot_delta
from fleetscope.streaming.pipelines import retention_sink, run_available

SCHEMA = "server_name string, check_ts timestamp_ntz, metric string, cum_value long, cum_count long"


def test_history_append_and_expiry(spark):
    path = scratch_path(spark, "hist-test")
    rows = [(dt.date(2024, 1, d), d) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "check_date date, v long")
    append_history(df, path)
    removed = expire_partitions(spark, path, "check_date", dt.date(2024, 1, 10), 3)
    assert len(removed) == 6
    left = sorted(r.v for r in spark.read.parquet(path).collect())
    assert left == [7, 8, 9, 10]


def test_render_and_write_outputs(spark):
    df = spark.createDataFrame([("a,b", 1), ('q"x', None)], "name string, n long")
    csv = sorted(r.line for r in render_lines(df, "CSV").collect())
    assert csv == ['"a,b","1"', '"q""x",']
    xml = sorted(r.line for r in render_lines(df, "XML").collect())
    assert xml[0] == "<row><name>a,b</name><n>1</n></row>"
    out = scratch_path(spark, "csv-out")
    write_output(df, "CSV", out)
    assert spark.read.option("header", "true").csv(out).count() == 2
    assert render_lines(df, "NONE").count() == 0


def test_stream_equals_batch_in_two_batch_sizes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(minutes=10 * i), m, 10 * i + (5 if m == "b" else 0), i)
            for i in range(30) for m in ("a", "b")]
    rows += [("s", t0 + dt.timedelta(minutes=300), "a", 1, 1)]             # counter reset
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {tuple(r) for r in sd.snapshot_delta(df, ["metric"], ["cum_value", "cum_count"], strict=False).collect()}
    for files in (1, 3):
        root = scratch_path(spark, "eq")
        for i in range(4):   # out-of-order chunks
            df.filter(F.abs(F.xxhash64("check_ts")) % 4 == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
        hb = spark.createDataFrame([("~hb", dt.datetime(2100, 1, 1), "~", 0, 0)], SCHEMA)
        hb.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        out = run_available(stream_snapshot_delta(stream, ["metric"], ["cum_value", "cum_count"], watermark="1 day"),
                            spark=spark, name="eq-out", conf=STATE_STORE)
        got = {tuple(r) for r in out.filter(F.col("server_name") != "~hb").select(
            "server_name", "metric", "check_ts", "prev_ts", "elapsed_seconds", "elapsed_minutes",
            "cum_value_delta", "cum_count_delta").collect()}
        assert got == batch
    assert os.path.isdir(spark.sparkContext.getCheckpointDir().replace("file:", ""))


def test_objects_exist_and_procedure_info(spark):
    from fleetscope.operators.quality import objects_exist, procedure_info

    objs = spark.createDataFrame([("t1", "U"), ("v1", "V")], "object_name string, object_type string")
    req = spark.createDataFrame([("t1", "U"), ("t1", "V"), ("v1", None), ("x", None)],
                                "object_name string, object_type string")
    got = {(r.object_name, r.object_type): r.exists for r in objects_exist(req, objs).collect()}
    assert got == {("t1", "U"): True, ("t1", "V"): False, ("v1", None): True, ("x", None): False}
    procs = spark.createDataFrame([(1, "p1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))],
                                  "object_id long, procedure_name string, create_date timestamp_ntz, modify_date timestamp_ntz")
    params = spark.createDataFrame([(1, 1), (1, 2)], "object_id long, parameter_id long")
    stats = spark.createDataFrame([(1, 5), (1, 7)], "object_id long, execution_count long")
    r = procedure_info(procs, params, stats).collect()[0]
    assert (r.execute_count, r.parameter_count) == (12, 2)


def test_stream_drops_rows_behind_the_last_emitted_snapshot(spark):
    t0 = dt.datetime(2024, 1, 1)
    on_time = [("s", t0 + dt.timedelta(minutes=30 * i), "a", 10 * i, i) for i in range(21)]   # 0h .. 10h
    late = [("s", t0 + dt.timedelta(minutes=95), "a", 1000, 1000)]                            # 1:35, arrives last
    root = scratch_path(spark, "late")
    first, second = on_time[:11], on_time[11:]
    for chunk in (first, second, late):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.createDataFrame([("~hb", dt.datetime(2100, 1, 1), "~", 0, 0)], SCHEMA).write.mode("append").parquet(
        f"{root}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = run_available(stream_snapshot_delta(stream, ["metric"], ["cum_value", "cum_count"], watermark="0 seconds"),
                        spark=spark, name="late-out", conf=STATE_STORE).filter(F.col("server_name") != "~hb")
    got = {(r.check_ts, r.cum_value_delta) for r in out.collect()}
    want = {(t0 + dt.timedelta(minutes=30 * i), 10) for i in range(1, 21)}
    assert got == want   # the late 1:35 snapshot neither produced a delta nor disturbed its neighbours


def test_series_state_ends_and_starts_again(spark):
    """After max_minutes without a snapshot the series' state is gone; the next snapshot starts anew."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(minutes=m), "a", v, v) for m, v in ((0, 1), (20, 4), (300, 5), (310, 9), (365, 11))]
    beats = [("~hb", t0 + dt.timedelta(hours=h), "~", 0, 0) for h in (4, 30)] + [("~hb", dt.datetime(2100, 1, 1), "~", 0, 0)]
    root = scratch_path(spark, "ends")
    for chunk in (rows[:2], beats[:1], rows[2:], beats[1:2], beats[2:]):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = run_available(stream_snapshot_delta(stream, ["metric"], ["cum_value"], watermark="1 hour", bucket_minutes=10),
                        spark=spark, name="ends-out", conf=STATE_STORE).filter("server_name = 's'")
    assert {(r.check_ts, r.cum_value_delta) for r in out.collect()} == {
        (t0 + dt.timedelta(minutes=20), 3), (t0 + dt.timedelta(minutes=310), 4), (t0 + dt.timedelta(minutes=365), 2)}


def test_history_batch_stands_once(spark):
    """A batch run again -- whole, after a part of it was written, or with other rows -- replaces its first run."""
    path = scratch_path(spark, "once")
    day = dt.date(2024, 1, 1)

    def rows(*vs):
        return spark.createDataFrame([(day + dt.timedelta(days=v // 10), v) for v in vs], "check_date date, v long")

    append_history(rows(1, 2, 11), path, writer="q", batch_id=0)
    append_history(rows(3), path, writer="q", batch_id=1)
    append_history(rows(4), path, writer="other", batch_id=1)
    for _ in range(2):
        append_history(rows(1, 2, 11), path, writer="q", batch_id=0)
    assert sorted(r.v for r in read_history(spark, path).collect()) == [1, 2, 3, 4, 11]
    append_history(rows(21, 2), path, writer="q", batch_id=0)
    assert sorted(r.v for r in read_history(spark, path).collect()) == [2, 3, 4, 21]


def test_retention_sink_replayed(spark):
    path = scratch_path(spark, "replayed")
    sink = retention_sink(2, ts="ts", partition="day")
    t0 = dt.datetime(2024, 1, 1)
    batches = [spark.createDataFrame([(t0 + dt.timedelta(days=d), d) for d in ds], "ts timestamp_ntz, v long") for ds in ((0, 1), (1, 2, 3), (5,))]
    for i in (0, 1, 1, 0, 2, 1):
        sink(batches[i], i, path)
    assert sorted(r.v for r in read_history(spark, path).collect()) == [3, 5]


def test_read_model_equals_full_aggregate(spark):
    """Three batches, one of them again, a fold, a folded batch again, a late batch: equal to the aggregate of all rows."""
    rows = [(i % 3, i, f"u{i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v long, u string")
    model = ReadModel(["k"], [Measure("n", "count"), Measure("s", "sum", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"),
                              Measure("users", "distinct", "u")])
    path = scratch_path(spark, "model")
    assert model.read(spark, path) is None
    part = [df.filter(F.col("v") % 4 == i) for i in range(4)]
    for i in (0, 1, 1, 2, 0):
        model.update(part[i], path, i)
    model.fold(spark, path)
    model.update(part[1], path, 1)
    model.update(part[3], path, 3)
    got = {r.k: (r.n, r.s, r.lo, r.hi) for r in model.read(spark, path).collect()}
    want = {r.k: (r.n, r.s, r.lo, r.hi) for r in df.groupBy("k").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert got == want
    assert [r.users for r in model.read(spark, path, keys=[]).collect()] == [40]


def test_sketch_error_is_as_stated(spark):
    model = ReadModel(["day"], [Measure("users", "distinct", "id")])
    days = spark.range(0, 200_000).withColumn("day", F.col("id") % 7)
    merged = model.results(model.merge(model.partials(days), keys=[])).collect()[0].users
    assert abs(merged - 200_000) <= 3 * 1.04 / 2 ** 6 * 200_000
