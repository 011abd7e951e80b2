"""Searches, comparisons and histories that skip what they need not read: equal to the plain form, and the plan shows it."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import catalog as ix
from fleetscope.operators import quality as dq
from fleetscope.operators import snapshots as sd
from fleetscope.operators import vectors as vec
from fleetscope.session import scratch_path
from fleetscope.sources.tables import read_bucketed, write_bucketed


def _clustered(n=1500, clusters=20, dim=8, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    mid = rng.standard_normal((clusters, dim))
    v = mid[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * spread
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n + i, v[0].tolist()) for i in range(40)]   # ties
    return rows + [(9000, None), (9001, [0.0] * dim), (9002, [])]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("spread, centres, block", [(0.02, 30, 64), (1.0, 7, 10_000)])
def test_search_in_cells_equals_every_block(spark, metric, spread, centres, block):
    e = spark.createDataFrame(_clustered(spread=spread), "vec_id long, embedding array<double>").repartition(3)
    q = e.filter("vec_id % 40 = 0 or vec_id >= 9000")
    want = {tuple(r) for r in vec.top_k_search(e, q, k=4, metric=metric).collect()}
    index = vec.build_cells(e, metric=metric, centres=centres, block=block)
    got, share = vec.top_k_in_cells(index, q, k=4, block=block)
    assert {tuple(r) for r in got.collect()} == want
    skipped = share.agg(F.avg("skipped")).collect()[0][0]
    if spread < 0.1 and metric != "dot":
        assert skipped > 0.6      # clustered vectors: most cells are never visited


def test_search_in_cells_few_rows_and_none(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got, _ = vec.top_k_in_cells(vec.build_cells(e), e, k=5)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in vec.top_k_search(e, e, k=5).collect()}
    none = e.limit(0)
    assert vec.top_k_in_cells(vec.build_cells(none), e)[0].collect() == []
    assert vec.top_k_in_cells(vec.build_cells(e), none)[0].collect() == []


def test_digests_find_the_same_differences(spark):
    rnd = random.Random(2)
    rows = [(i if i % 50 else None, rnd.choice("ab"), rnd.choice([None, "x", "y"]), i) for i in range(2000)]
    left = spark.createDataFrame(rows, "k int, p string, q string, v int").filter("k is not null")
    right = left.filter("k % 97 <> 0").withColumn("q", F.when(F.col("k") % 89 == 0, F.col("p")).otherwise(F.col("q"))).unionByName(
        spark.createDataFrame([(5000, None, None, 1)], left.schema))
    want = {tuple(r) for r in dq.compare_tables(left, right, key=["k"]).collect()}
    for ranges in (1, 64, 4096):
        assert {tuple(r) for r in dq.compare_by_digest(left, right, key=["k"], ranges=ranges).collect()} == want
    assert dq.compare_by_digest(left, left, key=["k"]).collect() == []


def test_one_changed_row_compares_one_range(spark):
    left = spark.range(50_000).select("id", (F.col("id") * 3).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") == 777, -1).otherwise(F.col("v")))
    a, b = (dq.range_digests(df, key=["id"], columns=["v"], ranges=1000) for df in (left, right))
    assert a.exceptAll(b).count() == 1
    assert [tuple(r) for r in dq.compare_by_digest(left, right, key=["id"], ranges=1000).collect()] == [(777, "changed")]


def test_bucketed_history_needs_no_exchange_and_prunes_days(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{s}", t0 + dt.timedelta(minutes=30 * i), m, i * 5, i) for s in range(3) for m in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "server_name string, check_ts timestamp_ntz, metric string, cum_value long, cum_count long")
    path = scratch_path(spark, "history")
    table = "history_" + path.rsplit("-", 1)[1]
    write_bucketed(df.filter("check_ts < timestamp_ntz'2024-01-03'"), table, f"{path}/t", series=["server_name", "metric"], buckets=4)
    write_bucketed(df.filter("check_ts >= timestamp_ntz'2024-01-03'"), table, f"{path}/t", series=["server_name", "metric"], buckets=4)
    window = read_bucketed(spark, table, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4))
    out = sd.snapshot_delta(window, ["metric"], ["cum_value", "cum_count"], strict=False, bucket=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "check_day" in plan.split("PartitionFilters")[1][:200]
    want = sd.snapshot_delta(df.filter("check_ts >= timestamp_ntz'2024-01-02' and check_ts < timestamp_ntz'2024-01-04'"), ["metric"],
                             ["cum_value", "cum_count"], strict=False)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}
    spark.sql(f"DROP TABLE {table}")


def test_prefixes_and_foreign_keys(spark):
    tbl = ("s", "d", "t")
    cat = [(*tbl, i, f"i{i}", keys, 2, False, False, False) for i, keys in enumerate(
        [["a"], ["a", "b"], ["a", "b", "c"], ["b", "a"], ["a", "b", "d"], ["x"], ["a", "b"]])]
    schema = ("server_name string, database_name string, table_name string, index_id long, index_name string, keys array<string>, index_type int, "
              "is_hypothetical boolean, is_disabled boolean, is_primary_key boolean")
    c = spark.createDataFrame(cat, schema)
    got = {r["index_id"]: (r["wider_index_id"], r["held_by"]) for r in ix.prefix_duplicates(c).collect()}
    assert got == {0: (2, 4), 1: (2, 2), 6: (2, 2)}
    fks = spark.createDataFrame([(*tbl, f"f{i}", cols) for i, cols in enumerate(
        [["b", "a"], ["a", "c"], ["c", "a", "b"], ["c"], ["x"], ["b"]])], "server_name string, database_name string, table_name string, fk_name string, fk_columns array<string>")
    assert sorted(r["fk_name"] for r in ix.unindexed_foreign_keys(fks, c).collect()) == ["f1", "f3"]
