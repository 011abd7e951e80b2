"""The skew-splitting rewrites give the same answer as the single window they
replace, on seeded pseudo-random data with a hot key, gaps and ties."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators.relational import bucketed_lag, carry_last, row_number_in_key

T0 = dt.datetime(2024, 1, 1)


def _rows(seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c"])
        # minutes spread over ~10 days with gaps, plus some exact duplicates in time
        t = T0 + dt.timedelta(minutes=rnd.choice([rnd.randint(0, 14400), 600, 601]))
        val = rnd.randint(0, 50) if rnd.random() < 0.4 else None
        rows.append((key, t, i, val, float(rnd.randint(0, 30))))
    return rows


SCHEMA = "k string, ts timestamp_ntz, id long, v long, x double"


@pytest.mark.parametrize("seed", [1, 2])
def test_bucketed_lag_equals_plain_lag(spark, seed):
    df = spark.createDataFrame(_rows(seed), SCHEMA)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {(r.id, r.p_ts, r.p_v) for r in df.select("id", F.lag("ts").over(w).alias("p_ts"),
                                                        F.lag("v").over(w).alias("p_v")).collect()}
    for bucket in ("day", "hour"):
        got = bucketed_lag(df, by=["k"], ts="ts", tie=["id"], cols=["v"], bucket=bucket, prefix="p_")
        assert {(r.id, r.p_ts, r.p_v) for r in got.select("id", "p_ts", "p_v").collect()} == want


@pytest.mark.parametrize("exclusive", [False, True])
def test_carry_last_equals_single_window(spark, exclusive):
    df = spark.createDataFrame(_rows(3), SCHEMA)
    plain = carry_last(df, by=["k"], ts="ts", tie=["id"], value="v", out="c", exclusive=exclusive, bucket=None)
    want = {(r.id, r.c) for r in plain.select("id", "c").collect()}
    for bucket in ("day", "hour"):
        got = carry_last(df, by=["k"], ts="ts", tie=["id"], value="v", out="c", exclusive=exclusive, bucket=bucket)
        assert {(r.id, r.c) for r in got.select("id", "c").collect()} == want
    num = df.withColumn("n", F.col("id") * 7 % 1000)
    plain_n = carry_last(num, by=["k"], ts="n", tie=["id"], value="v", out="c", exclusive=exclusive, bucket=None)
    want_n = {(r.id, r.c) for r in plain_n.select("id", "c").collect()}
    for per_range in (5, 50):
        got = carry_last(num, by=["k"], ts="n", tie=["id"], value="v", out="c", exclusive=exclusive, bucket=per_range)
        assert {(r.id, r.c) for r in got.select("id", "c").collect()} == want_n


def test_row_number_in_key_equals_row_number(spark):
    df = spark.createDataFrame(_rows(4), SCHEMA)
    w = Window.partitionBy("k").orderBy("x", "id")
    want = {(r.id, r.rn) for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    for per_range in (3, 40, 1000):
        got = row_number_in_key(df, by=["k"], order="x", tie=["id"], ranges=per_range)
        assert {(r["id"], r["__rn"]) for r in got.select("id", "__rn").collect()} == want


def test_deep_chain_resolves_in_log_rounds_with_checkpoints(spark):
    from fleetscope.operators.blocking import blocking_chains

    n = 1500
    rows = [("s", i, i - 1 if i > 1 else 0) for i in range(1, n + 1)]          # one chain 1 <- 2 <- ... <- n
    rows += [("s", n + 1, n + 2), ("s", n + 2, n + 3), ("s", n + 3, n + 1)]     # a three-node cycle
    df = spark.createDataFrame(rows, "server_name string, session_id long, blocking_session_id long")
    out = {r.session_id: r for r in blocking_chains(df).collect()}
    assert (out[n].root_blocker, out[n].chain_level) == (1, n - 1)
    assert all(out[i].root_blocker == 1 and out[i].chain_level == i - 1 for i in range(1, n + 1))
    assert out[n + 1].is_cycle and out[n + 2].is_cycle and out[n + 3].is_cycle


def test_role_closure_terminates_on_cycles(spark):
    from fleetscope.operators.security import role_closure

    edges = spark.createDataFrame([("u", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")], "member string, role string")
    got = {(r.member, r.role, r.depth) for r in role_closure(edges).collect()}
    assert ("u", "r3", 3) in got and ("r1", "r1", 3) in got
    assert len({(m, r) for m, r, _ in got}) == len(got)      # each pair once, at its shortest depth


def test_range_join_matches_brute_force_with_multi_day_intervals(spark):
    from fleetscope.operators.relational import range_join

    rnd = random.Random(7)
    pts = [(rnd.choice("ab"), i, T0 + dt.timedelta(hours=rnd.randint(0, 24 * 6))) for i in range(300)]
    ivs = []
    for j in range(25):
        s = T0 + dt.timedelta(hours=rnd.randint(0, 24 * 5))
        ivs.append((rnd.choice("ab"), j, s, s + dt.timedelta(hours=rnd.randint(1, 80))))
    p = spark.createDataFrame(pts, "k string, pid long, t timestamp_ntz")
    iv = spark.createDataFrame(ivs, "k string, iid long, s timestamp_ntz, e timestamp_ntz")
    got = {(r.pid, r.iid) for r in range_join(p, iv, by=["k"], point="t", start="s", end="e").collect()}
    want = {(pi, ii) for pk, pi, t in pts for ik, ii, s, e in ivs if pk == ik and s <= t < e}
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_matches_brute_force(spark, strict):
    from fleetscope.operators.relational import asof_join

    rnd = random.Random(11)
    left = [(rnd.choice("ab"), i, T0 + dt.timedelta(hours=rnd.randint(0, 24 * 8))) for i in range(200)]
    right = [(rnd.choice("ab"), 1000 + j, T0 + dt.timedelta(hours=rnd.randint(0, 24 * 8))) for j in range(40)]
    right += [(k, 2000 + i, t) for k, i, t in left[:10]]           # exact time ties with left rows
    lf = spark.createDataFrame(left, "k string, lid long, lt timestamp_ntz")
    rf = spark.createDataFrame(right, "k string, rid long, rt timestamp_ntz")
    out = asof_join(lf, rf, by=["k"], left_ts="lt", right_ts="rt", right_cols=["rid", "rt"], strict=strict)
    got = {(r.lid, r.rt) for r in out.collect()}
    want = set()
    for k, lid, lt in left:
        cands = [rt for rk, _, rt in right if rk == k and (rt < lt if strict else rt <= lt)]
        want.add((lid, max(cands) if cands else None))
    assert got == want


def test_ranges_split_a_burst_evenly_and_keep_null_keys(spark):
    """All rows of a key in one second, every column equal, and a null key: ranges stay even and in order."""
    from fleetscope.operators.relational import in_ranges

    rows = [("hot", T0, 1, i % 2, 0.0) for i in range(4000)] + [(None, T0, i, i, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    dealt = in_ranges(df, by=["k"], order=["ts", "id"], ranges=10)
    sizes = [r["count"] for r in dealt.groupBy("__rng").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 2 * 450
    got = [r["__rn"] for r in row_number_in_key(df, by=["k"], order="ts", tie=["id"], ranges=10).filter("k = 'hot'").collect()]
    assert sorted(got) == list(range(1, 4001))
    nulls = {(r["id"], r["__rn"], r["__n"]) for r in row_number_in_key(df, by=["k"], order="ts", tie=["id"], ranges=10).filter("k is null").collect()}
    assert nulls == {(i, i + 1, 500) for i in range(500)}


def test_range_helpers_read_their_rows_once(spark):
    """After the dealt rows are written, the rest of the plan scans them and their summary only."""
    df = spark.createDataFrame(_rows(5), SCHEMA)
    for out in (row_number_in_key(df, by=["k"], order="x", tie=["id"]),
                carry_last(df, by=["k"], ts="ts", tie=["id"], value="v", out="c", bucket="ranges")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 2


def test_dyadic_cover_is_exact_and_small(spark):
    from fleetscope.operators.relational import dyadic_cover

    rnd = random.Random(3)
    spans = [(a, a + n) for a, n in ((rnd.randint(-500, 500), rnd.randint(0, 300)) for _ in range(300))] + [(0, 87_660), (7, 87_667)]
    spans += [(a, a + n) for k in range(17) for n in ((1 << k) - 1, 1 << k, (1 << k) + 1) for a in (0, 1 << k, 3)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", dyadic_cover(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        held = [x for n in r["c"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"])]
        assert sorted(held) == list(range(r["a"], r["b"]))      # each number once
        assert len(r["c"]) < 40                                  # ten years of hours too


def test_range_join_long_short_empty_and_touching_intervals(spark):
    from fleetscope.operators.relational import range_join

    day = dt.timedelta(days=1)
    ivs = [("a", 1, T0 - 3650 * day, T0 + 3650 * day), ("a", 2, T0, T0), ("a", 3, T0, T0 + dt.timedelta(seconds=1)),
           ("a", 4, T0 + dt.timedelta(seconds=1), T0 + day), (None, 5, T0, T0 + day), ("a", 6, T0 + day, T0)]
    pts = [("a", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate((-1, 0, 1, 3599, 3600, 86399, 86400))] + [(None, 9, T0)]
    p = spark.createDataFrame(pts, "k string, pid long, t timestamp_ntz")
    iv = spark.createDataFrame(ivs, "k string, iid long, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r.pid, r.iid) for r in range_join(p, iv, by=["k"], point="t", start="s", end="e").collect())
    assert got == sorted((pi, ii) for pk, pi, t in pts for ik, ii, s, e in ivs if pk is not None and pk == ik and s <= t < e)
    assert range_join(p, iv.limit(0), by=["k"], point="t", start="s", end="e").collect() == []


def test_asof_join_with_null_and_hot_keys(spark):
    from fleetscope.operators.relational import asof_join

    left = spark.createDataFrame([("h", i, T0) for i in range(50)] + [(None, 99, T0)], "k string, lid long, lt timestamp_ntz")
    right = spark.createDataFrame([("h", 1, T0 - dt.timedelta(hours=1)), ("h", 2, T0), (None, 3, T0 - dt.timedelta(hours=2))],
                                  "k string, rid long, rt timestamp_ntz")
    for bucket in (None, "day", "ranges", 7):
        out = asof_join(left, right, by=["k"], left_ts="lt", right_ts="rt", right_cols=["rid"], bucket=bucket)
        assert {(r.lid, r.rid) for r in out.collect()} == {(i, 1) for i in range(50)} | {(99, 3)}
