"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id); equal texts are neighbours.  The
``shards - 1`` splitters are found by counting: every round places ``probes`` candidate
boundaries in the interval of each unsettled splitter, counts the exact bytes below each
boundary over all partitions (partial histograms per task, summed by Spark), and narrows the
interval.  A splitter settles when the bytes below it are within ``tolerance`` of a shard of its goal;
if a group of equal texts is too heavy for that, the search goes on inside it by the id's hash, and rows that are equal in
text and id are cut by their number.  The driver sees histograms only.  Rows are then exchanged once; rows of a key that is cut by
number (fewer such keys than shards) are numbered first, over ranges of equal depth.

Law ``bytes``: the sizes of the shards are equal but for the tolerance and the size of a
single row.  Groups of equal texts stay in one shard unless they cross a boundary and are
heavier than the tolerance allows.

Null and empty texts have size 16 (the row's overhead).  Rows that repeat an id are neighbours;
null ids sort like a hash of null.  An empty table gives no rows.  Extra columns are passed on; input columns
named size, shard or slot are replaced by the results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import cut
from fleetscope.operators.relational import row_number_in_key

OVERHEAD = 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _histogram(rows: DataFrame, cuts: dict[int, np.ndarray]) -> dict[int, dict[str, np.ndarray]]:
    """Exact bytes, rows, smallest and largest key of the rows between the sorted cuts of each lane.

    ``rows``: lane, k, size.  Interval i holds cuts[i-1] <= k < cuts[i]; the first and last are open.
    """
    def run(batches):
        acc = {g: (np.zeros(len(c) + 1, np.int64), np.zeros(len(c) + 1, np.int64), np.full(len(c) + 1, HIGH), np.full(len(c) + 1, LOW))
               for g, c in cuts.items()}
        for b in batches:
            lane, key, size = (c.to_numpy() for c in b.columns)
            for g in np.unique(lane):
                if g in acc:
                    own = lane == g
                    k, (total, n, low, top) = key[own], acc[g]
                    i = np.searchsorted(cuts[g], k, side="right")
                    np.add.at(total, i, size[own])
                    np.add.at(n, i, 1)
                    np.minimum.at(low, i, k)
                    np.maximum.at(top, i, k)
        for g, cols in acc.items():
            at = np.nonzero(cols[1])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), *(pa.array(x) for x in (at, *(c[at] for c in cols)))],
                                             ["lane", "i", "size", "n", "low", "top"])

    got = rows.mapInArrow(run, "lane int, i long, size long, n long, low long, top long").groupBy("lane", "i").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("top").alias("top")).collect()
    out = {g: {"size": np.zeros(len(c) + 1, np.int64), "n": np.zeros(len(c) + 1, np.int64), "low": np.full(len(c) + 1, HIGH),
               "top": np.full(len(c) + 1, LOW)} for g, c in cuts.items()}
    for r in got:
        for c, x in out[r["lane"]].items():
            x[r["i"]] = r[c]
    return out


def _search(rows: DataFrame, goals: list[tuple[int, float]], tol: float, totals: dict[int, int], probes: int) -> list[tuple[int, int, int, int]]:
    """For each goal (lane, bytes): boundary, bytes below it, bytes below it and its key, rows of its key.

    The second and third are equal where a boundary within ``tol`` was found.  All goals of
    all lanes are refined by one pass over the rows per round.
    """
    lo = [(LOW, 0) for _ in goals]  # bytes below lo <= goal
    hi = [(HIGH, totals[g]) for g, _ in goals]
    found: dict[int, tuple[int, int, int, int]] = {}
    while len(found) < len(goals):
        cuts: dict[int, set[int]] = {}
        for x, (lane, goal) in enumerate(goals):
            if x in found:
                continue
            (a, ca), (b, cb) = lo[x], hi[x]
            # keys are hashes: probe around the proportional place and at even steps
            mid = a + int((b - a) * min(max((goal - ca) / max(1, cb - ca), 0.0), 1.0))
            half = max(2, probes // 2)
            step = max(1, (b - a) >> 12)
            mine = cuts.setdefault(lane, set())
            mine.update((a, b))  # so that what the next round sees of this goal never grows
            mine.update(min(max(mid + (i - half // 2) * step, a + 1), b) for i in range(half))
            mine.update(a + 1 + (b - a - 1) * i // half for i in range(half))
        arrs = {g: np.array(sorted(c), np.int64) for g, c in cuts.items()}
        hist = _histogram(rows, arrs)
        for x, (lane, goal) in enumerate(goals):
            if x in found:
                continue
            h, arr = hist[lane], arrs[lane]
            upto = np.cumsum(h["size"])
            best = int(np.abs(upto[:-1] - goal).argmin())
            if abs(int(upto[best]) - goal) <= tol:
                found[x] = (int(arr[best]), int(upto[best]), int(upto[best]), 0)
                continue
            i = int(np.searchsorted(upto, goal, side="right"))  # the goal lies inside interval i
            low, top, before = int(h["low"][i]), int(h["top"][i]), int(upto[i] - h["size"][i])
            if low == top:  # one key holds all of it
                found[x] = (low, before, int(upto[i]), int(h["n"][i]))
            else:
                lo[x], hi[x] = (low, before), (top + 1, int(upto[i]))
    return [found[x] for x in range(len(goals))]


def splitters(rows: DataFrame, shards: int, tolerance: float, whole: float = 0.01, probes: int = 64) -> list[tuple[int, int, int]]:
    """Boundaries (k1, k2, number), ascending; rows (k1, k2, size).  A row belongs to the shard of the boundaries <= its key and number.

    Rows of one key (k1, k2) are numbered from 0; a number above 0 cuts such rows.  A group of one key k1 of at most ``whole`` of a
    shard is not cut: the boundary takes its nearer side.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    goals = [total * (i + 1) / shards for i in range(shards - 1)]
    tol = tolerance * total / shards
    lane0 = rows.select(F.lit(0).alias("lane"), F.col("k1").alias("k"), "size")
    first = _search(lane0, [(0, g) for g in goals], tol, {0: total}, probes)
    out: list[tuple[int, int, int]] = []
    inner: list[int] = []
    for x, (k, below, upto, n) in enumerate(first):
        if n > 1 and upto - below > whole * total / shards:
            inner.append(x)
        # a boundary that was found has n = 0; otherwise the nearer side of the key's rows
        out.append((k + (n > 0 and goals[x] - below > upto - goals[x]), LOW, 0))
    if inner:
        heavy = sorted({first[x][0] for x in inner})  # at most shards - 1 keys
        lane_of = {k: i for i, k in enumerate(heavy)}
        lane = F.lit(None).cast("int")
        for k, i in lane_of.items():
            lane = F.when(F.col("k1") == k, F.lit(i)).otherwise(lane)
        inside = cut(rows.where(F.col("k1").isin(heavy)).select(lane.alias("lane"), F.col("k2").alias("k"), "size"))
        totals = {lane_of[first[x][0]]: first[x][2] - first[x][1] for x in inner}
        want = [(lane_of[first[x][0]], goals[x] - first[x][1]) for x in inner]
        for x, (_, goal), (k2, at, most, n) in zip(inner, want, _search(inside, want, tol, totals, probes), strict=True):
            # rows with the very same key have one size: so many of them stay below
            number = round((goal - at) / ((most - at) / n)) if n else 0
            out[x] = (first[x][0], k2 + (n > 0 and number >= n), number if number < n else 0)
    return sorted(out)


def shard_of(bounds: list[tuple[int, int, int]]):
    """pandas_udf (k1, k2, number) -> shard."""
    table = np.array(bounds, np.int64).reshape(-1, 3)

    def run(*keys: pd.Series) -> pd.Series:
        def among(lo: int, hi: int, level: int, rows: np.ndarray) -> None:
            """Boundaries of table[lo:hi] (equal before ``level``) at or below the keys of ``rows``."""
            own, key = table[lo:hi, level], cols[level][rows]
            out[rows] = lo + np.searchsorted(own, key, side="left" if level < 2 else "right")
            if level < 2:
                for v in np.unique(own):
                    a, b = lo + np.searchsorted(own, v, side="left"), lo + np.searchsorted(own, v, side="right")
                    same = rows[key == v]
                    if len(same):
                        among(int(a), int(b), level + 1, same)

        cols = [k.to_numpy() for k in keys]
        out = np.zeros(len(cols[0]), np.int32)
        among(0, len(table), 0, np.arange(len(out)))
        return pd.Series(out)

    return F.pandas_udf(run, "int")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005,
          probes: int = 64, rows_per_task: int = 100_000) -> DataFrame:
    """``docs`` with size, shard and slot (from 0 without gaps in a shard), exchanged once."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long")
    k1, k2 = F.xxhash64(F.coalesce(text_col, F.lit(""))), F.xxhash64(F.col(id_col), F.lit(2))
    keys = cut(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")))
    n = keys.count()
    bounds = splitters(keys, shards, tolerance, probes=probes)
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    first = F.lit(0).cast("long").alias("_number")
    out = docs.select(*kept, size.alias("size"), k1.alias("_k1"), k2.alias("_k2"), first)
    slim = keys.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), first)
    split = sorted({b[:2] for b in bounds if b[2]})  # fewer than shards
    if split:
        is_split = F.struct("_k1", "_k2").isin([F.struct(F.lit(a).alias("_k1"), F.lit(b).alias("_k2")) for a, b in split])
        numbered = row_number_in_key(out.where(is_split).drop("_number"), by=["_k1", "_k2"], order="size")
        numbered = numbered.withColumn("_number", F.col("__rn") - 1).drop("__rn", "__n")
        out, slim = out.where(~is_split).unionByName(numbered), slim.where(~is_split).unionByName(numbered.select("_k1", "_k2", "_number"))
    # a shard is dealt over ``salts`` tasks, by id and number, so that neither its rows nor copies meet in one
    salts = max(1, math.ceil(n / shards / rows_per_task))
    put = {"shard": shard_of(bounds)("_k1", "_k2", "_number") if bounds else F.lit(0),
           "_salt": F.pmod(F.xxhash64("_k2", "_number"), F.lit(salts)).cast("int")}
    out, counts = out.withColumns(put), slim.withColumns(put).groupBy("shard", "_salt").agg(F.count("*").alias("n"))
    before = counts.select(F.col("shard").alias("_s"), F.col("_salt").alias("_t"),
                           (F.sum("n").over(Window.partitionBy("shard").orderBy("_salt")) - F.col("n")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy("_k1", "_k2", "_number", id_col)) - 1
    out = out.withColumn("_r", rank).join(before, (F.col("shard") == F.col("_s")) & (F.col("_salt") == F.col("_t")))
    return out.withColumn("slot", (F.col("_r") + F.col("_base")).cast("long")).select(*kept, "size", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    """Shard places of ``documents`` rows, without their texts."""
    slim = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(slim, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Shard files with the rows' own columns: one folder per shard."""
    shard(docs, **kw).write.partitionBy("shard").parquet(path)


def op2_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    return digest(table(spark, sf_dir, "documents"))
