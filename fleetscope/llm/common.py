"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.session import ensure_checkpoint_dir

#: text bytes handled by one numpy pass inside a task
CHUNK_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that nothing refers to any more.

    Shuffle files of finished jobs stay on the executors' disks until the driver's JVM
    collects the objects that own them; long operators call this between their steps.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column | str) -> Column:
    """Fold rule: crc32 of the id as text, modulo 5, is 0 (null id: not held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def finite_vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) of the non-empty lists of ``col`` without null or non-finite entries, by length."""
    size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    fine = (size > 0) & (odd[ends] == odd[ends - size])
    for dim in np.unique(size[fine]):
        rows = np.nonzero(fine & (size == dim))[0]
        yield rows, flat[(ends - size)[rows][:, None] + np.arange(dim)]


def parts_for(n_bytes: int, target: int = 64 << 20, least: int = 16) -> int:
    """Partitions of about ``target`` bytes."""
    return max(least, math.ceil(n_bytes / target))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternating large-star / small-star; every round is two aggregations with map-side
    combine and joins that AQE may split, so a hub with very many neighbours does not meet in
    one task.  Each round is checkpointed and costs no more rows than the edges.  Nodes
    without an edge do not appear.  ``max_rounds`` is only a guard: it raises, it never
    returns an unfinished labelling.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is hung under the node's smallest neighbour
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        # small star: the smaller neighbours of a node are hung under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(kept.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return roots.unionByName(tops.select("node", F.col("node").alias("root")))
