"""Exact top-k search by inner product over a bit-sliced index.

Every component x becomes the integer floor(scale * x).  The index holds blocks of rows; in a block each
dimension (less its smallest value) is kept as bitmaps over the rows, one for each of its highest ``slices`` bits,
together with the ids and the exact integers.

A query adds the slices of all dimensions, each as often as the bits of its component say, by carry-save bitmap
arithmetic (slices are inverted where the component is negative).  The sum is a lower bound of every row's score,
off by less than a known figure that is the same for all rows.  The k-th largest sum is read off from the most
significant slice downward; rows whose sum lies less than that figure below it form the boundary, and their scores
are computed exactly from the integers.  The best of every block meet in one ranking per query.

Blocks of rows and blocks of queries meet once each, in a task of their own; nothing passes through the driver and
no task holds more than one block of each.  Vectors that are null, empty or hold null or non-finite components, or
components so large that a score would not fit a long, take no part.  Scores compare vectors of one length only.  Rows
that repeat are candidates one by one; each query row asks for itself and never meets rows of its own id.  Rows
with a null id are candidates (after all ids in a tie) but never queries.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import cut, finite_vectors

#: integers in one block of rows (8192 rows of 64 dimensions)
BLOCK_CELLS = 1 << 19
#: queries in one block
BLOCK_QUERIES = 4096

INDEX = "dim int, n int, shift int, ids binary, known binary, kind string, whole binary, slices binary"


def integers(m: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * m) as int64, rows whose inner products surely fit a long)."""
    y = np.floor(m * scale)
    ok = np.abs(y).max(axis=1, initial=0) <= math.isqrt((1 << 62) // m.shape[1])
    return y[ok].astype(np.int64), np.nonzero(ok)[0]


def block_rows(dim: int) -> int:
    return max(64, BLOCK_CELLS // dim)


def _pack(scale: float, slices: int):
    def flush(ids, known, x) -> dict:
        n, dim = x.shape
        y = (x - x.min(axis=0)).T
        width = max(1, int(y.max(initial=0)).bit_length())
        shift = max(0, width - slices)
        y >>= shift
        words = -(-n // 64)
        maps = np.zeros((dim, width - shift, words * 8), np.uint8)
        for j in range(width - shift):
            bits = np.packbits((y >> j & 1).astype(bool), axis=1, bitorder="little")
            maps[:, j, :bits.shape[1]] = bits
        kind = next(k for k in ("i2", "i4", "i8") if -np.iinfo(k).max <= x.min() and x.max() <= np.iinfo(k).max)
        return {"dim": dim, "n": n, "shift": shift, "ids": ids.tobytes(), "known": known.tobytes(),
                "kind": kind, "whole": x.astype(kind).tobytes(), "slices": maps.tobytes()}

    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, m in finite_vectors(b.column(1)):
                x, ok = integers(m, scale)
                dim, at = m.shape[1], rows[ok]
                held.setdefault(dim, []).append((ids[at], known[at], x))
                while sum(len(h[0]) for h in held[dim]) >= block_rows(dim):
                    parts = [np.concatenate(c) for c in zip(*held[dim], strict=True)]
                    size = block_rows(dim)
                    held[dim] = [tuple(c[size:] for c in parts)]
                    yield pa.RecordBatch.from_pylist([flush(*(c[:size] for c in parts))], pa.schema(list(zip(names, types, strict=True))))
        for parts in held.values():
            ids, known, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            if len(ids):
                yield pa.RecordBatch.from_pylist([flush(ids, known, x)], pa.schema(list(zip(names, types, strict=True))))

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, slices: int = 7) -> DataFrame:
    """Blocks of rows (column ``block`` numbers the partitions that made them from 0); rows are dealt out evenly."""
    src = vectors.select(F.col(id_col).cast("long"), F.col(vec_col))
    n, dim = src.agg(F.count("*"), F.coalesce(F.max(F.size(F.col(vec_col))), F.lit(1))).collect()[0]
    parts = max(1, -(-n // block_rows(max(1, dim))))
    return src.repartition(parts).mapInArrow(_pack(scale, slices), INDEX).withColumn("block", F.spark_partition_id())


def add_slices(maps: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Slices (lowest first) of the sum over dimensions of |q| times the slices of the dimension, inverted where q < 0."""
    dim, width, words = maps.shape
    size = np.abs(q)
    depth = int(size.sum()) * ((1 << width) - 1)
    total = max(1, depth.bit_length())
    acc, carry = np.zeros((total + 1, words), np.uint64), np.zeros((total + 1, words), np.uint64)
    for d in np.nonzero(size)[0]:
        z = maps[d] if q[d] > 0 else ~maps[d]
        for b in range(int(size[d]).bit_length()):
            if size[d] >> b & 1:
                a, c = acc[b:], carry[b:]
                half, both = a ^ c, a & c
                both[:width] |= half[:width] & z
                half[:width] ^= z
                acc[b:], carry[b] = half, 0
                carry[b + 1:] = both[:-1]
    kept = np.zeros(words, np.uint64)
    for i in range(total):
        half = acc[i] ^ carry[i]
        acc[i], kept = half ^ kept, acc[i] & carry[i] | half & kept
    return acc[:total]


def count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def boundary(sums: np.ndarray, exists: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Bitmap of the rows of ``exists`` whose sum is at least the k-th largest one less ``slack``; all if there are fewer than k."""
    sure, open_, kth = np.zeros_like(exists), exists.copy(), 0
    for i in range(len(sums) - 1, -1, -1):
        with_bit = open_ & sums[i]
        if count(sure | with_bit) >= k:
            open_, kth = with_bit, kth | 1 << i
        else:
            sure, open_ = sure | with_bit, open_ & ~sums[i]
    least = kth - slack
    if least <= 0:
        return exists
    above, equal = np.zeros_like(exists), exists.copy()
    for i in range(len(sums) - 1, -1, -1):
        if least >> i & 1:
            equal = equal & sums[i]
        else:
            above, equal = above | equal & sums[i], equal & ~sums[i]
    return above | equal


def best_of_block(maps: np.ndarray, shift: int, whole: np.ndarray, ids: np.ndarray, known: np.ndarray, q: np.ndarray,
                  query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, scores) of the k best rows of one block, ties to smaller ids."""
    n = len(ids)
    exists = np.zeros(maps.shape[2] * 8, np.uint8)
    bits = np.packbits((ids != query_id) | ~known, bitorder="little")
    exists[:len(bits)] = bits
    sums = add_slices(maps, q)
    # what the bits below the slices can add to a sum, in units of the lowest slice
    slack = ((1 << shift) - 1) * int(np.abs(q).sum()) >> shift
    edge = boundary(sums, exists.view(np.uint64), k, slack)
    rows = np.nonzero(np.unpackbits(edge.view(np.uint8), bitorder="little", count=n))[0]
    scores = whole[rows].astype(np.int64) @ q
    order = np.lexsort((ids[rows], ~known[rows], -scores))[:k]
    return rows[order], scores[order]


def _probe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}
                dim, n = x["dim"], x["n"]
                maps = np.frombuffer(x["slices"], np.uint64).reshape(dim, -1, -(-n // 64))
                whole = np.frombuffer(x["whole"], x["kind"]).reshape(n, dim)
                ids, known = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["known"], bool)
                asked = np.frombuffer(x["q_whole"], x["q_kind"]).reshape(-1, dim).astype(np.int64)
                out = []
                for i, (q, query_id) in enumerate(zip(asked, np.frombuffer(x["q_ids"], np.int64), strict=True)):
                    rows, scores = best_of_block(maps, x["shift"], whole, ids, known, q, int(query_id), k)
                    m = len(rows)
                    out.append((np.full(m, i), np.full(m, query_id), ids[rows], known[rows], scores))
                who, query, vec, has, score = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), x["q_block"])), pa.array(who), pa.array(query), pa.array(vec, mask=~has), pa.array(score)],
                    ["q_block", "q_row", "query_id", "vec_id", "score"])

    return run


def _stacks(scale: float):
    """Blocks of query vectors, of one length each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, m in finite_vectors(b.column(1)):
                x, ok = integers(m, scale)
                for s in range(0, len(ok), BLOCK_QUERIES):
                    kind = next(c for c in ("i2", "i4", "i8") if np.abs(x[s:s + BLOCK_QUERIES]).max(initial=0) <= np.iinfo(c).max)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m.shape[1]], pa.int32()), pa.array([ids[rows[ok[s:s + BLOCK_QUERIES]]].tobytes()], pa.binary()),
                         pa.array([kind]), pa.array([x[s:s + BLOCK_QUERIES].astype(kind).tobytes()], pa.binary())],
                        ["q_dim", "q_ids", "q_kind", "q_whole"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for every row of ``queries``, rows of its own id aside."""
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col))
    parts = max(1, -(-asked.count() // BLOCK_QUERIES))
    # few wide rows: numbers of the blocks come from their place in the written table
    stacks = cut(asked.repartition(parts).mapInArrow(_stacks(scale), "q_dim int, q_ids binary, q_kind string, q_whole binary")
                 .withColumn("q_block", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    blocks = cut(index)
    wide = blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).collect()[0][0]
    deep = stacks.agg(F.coalesce(F.max("part") + 1, F.lit(0))).collect()[0][0]
    if not wide or not deep:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the cell of row block b and query part p is b * deep + p; every block is sent to all its cells
    left = blocks.withColumn("cell", F.explode(F.sequence(F.col("block") * deep, F.col("block") * deep + (deep - 1))))
    right = stacks.withColumn("cell", F.explode(F.sequence(F.col("part"), F.col("part") + (wide - 1) * deep, F.lit(deep)))).drop("part")
    spread = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * wide * deep)
    met = left.repartition(spread, "cell").join(right.repartition(spread, "cell"), "cell").where("dim = q_dim")
    got = met.drop("cell", "block", "q_dim").mapInArrow(_probe(k), "q_block long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
