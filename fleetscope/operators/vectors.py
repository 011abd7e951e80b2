"""Vector search (VEC-1, VEC-2).

Top-k search is an exact block product: queries and corpus are dealt into
blocks of bounded size, every (query block, corpus block) pair is one numpy
matrix product in one task that keeps its ``k`` best per query, and a final
per-query top-k runs over ``k x corpus blocks`` candidates.  No vector
passes through the driver and neither side is limited.

For repeated searches, or vectors that cluster, rows are dealt to the cells of chosen centres; a query visits only
those cells that the triangle inequality does not rule out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import distance
from ..session import ensure_checkpoint_dir


def pair_distances(pairs: DataFrame, *, a: str, b: str, metrics=("cosine", "euclidean", "dot"),
                   digits: int = 6) -> DataFrame:
    """VEC-2: distance metrics between two vector columns, JVM side."""
    return pairs.select("*", *[F.round(distance(m, a, b), digits).alias(f"{m}_distance") for m in metrics])


def _block_top_k(k: int, metric: str, digits: int):
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    def run(t: pa.Table) -> pa.Table:
        is_q = t.column("is_query").to_numpy()
        ids = t.column("id").to_numpy()
        vecs = np.array([np.asarray(v, dtype=np.float64) for v in t.column("vec").to_pylist()])
        out = {"query_id": [], "match_id": [], "distance": []}
        if is_q.any() and not is_q.all():
            qid, q, cid, c = ids[is_q], vecs[is_q], ids[~is_q], vecs[~is_q]
            if metric == "cosine":
                q, c = unit(q), unit(c)
            for s in range(0, len(q), 256):
                part = q[s:s + 256]
                if metric == "euclidean":
                    d = np.sqrt(np.maximum((part ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None, :] - 2 * part @ c.T, 0))
                else:
                    d = (1.0 if metric == "cosine" else 0.0) - part @ c.T
                d = np.round(d, digits) + 0.0  # ties are ties of the reported distance; no -0.0
                for i, row in enumerate(d):
                    kth = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                    near = np.nonzero(row <= kth)[0]
                    near = near[np.lexsort((cid[near], row[near]))][:k]
                    out["query_id"].append(np.full(len(near), qid[s + i]))
                    out["match_id"].append(cid[near])
                    out["distance"].append(row[near])
        cols = {n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()}
        return pa.table({"query_id": pa.array(cols["query_id"].astype(np.int64)), "match_id": pa.array(cols["match_id"].astype(np.int64)),
                         "distance": pa.array(cols["distance"].astype(np.float64))})

    return run


def _usable(df: DataFrame, metric: str, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0)
    if metric == "cosine":
        ok = ok & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(ok)


def _meet(q: DataFrame, c: DataFrame, k: int, metric: str, digits: int) -> DataFrame:
    """Candidates of the block products: queries (id, vec, cell) against rows (id, vec, cell) of equal cells."""
    both = q.withColumn("is_query", F.lit(True)).unionByName(c.withColumn("is_query", F.lit(False)))
    return both.groupBy("cell").applyInArrow(_block_top_k(k, metric, digits), "query_id long, match_id long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "match_id")
    top = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return top.select("query_id", "match_id", "distance", "rank")


def top_k_search(corpus: DataFrame, queries: DataFrame, *, k: int = 5, metric: str = "cosine",
                 id_col: str = "vec_id", vec_col: str = "embedding", block: int = 32768, digits: int = 6) -> DataFrame:
    """VEC-1: the ``k`` nearest corpus vectors of every query vector (ascending
    distance; the reference orders furthest first), ties of the rounded
    distance by corpus id.  Null vectors take no part; with the cosine metric
    zero vectors have no direction and take no part either."""
    q, c = _usable(queries, metric, id_col, vec_col), _usable(corpus, metric, id_col, vec_col)
    nq, nc = (max(1, math.ceil(d.count() / block)) for d in (q, c))
    # every query meets every corpus block and the other way round
    cell = F.struct("qb", "cb").alias("cell")
    deal_q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).select("id", "vec", cell)
    deal_c = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("id", "vec", cell)
    return _best(_meet(deal_q, deal_c, k, metric, digits), k)


def _nearest_centre(centres: np.ndarray, metric: str):
    """(id, vec, centre, gap): the centre nearest to each row and the distance to it (of directions for the cosine metric)."""
    def run(batches):
        for b in batches:
            vecs = np.array([np.asarray(v, dtype=np.float64) for v in b.column(1).to_pylist()])
            if not len(vecs):
                continue
            p = vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True)) if metric == "cosine" else vecs
            at, gap = np.empty(len(p), np.int32), np.empty(len(p))
            for s in range(0, len(p), 1024):
                d = ((p[s:s + 1024, None, :] - centres[None, :, :]) ** 2).sum(2) if p.shape[1] * len(centres) <= 1 << 14 else \
                    np.maximum((p[s:s + 1024] ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * p[s:s + 1024] @ centres.T, 0)
                at[s:s + 1024] = d.argmin(1)
                gap[s:s + 1024] = np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(gap)], ["id", "vec", "centre", "gap"])

    return run


def _cells_in_reach(centres: np.ndarray, radius: np.ndarray, metric: str, slack: float):
    """(id, vec, centre) of the centres whose cell may hold a vector nearer than the query's ``reach``, its own centre aside."""
    def run(batches):
        for b in batches:
            vecs = np.array([np.asarray(v, dtype=np.float64) for v in b.column(1).to_pylist()])
            if not len(vecs):
                continue
            own, reach = b.column(2).to_numpy(), b.column(3).to_numpy()
            size = np.sqrt((vecs * vecs).sum(1))
            p = vecs / size[:, None] if metric == "cosine" else vecs
            apart = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * p @ centres.T, 0))
            nearest = np.maximum(apart - radius[None, :], 0)
            if metric == "cosine":
                least = nearest ** 2 / 2  # of unit vectors
            elif metric == "euclidean":
                least = nearest
            else:
                least = -(p @ centres.T) - size[:, None] * radius[None, :]
            go = (least <= reach[:, None] + slack) & (radius >= 0)[None, :]
            go[np.arange(len(own)), own] = False
            who, centre = np.nonzero(go)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who)), pa.array(centre.astype(np.int32))], ["id", "vec", "centre"])

    return run


@dataclass(frozen=True)
class CellIndex:
    """Rows dealt to the cell of their nearest centre; every cell knows its radius."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray  # -1: empty
    blocks: DataFrame
    metric: str


def build_cells(corpus: DataFrame, *, metric: str = "cosine", centres: int = 256, block: int = 32768, id_col: str = "vec_id",
                vec_col: str = "embedding") -> CellIndex:
    """Index for :func:`top_k_in_cells`.  The centres are ``centres`` rows chosen by the hash of their id; every row is indexed.
    Cells of more than ``block`` rows are dealt into several blocks."""
    c = _usable(corpus, metric, id_col, vec_col)
    chosen = c.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(centres).collect()  # a documented, bounded sample
    p = np.array([r["vec"] for r in chosen], np.float64)
    if metric == "cosine" and len(p):
        p = p / np.sqrt((p * p).sum(1, keepdims=True))
    p = np.unique(p, axis=0) if len(p) else p
    ensure_checkpoint_dir(corpus.sparkSession)
    rows = c.mapInArrow(_nearest_centre(p, metric), "id long, vec array<double>, centre int, gap double") if len(p) else c.selectExpr(
        "id", "vec", "0 AS centre", "0.0D AS gap").limit(0)
    rows = rows.checkpoint()
    sizes = rows.groupBy("centre").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    radius = np.full(len(p), -1.0)
    for r in sizes.select("centre", "radius").collect():  # one row per centre
        radius[r["centre"]] = r["radius"] * (1 + 1e-9) + 1e-9
    blocks = sizes.select("centre", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = rows.join(blocks, "centre").select("id", "vec", "centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return CellIndex(dealt, p, radius, blocks, metric)


def top_k_in_cells(index: CellIndex, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                   block: int = 32768, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """VEC-1 without meeting every block: the result of :func:`top_k_search`, and per query the share of cells it skipped.

    A query first searches the cell of its nearest centre; its k-th distance there bounds the answer.  By the triangle inequality a cell
    whose centre is further away than that bound plus the cell's radius cannot hold a better vector and is not visited.
    The result is exact; how much is skipped depends on how the vectors cluster.  Query ids are distinct."""
    metric = index.metric
    q = _usable(queries, metric, id_col, vec_col)
    spark = q.sparkSession
    if not len(index.centres):
        return (spark.createDataFrame([], "query_id long, match_id long, distance double, rank long"),
                q.select(F.col("id").alias("query_id"), F.lit(0.0).alias("skipped")))
    near = q.mapInArrow(_nearest_centre(index.centres, metric), "id long, vec array<double>, centre int, gap double").drop("gap").checkpoint()

    def visit(asked: DataFrame) -> DataFrame:
        # queries per centre decide in how many parts they come; every part meets every block of the cell
        load = asked.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_parts"))
        plan = index.blocks.join(load, "centre")
        cell = F.struct("centre", "part", "q_part").alias("cell")
        a = asked.join(plan, "centre").withColumn("q_part", F.pmod(F.xxhash64("id"), F.col("q_parts")).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "vec", cell)
        b = index.rows.join(load, "centre").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("id", "vec", cell)
        return _meet(a, b, k, metric, digits)

    first = _best(visit(near), k).checkpoint()
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("reach"))
    asked = near.join(bound, "id", "left").select("id", "vec", "centre", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    more = asked.mapInArrow(_cells_in_reach(index.centres, index.radius, metric, 10.0 ** -digits), "id long, vec array<double>, centre int").checkpoint()
    found = first.drop("rank").unionByName(visit(more))
    cells = int((index.radius >= 0).sum())
    seen = near.select("id").join(more.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left")
    share = seen.select(F.col("id").alias("query_id"), F.round(1 - (F.coalesce("n", F.lit(0)) + 1) / cells, 6).alias("skipped"))
    return _best(found, k), share
