"""Embedding near-duplicates by E8 lattice hashing.

Equal vectors (same label) are collapsed first.  Every table projects the normalised vector to
eight dimensions, decodes the point to the nearest E8 lattice point (its home cell) and
also probes the neighbouring lattice cells in the directions of the residual.  Vectors that meet in a
cell, at least one of them at home there, are compared by cosine in double precision; only
pairs at or above the threshold link.

A pair that shares a home cell in some table is counted in the first such table, inside the task that
holds the cell, so dense groups send counts and spanning edges rather than pairs; pairs that
met through probes only are sent once each and made distinct.  Cells of more than ``block``
vectors are dealt over tasks as pairs of blocks.  Recall depends on the cosine: see the README for
figures against brute force.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing.  Rows that repeat an id count as vectors of their own; a row with a null id
gets the component of its vector (null only if no row there has an id).  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import components, cut, local_roots


#: up to so many cells (16 bytes each) are broadcast
FEW_CELLS = 100_000


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) * 0.5 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.nonzero(f.sum(1) % 2 != 0)[0]
    d = x[odd] - f[odd]
    k = np.abs(d).argmax(1)
    f[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return f


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row (E8 is D8 and D8 shifted by one half)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _mix(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hash of lattice points (rows) and a salt."""
    h = salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(8):
        h = (h ^ (points[:, c] * 2).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(home cells [n, tables], probed cells [n, tables, probes]) of normalised vectors."""
    n, dim = unit.shape
    roots = e8_roots()
    home, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        x = unit @ (np.random.default_rng([seed, t, dim]).standard_normal((dim, 8)) * scale)
        at = e8_decode(x)
        salt = label.astype(np.int64) * 1009 + t
        home[:, t] = _mix(at, salt)
        if probes:
            gain = (x - at) @ roots.T
            for p, k in enumerate(np.argpartition(-gain, probes, axis=1)[:, :probes].T):
                near[:, t, p] = _mix(at + roots[k], salt)
    return home, near


def _vectors(col: pa.Array) -> np.ndarray:
    dim = len(col[0])
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the square
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _entries(tables: int, probes: int, scale: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                vec, dims = b.column(2), np.array([len(x) for x in b.column(2)])
                for dim in np.unique(dims):  # vectors of other lengths never compare
                    rows = pa.array(np.nonzero(dims == dim)[0])
                    part = b.take(rows)
                    raw = _vectors(part.column(2))
                    label = part.column(1).to_numpy().astype(np.int64)
                    home, near = cells(_unit(raw), label + (int(dim) << 32), tables, probes, scale)
                    n = len(raw)
                    payload = pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())
                    homes = pa.array([r.tobytes() for r in home], pa.binary())
                    for t in range(tables):
                        for p in range(-1, probes):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(home[:, t] if p < 0 else near[:, t, p]), pa.array(np.full(n, t, np.int8)),
                                pa.array(np.full(n, p < 0)), part.column(0), pa.array(label), part.column(3), payload, homes],
                                ["cell", "t", "home", "cid", "label", "mult", "vec", "homes"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which every run of equal keys is complete (the input is sorted by them)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
            if held:
                prev = held[-1]
                change[0] |= prev.column(prev.schema.get_field_index(k))[-1].as_py() != c[0]
        at = np.nonzero(change)[0]
        if not len(at):
            held.append(b)
            continue
        last = int(at[-1])
        if held or last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float, tables: int, kind: str):
    names = ["kind", "a", "b", "n"]

    def group(cell_t, home, cid, label, mult, vec, homes, blk):
        out = []
        n = len(cid)
        unit = _unit(vec)
        counts = np.zeros(n, np.int64)
        ei, ej = [], []
        two = blk is not None and blk.min() != blk.max()
        for s in range(0, n, 256):
            sim = unit[s:s + 256] @ unit.T
            i, j = np.nonzero(sim >= threshold)
            i = i + s
            ok = (i < j) & (home[i] | home[j]) & (label[i] == label[j]) & (cid[i] != cid[j])
            if two:
                ok &= blk[i] != blk[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            same = homes[i] == homes[j]
            met = same.any(1)
            here = met & (same.argmax(1) == cell_t) & home[i] & home[j]
            np.add.at(counts, i[here], mult[j[here]])
            np.add.at(counts, j[here], mult[i[here]])
            ei.append(i[here])
            ej.append(j[here])
            x, y = i[~met], j[~met]
            if len(x):
                out.append((np.full(len(x), 2, np.int8), cid[x], cid[y], mult[y]))
                out.append((np.full(len(x), 2, np.int8), cid[y], cid[x], mult[x]))
        linked = np.nonzero(counts)[0]
        if len(linked):
            root = local_roots(np.concatenate(ei), np.concatenate(ej), n)
            out.append((np.zeros(len(linked), np.int8), cid[linked], cid[linked], counts[linked]))
            moved = linked[root[linked] != linked]
            out.append((np.ones(len(moved), np.int8), cid[moved], cid[root[moved]], np.zeros(len(moved), np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _whole_groups(batches, ["cell", "pair"]):
            cell, pair = tab.column("cell").to_numpy(), tab.column("pair").to_numpy()
            edge = np.nonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1]))[0] + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(cell)]))
            use = np.nonzero(ends - starts > 1)[0]
            if not len(use):
                continue
            t, home = tab.column("t").to_numpy(), tab.column("home").to_numpy()
            cid, label, mult = (tab.column(c).to_numpy() for c in ("cid", "label", "mult"))
            blk = tab.column("blk").to_numpy()
            out = []
            for g in use:
                s, e = int(starts[g]), int(ends[g])
                if not home[s:e].any():
                    continue
                raw = tab.column("vec").slice(s, e - s).to_pylist()
                hs = tab.column("homes").slice(s, e - s).to_pylist()
                for size in {len(r) for r in raw}:
                    at = [k for k, r in enumerate(raw) if len(r) == size]
                    vec = np.frombuffer(b"".join(raw[k] for k in at), kind).astype(np.float64).reshape(len(at), -1)
                    homes = np.frombuffer(b"".join(hs[k] for k in at), np.int64).reshape(len(at), tables)
                    k = np.array(at) + s
                    out += group(t[s], home[k], cid[k], label[k], mult[k], vec, homes, blk[k] if pair[s] >= 0 else None)
            if out:
                cols = [np.concatenate([o[c] for o in out]) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93, tables: int = 6, probes: int = 2, scale: float = 0.7, block: int = 4096) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    # vectors travel as they are stored; all arithmetic is in double precision
    kind = "f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "f8"
    vec = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vec, lambda x: x != 0), F.lit(False))
    lab = F.xxhash64(F.col(label_col).cast("string"))
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(fine, lab).alias("label"), F.when(fine, vec).alias("vec"))
    rows = rows.withColumn("cid", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    classes = cut(rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("mult"), F.min("_id").alias("low")))
    sent = classes.select("cid", "label", "vec", "mult").mapInArrow(
        _entries(tables, probes, scale, kind), "cell long, t tinyint, home boolean, cid long, label long, mult long, vec binary, homes binary")
    # cells with more than one block of vectors: usually few, then sent along with the tasks; otherwise joined by a shuffle
    big = cut(sent.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select(
        F.col("cell").alias("_c"), F.ceil(F.col("n") / block).cast("int").alias("nb")))
    few = big.count() <= FEW_CELLS
    dealt = sent.join(F.broadcast(big) if few else big, F.col("cell") == F.col("_c"), "left").drop("_c")
    blk = F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("cid", F.lit(3)), F.col("nb"))).cast("int")
    dealt = dealt.withColumn("blk", blk)
    # the pair (x, y) of blocks, x <= y, has the number x * nb + y
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda y: F.least(F.col("blk"), y) * F.col("nb") + F.greatest(F.col("blk"), y))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(-1))).otherwise(pairs))).drop("nb")
    found = dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(
        _compare(threshold, tables, kind), "kind tinyint, a long, b long, n long")
    found = cut(found)
    links = found.where("kind = 0").select("a", "n").unionByName(
        found.where("kind = 2").distinct().select("a", "n")).groupBy("a").agg(F.sum("n").alias("links"))
    comp = components(found.where("kind > 0").select("a", "b"))
    of = classes.select("cid", "mult", "low").join(comp, F.col("cid") == F.col("node"), "left").join(
        links, F.col("cid") == F.col("a"), "left").select(
        "cid", "mult", "low", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    lowest = of.groupBy("root").agg(F.min("low").alias("component"))
    of = of.join(lowest, "root").select(F.col("cid").alias("_cid"), (F.col("links") + F.col("mult") - 1).alias("links"), "component")
    out = rows.select("_id", "cid").join(of, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("_id")).otherwise(F.col("component"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    return link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


#: all pairs of the table, so for small tables only
OP5_SQL = """
WITH RECURSIVE
f AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM f WHERE fine),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT f.vec_id, coalesce(n.n, 0) AS n_links, least(f.vec_id, coalesce(c.low, f.vec_id)) AS component_id, coalesce(c.low, f.vec_id) >= f.vec_id AS kept
FROM f LEFT JOIN n ON n.a = f.vec_id LEFT JOIN c ON c.a = f.vec_id
"""
