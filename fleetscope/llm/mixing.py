"""Mixing sources to target weights by cube-method balanced sampling.

Targets: the wanted total is shared over the sources by weight; a target stops at
``max_repeat`` times its source's size and the excess is shared anew by weight until no source is
above.  A document of a source with c = target / size gets floor(c) copies for certain and one
more with inclusion probability c - floor(c).

The fractional part is drawn by the cube method: in the flight phase a vector of inclusion
probabilities moves along directions in the null space of the balancing constraints (token total
and document total of the source) until an entry reaches 0 or 1; each step settles at least one
document and keeps both totals.  Flights run in blocks of at most ``block`` documents of one
source, which leave at most two documents each; these open documents meet in further flights until
one block per source is left.  The landing phase settles its last (two) documents by the choice
whose token total is nearest.  Documents of equal probability but very different size are fine: totals
are balanced on sizes.

Null texts have size 0 and are drawn like others.  Rows of equal id, source and size are counted and numbered: each is
drawn for itself (each row carries its own number of copies), and blocks are dealt by id, size and number, so neither null nor
repeated ids fill one block.  An empty table gives no rows.  Null sources form one
source, last in the order.  Extra columns are ignored.  Draws depend only on ids, sizes and sources
(hash-seeded), so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut

#: source tables of up to so many rows (about 60 bytes each) are broadcast
FEW_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def numbered_rows(rows: DataFrame, chunk: int = 10_000) -> DataFrame:
    """``rows`` with a number ``_n`` that tells equal rows apart (from 0): counted, then unfolded in chunks dealt over the tasks."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count("*").alias("_m"))
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / chunk)))).repartition(
        F.xxhash64(*cols, "_part"))
    return parts.select(*cols, F.explode(F.sequence(F.col("_part") * chunk, F.least(F.col("_m"), (F.col("_part") + 1) * chunk) - 1)).alias("_n"))


def targets(sizes: dict, weights: dict, total: float, max_repeat: float) -> dict:
    """Capped proportional shares of ``total`` (see the module text)."""
    out = {k: 0.0 for k in sizes}
    free = {k for k in sizes if sizes[k] > 0}
    left = float(total)
    while free:
        w = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / w > max_repeat * sizes[k]}
        if not over:
            for k in free:
                out[k] = left * weights[k] / w
            break
        for k in over:
            out[k] = float(max_repeat * sizes[k])
            left -= out[k]
        free -= over
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight over one block: entries end at 0 or 1 but for two at most."""
    p = p.astype(float).copy()
    eps = 1e-9
    waiting = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    draws = iter(rng.random(len(waiting) + 4).tolist())
    live: list[int] = []
    at = 0
    while True:
        while len(live) < 3 and at < len(waiting):
            live.append(waiting[at])
            at += 1
        if len(live) < 3:
            break
        i, j, k = live
        # null vector of the rows (1, 1, 1) and (size_i, size_j, size_k)
        si, sj, sk = size[i], size[j], size[k]
        u = [float(sk - sj), float(si - sk), float(sj - si)]
        if u[0] == 0 and u[1] == 0 and u[2] == 0:
            u = [1.0, -1.0, 0.0]
        up = down = math.inf
        for x, d in zip((i, j, k), u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for x, d in zip((i, j, k), u, strict=True):
            p[x] += step * d
            if p[x] < eps:
                p[x] = 0.0
            elif p[x] > 1 - eps:
                p[x] = 1.0
        live = [x for x in live if 0.0 < p[x] < 1.0]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the last open entries: the 0/1 choice whose size total is nearest (fewest documents on ties)."""
    p = p.copy()
    free = np.nonzero((p > 0) & (p < 1))[0]
    want = float((p[free] * size[free]).sum())
    best = min(range(1 << len(free)), key=lambda m: (abs(sum(float(size[x]) for i, x in enumerate(free) if m >> i & 1) - want), m.bit_count(), m))
    for i, x in enumerate(free):
        p[x] = float(best >> i & 1)
    return p


def polish(p: np.ndarray, size: np.ndarray, want: float, rounds: int = 4) -> np.ndarray:
    """Swaps of a drawn and an undrawn entry that bring the size total nearer to ``want``."""
    p = p.copy()
    for _ in range(rounds):
        off = float((p * size).sum()) - want
        yes, no = np.nonzero(p == 1)[0], np.nonzero(p == 0)[0]
        if not len(yes) or not len(no):
            break
        no = no[np.argsort(size[no], kind="stable")]
        # taking y out and n in changes the total by size[n] - size[y]; wanted: -off
        at = np.clip(np.searchsorted(size[no], size[yes] - off), 1, len(no)) - 1
        pairs = [(abs(off + float(size[no[k]]) - float(size[y])), int(y), int(no[k]))
                 for y, a in zip(yes, at, strict=True) for k in (a, min(a + 1, len(no) - 1))]
        gain, y, n = min(pairs)
        if gain >= abs(off):
            break
        p[y], p[n] = 0.0, 1.0
    return p


def _fly(seed: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        n = t.num_rows
        key, size, pi = (t.column(c).to_numpy() for c in ("key", "size", "pi"))
        order = np.lexsort((pi, size, key))
        rng = np.random.default_rng([seed, abs(int(t.column("block")[0].as_py())), abs(int(t.column("src")[0].as_py()))])
        p = flight(pi[order], size[order], rng)
        if last:
            drawn = (pi[order] > 0) & (pi[order] < 1)
            p = landing(p, size[order])
            p[drawn] = polish(p[drawn], size[order][drawn], float((pi[order] * size[order])[drawn].sum()))
        back = np.empty(n)
        back[order] = p
        return t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(back))

    return run


def mix(docs: DataFrame, size: Column, weight_of=None, id_col: str = "doc_id", source_col: str = "source",
        total: float | None = None, max_repeat: int = 3, block: int = 4096, reserve: int = 512, seed: int = 6) -> DataFrame:
    """(id, source, size, source_size, target, copies) per document row.

    ``weight_of(i, source)`` gives the weight of the i-th source in code point order (null
    last); by default 5, 2, 1, repeating.  ``total`` defaults to the sum of all sizes.
    The list of sources and their totals is collected: one short row per source.
    """
    weight_of = weight_of or (lambda i, _: (5, 2, 1)[i % 3])
    rows = cut(numbered_rows(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"), size.cast("long").alias("size"))))
    per = {r["_src"]: (r["s"], r["n"]) for r in rows.groupBy("_src").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    names = sorted((s for s in per if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in per)
    weights = {s: weight_of(i, s) for i, s in enumerate(names)}
    sizes = {s: per[s][0] for s in names}
    goal = targets(sizes, weights, sum(sizes.values()) if total is None else total, max_repeat)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, i, int(sizes[s]), float(goal[s]), goal[s] / sizes[s] if sizes[s] else 0.0, max(1, math.ceil(per[s][1] / block)),
          min(1.0, reserve / per[s][1]))
         for i, s in enumerate(names)],
        "_s string, src int, source_size long, target double, c double, blocks int, share double")
    # one row per source, its number is known: a long source list is shuffled
    base = rows.join(F.broadcast(plan) if len(names) <= FEW_SOURCES else plan, F.col("_src").eqNullSafe(F.col("_s"))).drop("_s")
    u = F.pmod(F.xxhash64("_id", "size", "_n", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30)
    key = F.xxhash64("_id", "size", "_n", F.lit(seed))
    base = base.select("_id", "_src", "src", "size", "source_size", "target", F.floor("c").cast("int").alias("whole"),
                       (F.col("c") - F.floor("c")).alias("pi"), key.alias("key"),
                       F.pmod(F.xxhash64("_id", "size", "_n", F.lit(seed + 1)), F.col("blocks").cast("long")).cast("int").alias("block"), (u < F.col("share")).alias("_held"))
    marked, base = base, base.drop("_held")
    schema = base.schema
    most = max((max(1, math.ceil(n / block)) for _, n in per.values()), default=1)
    held = None
    if most > 1:
        held = marked.where("_held").drop("_held").withColumn("block", F.lit(0))
        base = marked.where("NOT _held").drop("_held")
    done, left, level = None, base, 0
    while True:
        last = most <= 1
        if last and held is not None:
            left = left.unionByName(held)
        flown = cut(left.groupBy("src", "block").applyInArrow(_fly(seed + level, last), schema))
        is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
        part = flown if last else flown.where(~is_open)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        level += 1
        most = math.ceil(2 * most / block)  # two open documents a block at most
        left = flown.where(is_open).withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(most)).cast("int"))
    return done.select(F.col("_id").alias(id_col), F.col("_src").alias(source_col), "size", "source_size", "target",
                       (F.col("whole") + F.round("pi").cast("int")).alias("copies"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    m = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")), max_repeat=3)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
                    "source", "copies")
