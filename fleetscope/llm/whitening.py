"""Embedding whitening by a block Jacobi-Davidson eigensolver.

Every entry c becomes the integer x = floor(1024 * c) + 100000.  The covariance of the integers is never formed:
Spark multiplies it with a few vectors at a time, one pass over the written blocks of rows per product, each row
centred before it is multiplied.

The search space is kept orthonormal; Rayleigh-Ritz on it gives the leading pairs.  A pair whose residual has
reached double precision is locked, in order, and the space stays orthogonal to it.  For the pairs still open the
projected correction equation is solved approximately by a few MINRES steps; all of them step together,
so a step costs one pass.  The corrections widen the space; beyond ``widest`` vectors it restarts from the best ones.
The locked vectors are multiplied once more at the end and rotated by a last Rayleigh-Ritz step.

Only vectors of one length make a covariance: the most common length (the longest of equally common ones) is fitted, rows of
other lengths are dropped, as are null and empty vectors, vectors with null or non-finite entries or entries beyond 2**40.
Rows that repeat count each.  Directions without variance (one row, equal rows, fewer rows than components) get whitened 0
and explained 0 and stay out of the identity error.  Fewer dimensions than components give fewer components.  An empty
table gives no rows.  Null ids are kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut, finite_vectors

#: entries beyond this are out of range (their integers would not be exact)
LARGEST = float(1 << 40)
#: entries of one block of rows
BLOCK_ENTRIES = 1 << 18


def integers(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(integers, numbers of the rows that are in range)."""
    ok = np.nonzero((np.abs(m) <= LARGEST).all(axis=1))[0]
    return np.floor(m[ok] * 1024.0).astype(np.int64) + 100_000, ok


def _pack():
    names = ["dim", "n", "ids", "known", "kind", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, m in finite_vectors(b.column(1)):
                x, ok = integers(m)
                step = max(1, BLOCK_ENTRIES // m.shape[1])
                for s in range(0, len(ok), step):
                    part, who = x[s:s + step], at[ok[s:s + step]]
                    kind = "i4" if np.abs(part).max() < 1 << 31 else "i8"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m.shape[1]], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([ids[who].tobytes()], pa.binary()),
                         pa.array([known[who].tobytes()], pa.binary()), pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], names)

    return run


def integer_blocks(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    src = vectors.select(F.col(id_col).cast("long"), F.col(vec_col))
    return cut(src.mapInArrow(_pack(), "dim int, n int, ids binary, known binary, kind string, rows binary"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for b in batches:
        kinds, rows = b.column(b.schema.get_field_index("kind")), b.column(b.schema.get_field_index("rows"))
        for r in range(b.num_rows):
            yield b, r, np.frombuffer(rows[r].as_buffer(), kinds[r].as_py()).reshape(-1, dim).astype(np.int64)


@dataclass(frozen=True)
class Fit:
    """The fit list: its written blocks, rows, exact sums and squares of every dimension."""

    blocks: DataFrame
    dim: int
    n: int
    sums: list
    squares: list

    @property
    def trace(self) -> float:
        return float(sum(Fraction(self.n * q - s * s, self.n * self.n) for s, q in zip(self.sums, self.squares, strict=True)))

    def centre(self):
        """Function that takes integer rows to x - S/n, rounded once."""
        n = self.n
        whole = np.array([s // n for s in self.sums], np.int64)
        rest = np.array([s % n / n for s in self.sums])
        return lambda x: (x - whole) - rest

    def total(self, per_matrix, size: int) -> np.ndarray:
        """Sum over all blocks of the ``size`` figures that ``per_matrix`` makes of a matrix of centred rows."""
        dim, centre = self.dim, self.centre()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(size)
            for _, _, x in _matrices(batches, dim):
                acc += per_matrix(centre(x)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(acc)], ["at", "value"])

        got = self.blocks.select("kind", "rows").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        out = np.zeros(size)
        for r in got.collect():  # a matrix of dimensions by a few vectors, whatever the number of rows
            out[r["at"]] = r["value"]
        return out

    def times(self, u: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``u``: one pass."""
        return self.total(lambda c: c.T @ (c @ u), u.size).reshape(u.shape) / self.n


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Fit | None:
    blocks = integer_blocks(vectors, id_col, vec_col)
    sizes = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]
    blocks = blocks.where(F.col("dim") == dim)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = [0] * dim, [0] * dim
        for _, _, x in _matrices(batches, dim):
            safe = int(np.abs(x).max()) ** 2 * len(x) < 1 << 62
            s = [a + int(b) for a, b in zip(s, x.sum(axis=0), strict=True)]
            q = [a + int(b) for a, b in zip(q, (x * x if safe else x.astype(object) ** 2).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": list(range(dim)), "s": [str(v) for v in s], "q": [str(v) for v in q]})

    got = blocks.select("kind", "rows").mapInArrow(moments, "at long, s string, q string").groupBy("at").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).orderBy("at").collect()
    return Fit(blocks, dim, int(n), [int(r["s"]) for r in got], [int(r["q"]) for r in got])


def orthonormal(new: np.ndarray, *bases: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Columns of ``new`` made orthonormal to each other and to ``bases``; columns that nothing is left of go."""
    out: list[np.ndarray] = []
    for col in new.T:
        size = np.linalg.norm(col)
        if not size > 0:
            continue
        v = col / size
        for _ in range(3):
            for b in (*bases, *([np.stack(out, axis=1)] if out else [])):
                v = v - b @ (b.T @ v)
            left = np.linalg.norm(v)
            if left < least:
                break
            v = v / left
        else:
            out.append(v)
    return np.stack(out, axis=1) if out else np.zeros((new.shape[0], 0))


def minres(times, shifts: np.ndarray, project, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of (A - shift) t = rhs on the projected space, one per column, stepping together.

    ``times`` multiplies all columns at once, so a step is one pass.  A column whose Krylov space ends stops there.
    """
    m = rhs.shape[1]
    x = np.zeros_like(rhs)
    v_old, v = np.zeros_like(rhs), project(rhs)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1.0)
    phi = beta.copy()
    floor = 1e-14 * np.maximum(np.abs(shifts), 1.0)
    c, s = np.full(m, -1.0), np.zeros(m)
    delta, eps = np.zeros(m), np.zeros(m)
    beta = np.zeros(m)
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    for _ in range(steps):
        if not live.any():
            break
        y = project(times(v) - v * shifts)
        alpha = (v * y).sum(axis=0)
        y = project(y - v * alpha - v_old * beta)
        y = y - v * (v * y).sum(axis=0)
        beta_new = np.linalg.norm(y, axis=0)
        # rotate the new column of the tridiagonal matrix
        old_eps, d = eps, c * delta + s * alpha
        gamma_bar = s * delta - c * alpha
        eps, delta = s * beta_new, -c * beta_new
        gamma = np.hypot(gamma_bar, beta_new)
        live = live & (gamma > floor)
        g = np.where(gamma > floor, gamma, 1.0)
        c, s = gamma_bar / g, beta_new / g
        tau, phi = c * phi, s * phi
        w_new = (v - w_old * old_eps - w * d) / g
        x = np.where(live, x + w_new * tau, x)
        w_old, w = w, w_new
        go_on = beta_new > floor
        v_old, v = v, np.where(go_on, y / np.where(go_on, beta_new, 1.0), 0.0)
        live, beta = live & go_on, beta_new
    return x


def leading_pairs(times, dim: int, wanted: int, seed: int = 12, inner: int = 4, widest: int | None = None,
                  tol: float = 2.0 ** -44, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors in columns) of the ``wanted`` largest pairs of the symmetric operator ``times`` (a block of columns at a time)."""
    wanted = min(wanted, dim)
    spare = min(dim - wanted, 2)
    widest = max(widest or 8 * (wanted + spare), 2 * (wanted + spare))
    rng = np.random.default_rng([seed, dim])
    locked = np.zeros((dim, 0))
    u = orthonormal(rng.standard_normal((dim, wanted + spare)))
    au = times(u)
    for _ in range(rounds):
        theta, s = np.linalg.eigh((u.T @ au + au.T @ u) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        x, ax = u @ s, au @ s
        res = ax - x * theta
        res -= locked @ (locked.T @ res)
        size = np.linalg.norm(res, axis=0)
        scale = max(abs(theta[0]), np.abs(theta).max(), np.finfo(float).tiny)
        whole = locked.shape[1] + u.shape[1] >= dim  # nothing is left to search: the pairs are exact up to rounding
        done = 0
        while done < x.shape[1] and locked.shape[1] + done < wanted and (whole or size[done] <= tol * scale):
            done += 1
        if done:
            locked = np.concatenate([locked, orthonormal(x[:, :done], locked, least=0.0)], axis=1)
        if locked.shape[1] >= wanted:
            break
        u, au, x, ax, theta, res = x[:, done:], ax[:, done:], x[:, done:], ax[:, done:], theta[done:], res[:, done:]
        u = u - locked @ (locked.T @ u)
        if u.shape[1] >= widest:  # restart from the best
            keep = wanted - locked.shape[1] + spare + 2
            u, au = u[:, :keep], au[:, :keep]
        todo = min(wanted - locked.shape[1] + spare, u.shape[1])
        shifts = theta[:todo]
        at = x[:, :todo]

        def project(t: np.ndarray, at=at, locked=locked) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - at * (at * t).sum(axis=0)

        fresh = orthonormal(minres(times, shifts, project, -res[:, :todo], inner), locked, u) if todo else np.zeros((dim, 0))
        if not fresh.shape[1]:  # the corrections brought nothing new
            fresh = orthonormal(rng.standard_normal((dim, min(wanted, dim - locked.shape[1] - u.shape[1]))), locked, u)
        u, au = np.concatenate([u, fresh], axis=1), np.concatenate([au, times(fresh)], axis=1)
    else:
        raise RuntimeError("the eigenpairs did not settle")
    product = times(locked)
    values, s = np.linalg.eigh((locked.T @ product + product.T @ locked) / 2)
    return values[::-1], locked @ s[:, ::-1]


@dataclass(frozen=True)
class Whitening:
    """Components, their values, share of the trace, scales (0 where there is no variance) and the identity error."""

    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scales: np.ndarray
    identity_error: float


def learn(found: Fit, components: int = 8, **how) -> Whitening:
    values, vectors = leading_pairs(found.times, found.dim, components, **how)
    trace = found.trace
    some = values > max(trace, 0.0) * 1e-12
    scales = np.where(some, 1.0 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    p, k = (vectors * scales)[:, some], int(some.sum())
    error = 0.0
    if k:
        mean = found.total(lambda c: (c @ p).sum(axis=0), k) / found.n

        def product(c: np.ndarray) -> np.ndarray:
            z = c @ p - mean
            return z.T @ z

        error = float(np.abs(found.total(product, k * k).reshape(k, k) / found.n - np.eye(k)).max())
    return Whitening(values, vectors, np.where(some, values / (trace or 1.0), 0.0), scales, error)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """Per row and component: id, component, n, deviation (decimal, exact), whitened, explained, identity_error."""
    found = fit(vectors, id_col, vec_col)
    schema = f"{id_col} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    w = learn(found, components, **how)
    n, dim, centre, p, k = found.n, found.dim, found.centre(), w.vectors * w.scales, len(w.values)
    whole = np.array([s // n for s in found.sums], np.int64)
    rest = np.array([s % n for s in found.sums], np.int64)
    explained, error = w.explained, w.identity_error

    def deviations(x: np.ndarray) -> pa.Array:
        # n * x - S = n * (x - S // n) - S % n
        most = n * int(np.abs(x - whole).max()) + n
        if dim * most * most < 1 << 63:
            return pa.array(((n * (x - whole) - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        from decimal import Context

        exact = ((n * (x - whole).astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([Context(prec=60).create_decimal(int(v)) for v in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, r, x in _matrices(batches, dim):
            m = len(x)
            ids = np.frombuffer(b.column(b.schema.get_field_index("ids"))[r].as_buffer(), np.int64)
            known = np.frombuffer(b.column(b.schema.get_field_index("known"))[r].as_buffer(), bool)
            z, far = centre(x) @ p, deviations(x)
            for j in range(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~known), pa.array(np.full(m, j + 1, np.int32)), pa.array(np.full(m, n)), far,
                     pa.array(np.ascontiguousarray(z[:, j])), pa.array(np.full(m, explained[j])), pa.array(np.full(m, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.blocks.mapInArrow(run, schema)


def op12_query(spark, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where it does not fit one."""
    from fleetscope.llm.common import table

    out = whiten(table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
