"""Spelling variants, whitening and bit-sliced top-k against brute force on odd rows."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from fleetscope.llm import bitslices, spelling, whitening

from .conftest import make_docs, odd_rows, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")


# --- spelling variants -------------------------------------------------------

def brute_words(rows, every=97):
    total = collections.Counter()
    for i, text in rows:
        for r in RUN.findall(text or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % every == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            total[r] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(vocab):
    out, form = {}, {}
    for w, n in vocab.items():
        near = [x for x in vocab if one_edit(w, x)]
        best = min(near, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), vocab[form[w]] if form[w] else None]
    for w in vocab:
        top = w
        while form[top]:
            top = form[top]
        out[w][1] = top
    return {w: tuple(v) for w, v in out.items()}


def variants(seed=3):
    rng = random.Random(seed)
    stems = ["receive", "grüße", "naïveté", "colour", "banana", "aaaaaa", "têteàt", "separate", "abcdefghij" * 9]
    texts = []
    for i in range(60):
        words = []
        for s in stems:
            for _ in range(rng.randrange(1, 6)):
                w = s
                for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                    k = rng.randrange(len(w))
                    c = rng.choice("aeinréÿÉ")
                    w = rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w[:k] + c + w[k:]])
                words.append(rng.choice([w, w.title(), w.upper()]))
        texts.append((i, " ".join(words) + " 12" + rng.choice(words) + "_", "en", "a"))
    texts.append((97, "walked " * 24 + "walket " * 12 + "walkot " * 6 + "wilkot " * 3, None, None))  # a chain of forms
    return texts


def got_groups(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


@pytest.mark.parametrize("symbols", [None, 1, 2, 9])
def test_variants_equal_brute_force(spark, symbols, monkeypatch):
    rows = variants() + odd_rows()
    counts = spelling.word_counts(make_docs(spark, rows).repartition(3), slip_every=97)
    vocab = brute_words([(r[0], r[1]) for r in rows])
    assert {r["word"]: r["n"] for r in counts.collect()} == vocab
    got = got_groups(spelling.group_variants(counts, symbols=symbols))
    assert got == brute_groups(vocab)
    assert any(len(w) > spelling.SHORT and v[3] for w, v in got.items())  # long words meet too
    assert any(v[0] and v[0] != v[1] for v in got.values())  # a chain of forms


def test_words_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    rows = variants(4)
    got = spelling.word_counts(make_docs(spark, rows).repartition(2), slip_every=97)
    assert {r["word"]: r["n"] for r in got.collect()} == brute_words([(r[0], r[1]) for r in rows])


def test_very_long_word_and_ties(spark):
    long = "ab" * 15_000
    rows = [(i, f"{long} {long[1:]} tables tablet tablex", "en", "a") for i in range(3)] + [(None, "tables tablet", None, None)] * 3
    counts = spelling.word_counts(make_docs(spark, rows))
    got = got_groups(spelling.group_variants(counts))
    assert got[long] == (None, long, 3, 1, None)
    assert got["tablex"] == ("tables", "tables", 3, 2, 6)  # equal counts: first in code-point order
    assert got["tables"][0] is None


def test_variants_empty(nothing):
    assert spelling.group_variants(spelling.word_counts(nothing)).collect() == []


def test_neighbourhood_is_complete():
    rng = np.random.default_rng(2)
    for symbols in (2, 4):
        for length in (1, 2, 5):
            sym = rng.integers(0, symbols, (20, length)).astype(np.uint64)
            keys = spelling.near_keys(sym, symbols)
            for row, k in zip(sym, keys, strict=True):
                around = {tuple(row)} | {(*row[:i], *row[i + 1:]) for i in range(length)}
                around |= {(*row[:i], c, *row[i + 1:]) for i in range(length) for c in range(symbols)}
                around |= {(*row[:i], c, *row[i:]) for i in range(length + 1) for c in range(symbols)}
                want = {int(spelling.own_keys(np.array([a], np.uint64).reshape(1, -1))[0]) for a in around}
                assert set(k.tolist()) == want


# --- vectors -----------------------------------------------------------------

def vector_frame(spark, rows, extra=("score", "n", "rank", "block", "dim", "component")):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame([(i, v, 1, *["x"] * len(extra)) for i, v in rows], schema)


def odd_vectors(n=700, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    m = (rng.standard_normal((n, dim)) * np.linspace(2, 0.2, dim)).astype(np.float32)
    rows = [(i, m[i].tolist()) for i in range(n)]
    rows += [(1000 + i, m[0].tolist()) for i in range(300)]  # ties
    rows += [(5, m[3].tolist()), (5, m[3].tolist()), (50, m[9].tolist()), (None, m[1].tolist()), (-50, m[2].tolist())]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * (dim - 2)), (2100, [math.nan] * dim), (2150, [math.inf] + [0.0] * (dim - 1)),
             (2200, []), (2250, [0.5] * 3), (2300, [0.0] * dim)]
    return rows


def usable(rows):
    return [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]


def brute_topk(rows, k=5, every=50, scale=256):
    ints = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in usable(rows)]
    out = []
    for qi, q in ints:
        if qi is None or qi % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), ci is None, ci or 0) for ci, c in ints if ci != qi and len(c) == len(q))
        out += [(qi, r + 1, None if no_id else ci, -s) for r, (s, no_id, ci) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("slices, block", [(7, 1 << 19), (3, 64 * 12), (1, 130 * 12), (40, 64 * 12)])
def test_topk_equals_brute_force(spark, monkeypatch, slices, block):
    monkeypatch.setattr(bitslices, "BLOCK_CELLS", block)
    rows = odd_vectors()
    v = vector_frame(spark, rows).repartition(3)
    got = bitslices.search(bitslices.build_index(v, slices=slices), v.where("vec_id % 50 = 0"), k=5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_topk(rows)


def test_topk_few_rows_large_numbers_and_nothing(spark):
    rows = [(0, [3e4, -3e4]), (50, [2e4, 1.0]), (100, [1e30, 1.0]), (3, [1.0, 1.0])]
    v = vector_frame(spark, rows)
    got = bitslices.search(bitslices.build_index(v), v.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_topk([r for r in rows if r[0] != 100]))
    none = vector_frame(spark, [])
    assert bitslices.search(bitslices.build_index(none), none).collect() == []
    assert bitslices.search(bitslices.build_index(v), none).collect() == []
    bad = vector_frame(spark, [(0, None), (50, [])])
    assert bitslices.search(bitslices.build_index(bad), bad).collect() == []


def test_queries_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "BLOCK_CELLS", 100 * 12)
    monkeypatch.setattr(bitslices, "BLOCK_QUERIES", 4)
    rows = odd_vectors(n=300)
    v = vector_frame(spark, rows).repartition(2)
    got = bitslices.search(bitslices.build_index(v), v.where("vec_id % 50 = 0")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_topk(rows)


def test_sum_of_slices():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 128, (9, 200))
    maps = np.zeros((9, 7, 32), np.uint8)
    for j in range(7):
        maps[:, j, :25] = np.packbits((y >> j & 1).astype(bool), axis=1, bitorder="little")
    q = rng.integers(-300, 300, 9)
    sums = bitslices.add_slices(maps.view(np.uint64).reshape(9, 7, 4), q)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(np.int64) << i for i, s in enumerate(sums))
    assert got.tolist() == (np.abs(q) @ np.where((q > 0)[:, None], y, 127 - y)).tolist()


def check_whitening(got, rows, components=8):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, dim = len(x), len(x[0][1])
    m = np.array([v for _, v in x], np.int64)
    sums = [int(s) for s in m.sum(0)]
    c = np.array([[float(Fraction(n * int(a) - s, n)) for a, s in zip(v, sums, strict=True)] for v in m])
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dim)
    assert len(got) == n * k
    far = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(map(int, v), sums, strict=True))) for (i, _), v in zip(x, m, strict=True))
    for j in range(k):
        part = [r for r in got if r["component"] == j + 1]
        assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in part) == far
        assert {r["n"] for r in part} == {n}
        real = values[j] > 1e-9 * values[0] > 0
        assert part[0]["explained"] == pytest.approx(values[j] / values.sum() if real else 0.0, rel=1e-9)
        want = c @ vectors[:, j] / math.sqrt(values[j]) if real else np.zeros(n)
        lone = [i for i, _ in x]
        have = {r["vec_id"]: r["whitened"] for r in part if lone.count(r["vec_id"]) == 1}
        pairs = [(have[i], w) for (i, _), w in zip(x, want, strict=True) if i in have]
        sign = 1.0 if not pairs or sum(a * b for a, b in pairs) >= 0 else -1.0
        assert max((abs(a - sign * b) for a, b in pairs), default=0) < 1e-8
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_equals_dense_solver(spark):
    rows = odd_vectors()
    got = whitening.whiten(vector_frame(spark, rows).repartition(3)).collect()
    check_whitening(got, [r for r in usable(rows) if len(r[1]) == 12])


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0])] * 3 + [(2, [1.5, 2.0])], [(1, [4.0]), (2, [5.0]), (3, [9.0])],
    [(i, [float(i % 3), 1.0, 0.0, -float(i % 3), 2.0 * i, 0.5, 0.25, 0.125, float(i * i), 7.0]) for i in range(6)]])
def test_whitening_without_full_rank(spark, rows):
    check_whitening(whitening.whiten(vector_frame(spark, rows)).collect(), rows)


def test_whitening_nothing_left(spark):
    assert whitening.whiten(vector_frame(spark, [])).collect() == []
    assert whitening.whiten(vector_frame(spark, [(1, None), (2, []), (3, [math.nan])])).collect() == []


def test_whitening_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(3) * 1e7).astype(np.float32).tolist()) for i in range(300)]
    got = whitening.whiten(vector_frame(spark, rows)).collect()
    check_whitening(got, rows)


def test_solver_restarts():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((150, 150)))
    values = np.sort(rng.uniform(1, 2, 150))[::-1]
    a = (q * values) @ q.T
    got, vectors = whitening.leading_pairs(lambda u: a @ u, 150, 8, widest=24)
    assert np.abs(got - values[:8]).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12
