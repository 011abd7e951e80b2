"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words always holds one whole block of ``anchor = (window + 1) // 2`` words
that starts at a multiple of ``anchor`` in the earlier document.  So the non-overlapping blocks of
every document are the index, and every rolling window of ``anchor`` words probes it.  Index
and probes travel as packed arrays of hashes, dealt over buckets of bounded size: a bucket says
which hashes stand in the index and in more than one document.  Documents then extend each such hit on
both sides to all windows of ``window`` words that hold it; windows are confirmed by their own
hash (64 bits, plus the bucket that a second hash deals them to), and a window is marked if a document
with a smaller id has it.  Runs of marked windows are maximal repeats; their words go.

Nothing is expanded into pairs: a passage that very many documents share is one hash, sent once per
document however often the document repeats it; the documents find its places again by the hash.  Buckets hold about ``bucket_words`` hashes whatever the size of the corpus.

Words are runs of characters other than ASCII white space.  Null or empty texts have no words.
Rows with a null id are kept whole and remove nothing.  Rows that repeat an id are the same
document: they do not remove each other's words.  Ids are whole numbers.  Extra columns are not passed on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut, release

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BATCH_WORDS = 1 << 20
MOST_ORDINALS = 1 << 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Rolling:
    """Hashes of all windows of some words of a document."""

    def __init__(self):
        self.cache = _WordHashes()
        self.powers = [np.ones(1, np.uint64) for _ in BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in BASES]

    def words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))

    def windows(self, h: np.ndarray, size: int, base: int = 0) -> np.ndarray:
        n = len(h)
        if len(self.powers[base]) <= n:
            m = 2 * n + 1024
            up = np.full(m, BASES[base], np.uint64)
            down = np.full(m, pow(BASES[base], -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[base], self.inverse[base] = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.powers[base][:n])))
        return _finish((sums[size:] - sums[:-size]) * self.inverse[base][:n - size + 1])


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


SENT = "bucket int, batch long, head boolean, ids binary, ords binary, vals binary, extra binary"
SENT_NAMES = ["bucket", "batch", "head", "ids", "ords", "vals", "extra"]


def _pack(a) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class _Batch:
    """Hashes of some documents, to be sent as one packed row per bucket and one row that names the documents."""

    def __init__(self, buckets: int, extra: bool):
        self.buckets, self.extra = buckets, extra
        self.clear()

    def clear(self):
        self.keys, self.bucket, self.vals, self.ords, self.n = [], [], [], [], 0

    def add(self, key: tuple[int, int], bucket: np.ndarray, vals: np.ndarray):
        self.ords.append(np.full(len(vals), len(self.keys), np.uint16))
        self.keys.append(key)
        self.bucket.append(bucket)
        self.vals.append(vals)
        self.n += len(vals)

    def full(self) -> bool:
        return self.n >= BATCH_WORDS or len(self.keys) >= MOST_ORDINALS - 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        import xxhash

        keys = np.array(self.keys, np.int64)
        bucket, vals, ords = np.concatenate(self.bucket), np.concatenate(self.vals), np.concatenate(self.ords)
        batch = xxhash.xxh3_64_intdigest(_pack(keys) + _pack(vals[:1024])) >> 1  # the same if a task runs again
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        out = []
        for b in np.nonzero(np.diff(edges))[0]:
            at = order[edges[b]:edges[b + 1]]
            used, short = np.unique(ords[at], return_inverse=True)
            out.append((int(b), batch, False, _pack(keys[used, 0]) if self.extra else b"", _pack(ords[at]), _pack(vals[at]),
                        _pack(short.astype(np.uint16)) if self.extra else b""))
        out.append((batch % self.buckets, batch, True, _pack(keys), b"", b"", b""))
        yield pa.RecordBatch.from_pylist([dict(zip(SENT_NAMES, r, strict=True)) for r in out], pa.schema([
            ("bucket", pa.int32()), ("batch", pa.int64()), ("head", pa.bool_()), ("ids", pa.binary()), ("ords", pa.binary()),
            ("vals", pa.binary()), ("extra", pa.binary())]))
        self.clear()


def _send_anchors(window: int, anchor: int, buckets: int):
    """Rolling windows of ``anchor`` words: 31 hash bits and whether the window is a block of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held = Rolling(), _Batch(buckets, False)
        for b in batches:
            for key, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = split_words(text)
                if key is None or len(words) < window:
                    continue
                h = roll.windows(roll.words(words), anchor)
                vals = ((h >> np.uint64(33)) << np.uint64(1)).astype(np.uint32)
                vals[::anchor] |= 1
                # a hash that a document repeats is sent once (twice if only some of its windows are blocks)
                once = np.unique(((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)) << np.uint64(32) | vals)
                held.add((key, th), (once >> np.uint64(32)).astype(np.int32), (once & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                if held.full():
                    yield from held.rows()
        yield from held.rows()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows with the same key; the input is sorted by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _reply(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [dict(zip(("batch", "head", "ids", "ords", "vals"), r, strict=True)) for r in rows],
        pa.schema([("batch", pa.int64()), ("head", pa.bool_()), ("ids", pa.binary()), ("ords", pa.binary()), ("vals", pa.binary())]))


REPLY = "batch long, head boolean, ids binary, ords binary, vals binary"


def _live_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: hashes that are in the index and in more than one document, back to their batches."""
    for group in _groups(batches, "bucket"):
        heads = [(r["batch"], True, r["ids"], b"", b"") for r in group if r["head"]]
        if heads:
            yield _reply(heads)
        rows = [r for r in group if not r["head"]]
        if not rows:
            continue
        vals = np.concatenate([np.frombuffer(r["vals"], np.uint32) for r in rows])
        ords = np.concatenate([np.frombuffer(r["ords"], np.uint16) for r in rows])
        size = np.array([len(r["ords"]) // 2 for r in rows])
        row_of = np.repeat(np.arange(len(rows), dtype=np.uint32), size)
        packed = np.sort(((vals >> np.uint32(1)).astype(np.uint64) << np.uint64(32)) | np.arange(len(vals), dtype=np.uint64))
        at = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        code = packed >> np.uint64(32)
        start = np.concatenate(([0], np.nonzero(code[1:] != code[:-1])[0] + 1))
        end = np.concatenate((start[1:], [len(code)])) - 1
        # members stand in document order, so a group has two documents if its ends differ
        two = (row_of[at[start]] != row_of[at[end]]) | (ords[at[start]] != ords[at[end]])
        indexed = np.bitwise_or.reduceat(vals[at] & np.uint32(1), start) > 0
        live = np.sort(at[np.repeat(two & indexed, end - start + 1)])
        if not len(live):
            continue
        key = (np.int64(rows[0]["bucket"]) << np.int64(31)) | (vals[live] >> np.uint32(1)).astype(np.int64)
        edges = np.searchsorted(live, np.concatenate(([0], np.cumsum(size))))
        yield _reply([(r["batch"], False, b"", _pack(ords[live[a:b]]), _pack(key[a:b]))
                      for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True) if b > a])


def _per_document(kind: str):
    """Replies of a batch, put together: (id, hash of the text, packed sorted values) per document with any."""
    dtype = np.dtype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "batch"):
            keys = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in group if r["head"]]).reshape(-1, 2)
            rows = [r for r in group if not r["head"]]
            if not rows:
                continue
            ords = np.concatenate([np.frombuffer(r["ords"], np.uint16) for r in rows])
            vals = np.concatenate([np.frombuffer(r["vals"], dtype) for r in rows])
            order = np.lexsort((vals, ords))
            ords, vals = ords[order], vals[order]
            edge = np.concatenate(([0], np.nonzero(ords[1:] != ords[:-1])[0] + 1, [len(ords)]))
            who = keys[ords[edge[:-1]]]
            packed = [_pack(np.unique(vals[a:b])) for a, b in itertools.pairwise(edge.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(who[:, 0]), pa.array(who[:, 1]), pa.array(packed, pa.binary())], ["_i", "_t", "vals"])

    return run


def _send_windows(window: int, anchor: int, buckets: int, anchor_buckets: int):
    """Windows of ``window`` words around live anchors: hash and document, a hash once for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held = Rolling(), _Batch(buckets, True)
        for b in batches:
            for key, th, text, live in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = roll.words(split_words(text))
                h = roll.windows(words, anchor)
                mine = (((h & np.uint64(0xFFFFFFFF)) % np.uint64(anchor_buckets)).astype(np.int64) << np.int64(31)) | (h >> np.uint64(33)).astype(np.int64)
                hit = np.nonzero(np.isin(mine, np.frombuffer(live, np.int64)))[0]
                n = len(words) - window + 1
                if n <= 0 or not len(hit):
                    continue
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, np.maximum(hit - (window - anchor), 0), 1)
                np.add.at(mark, hit + 1, -1)
                at = np.nonzero(np.cumsum(mark)[:n] > 0)[0]
                if not len(at):
                    continue
                code, first = np.unique(roll.windows(words, window)[at], return_index=True)
                deal = roll.windows(words, window, 1)[at[first]]
                held.add((key, th), (deal % np.uint64(buckets)).astype(np.int32), code)
                if held.full():
                    yield from held.rows()
        yield from held.rows()

    return run


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: windows that a document with a smaller id has too, back to their batches."""
    for group in _groups(batches, "bucket"):
        heads = [(r["batch"], True, r["ids"], b"", b"") for r in group if r["head"]]
        if heads:
            yield _reply(heads)
        rows = [r for r in group if not r["head"]]
        if not rows:
            continue
        size = np.array([len(r["ords"]) // 2 for r in rows])
        code = np.concatenate([np.frombuffer(r["vals"], np.uint64) for r in rows])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["extra"], np.uint16)] for r in rows])
        order = np.argsort(code, kind="stable")
        c = code[order]
        start = np.concatenate(([0], np.nonzero(c[1:] != c[:-1])[0] + 1))
        first = np.minimum.reduceat(ids[order], start)
        later = np.empty(len(code), bool)
        later[order] = ids[order] > np.repeat(first, np.diff(np.concatenate((start, [len(c)]))))
        edges = np.concatenate(([0], np.cumsum(size)))
        out = []
        for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            take = later[a:b]
            if take.any():
                out.append((r["batch"], False, b"", _pack(np.frombuffer(r["ords"], np.uint16)[take]), _pack(code[a:b][take])))
        if out:
            yield _reply(out)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, repeated in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = split_words(text)
                n_words.append(len(words))
                if not repeated:
                    n_removed.append(0)
                    kept.append(b" ".join(words).decode())
                    spans.append([])
                    continue
                at = np.nonzero(np.isin(roll.windows(roll.words(words), window), np.frombuffer(repeated, np.uint64)))[0]
                mark = np.zeros(len(words) + 1, np.int32)
                mark[at] += 1
                mark[at + window] -= 1
                gone = np.cumsum(mark)[:-1] > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(itertools.compress(words, (~gone).tolist())).decode())
                new = np.concatenate(([True], np.diff(at) != 1))
                first, last = at[new], at[np.concatenate((new[1:], [True]))] + window
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["_id", "n_words", "n_removed", "kept", "repeats"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   bucket_words: int = 3_000_000) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (words left, joined by one space), repeats (maximal repeats in words, end exclusive)."""
    spark = docs.sparkSession
    anchor = (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(64, math.ceil(n_bytes / 6 / bucket_words))
    sent = rows.mapInArrow(_send_anchors(window, anchor, buckets), SENT)
    live = sent.repartition("bucket").sortWithinPartitions("bucket", "batch", "head").mapInArrow(_live_anchors, REPLY)
    live = live.repartition("batch").sortWithinPartitions("batch").mapInArrow(_per_document("int64"), "_i long, _t long, vals binary")
    live = cut(live)
    del sent
    release(spark)
    live = live.dropDuplicates(["_i", "_t"])  # rows that repeat id and text have equal values
    near = rows.join(live, (F.col("_id") == F.col("_i")) & (F.col("_th") == F.col("_t"))).select("_id", "_th", "_text", "vals")
    sent = near.mapInArrow(_send_windows(window, anchor, buckets, buckets), SENT)
    gone = sent.repartition("bucket").sortWithinPartitions("bucket", "batch", "head").mapInArrow(_repeated_windows, REPLY)
    gone = gone.repartition("batch").sortWithinPartitions("batch").mapInArrow(_per_document("uint64"), "_i long, _t long, vals binary")
    gone = cut(gone)
    del sent, near, live
    release(spark)
    gone = gone.dropDuplicates(["_i", "_t"])
    out = rows.join(gone, (F.col("_id") == F.col("_i")) & (F.col("_th") == F.col("_t")), "left").select("_id", "_text", "vals")
    out = out.mapInArrow(_remove(window), "_id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>")
    return out.withColumnRenamed("_id", id_col)


def op1_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    out = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
low AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT win.doc_id, win.s FROM win JOIN low USING (k) WHERE low.first < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
