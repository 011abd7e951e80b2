"""Spelling variant grouping by reduced-alphabet neighbourhood generation.

Words are counted over all documents.  Every code point is hashed to one of a few symbols; a word
becomes its reduced word.  All strings one edit away from the reduced word (and the reduced word
itself: an edit may stay inside one symbol) are generated as hashes and joined with the reduced
vocabulary.  Two words one edit apart always meet, because the same edit leads from one reduced word to the
other; what meets is verified on the original strings inside the join, so only real pairs leave it.

The neighbourhood holds about ``2 * symbols`` strings for each letter, the reduced words shared by chance fall
with the power of the word's length, so the number of symbols follows the size of the vocabulary.

Null texts have no words.  A null id is read as an empty one in the slip rule.  Documents that repeat each count.  Very
long words send only their number along with their neighbourhood and are looked up for the verification.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut

#: UTF-8 of maximal runs of a-z and U+00C0 to U+00FF (lead byte C3)
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: distinct words that a task counts before it sends them on
HELD = 400_000
#: words up to so many code points travel with their neighbourhood
SHORT = 64
#: hashes that a task sends in one batch
SENT = 1 << 18


def _slip(run: bytes, h: int) -> bytes:
    """``run`` without its code point number h modulo its length."""
    s = run.decode("utf-8")
    k = h % len(s)
    return (s[:k] + s[k + 1:]).encode("utf-8")


def _tally(slip_every: int | None, shortest: int):
    def emit(total: dict) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if len(w) >= shortest and len(w.decode("utf-8")) >= shortest]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for b in batches:
            for who, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if who is None else who}:".encode())
                for w, n in Counter(RUN.findall(text.as_py().translate(LOWER))).items():
                    if slip_every:
                        h = zlib.crc32(w, start)
                        if not h % slip_every:
                            w = _slip(w, h)
                    total[w] = total.get(w, 0) + n
                if len(total) >= HELD:
                    yield emit(total)
                    total = {}
        if total:
            yield emit(total)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int | None = None,
                shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` code points and ``least`` occurrences.

    ``slip_every``: runs whose crc32 with the document's id is divisible by it lose one code point.
    """
    src = docs.select(F.col(id_col).cast("string"), F.col(text_col).alias("_text"))
    got = src.mapInArrow(_tally(slip_every, shortest), "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbols_for(vocabulary: int) -> int:
    """Symbols so that about as many reduced words of eight letters exist as the vocabulary has words."""
    return max(4, math.ceil(vocabulary ** 0.125))


def reduce_word(points: np.ndarray, symbols: int) -> np.ndarray:
    """Symbol of every code point: its multiplicative hash, scaled to the alphabet."""
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(symbols)).astype(np.uint64)


_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)))


def _finish(h: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Key of polynomial hashes of reduced words of the given length."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(length, np.uint64)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def own_keys(sym: np.ndarray) -> np.ndarray:
    """Keys of the reduced words in the rows of ``sym`` [n, length]."""
    length = sym.shape[1]
    return _finish(((sym + np.uint64(1)) * _powers(length)[:length]).sum(1, dtype=np.uint64), length)


def near_keys(sym: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of each row's reduced word and of all strings one edit away from it, sorted [n, 1 + length * 2 * symbols + symbols]."""
    n, length = sym.shape
    pw = _powers(length + 1)
    term = (sym + np.uint64(1)) * pw[:length]
    head = np.zeros((n, length + 1), np.uint64)  # hash of the first i symbols
    np.cumsum(term, axis=1, dtype=np.uint64, out=head[:, 1:])
    # the symbols from i on, at their places, shifted one place down or up
    tail = head[:, -1:] - head
    down = tail * np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = tail * _BASE
    out = [_finish(head[:, -1:], length), _finish(head[:, :-1] + down[:, 1:], length - 1)]
    for c in range(symbols):
        put = np.uint64(c + 1) * pw
        out.append(_finish(head[:, :-1] + put[:length] + tail[:, 1:], length))
        out.append(_finish(head + put[:length + 1] + up, length + 1))
    return np.sort(np.concatenate(out, axis=1), axis=1)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points [n, length]) for every length among ``words``."""
    texts = words.to_pylist()
    lengths = np.array([len(w) for w in texts])
    for length in np.unique(lengths):
        at = np.nonzero(lengths == length)[0]
        step = max(1, SENT // (16 * int(length)))
        for s in range(0, len(at), step):
            rows = at[s:s + step]
            points = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), "<u4")
            yield rows, points.reshape(len(rows), int(length))


def _reduced(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, points in _by_length(b.column(0)):
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_keys(reduce_word(points, symbols))), *part.columns], ["key", *part.schema.names])

    return run


def _neighbourhood(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, points in _by_length(b.column(0)):
                keys = near_keys(reduce_word(points, symbols), symbols)
                new = np.ones(keys.shape, bool)  # edits of equal outcome count once
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                who, col = np.nonzero(new)
                part = b.take(pa.array(rows))
                word, number = part.column(0), part.column(1)
                if points.shape[1] > SHORT:
                    word = pa.nulls(len(rows), pa.string())
                for s in range(0, len(who), SENT):
                    w = pa.array(who[s:s + SENT])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[who[s:s + SENT], col[s:s + SENT]]), word.take(w), number.take(w)], ["key", "word", "number"])

    return run


def near_pairs(vocab: DataFrame, size: int, symbols: int | None = None, part_words: int = 25_000) -> DataFrame:
    """(word, other, other_n): both directions of all pairs of words of ``vocab`` (word, n; distinct) one edit apart."""
    symbols = symbols or symbols_for(size)
    parts = max(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_words))
    words = vocab.select("word", F.xxhash64("word").alias("number"), "n").repartition(parts, "word")
    target = words.select("word", "n").mapInArrow(_reduced(symbols), "key long, other string, other_n long").repartition(parts, "key")

    def met(some: DataFrame) -> DataFrame:
        # the reduced vocabulary of one partition is a small hash table; the neighbourhoods stream past it unsorted
        near = some.select("word", "number").mapInArrow(_neighbourhood(symbols), "key long, word string, number long")
        return near.repartition(parts, "key").join(target.hint("shuffle_hash"), "key")

    one_edit = F.levenshtein("word", "other", 1) == 1
    short, long = words.where(F.length("word") <= SHORT), words.where(F.length("word") > SHORT)
    whole = met(short).where(one_edit).select("word", "other", "other_n")
    looked_up = met(long).drop("word").join(long.select("word", "number"), "number").where(one_edit)
    return whole.unionByName(looked_up.select("word", "other", "other_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) by pointer jumping over (word, form).

    A form has at least twice its word's count, so chains have no cycle and are shorter than log2 of the
    largest count ``most``; every round halves them.
    """
    way = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(2, most.bit_length())))):
        step = way.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        way = cut(way.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root")))
    return way


def group_variants(vocab: DataFrame, ratio: int = 2, symbols: int | None = None) -> DataFrame:
    """Per word of ``vocab`` (word, n): word, form, root, n, n_near, form_n.

    The form is the near word of largest n (ties: first in code-point order) if it has at least ``ratio`` (2 or more) times the
    word's count; the root is where the chain of forms ends.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 does not bound the chains of forms")
    vocab = cut(vocab)
    size, most = vocab.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).collect()[0]
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(vocab, size, symbols).groupBy(F.col("word").alias("_w")).agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocab.join(near, F.col("word") == F.col("_w"), "left")
    has = -F.col("best.n") >= ratio * F.col("n")
    rows = cut(rows.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(has, -F.col("best.n")).alias("form_n")))
    top = roots(rows.where(F.col("form").isNotNull()), most).withColumnRenamed("word", "_w")
    return rows.join(top, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    return group_variants(word_counts(table(spark, sf_dir, "documents"), slip_every=97))


OP11_SQL = """
WITH RECURSIVE
-- crc32 by its byte table, computed from the polynomial
bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS r
  FROM documents),
each AS (SELECT d, r, count(*) AS n FROM runs GROUP BY ALL),
-- UTF-8 bytes: ASCII as they are, the others have two bytes, the first is C3
summed AS (
  SELECT r, n, length(r) AS len, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(d || ':' || r, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
      lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h
  FROM each, tab),
cutted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % len AS INT)) || substr(r, CAST(h % len AS INT) + 2) ELSE r END AS word, n FROM summed),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cutted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
-- one edit apart: both give the same string once one place is taken out (or one is the other without a place)
holes AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab),
less AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS s FROM holes),
subs AS (SELECT word, n, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS s FROM holes),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM subs a JOIN subs b ON a.s = b.s AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.s = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.s = b.word),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k FROM near),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * v.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 2 * v.n THEN r.other_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND r.k = 1),
chain(word, tip) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.tip AS root FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
