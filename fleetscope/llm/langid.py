"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the 2-, 3- and 4-byte grams of the lower-cased text (ASCII signs and digits
read as spaces), hashed into ``1 << bits`` rows.  A text is the mean of its gram embeddings;
a linear softmax on it is trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents (``sample`` in all, equally many per language, chosen by a hash of id and text, equal rows once;
``grams`` grams of each).  A temperature, fitted on a part of the sample kept aside, calibrates the
probabilities, and the rejection threshold is the lowest score whose accuracy there reaches
``accept``.  As the model is linear after averaging, prediction sums one table row of class scores per gram
over the whole text.

Null texts and texts without a letter get ``und`` with score 0.  Without any labelled row every
text is ``und``.  Rows are judged one by one, so repeated rows and null ids stay; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import held_out

GRAMS = (2, 3, 4)
PIECE = 1 << 19
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE)


def gram_rows(b: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Table row of every n-byte gram of ``b`` (uint8)."""
    h = np.zeros(len(b) - n + 1, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ b[k:len(b) - n + 1 + k]
    h = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def _grams_of(bits: int, grams: int):
    """Per labelled text: rows of grams of the whole text, and of one short stretch of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, langs = [], []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = np.frombuffer(text_bytes(text or ""), np.uint8)
                if len(b) < 4 or not _LETTER.search(text):
                    continue
                rng = np.random.default_rng(key & 0xFFFFFFFF)
                at = int(rng.integers(0, max(1, len(b) - 40)))
                for piece in (b, b[at:at + 40]):
                    idx = np.concatenate([gram_rows(piece, n, bits) for n in GRAMS if len(piece) >= n])
                    rows.append(rng.choice(idx, grams) if len(idx) > grams else idx)
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(langs, pa.string())], ["g", "lang"])

    return run


def train_sgd(rows: list[np.ndarray], y: np.ndarray, n_lang: int, bits: int, dim: int = 16, epochs: int = 6,
              rate: float = 0.5, batch: int = 32, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(class scores per table row, bias): embedding times softmax weights after SGD."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    w, bias = np.zeros((dim, n_lang)), np.zeros(n_lang)
    total = max(1, epochs * len(rows))
    for ep in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            take = order[s:s + batch]
            size = np.array([len(rows[i]) for i in take])
            idx = np.concatenate([rows[i] for i in take])
            of = np.repeat(np.arange(len(take)), size)
            h = np.add.reduceat(emb[idx], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0) / size[:, None]
            z = h @ w + bias
            z -= z.max(1, keepdims=True)
            g = np.exp(z)
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(take)), y[take]] -= 1
            lr = rate * (1 - (ep * len(rows) + s) / total)
            back = (g @ w.T) / size[:, None]
            w -= lr * h.T @ g
            bias -= lr * g.sum(0) * 0.1
            np.add.at(emb, idx, -lr * back[of])
    return emb @ w, bias


def _probabilities(scores: np.ndarray, temperature: float) -> np.ndarray:
    z = scores / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 8000,
          grams: int = 384, bits: int = 15, accept: float = 0.99) -> dict:
    """Model from labelled rows outside the held-out fold."""
    use = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    count = {r["lang"]: r["n"] for r in use.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return {"langs": [], "table": np.zeros((1, 0), np.float32), "bias": np.zeros(0), "temperature": 1.0, "reject": 1.0, "bits": bits}
    each = max(1, sample // len(langs))
    share = F.lit(0.0)
    for lang, n in count.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, each / n))).otherwise(share)
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(4))
    picked = use.where(F.pmod(key, F.lit(1 << 30)) / float(1 << 30) < share).select(
        key.alias("key"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).dropDuplicates(["key"])
    got = picked.mapInArrow(_grams_of(bits, grams), "g array<int>, lang string").toPandas()
    rows = [np.asarray(g, np.int64) for g in got["g"]]
    y = np.array([langs.index(v) for v in got["lang"]], np.int64)
    # a fixed order, whatever the partitions
    order = sorted(range(len(rows)), key=lambda i: (int(y[i]), rows[i].tobytes()))
    rows, y = [rows[i] for i in order], y[order]
    aside = np.random.default_rng(1).random(len(rows)) < 0.2
    table, bias = train_sgd([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(langs), bits)
    temperature, reject = 1.0, 0.0
    if aside.any():
        s = np.array([table[r].mean(0) + bias for r, a in zip(rows, aside, strict=True) if a])
        t = y[aside]
        temperature = min(np.geomspace(0.05, 20, 60), key=lambda v: -np.log(_probabilities(s, v)[np.arange(len(t)), t] + 1e-12).mean())
        p = _probabilities(s, temperature)
        top, right = p.max(1), p.argmax(1) == t
        o = np.argsort(-top)
        good = np.nonzero(np.cumsum(right[o]) / np.arange(1, len(o) + 1) >= accept)[0]
        reject = float(top[o][good[-1]]) if len(good) else 1.0
    return {"langs": langs, "table": table.astype(np.float32), "bias": bias, "temperature": float(temperature), "reject": reject, "bits": bits}


def text_scores(texts: list[str | None], table: np.ndarray, bias: np.ndarray, bits: int) -> np.ndarray:
    """Class scores of whole texts; a text is read in pieces of bounded size."""
    out = np.zeros((len(texts), len(bias)))
    count = np.zeros(len(texts))
    held: list[tuple[int, bytes, int]] = []  # (text, bytes with the following overlap, grams start below)
    held_bytes = 0

    def flush():
        if not held:
            return
        buf = np.frombuffer(b"".join(p for _, p, _ in held), np.uint8)
        size = np.array([len(p) for _, p, _ in held])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        own = np.array([s for _, _, s in held])
        doc = np.array([d for d, _, _ in held])
        for n in GRAMS:
            if len(buf) < n:
                continue
            rows = gram_rows(buf, n, bits)
            stop = np.minimum(own, size - n + 1)
            ok = np.nonzero(stop > 0)[0]
            if not len(ok):
                continue
            ends = np.minimum(begin[ok] + stop[ok], len(rows))
            cuts = np.stack([begin[ok], ends], 1).ravel()
            vals = np.concatenate([table[rows], np.zeros((1, table.shape[1]), table.dtype)])
            sums = np.add.reduceat(vals, cuts, axis=0, dtype=np.float64)[::2]
            np.add.at(out, doc[ok], sums)
            np.add.at(count, doc[ok], stop[ok])
        held.clear()

    for i, t in enumerate(texts):
        b = text_bytes(t) if t else b""
        for s in range(0, len(b), PIECE):
            piece = b[s:s + PIECE + GRAMS[-1] - 1]
            held.append((i, piece, min(PIECE, len(b) - s)))
            held_bytes += len(piece)
            if held_bytes >= PIECE:
                flush()
                held_bytes = 0
    flush()
    return out / np.maximum(count, 1)[:, None] + bias


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (score below the calibrated threshold)."""
    langs, table, bias, bits = np.array([*model["langs"], UND]), model["table"], model["bias"], model["bits"]
    temperature, reject = model["temperature"], model["reject"]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts = s.tolist()
            has = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
            if len(bias):
                p = _probabilities(text_scores(texts, table, bias, bits), temperature)
                best, top = p.argmax(1), p.max(1)
            else:
                best, top = np.zeros(len(texts), int), np.zeros(len(texts))
                has &= False
            top = np.where(has, top, 0.0)
            yield pd.DataFrame({"lang_pred": np.where(has, langs[best], UND), "score": top, "rejected": ~has | (top < reject)})

    fn = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    out = docs.withColumn("_p", fn(F.col(text_col)))
    return out.withColumns({c: F.col(f"_p.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_p")


def op4_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
