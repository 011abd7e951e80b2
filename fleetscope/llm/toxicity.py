"""Toxicity score: a weighted lexicon matched by Aho-Corasick after folding.

Folding lower-cases first, then maps look-alike letters of other scripts and full-width forms to Latin, and
undoes digit and sign substitutions inside words (``1d10t``).  Accents stay: the terms of other
languages carry them.  The lexicon holds word beginnings (so that
inflected forms match), each with a weight; a word beginning inside an exception phrase does not
count: two words that hold a term but stand in clean documents, learned with the terms.  The score is a logistic function of the summed weights, normalised by text length.

Learning: word beginnings of 3 to 8 letters are counted over a bounded sample of labelled
training documents (``sample`` per class, chosen by a hash of id and text), terms with a strong
log-odds ratio enter the lexicon with that ratio as weight, and a logistic regression turns the
document sums into a probability.  Counting runs as Spark jobs; only the lexicon (bounded by
``max_terms`` and ``max_exceptions``) and one short feature row per sampled document reach the driver.

Empty or null texts match nothing and get the score of a text without matches.  Without any
usable label the built-in seed lexicon is used with fixed weights.  Rows are scored one by one,
so repeated rows and null ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut, held_out

#: Seed lexicon and benign phrases that contain a term (fixed values).
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "clown", "trash", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clownfish", "pathetic fallacy", "worthless check")

#: Look-alike letters (fixed values): Cyrillic, Greek and others to Latin.
LOOKALIKE = dict(zip(
    "аеорсухіјѕԁһӏкмтвнгαορυνικτβηɑɡıℓ",
    "aeopcyxijsdhlkmtbhraopuviktbhagil", strict=True))
#: Digits and signs read as letters inside a word (fixed values).
LEET = dict(zip("013457@$!", "oieastasi", strict=True))

_LOOKALIKE_TABLE = {ord(k): v for k, v in LOOKALIKE.items()}
_WORD = re.compile(r"[^\W_]+")
_BEFORE = re.compile(r"[^\W_]+ \Z")
_LEETED = re.compile(r"[^\W_]*(?:[^\W\d_][013457]|[013457][^\W\d_])[^\W_]*")
_SIGNS = re.compile(r"(?<=\w)[@$!]+(?=\w)")
_SKIP = re.compile("[­​-‏⁠﻿]")


def fold(text: str | None) -> str:
    import unicodedata

    t = text or ""
    if not t.isascii():
        if _SKIP.search(t):
            t = _SKIP.sub("", t)
        return unicodedata.normalize("NFKC", t).lower().translate(_LOOKALIKE_TABLE)
    return t.lower()


_LEET_TABLE = {ord(k): v for k, v in LEET.items()}
_HAS_LEET = re.compile(r"[013457@$!]")


def unleet(t: str) -> str:
    """Substitutes digits in words that mix them with letters, and signs inside words; others (a shout's ``!!``) stay."""
    if not _HAS_LEET.search(t):
        return t
    t = _SIGNS.sub(lambda m: m[0].translate(_LEET_TABLE), t)
    return _LEETED.sub(lambda m: m[0].translate(_LEET_TABLE), t)


class Lexicon:
    """Aho-Corasick matcher for weighted word beginnings with exception phrases."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.weights = terms
        self.auto = ahocorasick.Automaton()
        for t, w in terms.items():
            self.auto.add_word(t, (len(t), w))
        for p in exceptions:
            if p not in terms:
                self.auto.add_word(p, (len(p), None))
        self.empty = len(self.auto) == 0
        if not self.empty:
            self.auto.make_automaton()

    def _found(self, t: str) -> dict[int, float]:
        """Heaviest term of each word beginning that no exception phrase spares."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.auto.iter(t):
            at = end - size + 1
            if w is None:
                spared.append((at, end))
            elif (at == 0 or not (t[at - 1].isalnum())) and w > best.get(at, 0.0):
                best[at] = w
        if spared:
            best = {a: w for a, w in best.items() if not any(s <= a <= e for s, e in spared)}
        return best

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, matches, words) of a text; a word counts once, with its heaviest term."""
        t = unleet(fold(text))
        n = t.count(" ") + t.count("\n") + 1 if t else 0
        if self.empty or not t:
            return 0.0, 0, n
        best = self._found(t)
        return sum(best.values()), len(best), n

    def phrases(self, text: str | None) -> set[str]:
        """The matched words of a text, each with the word before and with the word after it (one space between)."""
        t = unleet(fold(text))
        out: set[str] = set()
        if self.empty or not t:
            return out
        for at in self._found(t):
            word = _WORD.match(t, at)
            if not word:
                continue
            after = _WORD.match(t, word.end() + 1) if t[word.end():word.end() + 1] == " " else None
            if after:
                out.add(t[at:after.end()])
            before = _BEFORE.search(t[max(0, at - 60):at])
            if before:
                out.add(before[0] + word[0])
        return out


def features(total: float, hits: int, n: int) -> list[float]:
    return [1.0, math.log1p(total), min(total / math.sqrt(n + 10.0), 20.0), min(hits, 5) / 5.0]


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, c in n.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample / c))).otherwise(share)
    u = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    picked = lab.where(u < share)
    # about 2 * sample ids, whatever the size of the tables: broadcast, so that only the texts of the sample
    # are shuffled; copies of one text count once, or their other words would look like terms
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), "_id").dropDuplicates(["_text", "y"]).select("_id", "_text", "y"))
    # many texts under one id are sampled anew
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if max(n.values(), default=0) <= 2 * sample:
        return rows
    share = F.lit(0.0)
    for y, c in n.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample / c))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("_id", "_text", F.lit(10)), F.lit(1 << 30)) / float(1 << 30) < share)


def _count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        keys = sorted(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([
            pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
            pa.array([seen[0][k] for k in keys], pa.int64())], ["term", "pos", "neg"])
        seen[0].clear()
        seen[1].clear()
        return out

    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(unleet(fold(t))))
            seen[y].update({w[:k] for w in words for k in range(3, min(len(w), 8) + 1)})
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield flush()
    yield flush()


def _count_phrases(terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(terms)
        seen = {0: Counter(), 1: Counter()}
        for b in batches:  # of the bounded sample
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(lex.phrases(t))
        keys = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                          pa.array([seen[0][k] for k in keys], pa.int64())], ["phrase", "pos", "neg"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = 8000, max_terms: int = 4000, max_exceptions: int = 2000, least: int = 5) -> dict:
    """Model {terms, exceptions, beta} from labelled rows outside the held-out fold (at most ``sample`` per class)."""
    rows = _training(docs, labels, id_col, text_col, label_col, sample)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    terms = {t: 4.0 for t in SEED_TERMS}
    if n_pos and n_neg:
        counts = rows.select("_text", "y").mapInArrow(_count_prefixes, "term string, pos long, neg long")
        odds = F.log(((F.col("pos") + 0.05) / (n_pos + 0.1)) / ((F.col("neg") + 0.05) / (n_neg + 0.1)))
        best = (counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
                .where(F.col("pos") >= max(least, n_pos // 100)).withColumn("w", odds).where("w > 2.5")
                .orderBy(F.desc(F.col("w") * F.sqrt("pos")), "term").limit(max_terms).collect())
        terms |= {r["term"]: round(float(r["w"]), 4) for r in best}
    beta, exceptions = [-4.0, 1.6, 1.0, 1.0], EXCEPTIONS
    if n_pos and n_neg:
        # phrases of a term that stand in clean documents and far more rarely in toxic ones
        phrases = rows.select("_text", "y").mapInArrow(_count_phrases(terms), "phrase string, pos long, neg long")
        odds = F.log(((F.col("neg") + 0.05) / (n_neg + 0.1)) / ((F.col("pos") + 0.05) / (n_pos + 0.1)))
        clean = (phrases.groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("neg") >= least)
                 .where(odds > 2.5).orderBy(F.desc("neg"), "phrase").limit(max_exceptions).collect())
        exceptions = (*EXCEPTIONS, *(r["phrase"] for r in clean))
        feats = rows.select("_text", "y").mapInArrow(_features(terms, exceptions), "f array<double>, y int").collect()
        x = np.array([r["f"] for r in feats])
        y = np.array([r["y"] for r in feats], float)
        # weigh the classes back to their shares in all labelled rows
        all_lab = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).agg(
            F.avg(F.col(label_col).cast("double"))).first()[0]
        share = y.mean()
        wt = np.where(y == 1, all_lab / share, (1 - all_lab) / (1 - share))
        beta = _logistic(x, y, wt)
    return {"terms": terms, "exceptions": exceptions, "beta": [float(v) for v in beta]}


def _features(terms: dict[str, float], exceptions: tuple[str, ...]):
    def run(batches):
        lex = Lexicon(terms, exceptions)
        for b in batches:
            f = [features(*lex.score(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "y"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, wt: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps of a weighted ridge logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (wt * p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (wt * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` (0 to 1); all columns are kept."""
    terms, exceptions, beta = model["terms"], model["exceptions"], np.array(model["beta"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = None
        for s in batches:
            lex = lex or Lexicon(terms, exceptions)
            z = np.array([features(*lex.score(t)) for t in s], float).reshape(-1, 4) @ beta
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.col(text_col)))


def op9_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
