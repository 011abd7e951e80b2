"""Personal data: fixed patterns plus a semi-Markov conditional random field.

Base spans come from one pattern per kind (leftmost, non-overlapping, checked afterwards) and
always stay.  Around digits and at-signs a semi-Markov CRF segments the text: candidate segments of at
most ``LONGEST`` tokens are scored by whole-span features (length, digits, groups, checksum,
separators, what stands left and right), and bounded-entity dynamic programming chooses boundaries and
kinds jointly.  Decoded segments that overlap no base span and whose posterior reaches
``certain`` are added, e.g. numbers without the plus sign or addresses spelled with "(at)".

The CRF is trained on a bounded sample of documents (``sample``, by a hash of id and text, equal rows once): base spans are
the labels, and copies of the windows with respelled spans (plus sign dropped, at-sign spelled out,
other separators) carry the same labels.

Null texts count as empty.  Rows are judged one by one; extra columns are not passed on.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values).
#: An address is looked for from its at-sign, and an ip from the first digit of a run: same spans
#: as trying every start, in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONGEST = 18
#: characters of a window around a spot; a window widened to white space grows by at most ``WIDEST`` on a side (no address is
#: longer).  Both are parameters of ``learn`` and ``find`` and bound added spans only; base spans are found in the whole text.
WINDOW, WIDEST = 48, 320

_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|[(\[] ?at ?[)\]]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_parts(s: str) -> bool:
    return all(len(v := p.lstrip("0") or "0") <= 3 and int(v) <= 255 for p in s.split("."))


def _emails(t: str) -> list[tuple[int, int, int]]:
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > free and t[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(t, at + 1) if s < at else None
        if m:
            out.append((s, m.end(), 0))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind."""
    out = []
    if "@" in t:
        out += _emails(t)
    if _DIGIT.search(t):
        if "." in t:
            out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if _small_parts(m[0])]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 12:
                d = _only_digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), 2))
        if "+" in t:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- windows, tokens and whole-span features ---------------------------------------------


def windows(t: str, window: int = WINDOW, widest: int = WIDEST) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, merged up to four windows, then widened to the next white space on both sides."""
    spots = [(m.start(), m.end()) for m in re.finditer(r"[0-9][0-9 ().+-]{6,}[0-9]|[0-9]+(?:[.,][0-9]+){2,}", t)]
    spots += [(m.start(), m.end()) for m in _AT.finditer(t)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(spots):
        s, e = max(0, s - window // 2), min(len(t), e + window // 2)
        if out and s <= out[-1][1] and e - out[-1][0] <= 4 * window:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return [_widened(t, s, e, widest) for s, e in out]


def _widened(t: str, s: int, e: int, widest: int) -> tuple[int, int]:
    low, high = max(0, s - widest), min(len(t), e + widest)
    while s > low and not t[s - 1].isspace():
        s -= 1
    while e < high and not t[e].isspace():
        e += 1
    return s, e


def around(t: str, s: int, e: int) -> tuple[str, str]:
    """The character before a window and the two after it (a blank at the ends of the text)."""
    return t[s - 1] if s else " ", t[e:e + 2] or " "


N_FEATURES = 34


def span_features(s: str, left: str, right: str) -> np.ndarray:
    f = np.zeros(N_FEATURES)
    d = _only_digits(s)
    n = len(d)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    f[0] = 1
    for i, top in enumerate((0, 3, 6, 8, 9, 10, 11, 12, 15, 16, 19)):
        if n <= top:
            f[1 + i] = 1
            break
    f[12] = n > 19
    f[13] = "@" in s
    f[14] = bool(re.search(r"[(\[] ?at ?[)\]]", s))
    f[15] = bool(re.search(r"\.[A-Za-z]{2,8}$| ?[(\[] ?dot ?[)\]] ?[A-Za-z]{2,8}$", s)) and not s[0].isspace()
    f[16] = s[0] == "+"
    f[17] = s[0] == "("
    f[18] = 12 <= n <= 19 and not letters and luhn(d)
    f[19] = len(groups) == 4 and _small_parts(".".join(groups)) and bool(re.fullmatch(r"[0-9]+( ?\. ?[0-9]+){3}", s))
    f[20] = letters > 0 and n > 0
    f[21] = letters > 0
    f[22] = bool(re.search(r"[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}$", s))
    f[23] = all(len(g) == 4 for g in groups) and len(groups) > 2
    f[24] = s[0].isspace() or s[-1].isspace()
    f[25] = left.isalnum() or left in "@._%+-"
    f[26] = right[0].isalnum() or right[0] == "@"
    f[27] = not (s[0].isalnum() or s[0] in "+(")
    f[28] = not s[-1].isalnum()
    f[29] = len(re.sub(r"[0-9A-Za-z().+ @\[\]_%-]", "", s)) > 0
    f[30] = s.count(" ") > 3
    f[31] = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", s))
    f[32] = bool(re.search(r"[^\W\d_] [^\W\d_]", s))
    f[33] = len(right) > 1 and right[0] in ".-" and right[1].isalnum()
    return f


def candidates(t: str, left: str = " ", right: str = " ") -> tuple[list[int], dict[tuple[int, int], np.ndarray]]:
    """Token bounds of a window that stands between ``left`` and ``right``, and the features of the segments worth a look, by (first, last + 1) token."""
    bounds = [m.start() for m in _TOKEN.finditer(t)] + [len(t)]
    n = len(bounds) - 1
    digits = np.concatenate(([0], np.cumsum([len(_only_digits(t[bounds[i]:bounds[i + 1]])) for i in range(n)]))).tolist()
    ats = np.concatenate(([0], np.cumsum([t[bounds[i]:bounds[i + 1]] in ("@", "at") for i in range(n)]))).tolist()
    out = {}
    for i in range(n):
        if t[bounds[i]].isspace():
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if t[bounds[j] - 1].isspace():
                continue
            nd = digits[j] - digits[i]
            if 7 <= nd <= 19 or ats[j] > ats[i] or (nd >= 4 and j - i >= 7):
                s, e = bounds[i], bounds[j]
                out[i, j] = span_features(t[s:e], t[s - 1] if s else left, (t[e:e + 2] + right)[:2])
    return bounds, out


def _lattice(n: int, feats: dict, w: np.ndarray) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Segments ending at each token boundary: (start, score of each kind)."""
    ending: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (i, j), f in feats.items():
        ending.setdefault(j, []).append((i, w @ f))
    return ending


def _forward(n: int, ending: dict) -> np.ndarray:
    a = np.full(n + 1, -np.inf)
    a[0] = 0
    for j in range(1, n + 1):
        terms = [a[j - 1]]  # a token outside any entity scores 0
        for i, sc in ending.get(j, ()):
            terms.extend((a[i] + sc).tolist())
        m = max(terms)
        a[j] = m + math.log(sum(math.exp(x - m) for x in terms))
    return a


def _backward(n: int, ending: dict) -> np.ndarray:
    begin: dict[int, list[tuple[int, np.ndarray]]] = {}
    for j, segs in ending.items():
        for i, sc in segs:
            begin.setdefault(i, []).append((j, sc))
    b = np.full(n + 1, -np.inf)
    b[n] = 0
    for i in range(n - 1, -1, -1):
        terms = [b[i + 1]]
        for j, sc in begin.get(i, ()):
            terms.extend((b[j] + sc).tolist())
        m = max(terms)
        b[i] = m + math.log(sum(math.exp(x - m) for x in terms))
    return b


def decode(t: str, w: np.ndarray, certain: float, left: str = " ", right: str = " ") -> list[tuple[int, int, int]]:
    """Best segmentation of a window; entities with a posterior of at least ``certain``."""
    bounds, feats = candidates(t, left, right)
    if not feats:
        return []
    n = len(bounds) - 1
    ending = _lattice(n, feats, w)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, sc in ending.get(j, ()):
            k = int(sc.argmax())
            if best[i] + sc[k] > best[j]:
                best[j], back[j] = best[i] + float(sc[k]), (i, k, float(sc[k]))
    a, b = _forward(n, ending), _backward(n, ending)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
            continue
        i, k, sc = back[j]
        if a[i] + sc + b[j] - a[n] >= math.log(certain):
            out.append((bounds[i], bounds[j], k))
        j = i
    return out[::-1]


# --- training ------------------------------------------------------------------------------


def respell(s: str, kind: int, rng: np.random.Generator) -> str:
    if kind == 0:
        return s.replace("@", [" (at) ", "(at)", " [at] ", "[at]"][rng.integers(4)])
    if kind == 1:
        return s.replace(".", " . ")
    if kind == 2:
        d = _only_digits(s)
        return [" ", "-", "."][rng.integers(3)].join(d[i:i + 4] for i in range(0, len(d), 4))
    s = re.sub(r"^\+[0-9]{1,2} ?", "", s) if rng.random() < 0.6 else s[1:]
    return s.replace(" ", ["-", ".", " "][rng.integers(3)])


def respelled(t: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The window with one of its spans spelled another way, and all spans at their new places."""
    if not spans:
        return None
    x, y, k = spans[int(rng.integers(len(spans)))]
    new = respell(t[x:y], k, rng)
    if new == t[x:y] or any(p < y and x < q for p, q, _ in spans if (p, q) != (x, y)):
        return None
    by = len(new) - (y - x)
    return t[:x] + new + t[y:], [(p, q + by, z) if (p, q) == (x, y) else (p + by, q + by, z) if p >= y else (p, q, z) for p, q, z in spans]


def _training_windows(per_document: int, window: int = WINDOW, widest: int = WIDEST):
    """Of each document the ``per_document`` windows of the smallest hashes, each with what stands around it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, gold, left, right = [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                spans = base_spans(t)
                rng = np.random.default_rng(key & 0xFFFFFFFF)
                chosen = sorted(windows(t, window, widest), key=lambda w, t=t, key=key: (zlib.crc32(f"{key} {w[0]} {t[w[0]:w[1]]}".encode("utf-8", "replace")), w))
                for s, e in chosen[:per_document]:
                    inside = [(x - s, y - s, k) for x, y, k in spans if s <= x and y <= e]
                    for words, marks in filter(None, ((t[s:e], inside), respelled(t[s:e], inside, rng))):
                        text.append(words)
                        gold.append([v for g in marks for v in g])
                        left.append(around(t, s, e)[0])
                        right.append(around(t, s, e)[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(text, pa.string()), pa.array(gold, pa.list_(pa.int32())), pa.array(left, pa.string()), pa.array(right, pa.string())],
                ["t", "gold", "before", "after"])

    return run


def train(examples: list[tuple], epochs: int = 4, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights [kind, feature] by stochastic gradient ascent of the log likelihood; examples are (window, spans, character before, characters after)."""
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -2.0
    ready = []
    for t, gold, left, right in examples:
        bounds, feats = candidates(t, left, right)
        at = {p: i for i, p in enumerate(bounds)}
        segs = [(at.get(s), at.get(e), k) for s, e, k in gold]
        if feats and all((i, j) in feats for i, j, _ in segs):
            ready.append((len(bounds) - 1, feats, segs))
    rng = np.random.default_rng(7)
    square = np.full_like(w, 1e-6)
    for _ in range(epochs):
        for x in rng.permutation(len(ready)):
            n, feats, segs = ready[x]
            ending = _lattice(n, feats, w)
            a, b = _forward(n, ending), _backward(n, ending)
            g = -ridge * w
            for i, j, k in segs:
                g[k] += feats[i, j]
            for j, ss in ending.items():
                for i, sc in ss:
                    g -= np.exp(np.minimum(a[i] + sc + b[j] - a[n], 0))[:, None] * feats[i, j][None, :]
            square += g * g
            w += rate * g / np.sqrt(square)
    return w


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, most: int = 1500,
          per_document: int = 8, window: int = WINDOW, widest: int = WIDEST) -> np.ndarray:
    """Weights from at most ``most`` windows of about ``sample`` documents that hold a digit or an at-sign, ``per_document`` of each at most, all by hash."""
    use = docs.where(F.col(text_col).rlike("[0-9@]"))
    n = use.count()
    if not n:
        return np.zeros((len(KINDS), N_FEATURES))
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7))
    picked = use.where(F.pmod(key, F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample / n)).select(key.alias("key"), F.col(text_col).alias("_text")).dropDuplicates(["key"])
    got = picked.mapInArrow(_training_windows(per_document, window, widest), "t string, gold array<int>, before string, after string").distinct()
    got = got.orderBy(F.xxhash64("t"), "t", "before", "after").limit(most).collect()
    return train([(r["t"], [tuple(r["gold"][i:i + 3]) for i in range(0, len(r["gold"]), 3)], r["before"], r["after"]) for r in got])


class Taken:
    """Stretches of a text that spans take, merged and in order; looked up by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k == 0 or self.ends[k - 1] <= s

    def take(self, s: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def added_spans(t: str, fixed: list[tuple[int, int, int]], weights: np.ndarray, certain: float, window: int = WINDOW,
                widest: int = WIDEST) -> list[tuple[int, int, int]]:
    """Decoded spans of a text that overlap no base span and none decoded before."""
    out: list[tuple[int, int, int]] = []
    if _DIGIT.search(t) or _AT.search(t):
        taken = Taken(fixed)
        for s, e in windows(t, window, widest):
            for x, y, k in decode(t[s:e], weights, certain, *around(t, s, e)):
                if taken.free(x + s, y + s):
                    taken.take(x + s, y + s)
                    out.append((x + s, y + s, k))
    return out


def find(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", certain: float = 0.9,
         window: int = WINDOW, widest: int = WIDEST) -> DataFrame:
    """Per row: id, base and spans, each an array of (kind, start, end) by start, then kind (code points, end exclusive)."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                fixed = base_spans(t)
                more = added_spans(t, fixed, weights, certain, window, widest)
                base.append(fixed)
                every.append(sorted(fixed + more, key=lambda v: (v[0], v[2])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x] for x in v], kind) for v in (base, every)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["_id", "base", "spans"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    out = src.mapInArrow(run, f"_id {src.schema[0].dataType.simpleString()}, base {one}, spans {one}")
    return out.withColumnRenamed("_id", id_col)


def op7_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs))

    def text(c: str):
        return F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(k: str):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
