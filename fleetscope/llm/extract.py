"""Main text of web pages: nearest-URL page differencing on top of the page structure.

Pages are ordered by host and URL path with one range exchange; neighbours of the same host are
paired, and each page takes the neighbour with the longer common path.  A range gets the pages that
adjoin it from the other ranges (two at most), so the text does not depend on where ranges end.  Pages become lines (one a
block) before the exchange.  The lines of a pair are aligned by longest common subsequence and shared lines, the
furniture that the host repeats from page to page, are deleted.

Structure decides where the page states it: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments (by element, or outside articles by words of class, id or role) are no lines at all, nor is what the attributes
hidden, aria-hidden or style (display:none) hide; a class, id or role drops no article or main element that it
holds (one about comments or related pages only if the page has another).  The lines inside
article or main elements are the text of a page that has them.  Inside, a class, id or role drops a block only where a
whole name says that it holds adverts or reader comments (``ads``, ``comment-list``); blocks that other furniture words mark
(``search-results``, ``related-work``) are lines that differencing judges: they go if a neighbour shares them.
The unmarked lines of an article are never deleted, for articles rightly
quote and copy each other; on pages without article or main, differencing judges all lines.  Pages whose lines are
all equal are copies and prove nothing about each other: each meets the nearest pages with other lines, and
the second of them if it shares no line with the first.  Where the first shares nearly all lines (a near copy, or
much furniture and little text), only lines that both have are deleted; a single such neighbour decides alone.

Null or empty pages give an empty text.  A page whose host has no other page keeps its
lines.  Null URLs form one host of their own.  Repeated rows are kept.  Extra columns are not passed on.
"""

import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import CHUNK_BYTES, cut, parts_for

#: Elements (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
FURNITURE = frozenset("nav header footer aside form head button dialog menu fieldset figcaption".split()) - {"figcaption"}
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Words in class, id or role that mark furniture.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
breadcrumb breadcrumbs sidebar side aside footer foot header masthead cookie cookies consent gdpr notice notices alert popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies disqus respond
widget toolbar pagination pager skip complementary contentinfo search""".split())
KEEP = frozenset(("article", "main"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNFINISHED = re.compile(r"</?[A-Za-z]")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Words of wrappers that rightly hold article elements of others.
OTHERS = frozenset("comment comments reply replies disqus respond related recommended".split())
#: Class, id, role or itemprop of an article element that is a comment.
_COMMENT = re.compile(r"(?:(?:div|li|user|reader|child|nested)[-_]+)?(?:comment|reply)(?:[-_]+(?:body|item|content|entry|text|\d+))?", re.I)
#: Names that state adverts or reader comments also inside an article.
_INNER = re.compile(r"(?:ad|ads|advert|adverts|advertisement|advertisements|sponsored|comments|(?:user|reader)[-_]comments?|comments?[-_](?:list|section|area|thread|form))", re.I)
#: Why an element drops what it holds: stated for good, by a word that an article or main element inside overrules, by a word of OTHERS.
STATED, WORD, OTHER_WORD = 1, 2, 3
#: Where a line stands: outside, inside article or main, inside and marked by a furniture word.
OUTSIDE, INSIDE, MARKED = 0, 1, 2


def _inner(attrs: str) -> bool:
    """Whether a class, id or role names adverts or reader comments."""
    return any(_INNER.fullmatch(v) for key, value in _ATTR.findall(attrs) if key.lower() in ("class", "id", "role")
               for v in value.strip("\"'").split())


def _marked(name: str, attrs: str) -> int:
    if not attrs or attrs.isspace():
        return 0
    word = 0
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").strip()
        if key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NO_DISPLAY.search(value):
            return STATED
        if name == "article" and key in ("class", "id", "role", "itemprop") and any(_COMMENT.fullmatch(v) for v in value.split()):
            return STATED
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            words = set(_WORDS.findall(value.lower()))
            if words & OTHERS:
                word = OTHER_WORD
            elif words & MARKS:
                word = word or WORD
    return word


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """Blocks outside stated furniture, in page order: (text, OUTSIDE, INSIDE or MARKED)."""
    out, lost = _parse(page, (WORD,))
    if lost and not any(k for _, k in out):
        out, _ = _parse(page, (WORD, OTHER_WORD))  # the only article stands in a wrapper with such a word
    return out


class _Open:
    """The open elements of a page: a stack with counts, so that no end tag searches it."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool]] = []  # name, why it drops, era of that, marks its lines
        self.names: dict[str, int] = {}
        self.drops = dict.fromkeys((STATED, WORD, OTHER_WORD), 0)
        self.era = self.inside = self.marked = 0

    def push(self, name: str, drops: int, marks: bool) -> None:
        self.stack.append((name, drops, self.era, marks))
        self.names[name] = self.names.get(name, 0) + 1
        if drops:
            self.drops[drops] += 1
        self.marked += marks
        self.inside += name in KEEP

    def pop(self) -> str:
        name, drops, era, marks = self.stack.pop()
        self.names[name] -= 1
        if drops and era == self.era:
            self.drops[drops] -= 1
        self.marked -= marks
        self.inside -= name in KEEP
        return name

    def forgive(self) -> None:
        """No open element drops any longer what it holds."""
        self.era += 1
        self.drops = dict.fromkeys(self.drops, 0)

    @property
    def dropping(self) -> bool:
        return any(self.drops.values())

    def close_paragraph(self) -> None:
        """A block start ends an open paragraph, with the inline elements in it."""
        if self.names.get("p"):
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] not in BLOCKS:
                k -= 1
            if k >= 0 and self.stack[k][0] == "p":
                while len(self.stack) > k:
                    self.pop()


def _parse(page: str | None, soft: tuple[int, ...]) -> tuple[list[tuple[str, int]], bool]:
    """Lines, and whether an article or main element was dropped for a word; drops for reasons of ``soft`` end at an article or main element."""
    out: list[tuple[str, int]] = []
    lost = False
    if not page:
        return out, lost
    now = _Open()
    parts: list[str] = []

    def flush():
        if parts:
            t = " ".join(html.unescape("".join(parts)).split())
            if t:
                out.append((t, (MARKED if now.marked else INSIDE) if now.inside else OUTSIDE))
            parts.clear()

    pos, size = 0, len(page)
    while pos < size:
        m = _TAG.search(page, pos)
        if not m:
            break
        if m.start() > pos and not now.dropping:
            parts.append(page[pos:m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            if now.names.get(name):
                # an end tag closes what it holds
                while now.pop() != name:
                    pass
            continue
        if name in BLOCKS:
            flush()
            now.close_paragraph()
        elif name == "br":
            parts.append(" ")
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        drops = STATED if name in FURNITURE else _marked(name, m[3])
        marks = False
        if name == "header" and now.inside:
            drops = 0  # an article's own heading
        elif now.inside and drops in (WORD, OTHER_WORD):
            drops, marks = (STATED, False) if _inner(m[3]) else (0, True)
        if name in KEEP and now.dropping and not drops:
            if not any(n and why not in soft for why, n in now.drops.items()):
                now.forgive()
            elif not now.drops[STATED]:
                lost = True
        now.push(name, drops, marks)
    if pos < size and not now.dropping:
        cut_off = _UNFINISHED.search(page, pos)
        parts.append(page[pos:cut_off.start()] if cut_off else page[pos:])
    flush()
    return out, lost


#: bits of the table of one alignment; longer lists are halved first
TABLE_BITS = 1 << 26


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``, in memory for one row."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if x in where:
            u = v & where[x]
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))


def _halved(a: list[str], b: list[str]) -> set[int]:
    """Longest common subsequence of long lists: the best place of ``b`` to meet the middle of ``a``, then both halves."""
    mid = len(a) // 2
    k = int((_prefix_lengths(a[:mid], b) + _prefix_lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
    return shared(a[:mid], b[:k]) | {mid + i for i in shared(a[mid:], b[k:])}


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of ``a`` on a longest common subsequence with ``b`` (bit-parallel)."""
    common = set(a) & set(b)
    if not common:
        return set()
    at = [i for i, x in enumerate(a) if x in common]
    right = [x for x in b if x in common]
    m = len(right)
    if len(at) > 1 and len(at) * m > TABLE_BITS:
        return {at[i] for i in _halved([a[i] for i in at], right)}
    where: dict[str, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << m) - 1
    rows, v = [full], full
    for i in at:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = set(), len(at), m
    while i and j:
        here = length(i, j)
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(at[i])
    return out


def main_text(lines: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> str:
    """Text of a page given its lines and those of its neighbours, the nearest first."""
    zone = [k for _, k in lines]
    stated = any(zone)
    judged = [i for i, k in enumerate(zone) if k == MARKED] if stated else range(len(lines))
    drop: set[int] = set()
    if judged:
        text = [t for t, _ in lines]
        met = [(len(other), both) for other in others if (both := shared(text, [t for t, _ in other]))]
        drop = met[0][1] if met else set()
        if len(met) > 1 and len(drop) > 0.8 * max(len(text), met[0][0]):
            drop = drop & met[1][1]  # nearly the same page: its own lines may be shared too, so both neighbours must have a line
        drop = drop & set(judged)
    return "\n".join(t for i, (t, k) in enumerate(lines) if i not in drop and (k or not stated))


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), f"{parts.path}?{parts.query}"
    except ValueError:
        return "", url or ""


def _to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as lines (joined by line ends, which no line holds; compressed for the exchange) and their flags, with host, path and a digest of the lines."""
    import zstandard

    small = zstandard.ZstdCompressor(level=3)
    for b in batches:
        host, path, digest, text, flags = [], [], [], [], []
        for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            place = _place(url)
            lines = lines_of(page)
            joined = "\n".join(t for t, _ in lines).encode("utf-8", "replace")
            host.append(place[0])
            path.append(place[1])
            digest.append(hashlib.blake2b(joined, digest_size=16).digest())
            text.append(small.compress(joined))
            flags.append(bytes(k for _, k in lines))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(digest, pa.binary()), pa.array(text, pa.binary()),
             pa.array(flags, pa.binary())], ["_id", "url", *PAGE])


PAGE = ["host", "path", "digest", "text", "flags"]
PAGE_TYPES = "host string, path string, digest binary, text binary, flags binary"
#: pages at the ends of a range: the first, the first with other lines than it, the last, the last with other lines than it
FIRST, SECOND, LAST, OTHER = range(4)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The at most four pages of a range that adjoining ranges may need; pages without lines do not count, and pairs are of one host."""
    part, got = TaskContext.get().partitionId(), [None] * 4
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in PAGE), strict=True):
            if not r[4]:
                continue
            if got[FIRST] is None:
                got[FIRST] = r
            elif got[SECOND] is None and r[0] == got[FIRST][0] and r[2] != got[FIRST][2]:
                got[SECOND] = r
            last = got[LAST]
            if last is None or last[0] != r[0]:
                got[OTHER] = None
            elif last[2] != r[2]:
                got[OTHER] = last
            got[LAST] = r
    rows = [(part, slot, *r) for slot, r in enumerate(got) if r is not None]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
            pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "slot", *PAGE])


def _carried(ends: list[tuple[int, int, str, bytes]]) -> dict[int, tuple]:
    """Per range: the places (range, slot) of the nearest pages with other lines before its first and after its last page, of the same host."""
    by: dict[int, dict[int, tuple[str, bytes]]] = {}
    for part, slot, host, digest in ends:
        by.setdefault(part, {})[slot] = host, digest

    def walk(parts, near, far, other):
        got, at, page, differs = {}, None, None, None
        for p in parts:
            e = by[p]
            came = None
            if page is not None and page[0] == e[near][0]:
                came = at if page[1] != e[near][1] else differs
            got[p] = came
            # without two kinds of pages in its last host, a range of one host passes on what it got
            differs = (p, other) if other in e else came if e[far][0] == e[near][0] else None
            at, page = (p, far), e[far]
        return got

    before, after = walk(sorted(by), FIRST, LAST, OTHER), walk(sorted(by, reverse=True), LAST, FIRST, SECOND)
    return {p: (before[p], after[p]) for p in by}


def _pair(sent: dict[int, tuple]):
    """Pages in order of host and path; each meets the nearest pages with other lines before and after it, of the same host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole = zstandard.ZstdDecompressor()
        kind = None

        def lines(text, flags):
            return list(zip(whole.decompress(text).decode().split("\n"), flags, strict=True))

        def texts():
            nonlocal kind
            before, after = sent.get(TaskContext.get().partitionId(), (None, None))
            held: list[tuple] = []  # ids, urls, paths and flags of pages with the lines of ``now``
            now = None

            def settle(nxt):
                sides = [(x, lines(x[3], x[4])) for x in (before, nxt) if x is not None]
                known: dict[tuple, str] = {}
                for key, url, path, flags in held:
                    near = sorted(sides, key=lambda x: -_common(x[0][1], path))
                    which = flags, near[0][0] is before if near else None
                    if which not in known:
                        known[which] = main_text(lines(now[3], flags), [x for _, x in near])
                    yield key, url, known[which]

            for b in batches:
                kind = b.column(0).type
                for key, url, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not r[4]:
                        yield key, url, ""
                        continue
                    if now is None or now[0] != r[0] or now[2] != r[2]:
                        if now is not None:
                            yield from settle(r if r[0] == now[0] else None)
                            before = (*now[:1], held[-1][2], *now[2:]) if r[0] == now[0] else None
                        held, now = [], r
                    held.append((key, url, r[1], r[4]))
            if now is not None:
                yield from settle(after)

        rows, size = [], 0

        def batch():
            ids, urls, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(out, pa.string())], ["_id", "url", "text"])

        for row in texts():
            rows.append(row)
            size += len(row[2])
            if size > CHUNK_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int | None = None) -> DataFrame:
    """Per row: id, url, text.  The text does not depend on ``parts``."""
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("page"))
    kind = src.schema[0].dataType.simpleString()
    parts = parts or parts_for(src.agg(F.sum(F.octet_length("page"))).first()[0] or 0)
    src = src.mapInArrow(_to_lines, f"_id {kind}, url string, {PAGE_TYPES}")
    dealt = cut(src.repartitionByRange(parts, "host", "path", "_id").sortWithinPartitions("host", "path", "_id"))
    ends = cut(dealt.mapInArrow(_ends, f"part int, slot int, {PAGE_TYPES}"))
    wanted = _carried([tuple(r) for r in ends.select("part", "slot", "host", "digest").collect()])  # at most four a range
    use = {4 * at[0] + at[1] for two in wanted.values() for at in two if at is not None}
    rows = {(r["part"], r["slot"]): tuple(r)[2:] for r in ends.where((F.col("part") * 4 + F.col("slot")).isin(sorted(use))).collect()} if use else {}
    sent = {p: tuple(rows.get(at) for at in two) for p, two in wanted.items()}
    out = dealt.mapInArrow(_pair(sent), f"_id {kind}, url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("url").alias(url_col), "text")


def op3_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
