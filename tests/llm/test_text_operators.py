"""Substring dedup, SimHash and decontamination against brute force on odd rows."""

import collections
import hashlib
import re

import duckdb
import pytest

from fleetscope.llm import decontaminate, queries, simhash, substrings

from .conftest import make_docs, odd_rows, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, window):
    starts = collections.defaultdict(set)
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                starts[tuple(w[s:s + window])].add(i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if min(starts[tuple(w[s:s + window])]) < i:
                    gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 7, 8])
def test_substrings_equal_brute_force(odd, window):
    got = substrings.remove_repeats(odd, window=window, bucket_words=500).collect()
    want = brute_repeats([(r[0], r[1]) for r in odd_rows()], window)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == want
    for r in got:
        assert all(s["end"] - s["start"] >= window for s in r["repeats"])


def test_substrings_many_batches(odd, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WORDS", 300)
    got = substrings.remove_repeats(odd, window=20).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute_repeats(
        [(r[0], r[1]) for r in odd_rows()], 20)


def test_substrings_repeated_rows_that_share_a_passage(spark):
    shared = prose(99, 60)
    rows = [(1, prose(1, 30) + " " + shared), *[(2, shared + " " + prose(2, 40))] * 3, *[(3, shared)] * 2, (2, prose(4, 20) + " " + shared)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute_repeats(rows, 50)


def test_substrings_of_one_repeated_word(spark):
    """One word repeated through long texts: every document sends the word's windows once, and the result is exact."""
    rows = [(i, "na " * n) for i, n in enumerate((49, 50, 70_000, 90_000, 51))] + [(9, prose(1, 60) + " na" * 60_000 + " " + prose(2, 60))]
    sent = list(substrings._send_anchors(50, 25, 64)(iter([__import__("pyarrow").RecordBatch.from_pydict(
        {"_id": [2], "_th": [7], "_text": [rows[2][1]]})])))
    assert sum(len(v) for b in sent for v in b.column(b.schema.get_field_index("vals")).to_pylist()) <= 2 * 4
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {0: (49, 0), 1: (50, 0), 2: (70_000, 70_000), 3: (90_000, 90_000), 4: (51, 51), 9: (60_120, 60_000)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got} == want
    assert {r["doc_id"]: [tuple(s) for s in r["repeats"]] for r in got}[9] == [(60, 60_060)]


def test_substrings_empty_table(nothing):
    assert substrings.remove_repeats(nothing).collect() == []


def brute_simhash(text):
    import xxhash
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """fps: {(row): (id, fp)} -> smallest id reachable for each row."""
    n, par = len(fps), list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(n)]


def test_simhash_equals_brute_force(odd):
    got = simhash.near_duplicates(odd).collect()
    rows = odd_rows()
    fps = [(r[0], brute_simhash(r[1])) for r in rows]
    comp = brute_components(fps, 2)
    want = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(fps, comp, strict=True)), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_cover_every_pair(radius):
    import itertools
    masks = simhash.covering_masks(list(range(12)), radius)
    assert len(masks) == (1 << radius + 1) - 1
    for diff in itertools.combinations(range(12), radius):
        assert any(not any(m >> p & 1 for p in diff) for m, _ in masks)


def test_simhash_splits_large_buckets(spark):
    """A bucket over the cap is covered again; no link is lost."""
    import random
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(simhash._signed(f) for f in fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from fleetscope.llm.common import components
    got = {r["node"]: r["root"] for r in components(simhash.links(frame, 2, bucket_cap=8)).collect()}
    comp = brute_components([(f, f & (1 << 64) - 1) for f in fps], 2)
    assert [got.get(f, f) for f in fps] == comp


def test_simhash_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []


def brute_hits(docs, items, window=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s:s + window])].add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, its = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    its |= wins[tuple(w[s:s + n])] - {None}
        out.append((i, len(w), len(hit), len(its), ",".join(sorted(map(str, its))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, odd, limit):
    shared = prose(99, 60).split()
    items = [(1, " ".join(shared[5:30])), (2, "ONE"), (3, "one two"), (4, None), (5, ""), (6, " ".join(shared[40:47])),
             (7, " ".join(shared[5:30]).upper()), (8, "never seen words at all in any of the texts of this small test here"),
             (None, "alpha0 beta1"), (9, prose(1, 40))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(odd, frame, broadcast_bytes=limit).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got), key=str)
    want = brute_hits([(r[0], r[1]) for r in odd_rows()], items)
    assert have == want


def test_decontamination_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] or r["n_hit"] for r in decontaminate.decontaminate(odd, items).collect())
    assert decontaminate.decontaminate(nothing, items).collect() == []


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op10_decontaminate"])
def test_sql_agrees_on_odd_rows(spark, tmp_path, name):
    docs = make_docs(spark, [r for r in {r[0]: r for r in odd_rows() if r[0] is not None}.values()])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(prose(99, 60).split()[5:30])), (2, "ONE")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    res = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in res.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())


def test_digest_of_kept_words(spark, tmp_path):
    make_docs(spark, odd_rows()[:6]).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got}[5] == hashlib.sha256(b"one two").hexdigest()
