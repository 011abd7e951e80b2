"""Mixing, sharding, models, embeddings, pages and the pipeline on odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscope.llm import embeddings, extract, langid, mixing, pii, queries, sharding, toxicity

from .conftest import EXTRA, make_docs, odd_rows, prose


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([3, 20, 60, 400])), "en", "abc"[min(i % 5, 2)]) for i in range(900)]
    docs = make_docs(spark, rows)
    got = mixing.mix(docs, mixing.word_count(F.col("text")), block=100, reserve=40).collect()
    again = mixing.mix(docs.repartition(7), mixing.word_count(F.col("text")), block=100, reserve=40).collect()
    assert sorted(got) == sorted(again)
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    assert math.isclose(sum(target.values()), sum(r["size"] for r in got))


def test_mix_blocks_with_null_and_repeated_ids(spark, monkeypatch):
    """A third of the ids null, a third one and the same: no block is much larger than the mean, targets are met, reruns agree."""
    from pyspark.sql.types import LongType

    rng = random.Random(5)
    words = [prose(i, rng.choice([3, 20, 60, 100])) for i in range(60)]
    rows = [([None, 7, i][i % 3], rng.choice(words), "en", "ab"[i % 2]) for i in range(6000)]
    docs = make_docs(spark, rows).repartition(3)
    numbered = mixing.numbered_rows(docs.select("doc_id", "source", F.length("text").alias("size")), chunk=7)
    blocks = numbered.groupBy("source", F.pmod(F.xxhash64("doc_id", "size", "_n", F.lit(7)), F.lit(30))).count().toPandas()["count"]
    assert numbered.count() == 6000 and blocks.max() < 2 * blocks.mean()
    got = mixing.mix(docs, mixing.word_count(F.col("text")), block=200, reserve=40).collect()
    again = mixing.mix(docs.repartition(5), mixing.word_count(F.col("text")), block=200, reserve=40).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter((r[0], r[3]) for r in rows)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 0.01 * r["target"] for r in got)
    assert isinstance(numbered.schema["_n"].dataType, LongType)


def test_mix_caps_and_odd_rows(odd, nothing):
    sizes = {"a": 10, "b": 1000, None: 0}
    t = mixing.targets(sizes, {"a": 5, "b": 2, None: 1}, 1010, 3)
    assert t == {"a": 30.0, "b": 980.0, None: 0.0}
    got = mixing.mix(odd, mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(odd_rows())
    assert mixing.mix(nothing, mixing.word_count(F.col("text"))).collect() == []


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(200), rng.integers(0, 500, 200)
    out = mixing.flight(p, size, rng)
    free = (out > 0) & (out < 1)
    assert free.sum() <= 2
    assert math.isclose(out.sum(), p.sum(), abs_tol=1e-6) and math.isclose((out * size).sum(), (p * size).sum(), rel_tol=1e-6)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_are_even_and_gapless(spark, shards):
    rows = [(i, prose(i % 300, 5 + i % 70), "en", "s") for i in range(1200)] + [(5000 + i, prose(7, 50), "en", "s") for i in range(600)]
    docs = make_docs(spark, rows)
    got = sharding.shard(docs, shards=shards, rows_per_task=50).select("doc_id", "size", "shard", "slot", "text").collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert len(got) == len(rows) and len(size) == shards
    assert max(size.values()) - min(size.values()) <= 0.03 * sum(size.values()) / shards + 2 * max(r["size"] for r in got)
    for s in size:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


@pytest.mark.parametrize("who", [None, 7])
def test_equal_rows_are_cut_by_number(spark, who):
    """A third of all rows are one row, with one id or none: every shard still gets its bytes, and input columns of result names are replaced."""
    rows = [(i, prose(i, 5 + i % 40), "en", "s") for i in range(2000)] + [(who, prose(5000, 30), "en", "s")] * 1000
    docs = make_docs(spark, rows).repartition(5)
    assert {"size", "shard", "slot"} <= set(docs.columns)
    got = sharding.shard(docs, shards=20, rows_per_task=40).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == set(docs.columns)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(size) == 20
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 20 + 2 * max(r["size"] for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((r[0], r[1]) for r in rows)


def test_boundaries_compare_by_key_then_number():
    rng = random.Random(4)
    bounds = sorted({tuple(rng.randrange(4) for _ in range(3)) for _ in range(12)})
    keys = [tuple(rng.randrange(5) for _ in range(3)) for _ in range(300)]
    got = sharding.shard_of(bounds).func(*(__import__("pandas").Series([k[i] for k in keys], dtype="int64") for i in range(3)))
    assert got.tolist() == [sum(b <= k for b in bounds) for k in keys]


def test_shards_of_odd_rows(spark, odd, nothing, tmp_path):
    got = sharding.digest(odd).collect()
    assert len(got) == len(odd_rows())
    texts = collections.Counter(zlib.crc32((r[1] or "").encode()) for r in odd_rows())
    assert collections.Counter(r["text_crc32"] for r in got) == texts
    assert sharding.digest(nothing).collect() == []
    sharding.write_shards(odd.drop(*EXTRA), str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows())


def _labelled(spark):
    bad, fine = ["blorgface", "blorgish", "snerkel"], ["kind", "warm", "bright"]
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        else:
            w.insert(rng.randrange(len(w)), rng.choice(fine))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_scores(spark, odd, nothing):
    docs, labels = _labelled(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model, out="tox").join(labels, "doc_id").select("tox", "toxic").collect()
    assert sum((r["tox"] >= 0.5) == bool(r["toxic"]) for r in got) >= 0.98 * len(got)
    other = toxicity.score(odd, model, out="tox").collect()
    assert len(other) == len(odd_rows()) and all(0 <= r["tox"] <= 1 for r in other)
    assert toxicity.score(nothing, model, out="tox").collect() == []
    none = toxicity.learn(docs, labels.limit(0))
    assert none["terms"].keys() == set(toxicity.SEED_TERMS)


def test_toxicity_learns_exceptions(spark):
    """A term that is harmless after one word: the phrase is learned from clean documents and spared."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = prose(i, 50).split()
        if i % 3 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "grumbol")
        elif i % 24 == 1:
            w.insert(rng.randrange(len(w)), "harbour grumbol")
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.learn(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "harbour grumbol" in model["exceptions"]
    probe = spark.createDataFrame([(0, "we met at the harbour grumbol today"), (1, "you grumbol you grumbol")], "doc_id long, text string")
    low, high = (r["score"] for r in toxicity.score(probe, model).orderBy("doc_id").collect())
    assert low < 0.5 <= high


def test_samples_are_bounded_on_repeated_ids(spark):
    """Labelled rows that repeat an id, with other texts or the same, do not fill the training sample."""
    rows = [(1, prose(i, 20), "en", "s") for i in range(900)] + [(3, prose(5000, 20), "en", "s")] * 300 + [(10 + i, prose(6000 + i, 20), "en", "s") for i in range(50)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(1, 1), (3, 0), *((10 + i, i % 2) for i in range(50))], "doc_id long, toxic int")
    picked = toxicity._training(docs, labels, "doc_id", "text", "toxic", 100)
    n = collections.Counter(r["y"] for r in picked.collect())
    assert n[1] <= 200 and n[0] <= 30


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0})
    assert lex.score("such an 1d10t and іdіоt")[1] == 2
    assert lex.score("ｉｄｉｏｔ")[1] == 1
    assert lex.score("ІDІОТ, IDIOT and Іdiоt")[1] == 3  # capitals of Cyrillic look like Latin ones
    assert lex.phrases("the old Trash heap, an idiot") == {"old trash", "trash heap", "an idiot"}
    assert lex.score("an id!ot, tr@sh")[1] == 2 and toxicity.unleet("lo!! this$$$ 2nd 1990") == "lo!! this$$$ 2nd 1990"
    assert lex.score("put it in the trash can, trash it")[1] == 1
    assert lex.score("notidiot 4 2010 a1") [1] == 0
    assert lex.score(None) == (0.0, 0, 0)


def test_language_of_held_out_rows(spark, odd, nothing):
    vocab = {"xx": ["olo", "mana", "pilu", "osta"], "yy": ["krt", "zwisch", "brdu", "szt"], "zz": ["éàê", "çuè", "ñoú", "üöä"]}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(vocab[k]) + rng.choice(vocab[k]) for _ in range(rng.choice([3, 30]))), k, "s")
            for i, k in ((i, "xyz"[i % 3] * 2) for i in range(300))]
    docs = make_docs(spark, rows)
    model = langid.learn(docs)
    got = langid.predict(docs, model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    other = {r["doc_id"]: r for r in langid.predict(odd, model).select("doc_id", "lang_pred", "score").collect()}
    assert len(langid.predict(odd, model).collect()) == len(odd_rows())
    assert all(other[k]["lang_pred"] == "und" and other[k]["score"] == 0 for k in (1, 2, 3))
    assert langid.predict(nothing, model).collect() == []
    blank = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, blank).collect()} == {"und"}


def test_language_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    table, bias = rng.random((1 << 10, 3)).astype(np.float32), np.zeros(3)
    texts = [prose(1, 500), "", "ab", None, prose(2, 40)]
    whole = langid.text_scores(texts, table, bias, 10)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert np.allclose(whole, langid.text_scores(texts, table, bias, 10))


def test_pii_base_patterns_and_added_spans(spark, odd, nothing):
    import re
    rows = [(i, f"{prose(i, 8)} mail me.{i}@host{i % 9}.example.com or 10.0.{i % 250}.7 call +1 ({200 + i}) 555-0{100 + i % 800} end", "en", "s") for i in range(150)]
    rows += [(1000, "write to jane.roe (at) host3.example.com now", "en", "s"), (1001, "a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111", "en", "s"),
             (1002, "@" * 50 + "a@@b.c " + "9" * 5000 + ".1.1.1", "en", "s")]
    docs = make_docs(spark, rows)
    got = {r["doc_id"]: r for r in pii.find(docs, pii.learn(docs)).collect()}
    plain = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")]
    for i, t, *_ in rows:
        for k, p in zip(("email", "ip"), plain, strict=True):
            want = [m.span() for m in p.finditer(t) if k == "email" or all(len(x) < 9 and int(x) <= 255 for x in m[0].split("."))]
            assert [(s["start"], s["end"]) for s in got[i]["base"] if s["kind"] == k] == want
        assert {tuple(s) for s in got[i]["base"]} <= {tuple(s) for s in got[i]["spans"]}
    t = rows[150][1]
    assert any(t[s["start"]:s["end"]] == "jane.roe (at) host3.example.com" for s in got[1000]["spans"])
    assert pii.find(odd, pii.learn(odd)).count() == len(odd_rows())
    assert pii.find(nothing, pii.learn(nothing)).collect() == []


def test_pii_windows_hold_whole_words(spark):
    rows = [(i, f"word {i} mail user{i}@host{i % 9}.example.com or call +49 30 12345{i:03} and pay 4111 1111 1111 1111 today", "en", "s") for i in range(150)]
    long = "informatics.uni-heidelberg.de", "maximiliane.featherstonehaugh-cholmondeley"
    rows += [(1000, f"write to jane (at) {long[0]} now", "en", "s"), (1001, f"write to {long[1]} (at) host3.example.com now", "en", "s")]
    docs = make_docs(spark, rows)
    got = {r["doc_id"]: r for r in pii.find(docs, pii.learn(docs)).collect()}
    for i, want in ((1000, f"jane (at) {long[0]}"), (1001, f"{long[1]} (at) host3.example.com")):
        text = dict(r[:2] for r in rows)[i]
        assert want in [text[s["start"]:s["end"]] for s in got[i]["spans"]]
    text = "x" * 500 + "@" + "y" * 500
    (s, e), = pii.windows(text)
    assert pii.around(text, s, e) == ("x", "yy") and e - s <= 2 * pii.WIDEST + pii.WINDOW + 1


def test_pii_training_windows_come_from_the_whole_text(spark):
    import pyarrow as pa
    text = " ".join(f"item number{i} is user{i}@host.example.com and so on and so forth for a while until it ends here" for i in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["key", "_text"])
    (got,) = pii._training_windows(8)(iter([batch]))
    at = [text.index(t) for t in got.column(0).to_pylist() if t in text]
    assert len(at) == 8 and max(at) > len(text) // 2


def held_out_spans(texts, weights, certain=0.9, seed=3):
    """Per kind: spans of the texts respelled, of them found exactly; and decoded spans that touch no span at all (false ones)."""
    rng = np.random.default_rng(seed)
    asked, hit, false = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        spans = pii.base_spans(t)
        new = pii.respelled(t, spans, rng)
        if new is None:
            continue
        words, marks = new
        fixed = pii.base_spans(words)
        gold = {m for m in marks if not any(m[0] < q and p < m[1] for p, q, _ in fixed)}
        got = pii.added_spans(words, fixed, weights, certain)
        for s, e, k in gold:
            asked[pii.KINDS[k]] += 1
            hit[pii.KINDS[k]] += (s, e, k) in got
        for s, e, k in got:
            false[pii.KINDS[k]] += (s, e, k) not in gold
    return asked, hit, false


def _personal_texts(n, seed):
    rng = random.Random(seed)

    def card():
        d = [rng.randrange(10) for _ in range(15)]
        return next(c for c in (" ".join("".join(map(str, [*d, x]))[i:i + 4] for i in range(0, 16, 4)) for x in range(10)) if pii.luhn(c.replace(" ", "")))

    out = []
    for i in range(n):
        w = prose(seed * 1000 + i, 40).split()
        for one in (f"jo{rng.randrange(99)}@mail{rng.randrange(9)}.example.org", ".".join(str(rng.randrange(256)) for _ in range(4)), card(),
                    f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"):
            w.insert(rng.randrange(len(w)), one)
        out.append(" ".join(w))
    return out


def test_pii_added_spans_on_held_out_respellings(spark):
    train = spark.createDataFrame(list(enumerate(_personal_texts(300, 1))), "doc_id long, text string")
    asked, hit, false = held_out_spans(_personal_texts(200, 2), pii.learn(train))
    assert sum(asked.values()) > 100
    assert sum(hit.values()) >= 0.7 * sum(asked.values())              # recall of respelled spans
    assert sum(hit.values()) >= 0.8 * (sum(hit.values()) + sum(false.values()))   # precision


def test_pii_base_patterns_of_numbers_against_plain_rules():
    """Cards and phones against the patterns tried from every start, on random digit soup."""
    import re as r

    rng = random.Random(9)
    for _ in range(400):
        t = "".join(rng.choice("0123456789" * 3 + " --+.()x") for _ in range(rng.randrange(80)))
        cards = [(m.start(), m.end()) for m in r.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := r.sub(r"[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        phones = [(m.start(), m.end()) for m in r.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(r.sub(r"[^0-9]", "", m[0])) <= 15]
        got = pii.base_spans(t)
        assert [(s, e) for s, e, k in got if k == 2] == cards and [(s, e) for s, e, k in got if k == 3] == phones


def test_pii_overlaps_are_found_by_bisection():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 9), 0) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        taken, held = pii.Taken(spans), list(spans)
        for _ in range(20):
            s = rng.randrange(70)
            e = s + rng.randrange(1, 9)
            free = not any(s < q and p < e for p, q, _ in held)
            assert taken.free(s, e) == free
            if free:
                taken.take(s, e)
                held.append((s, e, 0))


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 24))
    vecs = [(b + rng.standard_normal(24) * s).tolist() for b in base for s in (0, 0.02, 0.05, 0.2, 2)] + [base[0].tolist()] * 4
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, vecs[0], None), (905, [1.0, None], 0),
             (0, vecs[0], 0), (None, vecs[0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in EXTRA if c != "label"})
    for block in (4096, 5):
        got = embeddings.link_vectors(frame, threshold=0.93, block=block).collect()
        ok = [(k, np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
        want, par = collections.Counter(), list(range(len(ok)))

        def find(x, par=par):
            while par[x] != x:
                x = par[x]
            return x

        links = [0] * len(ok)
        for i in range(len(ok)):
            for j in range(i):
                if ok[i][2] == ok[j][2] and ok[i][1] @ ok[j][1] >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    par[max(a, b)] = min(a, b)
        low = {}
        for i, (k, *_) in enumerate(ok):
            if k is not None:
                low[find(i)] = min(low.get(find(i), k), k)
        for i, (k, *_) in enumerate(ok):
            want[k, links[i], low[find(i)], k == low[find(i)]] += 1
        for k, v, lab in rows:
            if not (lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)):
                want[k, 0, k, True] += 1
        assert collections.Counter(map(tuple, got)) == want
    assert embeddings.link_vectors(frame.limit(0)).collect() == []


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)) * 2
    at = embeddings.e8_decode(x)
    assert np.allclose(at.sum(1) % 2, 0) and (np.allclose(at * 2, np.rint(at * 2)))
    near = np.linalg.norm(x[:, None] - (at[:, None] + embeddings.e8_roots()[None]), axis=2).min(1)
    assert (np.linalg.norm(x - at, axis=1) <= near + 1e-9).all()


PAGE = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><ul><li>Home</li></ul></nav>{}<footer>&copy; me</footer></body></html>"


def test_pages(spark):
    art = "<article><h1>Title &amp; more</h1><p>First  <b>one</b>.<br>two<p>Second &eacute;.</p></article>"
    soup = "<div>Shared banner line</div><div>Own text {0}.</div><div class='comments'>bad</div><div>Shared foot line</div><form>f</form>"
    rows = [(1, "http://a.org/x/1", PAGE.format(art)), (2, "http://b.org/y/1", PAGE.format(soup.format(1))), (3, "http://b.org/y/2", PAGE.format(soup.format(2))),
            (4, None, None), (5, "http://[bad", ""), (6, "http://c.org/", "<p>cut of"), (7, "http://c.org/", "<p>cut of"), (None, "http://d.org", "plain &lt;text"),
            (8, "http://e.org/1", "<article><p>" + "word " * 50_000 + "</p></article>"), (9, "http://e.org/2", "<main><p>a</p><!-- c --><aside>b</aside></main> tail <")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in [*EXTRA, "host", "path", "page", "text"]})
    got = {r["page_id"]: r["text"] for r in extract.extract(frame, parts=1).collect()}
    assert got == {1: "Title & more\nFirst one. two\nSecond é.", 2: "Own text 1.", 3: "Own text 2.", 4: "", 5: "", 6: "cut of", 7: "cut of",
                   None: "plain <text", 8: ("word " * 50_000).strip(), 9: "a"}
    assert extract.extract(frame.limit(0)).collect() == []


def test_pages_meet_across_ranges(spark):
    """Neighbours in other ranges, past empty pages, copies and empty ranges, give the same text as one range."""
    soup = "<div>Shared banner line</div><div>Own text {0}.</div><div>More of {0}.</div><div>Last of {0}.</div><div>Shared foot line</div>"
    rows = [(i, f"http://b.org/y/{i}", PAGE.format(soup.format(i))) for i in range(2)]
    rows += [(10 + i, f"http://c.org/{i:02}", PAGE.format(soup.format(7 if 2 <= i < 9 else i)) if i != 5 else None) for i in range(12)]
    rows += [(30, "http://d.org/1", PAGE.format(soup.format(30)))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r["page_id"]: r["text"] for r in extract.extract(frame, parts=n).collect()} for n in (1, 60))
    assert many == one
    assert {k: one[k] for k in (0, 1)} == {k: f"Own text {k}.\nMore of {k}.\nLast of {k}." for k in (0, 1)}
    assert one[14] == "Own text 7.\nMore of 7.\nLast of 7." and one[15] == "" and "Shared foot line" in one[30]


def test_pages_with_much_furniture_copies_and_empty_neighbours(spark):
    menu = "".join(f"<div>Menu entry {i}</div>" for i in range(20))
    soup = "<html><body>" + menu + "<div>Own text {0}.</div><div>More of {0}.</div><div>Last of {0}.</div></body></html>"
    rows = [(i, f"http://b.org/y/{i}", soup.format(i)) for i in range(3)]
    rows += [(10 + i, f"http://c.org/{i}", soup.format(5 if i < 4 else 6)) for i in range(5)]  # four copies and another page
    rows += [(20, "http://d.org/a/1", soup.format(20)), (21, "http://d.org/a/2", ""), (22, "http://d.org/b", soup.format(22))]
    rows += [(30, "http://e.org/a/1", soup.format(30)), (31, "http://e.org/a/2", "<div>Nothing alike.</div>"), (29, "http://e.org/0", soup.format(29))]
    # near copies: what the page of its own shares with one of them stays, for another page tells the menu
    rows += [(40, "http://f.org/a", soup.format(40)), (41, "http://f.org/b", soup.format(41)), (42, "http://f.org/c", soup.format(41).replace("Last", "End"))]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = {i: i for i in (0, 1, 2, 20, 22, 30, 29, 41)} | {10: 5, 11: 5, 12: 5, 13: 5, 14: 6}
    assert {k: got[k] for k in own} == {k: f"Own text {n}.\nMore of {n}.\nLast of {n}." for k, n in own.items()}
    assert got[21] == "" and got[31] == "Nothing alike."


@pytest.mark.parametrize(("page", "want"), [
    ('<body style="overflow-x:hidden"><p>Some text.</p></body>', ["Some text."]),
    ('<html class="overflow-hidden"><body class=hidden><div class="overflow-hidden">Some text.</div></body></html>', ["Some text."]),
    ('<p>See <a href="/hidden-gems" title="display:none">these gems</a>.</p>', ["See these gems."]),
    ('<p hidden>a</p><p aria-hidden="true">b</p><p style="color:red; DISPLAY : none">c</p><p HIDDEN="">d</p><p aria-hidden=false>e</p>', ["e"]),
    ('<div class="container has-sidebar"><p>lead</p><article><p>Text.</p><div class="ads">s</div></article></div>', ["Text."]),
    ('<article><p>Text.</p></article><div class="related"><article>Other</article></div><div id="comments"><article>Me too</article></div>', ["Text."]),
    ('<div class="post comments-open"><article>Text.</article></div>', ["Text."]),
    ('<article class="post has-comments">Text.<article class="comment">Me too</article></article><article id="div-comment-7">x</article>', ["Text."]),
    ('<div hidden><main>x</main></div><nav class="menu"><article>y</article></nav>z', ["z"]),
    ("5 < 6 and more", ["5 < 6 and more"]), ("<p>a</p>1 < 2 <- 3", ["a", "1 < 2 <- 3"]), ("<p>a</p>rest <b class='x", ["a", "rest"]),
])
def test_page_attributes_and_literal_signs(page, want):
    assert [t for t, *_ in extract.lines_of(page)] == want


@pytest.mark.parametrize(("inner", "kept"), [
    ('<div class="search-results">Found.</div>', True), ('<div class="notice-of-motion">Moved.</div>', True), ('<section id="related-work">Others.</section>', True),
    ('<div class="content side">Next.</div>', True), ('<section class="reply">Answer.</section>', True), ('<div class="footer-height-calc">x</div>', True),
    ('<math><mi>x</mi><mo>=</mo><mn>1</mn></math>', True), ('<div class="comments"><p>Me too</p></div>', False), ('<div class="ad">Buy</div>', False),
    ('<ul class="comment-list"><li>Me too</ul>', False), ('<aside>More</aside>', False), ('<form>Send</form>', False), ('<div hidden>x</div>', False)])
def test_blocks_inside_articles(inner, kept):
    """A furniture word marks a block inside an article for differencing only; adverts, comments and furniture elements go."""
    for tag in ("main", "article"):
        lines = extract.lines_of(f"<body><{tag}><h1>Head</h1>{inner}<p>Tail</p></{tag}></body>")
        assert [t for t, _ in lines[:1]] == ["Head"] and lines[-1] == ("Tail", extract.INSIDE)
        assert (len(lines) == 3) == kept
        assert (extract.main_text(lines, []).count("\n") == 2) == kept


def test_marked_blocks_inside_articles_go_if_neighbours_share_them(spark):
    art = '<article><h1>Title {0}</h1><p>Same words.</p><div class="share-box">Share this</div><div class="related-work">Work {0}</div></article>'
    frame = spark.createDataFrame([(i, f"http://b.org/{i}", art.format(i)) for i in range(3)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract.extract(frame).collect()} == {i: f"Title {i}\nSame words.\nWork {i}" for i in range(3)}


def test_broken_and_long_pages_take_linear_time():
    import time

    def took(page):
        t = time.time()
        extract.lines_of(page)
        return time.time() - t

    for page in ("<div>" * 40_000 + "x" + "</div></span>" * 40_000, "<b>" * 40_000 + "<p>x" * 40_000, "<div class=ad><article>x" * 20_000,
                 "<p><i>x</b>" * 40_000):
        assert took(page) < 5
    rng = random.Random(1)
    a, b = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(3000)] for _ in range(2)]
    whole = extract.shared(a, b)
    extract.TABLE_BITS, old = 1 << 12, extract.TABLE_BITS
    try:
        halved = extract.shared(a, b)
    finally:
        extract.TABLE_BITS = old
    assert len(halved) == len(whole)
    it = iter(b)
    assert all(a[i] in it for i in sorted(halved))


def test_articles_keep_lines_that_neighbours_share(spark):
    art = "<div>Menu</div><article><h1>Title {0}</h1><ul><li>2 eggs</li></ul><table><tr><th>Size<td>12<td>Yes</table><pre>x = 1</pre><div>O wind</div></article>"
    frame = spark.createDataFrame([(i, f"http://b.org/{i}", art.format(i)) for i in range(3)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract.extract(frame).collect()} == {
        i: f"Title {i}\n2 eggs\nSize\n12\nYes\nx = 1\nO wind" for i in range(3)}


def test_longest_common_subsequence_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(60):
        a, b = [[rng.choice("abcdef") for _ in range(rng.randrange(14))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = sorted(extract.shared(a, b))
        assert len(got) == t[len(a)][len(b)]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_pipeline_with_clashing_names_and_empty_tables(spark, tmp_path, odd):
    """Documents that carry the helper columns' names keep them; an empty table gives no rows."""
    clash = ["_key", "_toxicity", "_mix_copies", "_mix_copy", "_id", "contaminated", "component_id"]
    docs = odd.withColumns({c: F.lit("x") for c in clash})
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("b1", prose(77, 20))], "item_id string, text string")
    for name, frame in (("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*clash).distinct().collect()} == {("x",) * len(clash)}
    assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == out.count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = make_docs(spark, odd_rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, 0), (9, 0), (100, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(8, 400))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 13 not in ids and 14 not in ids  # contaminated
    assert 100 in ids and not ids & set(range(101, 140))  # one copy of each group
    out = queries_pipeline(spark, tmp_path)
    assert {"doc_id", "shard", "slot", "size"} <= set(out.columns) and out.count() > 0


def test_pipeline_keeps_one_row_per_component_whatever_its_id(spark, tmp_path):
    rows = [(None, prose(900 + i, 80), "en", "a") for i in range(4)] + [(None, prose(900, 80), "en", "a"), (None, prose(950, 90), "en", "a")]
    rows += [(3, prose(910, 300), "en", "a"), (5, prose(910, 300), "en", "a"), (5, prose(911, 70), "en", "a"), (5, prose(912, 70), "en", "a")]
    rows += [(6, prose(902, 80), "en", "a"), (9, prose(913, 50), "en", "a"), (9, prose(913, 50), "en", "a")]
    spark.createDataFrame([(1, prose(950, 90))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(spark, rows).repartition(3), str(tmp_path)).checkpoint()
    want = [(None, 900), (None, 901), (None, 903), (None, 950), (3, 910), (5, 911), (5, 912), (6, 902), (9, 913)]
    seed_of = {r[1]: s for s in range(900, 951) for r in [(0, prose(s, {950: 90, 910: 300, 911: 70, 912: 70, 913: 50}.get(s, 80)))]}
    seeds = lambda df: sorted(((r["doc_id"], seed_of[r["text"]]) for r in df.collect()), key=str)
    assert seeds(kept) == sorted(want, key=str)
    clean = corpus_pipeline.drop_contaminated(spark, kept, str(tmp_path)).checkpoint()
    want.remove((None, 950))
    assert seeds(clean) == sorted(want, key=str)
    assert seeds(corpus_pipeline.mix_sources(spark, clean, str(tmp_path))) == sorted(want, key=str)  # one source: each once


def queries_pipeline(spark, path):
    return corpus_pipeline.run(spark, str(path))


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
