"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer
words is one window).  A window is a set of two-word shingles; as the whole window must
occur, the required prefix under the order "rarest shingle in the corpus first" is one
shingle.  Documents emit their shingles, only prefix shingles join, length and position
bounds drop windows that would stick out of the document, and the surviving candidates are
verified word by word.  The join key is a 64-bit hash of the shingle.  Shingle frequencies are counted over all documents; a window with a
shingle that no document has cannot occur and is dropped before the join.

The benchmark side is broadcast only if its measured size is within ``broadcast_bytes``;
beyond it the same join runs as a shuffle of (shingle, document, position).

Null text or an empty text has no words (no hit).  Rows that repeat an id are judged row by
row (by id and text); a null id is kept.  Extra columns are ignored.  Ties between equally
rare shingles go to the smaller shingle, then the smaller offset.  Null item texts have no
window, so such items never occur; the windows of an item with a null id hit words but are not
listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that end a word
BREAKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
BREAK_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def fold(text: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(fold(t), BREAK_RE))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per distinct window: win (array of words), len, items (array of ids)."""
    w = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (
        w.withColumn("s", F.explode(starts))
        .select("item", F.slice("w", F.col("s"), F.lit(window)).alias("win"))
        .groupBy("win").agg(F.collect_set("item").alias("items"))
        .withColumn("len", F.size("win"))
    )


def _emit(docs: DataFrame, single: bool) -> list[DataFrame]:
    """Frames (columns of docs, pos, sh): a 64-bit hash of every two-word shingle, and of every word if ``single``.

    An outer generator and a filter on its position, so that no filter on the word array is
    pushed below (which would split the text once more).  The frames are joined one by one: the word
    array must stay a variable of one code-generated stage, never be copied into the generated rows.
    """
    at = docs.select("*", F.posexplode_outer("words").alias("pos", "_w"))
    pair = F.xxhash64("_w", F.get("words", F.col("pos") + 1))
    out = [at.where(F.col("pos") < F.size("words") - 1).withColumn("sh", pair).drop("_w")]
    if single:
        out.append(at.where("pos IS NOT NULL").withColumn("sh", F.xxhash64("_w")).drop("_w"))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def window_hits(docs: DataFrame, wins: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Occurrences (key columns of ``docs``, start, len, items) of ``wins`` in ``docs`` (keys..., words)."""
    keys = [c for c in docs.columns if c != "words"]
    wins = cut(wins)
    size = wins.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "win")) * 3 + 16 * F.size("items") + 64).alias("b"),
                    F.max(F.when(F.col("len") == 1, 1).otherwise(0)).alias("one")).first()
    small = (size["b"] or 0) * 16 <= broadcast_bytes  # a window has up to 12 shingles
    hint = F.broadcast if small else (lambda d: d)
    single = bool(size["one"])
    offs = wins.withColumn("off", F.explode(F.sequence(F.lit(0), F.greatest(F.col("len") - 2, F.lit(0))))).select(
        "win", "off", F.when(F.col("len") == 1, F.xxhash64(F.get("win", F.lit(0))))
        .otherwise(F.xxhash64(F.get("win", F.col("off")), F.get("win", F.col("off") + 1))).alias("sh"))
    vocab = offs.select("sh").distinct()
    seen = _union([f.select("sh").join(hint(vocab), "sh", "left_semi") for f in _emit(docs.select("words"), single)])
    freq = seen.groupBy("sh").agg(F.count("*").alias("n"))
    freq = cut(freq)
    prefix = (
        offs.join(hint(freq), "sh", "left")
        .groupBy("win").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "sh", "off")).alias("p"))
        .where("least > 0").select("win", F.col("p.sh").alias("sh"), F.col("p.off").alias("off"))
        .join(wins, "win")
    )
    prefix = cut(prefix)
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.slice("words", start + 1, F.col("len")) == F.col("win")
    if small:
        return _union([f.join(F.broadcast(prefix), "sh").where(inside & same).select(*keys, start.alias("start"), "len", "items")
                       for f in _emit(docs, single)])
    slim = _union([f.drop("words") for f in _emit(docs.withColumn("n", F.size("words")), single)])
    near = slim.join(prefix, "sh").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    near = near.select(*[F.col(k).alias(f"_{k}") for k in keys], "pos", "off", "win", "len", "items")
    on = None
    for k in keys:
        c = near[f"_{k}"].eqNullSafe(docs[k])
        on = c if on is None else on & c
    found = near.join(docs, on).where(same)
    return found.select(*keys, start.alias("start"), "len", "items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 13, hit_share: int = 20,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if it has a
    hit and at least one word in ``hit_share`` is hit.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), words_of(F.col(text_col)).alias("words"))
    wins = item_windows(items, item_id, item_text, window)
    hits = window_hits(base, wins, broadcast_bytes)
    per = hits.groupBy("_id", "_th").agg(
        F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"),
        F.collect_set("items").alias("sets"))
    # union of the spans, in order of their starts
    union = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"])
    per = per.select(
        F.col("_id").alias("_i"), F.col("_th").alias("_t"), union.cast("long").alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten("sets")), lambda i: i.cast("string"))).alias("items"))
    slim = base.select("_id", "_th", F.size("words").cast("long").alias("n_words"))
    out = slim.join(per, slim["_id"].eqNullSafe(per["_i"]) & (slim["_th"] == per["_t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        found.alias("items"), ((n_hit > 0) & (n_hit * hit_share >= F.col("n_words"))).alias("contaminated"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
