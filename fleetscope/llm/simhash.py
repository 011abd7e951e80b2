"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of every word shingle, repeats included; bit i is set if more
than half of the hashes have it.  Fingerprints link at ``max_bits`` or fewer differing bits.

Covering: give every bit position a code word a(i) of ``max_bits + 1`` bits; for each of the
``2**(max_bits+1) - 1`` non-zero vectors v the mask keeps the positions whose code word has
odd inner product with v.  For any ``max_bits`` differing positions some v is orthogonal to all
their code words, so that pair agrees on the whole mask: no pair is missed.  A bucket that is
too large is covered again over the positions that its mask left out (the differing bits lie
there), which keeps the guarantee and halves the open positions at each level; so no bucket has
to be compared pair by pair beyond ``bucket_cap`` fingerprints, and none is cut.

Equal fingerprints are collapsed before the search.  Texts without words have fingerprint
zero and link like any other.  Null text counts as empty.  Rows that repeat an id each get a row.
A null id is kept and takes the component of its fingerprint (smallest non-null id; null if the
whole component has none).  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import components, cut, local_roots

SEED = 42
UP, LO = bytes(range(65, 91)), bytes(range(97, 123))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8", "replace").translate(bytes.maketrans(UP, LO)).split()
    if not words:
        return 0
    buf, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    x, m = xxhash.xxh64_intdigest, n - shingle + 1
    h = np.fromiter((x(buf[s:e], SEED) for s, e in zip(starts[:m].tolist(), ends[shingle - 1:].tolist(), strict=True)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for i in range(0, m, 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > m, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) with fp as a signed long."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["_id", "fp"])

    return src.mapInArrow(run, f"_id {src.schema[0].dataType.simpleString()}, fp long")


def covering_masks(positions: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """(mask as unsigned int, positions it leaves open) for each table over ``positions``."""
    k = radius + 1
    out = []
    for v in range(1, 1 << k):
        kept = [p for i, p in enumerate(positions) if (((i % ((1 << k) - 1)) + 1) & v).bit_count() & 1]
        mask = sum(1 << p for p in kept)
        out.append((mask, [p for p in positions if p not in set(kept)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bucket_edges(radius: int):
    def run(batches):
        for b in batches:
            us, vs = [], []
            for arr in b.column(0):
                f = np.array(arr.as_py(), np.int64)
                n = len(f)
                ai, bi = [], []
                for i in range(0, n, 256):
                    d = np.bitwise_count((f[i:i + 256, None] ^ f[None, :]).view(np.uint64))
                    p, q = np.nonzero(d <= radius)
                    keep = p + i < q
                    ai.append(p[keep] + i)
                    bi.append(q[keep])
                root = local_roots(np.concatenate(ai), np.concatenate(bi), n)
                moved = np.nonzero(root != np.arange(n))[0]
                us.append(f[moved])
                vs.append(f[root[moved]])
            u = np.concatenate(us) if us else np.zeros(0, np.int64)
            v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int, bucket_cap: int = 2048) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints ``fps`` (fp): same components as all pairs within ``radius``."""
    work = fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("key"))
    opened: dict[str, list[int]] = {"": list(range(64))}
    edges = None
    while True:
        # cover the open positions of every path: one key per table
        entries = []
        new_open: dict[str, list[int]] = {}
        for path, pos in opened.items():
            for t, (mask, left) in enumerate(covering_masks(pos, radius)):
                name = f"{path}/{t}"
                new_open[name] = left
                entries.append(F.when(F.col("path") == path, F.struct(
                    F.lit(name).alias("path"), F.xxhash64(F.col("key"), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("key"))))
        keyed = work.select("fp", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("t")).select(
            "fp", "t.path", "t.key")
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = cut(keyed.join(sizes, ["path", "key"]))
        few = shared.where(F.col("n") <= bucket_cap).groupBy("path", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        got = few.select("fps").mapInArrow(_bucket_edges(radius), "u long, v long")
        edges = got if edges is None else edges.unionByName(got)
        big = shared.where(F.col("n") > bucket_cap)
        paths = [r["path"] for r in big.select("path").distinct().collect()]  # at most 7 per level and path
        if not paths:
            return edges
        # with few positions left open a bucket holds few distinct fingerprints, so this ends
        opened = {p: new_open[p] for p in paths}
        work = big.select("fp", "path", "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, bucket_cap: int = 2048) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = cut(rows.groupBy("fp").agg(F.min("_id").alias("low")))
    comp = components(links(reps.select("fp"), max_bits, bucket_cap))
    top = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = top.groupBy("root").agg(F.min("low").alias("component_id"))
    of = top.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(of, F.col("fp") == F.col("_fp"))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_query(spark, sf_dir: str) -> DataFrame:
    from fleetscope.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
