"""Corpus pipeline: toxicity, SimHash near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  Stages are written as Parquet and read again by the next one; the stages' folders are
removed when the application ends.

Null texts and empty texts pass as documents without words.  Rows that repeat id and text stand once from the near-copy stage on.
Rows with a null id are told apart by their text.  Helper columns take names that the documents do not have, so extra columns
of any name pass through.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontaminate, mixing, sharding, simhash, toxicity
from fleetscope.llm.common import table
from fleetscope.session import scratch_path


def spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; trained on the labels of the documents given."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = spare(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def row_key(docs: DataFrame) -> Column:
    """Digest of id and text: tells rows with a null id, or different texts under one id, apart; rows that repeat both share it."""
    who = F.when(F.col("doc_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("doc_id").cast("string")))
    return F.unhex(F.md5(F.concat(who, F.lit("\n"), F.coalesce("text", F.lit("")))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per SimHash component: the smallest id (a null id only if there is no other), then the smallest key."""
    key = spare(docs, "_key")
    keyed = docs.withColumn(key, row_key(docs))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    found = simhash.near_duplicates(keyed.select(who.alias("_who"), "text"), id_col="_who", shingle=3, max_bits=2)
    keep = found.select(F.col("component_id.key").alias(key)).distinct()
    return keyed.dropDuplicates([key]).join(keep, key, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window contaminates."""
    key = spare(docs, "_key")
    keyed = docs.withColumn(key, row_key(docs))
    found = decontaminate.decontaminate(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    bad = found.where("contaminated").select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes; no two rows repeat id and text, the near-copy stage sees to that."""
    key, copies, copy = spare(docs, "_key"), spare(docs, "_mix_copies"), spare(docs, "_mix_copy")
    keyed = docs.withColumn(key, row_key(docs))
    plan = mixing.mix(keyed.select(key, "text", "source"), mixing.word_count(F.col("text")), id_col=key, max_repeat=3).where("copies > 0").select(
        key, F.col("copies").alias(copies))
    out = keyed.join(plan, key)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard places of all documents."""
    return sharding.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: the stages learn, draw and search iteratively; tests check them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a Parquet table in the shared folder."""
    base = scratch_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
