"""Readers for telemetry tables (SRC-1, SRC-5, SRC-6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import split_list


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Read one parquet table ``<root>/<name>.parquet``.

    With an explicit ``schema`` no footer inference pass is needed, which
    matters when a table is thousands of files.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_snapshots(spark: SparkSession, path: str, schema: StructType | None = None, since=None, until=None,
                   ts: str = "check_ts") -> DataFrame:
    """SRC-1: snapshot history, optionally limited to ``[since, until)``.

    The time filter is a plain predicate, so a table partitioned by check
    date is pruned and the rest is pushed into the parquet scan.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    if since is not None:
        df = df.filter(F.col(ts) >= F.lit(since))
    if until is not None:
        df = df.filter(F.col(ts) < F.lit(until))
    return df


def write_bucketed(df: DataFrame, table: str, path: str, *, series: Sequence[str], ts: str = "check_ts", buckets: int = 64,
                   mode: str = "append") -> None:
    """SRC-1: snapshot history as a table at ``path``: day partitions (a time window prunes them), inside them bucketed and sorted by
    series, so that windows over a series need no exchange (read with :func:`read_bucketed`)."""
    day = df.withColumn("check_day", F.to_date(ts))
    (day.repartition(buckets, *series).write.mode(mode).partitionBy("check_day").bucketBy(buckets, *series).sortBy(*series, ts)
        .option("path", path).saveAsTable(table))


def read_bucketed(spark: SparkSession, table: str, since=None, until=None, ts: str = "check_ts") -> DataFrame:
    """SRC-1: the history written by :func:`write_bucketed`, limited to ``[since, until)`` by time and by day partition."""
    df = spark.table(table)
    if since is not None:
        df = df.filter((F.col("check_day") >= F.to_date(F.lit(since))) & (F.col(ts) >= F.lit(since)))
    if until is not None:
        df = df.filter((F.col("check_day") <= F.to_date(F.lit(until))) & (F.col(ts) < F.lit(until)))
    return df


def union_sources(frames: Mapping[str, DataFrame] | Sequence[DataFrame], tag: str = "source") -> DataFrame:
    """SRC-5: run-per-database results unioned by name with an origin tag.

    Missing columns are filled with NULL (``allowMissingColumns``), which is
    also how additive schema migration is absorbed.
    """
    items = list(frames.items()) if isinstance(frames, Mapping) else [(None, f) for f in frames]
    out = None
    for name, df in items:
        if name is not None:
            df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames to union")
    return out


def explode_list(df: DataFrame, col: str, out: str = "item", sep: str = ",", keep_position: bool = True) -> DataFrame:
    """SRC-6: delimited-list column to one row per element (with position)."""
    arr = split_list(col, sep)
    if keep_position:
        return df.select("*", F.posexplode(arr).alias(f"{out}_pos", out)).withColumn(
            f"{out}_pos", (F.col(f"{out}_pos") + 1).cast("long"))
    return df.select("*", F.explode(arr).alias(out))
