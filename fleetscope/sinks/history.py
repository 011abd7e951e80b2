"""History tables and report rendering (SNK-1 ... SNK-4).

History is plain parquet partitioned by check date, so retention is a
partition delete (metadata only) and time-window reads prune partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FINDING_COLUMNS


#: partition column that names the writer and batch a row came with
BATCH = "written_by"


def _folders(spark: SparkSession, pattern: str) -> list:
    """(file system, path) of the folders that match ``pattern``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return [(fs, st.getPath()) for st in found or [] if st.isDirectory()]


def append_history(df: DataFrame, path: str, *, partition_by: Sequence[str] = ("check_date",), writer: str | None = None,
                   batch_id: int | None = None) -> None:
    """SNK-1: append rows to a history table partitioned by check date.

    With a ``writer`` and ``batch_id`` the append happens exactly once per (writer, batch): the rows go to partitions
    of that batch's own below the date, and whatever an earlier run of the same batch left -- whole or in part, on the same
    dates or on others -- is removed first.  A batch that a lost driver runs again therefore stands once."""
    if writer is None:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
        return
    if batch_id is None or not writer.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a writer is a name of letters, digits, - and _ and comes with a batch id")
    tag = f"{writer}.{int(batch_id)}"
    for fs, folder in _folders(df.sparkSession, "/".join([path, *["*"] * len(partition_by), f"{BATCH}={tag}"])):
        fs.delete(folder, True)
    df.withColumn(BATCH, F.lit(tag)).write.mode("append").partitionBy(*partition_by, BATCH).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history without the column that names writer and batch."""
    return spark.read.parquet(path).drop(BATCH)


def newest_partition(spark: SparkSession, path: str, partition: str) -> dt.date | None:
    """Newest day partition of a table, from the folder names."""
    days = [p.getName().split("=", 1)[1] for _, p in _folders(spark, f"{path}/{partition}=*")]
    return max((dt.date.fromisoformat(d[:10]) for d in days if d[:1].isdigit()), default=None)


def expire_partitions(spark: SparkSession, path: str, partition: str, newest, keep_days: int) -> list[str]:
    """SNK-2: delete day partitions older than ``keep_days`` before ``newest``
    (Hadoop FileSystem calls on partition folders; no data is rewritten)."""
    cutoff = (newest if isinstance(newest, dt.date) else dt.date.fromisoformat(str(newest))) - dt.timedelta(days=keep_days)
    removed = []
    for fs, folder in _folders(spark, f"{path}/{partition}=*"):
        day = folder.getName().split("=", 1)[1][:10]
        if day[:1].isdigit() and dt.date.fromisoformat(day) < cutoff:
            fs.delete(folder, True)
            removed.append(folder.getName())
    return removed


def retention_filter(df: DataFrame, as_of, keep_days: int, *, ts: str = "check_ts") -> DataFrame:
    """SNK-2 as a read-side filter: rows within ``keep_days`` of ``as_of``."""
    return df.filter(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(F.lit(keep_days)))


def report_lines(findings: DataFrame, *, per: str = "server_name") -> DataFrame:
    """SNK-3: Markdown report lines in finding order, with a priority heading
    where the priority changes against the previous line (``lag``), one
    window per server (no single-task global sort)."""
    order = [F.col("priority"), F.col("findings_group"), F.col("finding"), F.col("database_name"), F.col("details")]
    w = Window.partitionBy(per).orderBy(*order)
    f = findings.select("*", F.lag("priority").over(w).alias("__prev"), F.row_number().over(w).cast("long").alias("line_no"))
    head = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("priority")),
                  F.concat(F.lit("## Priority "), F.col("priority").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit("- **"), F.col("findings_group"), F.lit("** "), F.col("finding"),
                    F.when(F.col("database_name").isNotNull(), F.concat(F.lit(" ("), F.col("database_name"), F.lit(")")))
                    .otherwise(F.lit("")),
                    F.when(F.col("details").isNotNull(), F.concat(F.lit(": "), F.col("details"))).otherwise(F.lit("")))
    return f.select(per, "line_no", F.concat(head, body).alias("markdown"))


def _csv_field(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("")).otherwise(
        F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))


def _xml_text(c: Column) -> Column:
    s = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def render_lines(df: DataFrame, mode: str, *, columns: Sequence[str] | None = None) -> DataFrame:
    """SNK-4: one rendered text line per row for the ``CSV``, ``MARKDOWN``
    or ``XML`` output modes (``TABLE`` returns the rows, ``NONE`` nothing)."""
    cols = list(columns or df.columns)
    mode = mode.upper()
    if mode == "TABLE":
        return df.select(*cols)
    if mode == "NONE":
        return df.select(*cols).limit(0)
    if mode == "CSV":
        line = F.concat_ws(",", *[_csv_field(F.col(c)) for c in cols])
    elif mode == "MARKDOWN":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]),
                        F.lit(" |"))
    elif mode == "XML":
        line = F.concat(F.lit("<row>"), *[F.when(F.col(c).isNull(), F.lit("")).otherwise(
            F.concat(F.lit(f"<{c}>"), _xml_text(F.col(c)), F.lit(f"</{c}>"))) for c in cols], F.lit("</row>"))
    else:
        raise ValueError(f"unknown output mode {mode}")
    return df.select(line.alias("line"))


def write_output(df: DataFrame, mode: str, path: str) -> None:
    """SNK-4 through the DataFrame writer (files, not driver strings)."""
    mode = mode.upper()
    if mode == "NONE":
        return
    fmt = {"TABLE": "parquet", "CSV": "csv", "XML": "xml", "JSON": "json"}[mode]
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", "true")
    if fmt == "xml":
        w = w.option("rowTag", "row").option("rootTag", "rows")
    w.format(fmt).save(path)


FINDINGS_ORDER = FINDING_COLUMNS
