"""Data quality and table comparison (DQ-1 ... DQ-7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_profile(df: DataFrame, *, table: str) -> DataFrame:
    """DQ-1: rows, non-null and null counts of every column in one pass
    (one aggregate, unpivoted)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"nn__{c}"))
    g = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `nn__{c}`" for c in df.columns)
    u = g.select("__rows", F.expr(f"stack({len(df.columns)}, {stack}) AS (column_name, non_null)"))
    return u.select(F.lit(table).alias("table_name"), "column_name", F.col("__rows").cast("long").alias("rows"),
                    F.col("non_null").cast("long").alias("non_null"),
                    (F.col("__rows") - F.col("non_null")).cast("long").alias("nulls"))


def orphan_counts(child: DataFrame, parent: DataFrame, *, fk: str, pk: str, name: str) -> DataFrame:
    """DQ-2: rows of ``child`` whose foreign key has no parent (left anti
    join + count); the reference only flags the constraint as untrusted."""
    o = child.select(F.col(fk).alias("__k")).join(parent.select(F.col(pk).alias("__k")), "__k", "left_anti")
    return o.agg(F.count(F.lit(1)).cast("long").alias("orphan_rows")).select(F.lit(name).alias("constraint_name"),
                                                                              "orphan_rows")


# Spark type name -> SQL type name used in listings.
SQL_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN",
            "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def column_listing(spark: SparkSession, df: DataFrame, *, table: str) -> DataFrame:
    """DQ-3: column definitions of a table with the number of its non-null
    values: one aggregation pass, turned into one row per column."""
    counts = df.agg(*[F.count(F.col(f.name)).cast("long").alias(f.name) for f in df.schema.fields])
    rows = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal_position"),
                 F.lit(SQL_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString().upper())).alias("data_type"),
                 F.lit("YES" if f.nullable else "NO").alias("is_nullable"), F.col(f.name).alias("non_null_rows"))
        for i, f in enumerate(df.schema.fields)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def orphaned_files(files: DataFrame, databases: DataFrame, *, key: Sequence[str] = ("server_name", "database_id")) -> DataFrame:
    """DQ-4: file rows whose database no longer exists (left anti join)."""
    return files.join(databases.select(*key), list(key), "left_anti")


def index_size_estimate(indexes: DataFrame, *, default_width: int = 8) -> DataFrame:
    """DQ-5: index size estimate = rows x (key width + row overhead) from the
    real row count (the reference counts one dummy row)."""
    width = F.aggregate(F.transform("keys", lambda k: F.length(k) + F.lit(default_width)), F.lit(0),
                        lambda a, x: a + x)
    return indexes.select("table_name", "index_name", "row_count", width.cast("long").alias("key_bytes"),
                          F.round(F.col("row_count") * (width + 11) / 1048576.0, 4).alias("estimated_mb"))


def compare_tables(left: DataFrame, right: DataFrame, *, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """DQ-6: rows missing on either side or changed, by key.  Each side is
    reduced to ``key + xxhash64(columns)`` before the full outer join, so the
    shuffle carries one hash per row instead of the whole row.  The hash skips
    NULLs, so every column goes in with a NULL marker before it; keys compare null-safe."""
    k = list(key)
    cols = list(columns) if columns else [c for c in left.columns if c not in k]
    marked = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    lh = left.select(*k, F.xxhash64(*marked).alias("__lh"))
    rh = right.select(*[F.col(c).alias(f"__r_{c}") for c in k], F.xxhash64(*marked).alias("__rh"))
    on = None
    for c in k:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        on = same if on is None else on & same
    j = lh.join(rh, on, "full_outer").select(*[F.when(F.col("__lh").isNull(), F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c) for c in k],
                                             "__lh", "__rh")
    status = (F.when(F.col("__rh").isNull(), "missing_in_right").when(F.col("__lh").isNull(), "missing_in_left")
              .when(F.col("__lh") != F.col("__rh"), "changed"))
    return j.select(*k, status.alias("status")).filter(F.col("status").isNotNull())


def range_digests(df: DataFrame, *, key: Sequence[str], columns: Sequence[str], ranges: int = 4096) -> DataFrame:
    """DQ-6: one digest per range of the hashed key: row count and two order-free combinations (exclusive or, sum) of row hashes.
    Digests are small enough to be stored and compared with later or remote ones."""
    marked = [x for c in [*key, *columns] for x in (F.col(c).isNull(), F.col(c))]
    return df.select(_key_range(key, ranges).alias("key_range"), F.xxhash64(*marked).alias("h")).groupBy("key_range").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))


def _key_range(key: Sequence[str], ranges: int):
    return F.pmod(F.xxhash64(F.lit(6), *[x for c in key for x in (F.col(c).isNull(), F.col(c))]), F.lit(ranges))


def compare_by_digest(left: DataFrame, right: DataFrame, *, key: Sequence[str], columns: Sequence[str] | None = None,
                      ranges: int = 4096) -> DataFrame:
    """DQ-6 for large tables that differ in few rows: digests per key range first (a map-side aggregate, at most ``ranges`` rows are
    shuffled a task), then only the rows of ranges whose digests differ are shuffled and compared
    (:func:`compare_tables`).  The list of such ranges has at most ``ranges`` rows and is broadcast."""
    cols = list(columns) if columns else [c for c in left.columns if c not in key]
    a, b = (range_digests(df, key=key, columns=cols, ranges=ranges) for df in (left, right))
    b = b.select(F.col("key_range").alias("r"), F.struct("rows", "mixed", "total").alias("theirs"))
    differ = a.select("key_range", F.struct("rows", "mixed", "total").alias("ours")).join(b, F.col("key_range") == F.col("r"), "full_outer").filter(
        ~F.col("ours").eqNullSafe(F.col("theirs"))).select(F.coalesce("key_range", "r").alias("__range"))

    def suspects(df: DataFrame) -> DataFrame:
        return df.withColumn("__range", _key_range(key, ranges)).join(F.broadcast(differ), "__range", "left_semi").drop("__range")

    return compare_tables(suspects(left), suspects(right), key=key, columns=cols)


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """DQ-7 / ST-4: per table rows, columns and string bytes, unioned."""
    out = None
    for name, df in tables.items():
        strs = [c for c, t in df.dtypes if t == "string"]
        nbytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strs), F.lit(0)) if strs else F.lit(0)
        part = df.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.sum(nbytes).cast("long").alias("string_bytes"))
        part = part.select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
                           F.coalesce("string_bytes", F.lit(0)).cast("long").alias("string_bytes"))
        out = part if out is None else out.unionByName(part)
    return out


def object_counts(objects: DataFrame, *, group: Sequence[str] = ("database_name",), type_col: str = "object_type") -> DataFrame:
    """DQ-7: objects per database and type, with the total of the database beside them."""
    n = objects.groupBy(*group, type_col).agg(F.count(F.lit(1)).cast("long").alias("objects"))
    total = n.groupBy(*group).agg(F.sum("objects").cast("long").alias("total_objects"))
    return n.join(total, list(group))


def deprecated_references(texts: DataFrame, patterns: Sequence[str], *, text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """DQ-7: rows whose text mentions each deprecated feature (a plain
    substring), counted in one pass over the texts and turned into rows."""
    g = texts.groupBy(*group).agg(*[F.count_if(F.contains(F.col(text), F.lit(p))).cast("long").alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("feature"), F.col(f"p{i}").alias("reference_count")) for i, p in enumerate(patterns)])
    return g.select(*group, F.explode(rows).alias("r")).select(*group, "r.*").filter(F.col("reference_count") > 0)


def objects_exist(requests: DataFrame, objects: DataFrame, *, name: str = "object_name",
                  type_col: str = "object_type") -> DataFrame:
    """§2.17 ``check_object_exists``: each requested ``(name, type)`` with an
    ``exists`` flag; a NULL requested type matches any type (two equi
    semi-joins, no OR join)."""
    typed = requests.filter(F.col(type_col).isNotNull())
    untyped = requests.filter(F.col(type_col).isNull())
    obj = objects.select(name, type_col).distinct()
    a = typed.join(obj.withColumn("__hit", F.lit(True)), [name, type_col], "left")
    b = untyped.join(obj.select(name).distinct().withColumn("__hit", F.lit(True)), [name], "left")
    return a.unionByName(b).withColumn("exists", F.coalesce("__hit", F.lit(False))).drop("__hit")


def procedure_info(procedures: DataFrame, parameters: DataFrame, stats: DataFrame) -> DataFrame:
    """§2.17 ``get_stored_proc_info``: procedure, create/modify dates, execution
    count (from the statistics table) and parameter count (left joins on the
    procedure key after aggregating each side)."""
    p = parameters.groupBy("object_id").agg(F.count(F.lit(1)).cast("long").alias("parameter_count"))
    s = stats.groupBy("object_id").agg(F.sum("execution_count").cast("long").alias("execute_count"))
    return procedures.join(p, "object_id", "left").join(s, "object_id", "left").select(
        "object_id", "procedure_name", "create_date", "modify_date", "execute_count",
        F.coalesce("parameter_count", F.lit(0)).cast("long").alias("parameter_count"))
