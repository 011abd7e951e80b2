"""Generic relational building blocks the reference expresses with T-SQL
idioms (JN-*, AG-7, WN-2, WN-4, WN-8, PRJ-4, PRJ-5).

Every join here is an equi-join (theta conditions are turned into an
equi key plus a filter), so Spark can hash-partition it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def in_ranges(df: DataFrame, *, by: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows dealt into ranges of equal depth, in ``(by, order)`` order: column ``__rng`` numbers the ranges, ``__salt``
    is the last order column.

    One range exchange over the key, the order columns, a hash of the row and its number, so a range is a stretch of rows, not of
    values: a hot key, a burst inside one second and rows that tie are split as evenly as any others, and rows that tie stand in the
    order of their hash whatever the partitioning (only rows equal in every column are told apart by number).  There are as
    many ranges as shuffle partitions.  The dealt rows are checkpointed: what is computed from a range's rows and from
    its summary sees the same ranges, and the input is evaluated for the exchange only."""
    ensure_checkpoint_dir(df.sparkSession)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = [c for c, t in df.dtypes if "map<" not in t]
    salted = df.withColumn("__salt", F.struct(F.xxhash64(*content).alias("row"), F.monotonically_increasing_id().alias("number")))
    dealt = salted.repartitionByRange(n, *by, *order, "__salt")
    return dealt.withColumn("__rng", F.spark_partition_id()).checkpoint()


def _attach(rows: DataFrame, summary: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` of the summary row of each row's ``(by, __rng)``; null keys meet null keys."""
    s = summary.select(F.col("__rng").alias("__s_rng"), *[F.col(c).alias(f"__s_{c}") for c in by], *cols)
    on = F.col("__rng") == F.col("__s_rng")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return rows.join(s, on, "left").drop("__s_rng", *[f"__s_{c}" for c in by])


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_ts: str, right_ts: str,
              right_cols: Sequence[str], strict: bool = True, bucket: str | int | None = "ranges") -> DataFrame:
    """JN-8: for each left row the latest right row of the same ``by`` key with
    ``right_ts`` before (``strict``) or at ``left_ts`` -- the ``CROSS APPLY
    (TOP 1 ... ORDER BY ts DESC)`` pattern.  Both sides are unioned and one
    window per key carries the last right row forward (``last`` ignoring
    nulls); no pairs are formed.  The windows run over ranges of equal depth (``bucket``: see :func:`carry_last`)."""
    b = list(by)
    rc = list(right_cols)
    lcols = [c for c in left.columns if c not in b]
    ltype = left.select(F.struct(*lcols)).schema[0].dataType
    # at equal times a right row sorts after (strict) or before the left row
    l_ = left.select(*b, F.col(left_ts).alias("__t"), F.lit(0 if strict else 1).alias("__o"),
                     F.struct(*lcols).alias("__l"),
                     *[F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in rc])
    r_ = right.select(*b, F.col(right_ts).alias("__t"), F.lit(1 if strict else 0).alias("__o"),
                      F.lit(None).cast(ltype).alias("__l"), *[F.col(c).alias(f"__r_{c}") for c in rc])
    u = l_.unionByName(r_).withColumn("__rv", F.when(F.col("__l").isNull(), F.struct(*[F.col(f"__r_{c}").alias(c)
                                                                                      for c in rc])))
    u = carry_last(u, by=b, ts="__t", tie=["__o"], value="__rv", out="__carried", exclusive=True, bucket=bucket)
    out = u.filter(F.col("__l").isNotNull())
    return out.select(*b, "__l.*", *[F.col(f"__carried.{c}").alias(c) for c in rc])


def bucketed_lag(df: DataFrame, *, by: Sequence[str], ts: str, tie: Sequence[str] = (), cols: Sequence[str] = (),
                 bucket: str | None = "day", prefix: str = "prev_") -> DataFrame:
    """``lag`` of ``ts`` and ``cols`` over ``(ts, tie)`` order within ``by``
    (columns ``prev_<name>``), without one task per key: the window runs per
    ``(by, time bucket)`` and the first row of a bucket takes the last row of
    the previous non-empty bucket (``lag`` over the small per-bucket summary,
    attached by an equi-join)."""
    b = list(by)
    names = [ts, *cols]
    order = [F.col(ts), *[F.col(t) for t in tie]]
    if bucket is None:
        w = Window.partitionBy(*b).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in names])
    x = df.withColumn("__bk", F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*b, "__bk").orderBy(*order)
    x = x.select("*", *[F.lag(c).over(w).alias(f"__lag_{c}") for c in names])
    last = df.withColumn("__bk", F.date_trunc(bucket, F.col(ts))).groupBy(*b, "__bk").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in names]), F.struct(*order)).alias("__last"))
    wb = Window.partitionBy(*b).orderBy("__bk")
    prev = last.select(*b, "__bk", F.lag("__last").over(wb).alias("__pl"))
    j = x.join(prev, [*b, "__bk"], "left")
    first = F.col(f"__lag_{ts}").isNull()
    return j.select(*df.columns, *[F.when(first, F.col(f"__pl.{c}")).otherwise(F.col(f"__lag_{c}"))
                                   .alias(f"{prefix}{c}") for c in names])


def carry_last(df: DataFrame, *, by: Sequence[str], ts: str, tie: Sequence[str], value: str, out: str,
               exclusive: bool = False, bucket: str | int | None = "day") -> DataFrame:
    """Last non-null ``value`` in ``(ts, tie)`` order within ``by``, up to the
    current row (or strictly before it with ``exclusive``) -- ``LAST(...
    IGNORE NULLS)`` over a running frame.

    ``bucket``: ``"ranges"`` (or their number) deals the rows into ranges of equal depth
    (:func:`in_ranges`), a time unit into calendar buckets, None keeps a key in one window.  The window then
    runs per ``(by, range)``, so a hot key (a third of all rows) is spread over its ranges; rows with
    nothing earlier in their range take the value carried out of the previous ranges, computed on the small
    per-(key, range) summary and attached by an equi-join."""
    b = list(by)
    order = [F.col(ts), *[F.col(t) for t in tie]]
    frame_end = -1 if exclusive else Window.currentRow
    if bucket is None:
        w = Window.partitionBy(*b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    if isinstance(bucket, int) or bucket == "ranges":
        x = in_ranges(df, by=b, order=[ts, *tie], ranges=bucket if isinstance(bucket, int) else None)
        order.append(F.col("__salt"))
    else:
        x = df.withColumn("__rng", F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*b, "__rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    # every (key, range) present gets a row, so ranges without a value inherit below
    summ = x.groupBy(*b, "__rng").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__range_last"))
    wb = Window.partitionBy(*b).orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*b, "__rng", F.last("__range_last", ignorenulls=True).over(wb).alias("__before"))
    x = x.withColumn("__local", F.last(value, ignorenulls=True).over(w))
    j = _attach(x, summ, b, ["__before"])
    return j.withColumn(out, F.coalesce(F.col("__local"), F.col("__before"))).drop("__rng", "__salt", "__local", "__before")


def dyadic_cover(first: Column, past: Column) -> Column:
    """The numbers ``first`` (included) to ``past`` (excluded) as an array of (level, node): node ``k`` of level ``l`` holds the
    ``2**l`` numbers from ``k * 2**l`` on.  At most two nodes a level."""
    def at(lev: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), lev)
        lo = F.call_function("shiftright", first + one - 1, lev)
        hi = F.call_function("shiftright", past, lev)
        node = F.struct(lev.alias("level"), lo.alias("node"))
        low = F.when((lo % 2 != 0) & (lo < hi), node)
        high = F.when((hi % 2 != 0) & (lo + F.abs(lo % 2) < hi), F.struct(lev.alias("level"), (hi - 1).alias("node")))
        return F.array(low, high)

    # no node is larger than the interval (one level more, as logarithms are rounded)
    top = F.floor(F.log2(F.greatest(past - first, F.lit(1)).cast("double"))).cast("int") + 1
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda x: x.isNotNull())


def range_join(points: DataFrame, intervals: DataFrame, *, by: Sequence[str], point: str, start: str, end: str,
               unit_seconds: int = 3600) -> DataFrame:
    """JN-9: points inside ``[start, end)`` of an interval with the same ``by`` key.

    Time is cut into units; an interval becomes the dyadic nodes that cover its units (at most two a level: 34 rows
    for ten years of hours), a point its ancestors on those levels that some interval uses.  The join is an equi-join on
    ``(by, level, node)`` plus the exact range filter.  Every point meets an interval in one node at most."""
    b = list(by)

    def unit(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(unit_seconds)).cast("long")

    iv = intervals.filter(F.col(start) < F.col(end)).withColumn(
        "__n", F.explode(dyadic_cover(unit(F.col(start)), unit(F.col(end)) + 1)))
    # the levels in use: at most 62 numbers
    used = sorted(r[0] for r in iv.select("__n.level").distinct().collect())
    pt = points.withColumn("__n", F.explode(F.array(*[F.struct(
        F.lit(lev).alias("level"), F.shiftright(unit(F.col(point)), lev).alias("node")) for lev in used] or [
            F.lit(None).cast("struct<level:int,node:bigint>")])))
    j = pt.join(iv, [*b, "__n"]).filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    return j.drop("__n")


def dynamic_pivot(df: DataFrame, *, keys: Sequence[str], pivot: str, value: Column) -> DataFrame:
    """AG-7: pivot with the column list read from the data: a distinct pass of
    the pivot column gives the output schema (one name per value), then
    ``pivot(values)``."""
    vals = [r[0] for r in df.select(pivot).distinct().orderBy(pivot).collect()]
    return df.groupBy(*keys).pivot(pivot, vals).agg(value)


def global_rank(df: DataFrame, *, metric: str, value: str, n: int, descending: bool = True) -> DataFrame:
    """WN-2: rows of rank ``n`` or better by ``value`` over the whole table, ties at the cut included.

    The best ``n`` rows hold every value of rank ``n`` or better, so they alone are ranked (a top-k, then a window over
    ``n`` rows) and their distinct values, ``n`` at most, are sent to the rows: rows that tie never meet in one task."""
    def sort(c: str) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc()]

    top = df.select(F.col(value).alias("__v")).orderBy(*sort("__v")).limit(n)
    ranks = top.withColumn(f"{metric}_rank", F.rank().over(Window.orderBy(*sort("__v"))).cast("long")).distinct()
    return df.join(F.broadcast(ranks), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def row_number_in_key(df: DataFrame, *, by: Sequence[str], order: str, tie: Sequence[str] = (),
                      ranges: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY by ORDER BY order, tie)`` and the key's row count (``__rn``, ``__n``),
    without sorting a hot key in one task: rows are numbered inside ranges of equal depth (:func:`in_ranges`) and
    offset by the row counts of the lower ranges (a running sum over the small per-range counts)."""
    b = list(by)
    x = in_ranges(df, by=b, order=[order, *tie], ranges=ranges)
    w = Window.partitionBy(*b, "__rng").orderBy(F.col(order), *[F.col(t) for t in tie], F.col("__salt"))
    key = Window.partitionBy(*b)
    per = x.groupBy(*b, "__rng").agg(F.count(F.lit(1)).alias("__c")).select(
        *b, "__rng", F.coalesce(F.sum("__c").over(key.orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__c").over(key).alias("__n"))
    j = _attach(x.withColumn("__local", F.row_number().over(w)), per, b, ["__off", "__n"])
    return j.withColumn("__rn", (F.col("__off") + F.col("__local")).cast("long")).drop("__rng", "__salt", "__local", "__off")


def middle_tile_mean(df: DataFrame, *, keys: Sequence[str], value: str, order_tie: str,
                     ranges: int | None = None) -> DataFrame:
    """WN-4: robust mean = average of the middle tile of ``ntile(3)`` per key.

    The tile is derived from the row number and the key's count with
    ``NTILE``'s rule (the first ``n % 3`` tiles get one extra row); the row
    number comes from :func:`row_number_in_key`, so no key is sorted whole in
    one task."""
    r = row_number_in_key(df.select(*keys, value, order_tie), by=keys, order=value, tie=[order_tie],
                          ranges=ranges)
    n, rn = F.col("__n"), F.col("__rn")
    base, rem = F.floor(n / 3), n % 3
    big = rem * (base + 1)
    tile = F.when(rn <= big, F.floor((rn - 1) / (base + 1)) + 1).otherwise(
        rem + F.floor((rn - big - 1) / F.greatest(base, F.lit(1))) + 1)
    t = r.withColumn("__tile", tile)
    return t.filter(F.col("__tile") == 2).groupBy(*keys).agg(F.round(F.avg(value), 4).alias("middle_mean"),
                                                             F.count(F.lit(1)).cast("long").alias("middle_rows"))


def first_last_seen(df: DataFrame, *, key: str, ts: str) -> DataFrame:
    """WN-8: first and last time each key was seen, kept on every row.

    ``MIN/MAX OVER (PARTITION BY key)`` would buffer a hot key's rows in one
    task; a partially aggregated ``groupBy`` joined back on the key (one row
    per key, AQE broadcasts or splits a skewed side) gives the same result."""
    g = df.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return df.join(g, df[key].eqNullSafe(g[key]), "left").drop(g[key])


def optional_filters(df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """PRJ-4: ``col = @p OR @p IS NULL`` -- only the non-null parameters
    become predicates, so they are pushed into the scan."""
    out = df
    for col, v in params.items():
        if v is not None:
            out = out.filter(F.col(col).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(col) == F.lit(v))
    return out


def exclude_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """PRJ-5: anti-list of benign values.  A literal list is a
    ``NOT IN`` predicate (no join at all)."""
    return df.filter(~F.col(col).isin(list(values)))


def hinted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                strategy: str = "shuffle_hash") -> DataFrame:
    """JN-3: forced join strategy via a hint (normally left to AQE)."""
    return left.join(right.hint(strategy), list(on), how)
