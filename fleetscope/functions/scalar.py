"""Column helpers shared by the operators.

All helpers return ``pyspark.sql.Column`` expressions built from built-in
functions, so they stay inside whole-stage codegen; none of them is a
Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(col: ColumnOrName, bands: Sequence[tuple[str, float, str]], default: str | None = None) -> Column:
    """Threshold CASE ladder.

    ``bands`` is an ordered list of ``(op, threshold, label)`` where ``op`` is
    one of ``> >= < <= ==``; the first matching band wins, else ``default``.
    """
    c = _c(col)
    ops = {
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        "==": lambda a, b: a == b,
    }
    expr = None
    for op, thr, label in bands:
        cond = ops[op](c, F.lit(thr))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def decode(col: ColumnOrName, mapping: dict, default: str | None = None) -> Column:
    """Code -> description (small CASE).  Keeps input order of ``mapping``."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        cond = c == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None).cast("string"))


def try_ratio(num: ColumnOrName, den: ColumnOrName, zero_value: float | None = None) -> Column:
    """``num / den`` as double; ``zero_value`` (or NULL) when ``den`` is 0 or NULL."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    r = F.try_divide(n, F.when(d != 0, d))
    if zero_value is None:
        return r
    return F.when((d == 0) | d.isNull(), F.lit(float(zero_value))).otherwise(r)


def datediff_boundary(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    This is the T-SQL ``DATEDIFF`` rule (00:00:59 -> 00:01:01 is one minute),
    unlike Spark's ``timestampdiff`` which counts whole elapsed units.
    """
    unit = unit.lower()
    s, e = _c(start), _c(end)
    if unit in ("second", "minute", "hour", "day"):
        return F.timestamp_diff(unit.upper(), F.date_trunc(unit, s), F.date_trunc(unit, e)).cast("long")
    if unit == "month":
        return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("long")
    if unit == "year":
        return (F.year(e) - F.year(s)).cast("long")
    raise ValueError(f"unsupported unit {unit}")


def format_bytes(col: ColumnOrName) -> Column:
    """Human readable size with 1024-based units, two decimals ("1.00 GB")."""
    b = _c(col).cast("long")

    def unit(div: int, suffix: str) -> Column:
        return F.concat(F.format_string("%.2f", F.round(b.cast("double") / F.lit(float(div)), 2)), F.lit(" " + suffix))

    return (
        F.when(b >= 1024**4, unit(1024**4, "TB"))
        .when(b >= 1024**3, unit(1024**3, "GB"))
        .when(b >= 1024**2, unit(1024**2, "MB"))
        .when(b >= 1024, unit(1024, "KB"))
        .otherwise(F.concat(b.cast("string"), F.lit(" B")))
    )


def ms_to_dhms(col: ColumnOrName) -> Column:
    """Milliseconds -> ``"<d>d <hh>:<mm>:<ss>"`` with exact integer arithmetic."""
    ms = _c(col).cast("long")
    secs = F.floor(ms / 1000).cast("long")
    d = F.floor(secs / 86400).cast("long")
    h = F.floor((secs % 86400) / 3600).cast("long")
    m = F.floor((secs % 3600) / 60).cast("long")
    s = (secs % 60).cast("long")
    return F.format_string("%dd %02d:%02d:%02d", d, h, m, s)


def drive_of(path: ColumnOrName) -> Column:
    """Leading drive or mount component of a file path (``C:`` or ``data``)."""
    p = _c(path)
    return F.regexp_extract(p, r"^([A-Za-z]:|[/\\]*[^/\\]+)", 1)


def statement_text(text: ColumnOrName, start_offset: ColumnOrName, end_offset: ColumnOrName) -> Column:
    """Current statement from a batch text.

    Offsets are byte offsets into a two-byte character string; ``end = -1``
    means "to the end of the text".
    """
    t, so, eo = _c(text), _c(start_offset).cast("long"), _c(end_offset).cast("long")
    end_bytes = F.when(eo == -1, F.length(t).cast("long") * 2).otherwise(eo)
    length = F.floor((end_bytes - so) / 2).cast("long") + 1
    return _substring(t, F.floor(so / 2).cast("long") + 1, length)


def _substring(t: Column, pos: Column, length: Column) -> Column:
    return t.substr(pos.cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def split_list(col: ColumnOrName, sep: str = ",") -> Column:
    """Delimited parameter list -> trimmed, non-empty array of strings."""
    parts = F.split(_c(col), _regex_escape(sep))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != F.lit(""))


def _regex_escape(s: str) -> str:
    import re

    return re.escape(s)


def ampm_hour(ts: ColumnOrName) -> Column:
    """Hour of day labelled ``12am``, ``1am`` ... ``12pm`` ... ``11pm``."""
    return F.lower(F.date_format(_c(ts), "ha"))


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(ts: ColumnOrName) -> Column:
    """Zone-less wall-clock timestamp -> instant (TIMESTAMP) read as UTC,
    independent of the session zone (event-time watermarks need TIMESTAMP)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts))
    return F.timestamp_micros(micros)


def instant_to_ntz(ts: ColumnOrName) -> Column:
    """Inverse of :func:`ntz_to_instant`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), F.expr(_EPOCH_NTZ))
