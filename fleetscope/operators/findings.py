"""Helpers that shape operator output into the common finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDING_COLUMNS


def _lit_or_col(x, cast: str | None = None) -> Column:
    if isinstance(x, Column):
        c = x
    elif x is None:
        c = F.lit(None)
    else:
        c = F.lit(x)
    return c.cast(cast) if cast else c


def as_findings(df: DataFrame, *, check_id, priority, group, finding, details=None, value=None,
                server="server_name", database=None, ts=None) -> DataFrame:
    """Project ``df`` to FINDING_SCHEMA.  Each argument is a literal or a Column;
    ``server``/``database``/``ts`` may also name a column."""
    def colref(x, cast):
        if isinstance(x, str):
            return F.col(x).cast(cast)
        return _lit_or_col(x, cast)

    return df.select(
        colref(server, "string").alias("server_name"),
        colref(database, "string").alias("database_name"),
        colref(ts, "timestamp_ntz").alias("check_ts"),
        _lit_or_col(check_id, "int").alias("check_id"),
        _lit_or_col(priority, "int").alias("priority"),
        _lit_or_col(group, "string").alias("findings_group"),
        _lit_or_col(finding, "string").alias("finding"),
        _lit_or_col(details, "string").alias("details"),
        _lit_or_col(value, "double").alias("value"),
    ).select(*FINDING_COLUMNS)
