"""Registered queries: the scalar helpers of §2.15/§2.17 (format_bytes,
ms_to_dhms, boundary DATEDIFF) applied to backup history (F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary, format_bytes, ms_to_dhms
from . import fixtures as fx
from . import oracle_fixtures as ofx

QUERIES: dict = {}
ORACLE: dict = {}

_SECS = "date_diff('second', backup_start_date, backup_finish_date)"


def _fmt(col: str) -> str:
    units = [(1099511627776, "TB"), (1073741824, "GB"), (1048576, "MB"), (1024, "KB")]
    whens = " ".join(f"WHEN {col} >= {d} THEN printf('%.2f', round({col} / {d}.0, 2)) || ' {u}'" for d, u in units)
    return f"CASE {whens} ELSE CAST({col} AS VARCHAR) || ' B' END"


ORACLE["fn01_format_sizes_and_durations"] = ofx.with_(ofx.f3_backups()) + f"""
SELECT server_name, database_name, backup_set_id, {_fmt('backup_size')} AS size_text,
       {_fmt('compressed_backup_size * 1000')} AS compressed_x1000_text,
       {_SECS} AS duration_seconds,
       printf('%dd %02d:%02d:%02d', {_SECS} // 86400, ({_SECS} % 86400) // 3600, ({_SECS} % 3600) // 60,
              {_SECS} % 60) AS duration_text,
       date_diff('month', backup_start_date, backup_finish_date + INTERVAL 40 DAY) AS months_crossed
FROM f3"""


def q_fn01(spark, sf_dir):
    b = fx.f3_backups(spark, sf_dir)
    secs = datediff_boundary("second", F.col("backup_start_date"), F.col("backup_finish_date"))
    return b.select(
        "server_name", "database_name", "backup_set_id", format_bytes("backup_size").alias("size_text"),
        format_bytes(F.col("compressed_backup_size") * 1000).alias("compressed_x1000_text"),
        secs.alias("duration_seconds"), ms_to_dhms(secs * 1000).alias("duration_text"),
        datediff_boundary("month", F.col("backup_start_date"),
                          F.col("backup_finish_date") + F.expr("INTERVAL 40 DAYS")).alias("months_crossed"))


QUERIES["fn01_format_sizes_and_durations"] = q_fn01
