"""Backup and replica chain analytics (BK-*).

Backup history columns: ``server_name, database_name, type (D full, I diff,
L log), backup_start_date, backup_finish_date, backup_set_id, backup_size,
compressed_backup_size, user_name, first_lsn, last_lsn`` plus option flags.

Chain questions ("which full does this log belong to", "latest full before
this time") are as-of lookups.  They are answered by carrying the last full
forward (``last(..., ignorenulls)`` over a running frame, per database and
LSN range so one busy database is not one task) and then aggregates and
equi-joins on ``(server, database, segment)`` -- never a theta join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import datediff_boundary
from ..session import ensure_checkpoint_dir
from .findings import as_findings
from .relational import row_number_in_key

DB = ["server_name", "database_name"]
MB = 1048576.0


def _secs(start="backup_start_date", finish="backup_finish_date"):
    return datediff_boundary("second", F.col(start), F.col(finish))


def throughput_by_type(backups: DataFrame, *, since=None, digits: int = 4) -> DataFrame:
    """BK-1 / AG-8: MB/s and size min/avg/max per database and type, undamaged
    only, 0-second backups counted as 1 s; then full/diff/log side by side
    via one conditional pivot instead of three self-joins."""
    b = backups
    if "is_damaged" in b.columns:
        b = b.filter(~F.col("is_damaged"))
    if since is not None:
        b = b.filter(F.col("backup_finish_date") >= F.lit(since))
    secs = _secs()
    mbps = F.col("backup_size") / F.when(secs == 0, F.lit(1)).otherwise(secs) / MB
    b = b.select(*DB, "type", mbps.alias("mbps"), (F.col("backup_size") / MB).alias("size_mb"),
                 (F.col("compressed_backup_size") / MB).alias("csize_mb"))
    g = b.groupBy(*DB).pivot("type", ["D", "I", "L"]).agg(
        F.round(F.avg("mbps"), digits).alias("mbps_avg"), F.round(F.min("mbps"), digits).alias("mbps_min"),
        F.round(F.max("mbps"), digits).alias("mbps_max"), F.round(F.avg("size_mb"), digits).alias("size_mb_avg"),
        F.round(F.min("size_mb"), digits).alias("size_mb_min"), F.round(F.max("size_mb"), digits).alias("size_mb_max"),
        F.round(F.avg("csize_mb"), digits).alias("compressed_mb_avg"))
    names = {"D": "full", "I": "diff", "L": "log"}
    out = g
    for c in g.columns:
        if "_" in c and c[0] in names and c[1] == "_":
            out = out.withColumnRenamed(c, f"{names[c[0]]}_{c[2:]}")
    return out.filter(F.col("full_size_mb_avg").isNotNull())


def rpo_gaps(backups: DataFrame, *, bucket: str | None = "day") -> DataFrame:
    """BK-2: gap to the previous backup of the same database (any type).

    The previous backup finished strictly earlier and has a smaller set id,
    which follows from an earlier finish as ids rise with time.  Backups that finish
    in the same second share their predecessor, so the lag runs over the distinct finish
    times of a database (with the largest id of each) and is joined back."""
    from .relational import bucketed_lag

    times = backups.groupBy(*DB, "backup_finish_date").agg(F.max("backup_set_id").alias("__id"))
    prev = bucketed_lag(times, by=DB, ts="backup_finish_date", cols=["__id"], bucket=bucket, prefix="__p_").filter(
        F.col("__p___id").isNotNull())
    b = backups.select(*DB, "backup_set_id", "backup_finish_date").join(prev.drop("__id"), [*DB, "backup_finish_date"])
    b = b.select(*DB, "backup_set_id", "backup_finish_date", F.col("__p___id").alias("prior_backup_set_id"),
                 F.col("__p_backup_finish_date").alias("prior_finish_date"))
    return b.withColumn("gap_seconds", datediff_boundary("second", F.col("prior_finish_date"),
                                                           F.col("backup_finish_date")))


def rpo_worst(backups: DataFrame) -> DataFrame:
    """BK-2 / JN-14: worst RPO gap per database; ties are all kept (``rank``)."""
    g = rpo_gaps(backups)
    w = Window.partitionBy(*DB).orderBy(F.col("gap_seconds").desc())
    return g.withColumn("__r", F.rank().over(w)).filter(F.col("__r") == 1).drop("__r").withColumn(
        "rpo_worst_minutes", F.round(F.col("gap_seconds") / 60.0, 4))


def with_full_segment(backups: DataFrame, *, ranges: int | str | None = "ranges") -> DataFrame:
    """JN-8 as-of: attach the latest full backup at or before each row in LSN
    order (``seg_full_lsn``) by carrying the last full forward.  The carry
    runs per ``(database, LSN range)`` over ranges of equal depth
    (:func:`~fleetscope.operators.relational.carry_last`), so a database holding most of the history is not one task."""
    from .relational import carry_last

    is_full = F.col("type") == "D"
    b = backups.withColumn("__full_lsn", F.when(is_full, F.col("last_lsn")))
    b = carry_last(b, by=DB, ts="last_lsn", tie=["backup_set_id"], value="__full_lsn", out="seg_full_lsn",
                   bucket=ranges)
    return b.drop("__full_lsn")


def recovery_points(backups: DataFrame) -> DataFrame:
    """BK-3 / BK-4: one recovery point per full backup: the log chain that
    follows it up to the next full, the latest diff in that range, and the
    time and size needed to restore full + diff + logs.

    Physical plan: rows are assigned to their full's segment by a
    range-bucketed carry-forward; the segment's last log and its chosen diff
    are small per-segment aggregates joined back on the segment key, and the
    totals one more aggregate -- no self-joins between fulls, diffs and logs,
    and no window that would hold a whole (possibly huge) segment in a task."""
    b = with_full_segment(backups.filter(F.col("type").isin("D", "I", "L")))
    b = b.filter(F.col("seg_full_lsn").isNotNull())
    seg = [*DB, "seg_full_lsn"]
    typ, lsn = F.col("type"), F.col("last_lsn")
    last_log = b.filter(typ == "L").groupBy(*seg).agg(F.max("last_lsn").alias("log_last_lsn"))
    b = b.join(last_log, seg, "left")
    diff_ok = (typ == "I") & (F.col("log_last_lsn").isNull() | (lsn < F.col("log_last_lsn")))
    best_diff = b.filter(diff_ok).groupBy(*seg).agg(F.max("last_lsn").alias("diff_last_lsn"))
    b = b.join(best_diff, seg, "left")
    after = F.coalesce(F.col("diff_last_lsn"), F.col("seg_full_lsn"))
    in_logs = (typ == "L") & (F.col("first_lsn") >= after) & (F.col("first_lsn") <= F.col("log_last_lsn"))
    secs = _secs()
    size_mb = F.round(F.col("backup_size") / MB, 4)
    g = b.groupBy(*seg).agg(
        F.max_by(F.struct(F.col("backup_set_id").alias("full_backup_set_id"), secs.alias("full_time_seconds"),
                          size_mb.alias("full_size_mb")), F.when(typ == "D", lsn)).alias("f"),
        F.max_by(F.struct(F.col("backup_set_id").alias("diff_backup_set_id"), secs.alias("diff_time_seconds"),
                          size_mb.alias("diff_size_mb")), F.when(diff_ok, lsn)).alias("d"),
        F.max("diff_last_lsn").alias("diff_last_lsn"), F.max("log_last_lsn").alias("log_last_lsn"),
        F.count_if(in_logs).cast("long").alias("log_backups"),
        F.sum(F.when(in_logs, secs)).cast("long").alias("log_time_seconds"),
        F.round(F.sum(F.when(in_logs, F.col("backup_size"))) / MB, 4).alias("log_size_mb"))
    has_diff = F.col("diff_last_lsn").isNotNull()
    out = g.filter(F.col("f").isNotNull()).select(
        *DB, F.col("seg_full_lsn").alias("full_last_lsn"), "f.full_backup_set_id", "f.full_time_seconds",
        "f.full_size_mb",
        F.when(has_diff, F.col("d.diff_backup_set_id")).alias("diff_backup_set_id"), "diff_last_lsn",
        F.when(has_diff, F.col("d.diff_time_seconds")).alias("diff_time_seconds"),
        F.when(has_diff, F.col("d.diff_size_mb")).alias("diff_size_mb"), "log_last_lsn",
        "log_backups", F.coalesce("log_time_seconds", F.lit(0)).cast("long").alias("log_time_seconds"),
        F.coalesce("log_size_mb", F.lit(0.0)).alias("log_size_mb"))
    return out.select(
        "*",
        F.round(F.col("full_size_mb") + F.coalesce("diff_size_mb", F.lit(0.0)) + F.col("log_size_mb"), 4)
        .alias("rto_size_mb"),
        (F.col("full_time_seconds") + F.coalesce("diff_time_seconds", F.lit(0)) + F.col("log_time_seconds"))
        .cast("long").alias("rto_time_seconds"),
    )


def rto_worst(points: DataFrame, *, restore_mbps: float | None = None) -> DataFrame:
    """BK-4: worst recovery point per database by total restore size; the
    newest full wins a tie.  With ``restore_mbps`` the estimate is
    ``MB ÷ MBps ÷ 60`` minutes (the reference divides the other way round)."""
    w = Window.partitionBy(*DB).orderBy(F.col("rto_size_mb").desc(), F.col("full_last_lsn").desc())
    out = points.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")
    if restore_mbps:
        out = out.withColumn("rto_worst_minutes", F.round(F.col("rto_size_mb") / F.lit(restore_mbps) / 60.0, 4))
    else:
        out = out.withColumn("rto_worst_minutes", F.round(F.col("rto_time_seconds") / 60.0, 4))
    return out


def recoverability(backups: DataFrame) -> DataFrame:
    """BK-5: first/last full size and date, average speed, size and duration."""
    f = backups.filter(F.col("type") == "D")
    secs = _secs()
    return f.groupBy(*DB).agg(
        F.min("backup_finish_date").alias("first_full"), F.max("backup_finish_date").alias("last_full"),
        F.round(F.min_by(F.col("backup_size"), F.struct("backup_finish_date", "backup_set_id")) / MB, 4)
        .alias("first_full_size_mb"),
        F.round(F.max_by(F.col("backup_size"), F.struct("backup_finish_date", "backup_set_id")) / MB, 4)
        .alias("last_full_size_mb"),
        F.round(F.avg(F.col("backup_size") / F.when(secs == 0, 1).otherwise(secs) / MB), 4).alias("avg_mbps"),
        F.round(F.avg(F.col("backup_size") / MB), 4).alias("avg_size_mb"),
        F.round(F.avg(secs), 4).alias("avg_duration_seconds"),
        F.count(F.lit(1)).cast("long").alias("full_backups"))


def size_trend(backups: DataFrame, as_of, *, months: int = 12) -> DataFrame:
    """BK-6 / AG-6: average full size per month offset ``-months..0`` before
    ``as_of``, pivoted with a fixed value list (no distinct pass)."""
    f = backups.filter((F.col("type") == "D") & (F.col("backup_finish_date") <= F.lit(as_of)))
    off = datediff_boundary("month", F.lit(as_of), F.col("backup_finish_date"))
    f = f.select(*DB, off.alias("month_offset"), (F.col("backup_size") / MB).alias("mb")).filter(
        F.col("month_offset") >= -months)
    values = list(range(-months, 1))
    p = f.groupBy(*DB).pivot("month_offset", values).agg(F.round(F.avg("mb"), 4))
    return p.select(*DB, *[F.col(str(v)).alias(f"m{abs(v)}" if v else "m0") for v in values])


# Backup-history rule ids, priorities and names (rules 2-12 are counted per database).
BACKUP_RULES = [
    (2, 100, "Compatibility level changing", "compatibility levels"),
    (3, 100, "Password backups", "password-protected backups"),
    (4, 100, "Snapshot backups", "snapshot backups"),
    (5, 100, "Read only state backups", "backups while read only"),
    (6, 100, "Single user mode backups", "backups in single user mode"),
    (7, 100, "No CHECKSUMS", "backups without checksums"),
    (8, 100, "Damaged backups", "damaged backups"),
    (9, 100, "Encrypted backups", "encrypted backups"),
    (10, 100, "Bulk logged backups", "backups in bulk-logged recovery"),
    (11, 100, "Recovery model switched", "recovery models"),
    (12, 100, "Uncompressed backups", "uncompressed full backups in the last 30 days"),
]


def backup_rule_findings(backups: DataFrame, as_of, *, check_ts=None) -> DataFrame:
    """BK-7: backup-history rules.  Rules 2-12 are conditional counts in a
    single aggregate per database, unpivoted to findings.  Rule 1 counts, per
    database and user, backups by anyone but an agent account and the one
    user who takes most backups of all (the first by name on a tie)."""
    by_user = backups.groupBy(*DB, "user_name").agg(F.count(F.lit(1)).cast("long").alias("n"))
    most = by_user.groupBy("user_name").agg(F.sum("n").alias("all")).agg(
        F.min(F.struct((-F.col("all")).alias("minus"), "user_name"))["user_name"].alias("usual_user"))
    others = by_user.filter((F.col("n") > 1) & ~F.upper("user_name").contains("AGENT")).join(
        most, F.col("user_name") == F.col("usual_user"), "left_anti")
    one = others.select(*DB, F.lit(1).alias("check_id"), F.lit(100).alias("priority"), F.lit("Non-Agent backups taken").alias("finding"),
                        F.concat(F.lit("backups by "), F.col("user_name")).alias("descr"), "n")
    levels, models = F.count_distinct("compatibility_level"), F.count_distinct("recovery_model")
    recent = F.col("backup_finish_date") >= F.lit(as_of) - F.make_dt_interval(F.lit(30))
    cnt = {
        2: F.when(levels > 2, levels),
        3: F.count_if("is_password_protected"),
        4: F.count_if("is_snapshot"),
        5: F.count_if("is_readonly"),
        6: F.count_if("is_single_user"),
        7: F.count_if(~F.col("has_backup_checksums")),
        8: F.count_if("is_damaged"),
        9: F.count_if("is_encrypted"),
        10: F.count_if(F.col("recovery_model") == "BULK_LOGGED"),
        11: F.when(models > 1, models),
        12: F.count_if((F.col("type") == "D") & (F.col("backup_size") == F.col("compressed_backup_size")) & recent),
    }
    g = backups.groupBy(*DB).agg(*[v.cast("long").alias(f"r{k}") for k, v in cnt.items()])
    stack = ", ".join(f"{rid}, {pr}, '{name}', '{desc}', r{rid}" for rid, pr, name, desc in BACKUP_RULES)
    u = g.select(*DB, F.expr(f"stack({len(BACKUP_RULES)}, {stack}) AS (check_id, priority, finding, descr, n)"))
    u = u.filter(F.col("n") > 0).unionByName(one)
    return as_findings(u, check_id=F.col("check_id"), priority=F.col("priority"), group="Backup",
                       finding=F.col("finding"),
                       details=F.concat(F.col("n").cast("string"), F.lit(" "), F.col("descr")),
                       value=F.col("n"), database="database_name", ts=check_ts)


def big_diffs_and_logs(backups: DataFrame, *, diff_pct: float = 40.0, log_pct: float = 20.0,
                       min_full_mb: float = 10240.0) -> DataFrame:
    """BK-8: diffs at least ``diff_pct`` % and logs at least ``log_pct`` % of
    the average full, only for databases whose average full exceeds
    ``min_full_mb``."""
    g = backups.groupBy(*DB).agg(
        (F.avg(F.when(F.col("type") == "D", F.col("backup_size"))) / MB).alias("avg_full_mb"),
        (F.avg(F.when(F.col("type") == "I", F.col("backup_size"))) / MB).alias("avg_diff_mb"),
        (F.avg(F.when(F.col("type") == "L", F.col("backup_size"))) / MB).alias("avg_log_mb"))
    g = g.filter(F.col("avg_full_mb") > min_full_mb)
    return g.select(
        *DB, F.round("avg_full_mb", 4).alias("avg_full_mb"),
        F.round(F.col("avg_diff_mb") * 100.0 / F.col("avg_full_mb"), 4).alias("diff_pct_of_full"),
        F.round(F.col("avg_log_mb") * 100.0 / F.col("avg_full_mb"), 4).alias("log_pct_of_full"),
    ).filter((F.col("diff_pct_of_full") >= diff_pct) | (F.col("log_pct_of_full") >= log_pct))


def missing_backups(databases: DataFrame, backups: DataFrame, as_of, *, max_age_hours: int = 24 * 7) -> DataFrame:
    """BK-9: databases whose last full is older than ``max_age_hours`` or
    which were never backed up (left join + max, anti join for the never
    case), and full-recovery databases without any log backup."""
    last = backups.groupBy(*DB).agg(
        F.max(F.when(F.col("type") == "D", F.col("backup_finish_date"))).alias("last_full"),
        F.max(F.when(F.col("type") == "L", F.col("backup_finish_date"))).alias("last_log"),
        F.max_by(F.col("recovery_model"), F.struct("backup_finish_date", "backup_set_id")).alias("recovery_model"))
    j = databases.select(*DB).join(last, DB, "left")
    stale = F.col("last_full").isNull() | (F.col("last_full") < F.lit(as_of) - F.make_dt_interval(
        F.lit(0), F.lit(max_age_hours)))
    no_log = (F.col("recovery_model") == "FULL") & F.col("last_log").isNull()
    return j.filter(stale | no_log).select(
        *DB, "last_full", "last_log",
        F.when(F.col("last_full").isNull(), "never backed up").when(stale, "no recent full")
        .otherwise("full recovery without log backups").alias("problem"))


def restore_sequence(backups: DataFrame, stop_at) -> DataFrame:
    """BK-10: restore plan rows up to ``stop_at``: latest full, the latest
    diff after it, then the logs after that up to and including the first
    log finishing at or after ``stop_at``."""
    b = backups.filter(F.col("type").isin("D", "I", "L"))
    before = b.filter(F.col("backup_finish_date") <= F.lit(stop_at))
    full = before.filter(F.col("type") == "D").groupBy(*DB).agg(F.max_by(F.struct(
        F.col("backup_set_id"), F.col("last_lsn")), F.struct("backup_finish_date", "backup_set_id")).alias("f"))
    full = full.select(*DB, F.col("f.backup_set_id").alias("full_id"), F.col("f.last_lsn").alias("full_lsn"))
    diff = before.filter(F.col("type") == "I").join(full, DB).filter(F.col("first_lsn") >= F.col("full_lsn")).groupBy(
        *DB).agg(F.max_by(F.struct(F.col("backup_set_id"), F.col("last_lsn")),
                          F.struct("backup_finish_date", "backup_set_id")).alias("d"))
    # one row per database, used for the steps and to find the logs
    ensure_checkpoint_dir(b.sparkSession)
    base = full.join(diff, DB, "left").select(
        *DB, "full_id", "full_lsn", F.col("d.backup_set_id").alias("diff_id"),
        F.coalesce(F.col("d.last_lsn"), F.col("full_lsn")).alias("from_lsn")).checkpoint()
    logs = b.filter(F.col("type") == "L").join(base.select(*DB, "from_lsn"), DB).filter(
        F.col("first_lsn") >= F.col("from_lsn"))
    # stop at the first log that reaches stop_at
    end = logs.filter(F.col("backup_finish_date") >= F.lit(stop_at)).groupBy(*DB).agg(
        F.min("last_lsn").alias("end_lsn"))
    logs = logs.join(end, DB, "left").filter(F.col("end_lsn").isNull() | (F.col("last_lsn") <= F.col("end_lsn")))
    steps = (base.select(*DB, F.col("full_id").alias("backup_set_id"), F.lit("D").alias("type"),
                         F.col("full_lsn").alias("last_lsn"))
             .unionByName(base.filter(F.col("diff_id").isNotNull()).select(
                 *DB, F.col("diff_id").alias("backup_set_id"), F.lit("I").alias("type"),
                 F.col("from_lsn").alias("last_lsn")))
             .unionByName(logs.select(*DB, "backup_set_id", "type", "last_lsn")))
    # numbered over ranges of equal depth: a long chain is not sorted in one task
    numbered = row_number_in_key(steps, by=DB, order="last_lsn", tie=["backup_set_id"])
    return numbered.withColumn("step", F.col("__rn").cast("long")).drop("__rn", "__n")


def replica_lag(replicas: DataFrame, *, max_lag_seconds: int = 60, group: str = "database_name") -> DataFrame:
    """BK-11: each secondary against its primary (equi self-join on the
    group), lag in seconds and a status band."""
    p = replicas.filter(F.col("role") == "PRIMARY").select(group, F.col("last_commit").alias("primary_commit"))
    s = replicas.filter(F.col("role") == "SECONDARY").join(p, group)
    lag = datediff_boundary("second", F.col("last_commit"), F.col("primary_commit"))
    return s.select(group, "replica", lag.alias("lag_seconds"),
                    F.when(lag > max_lag_seconds, "FALLING BEHIND").when(lag > 0, "LAGGING").otherwise("IN SYNC")
                    .alias("status"))


def restore_latency(secondaries: DataFrame, as_of) -> DataFrame:
    """BK-11: minutes (boundaries) since a log-shipping secondary's last restore against its threshold."""
    minutes = datediff_boundary("minute", F.col("last_restored_date"), F.lit(as_of))
    return secondaries.select("secondary_server", "secondary_database", "restore_threshold_minutes", "last_restored_date",
                              minutes.alias("minutes_since_restore"),
                              F.when(minutes > F.col("restore_threshold_minutes"), "ALERT - Restore threshold exceeded").otherwise("OK").alias("status"))


def unsynchronized_replicas(replicas: DataFrame, *, fine: Sequence[str] = ("SYNCHRONIZED",)) -> DataFrame:
    """BK-11: replicas of each database whose known synchronization state is none of ``fine``."""
    return replicas.filter(~F.col("synchronization_state").isin(list(fine)))


def new_history_rows(incoming: DataFrame, existing: DataFrame, *, key: Sequence[str] = ("server_name",
                                                                                          "backup_set_id")) -> DataFrame:
    """BK-12 / JN-5: rows of ``incoming`` not yet in ``existing`` (left anti
    join), ready for an append."""
    return incoming.join(existing.select(*key), list(key), "left_anti")


# Job run status codes.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}


def job_history(runs: DataFrame, as_of, *, n: int = 5) -> DataFrame:
    """BK-13: last ``n`` runs per job with decoded status and a 24-hour flag."""
    from ..functions.scalar import decode

    w = Window.partitionBy("job_name").orderBy(F.col("run_ts").desc(), F.col("run_id").desc())
    r = runs.withColumn("run_rank", F.row_number().over(w).cast("long")).filter(F.col("run_rank") <= n)
    return r.select("job_name", "run_id", "run_ts", "run_rank", decode("run_status", RUN_STATUS, "Unknown")
                    .alias("status"),
                    (F.col("run_ts") >= F.lit(as_of) - F.make_dt_interval(F.lit(1))).alias("within_24h"))
