"""Blocking, sessions and parallel-skew analytics (BLK-*).

Session snapshots: ``server_name, session_id, blocking_session_id (0 = not
blocked), wait_duration_ms, wait_type, status, login_name, database_name,
open_tran_count, program_name, start_ts``.  Every join below is an
equi-join on ``(server, session)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import try_ratio
from .graph import resolve_roots

S = "server_name"


def blocked_with_blocker(sessions: DataFrame, *, blocker_cols: Sequence[str] = ("login_name", "status",
                                                                                 "program_name")) -> DataFrame:
    """BLK-1: each blocked session with its blocker's attributes (inner
    equi-join on server + blocker id)."""
    blocked = sessions.filter(F.col("blocking_session_id") != 0)
    blk = sessions.select(S, F.col("session_id").alias("blocking_session_id"),
                          *[F.col(c).alias(f"blocker_{c}") for c in blocker_cols])
    return blocked.join(blk, [S, "blocking_session_id"], "inner")


def blockers(sessions: DataFrame) -> DataFrame:
    """BLK-1 / JN-4: sessions that block at least one other (left semi join)."""
    edges = sessions.filter(F.col("blocking_session_id") != 0).select(S, F.col("blocking_session_id").alias("session_id"))
    return sessions.join(edges, [S, "session_id"], "left_semi")


def blocking_chains(sessions: DataFrame) -> DataFrame:
    """BLK-2: root blocker and chain level of every blocked session, cycles
    flagged (pointer jumping, :func:`resolve_roots`)."""
    r = resolve_roots(sessions.select(S, "session_id", "blocking_session_id"), node="session_id",
                      parent="blocking_session_id", group=[S])
    return r.select(S, F.col("node").alias("session_id"), F.col("root").alias("root_blocker"),
                    F.col("depth").alias("chain_level"), "is_cycle")


def victims_per_root(chains: DataFrame) -> DataFrame:
    """BLK-2: number of sessions waiting behind each root, and the deepest level."""
    return chains.filter(F.col("chain_level") > 0).groupBy(S, "root_blocker").agg(
        F.count(F.lit(1)).cast("long").alias("victims"), F.max("chain_level").alias("max_level"))


def lead_blockers(sessions: DataFrame, *, min_wait_ms: int = 30000) -> DataFrame:
    """BLK-3: sessions that keep someone waiting on a lock (wait type
    ``LCK...``) for more than ``min_wait_ms`` and are not blocked themselves (semi join + filter, no correlated subquery)."""
    long_waits = sessions.filter((F.col("blocking_session_id") != 0) & (F.col("wait_duration_ms") > min_wait_ms)
                                 & F.col("wait_type").startswith("LCK"))
    edges = long_waits.groupBy(S, F.col("blocking_session_id").alias("session_id")).agg(
        F.count(F.lit(1)).cast("long").alias("sessions_blocked"), F.max("wait_duration_ms").alias("longest_wait_ms"))
    return sessions.filter(F.col("blocking_session_id") == 0).join(edges, [S, "session_id"], "inner")


def reconcile_blocker(requests: DataFrame, waits: DataFrame) -> DataFrame:
    """BLK-4: blocker id from two sources, the request view and the blocked-process view.

    A session that the second source lists has the blocker named there, unless that is the session itself and the request names
    one; any other session has the request's own.  No answer where neither knows."""
    listed = waits.select(S, "session_id", F.col("blocking_session_id").alias("__listed"))
    own = F.nullif(F.col("blocking_session_id"), F.lit(0))
    itself = F.col("__listed") == F.col("session_id")
    better = F.when(~itself | own.isNull(), F.col("__listed"))
    return requests.join(listed, [S, "session_id"], "left").select(S, "session_id", F.coalesce(better, own).alias("resolved_blocking_session_id"))


def locks_per_session(sessions: DataFrame, locks: DataFrame, *, status: str | None = None) -> DataFrame:
    """BLK-5: sessions left-joined to their locks, optionally keeping one
    request status (``GRANT`` / ``WAIT``)."""
    j = sessions.select(S, "session_id", "login_name").join(locks, [S, "session_id"], "left")
    return j if status is None else j.filter(F.col("request_status") == status)


def wait_list(waits: DataFrame, *, session: str = "session_id", wait_type: str = "wait_type",
              duration: str = "wait_duration_ms") -> DataFrame:
    """BLK-6 / AG-5: per session ``"type (ms), type (ms)"`` ordered by summed
    duration (descending, ties by name)."""
    g = waits.groupBy(S, session, wait_type).agg(F.sum(duration).cast("long").alias("ms"))
    per = g.groupBy(S, session).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("ms")).alias("k"), F.col(wait_type).alias("t"), F.col("ms").alias("ms")))).alias("l"),
        F.sum("ms").cast("long").alias("total_wait_ms"))
    return per.select(S, session, "total_wait_ms", F.array_join(F.transform(
        "l", lambda x: F.concat(x["t"], F.lit(" ("), x["ms"].cast("string"), F.lit(" ms)"))), ", ").alias("wait_list"))


def last_observation(observations: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """BLK-7 / JN-12: last row per key by ``order`` with ``max_by(struct(*))``
    -- a hash aggregate with partial aggregation, no sort."""
    rest = [c for c in observations.columns if c not in keys]
    g = observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"),
                                        F.count(F.lit(1)).cast("long").alias("observations"))
    return g.select(*keys, "__last.*", "observations")


def parallel_skew(threads: DataFrame, *, min_rows: int = 10000, high: float = 2.0, low: float = 0.5,
                  keys: Sequence[str] = ("session_id", "request_id", "node_id")) -> DataFrame:
    """BLK-9 / WN-6: threads whose row count is over ``high`` or under
    ``low`` times the even share of their plan node (full-frame window
    partitioned by the node), reported per request."""
    w = Window.partitionBy(*keys)
    t = threads.filter(F.col("thread_id") > 0).select(
        "*", F.sum("row_count").over(w).alias("sum_node_rows"), F.count(F.lit(1)).over(w).alias("node_dop"))
    t = t.filter(F.col("node_dop") > 1)
    even = F.col("sum_node_rows") / F.col("node_dop")
    ratio = F.col("row_count") / F.when(even == 0, F.lit(1.0)).otherwise(even)
    t = t.withColumn("skew", ratio).filter((F.col("row_count") > min_rows) & ((ratio > high) | (ratio < low)))
    return t.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).cast("long").alias("skewed_threads"),
                                     F.round(F.max("skew"), 4).alias("max_skew"))


def bad_estimates(ops: DataFrame, *, factor: float = 1000.0, estimated: str = "estimated_rows",
                  actual: str = "actual_rows") -> DataFrame:
    """BLK-10: estimate off by more than ``factor`` either way."""
    e, a = F.col(estimated), F.col(actual)
    return ops.filter((a > 0) & ((e * factor < a) | (e > a * factor)))


def connection_summary(sessions: DataFrame, *, database: str = "database_name", login: str = "login_name") -> DataFrame:
    """BLK-11: per database: sessions, distinct logins and the sorted login list."""
    return sessions.groupBy(S, database).agg(
        F.count(F.lit(1)).cast("long").alias("sessions"),
        F.count_distinct(login).cast("long").alias("distinct_logins"),
        F.array_join(F.array_sort(F.collect_set(login)), ", ").alias("logins"))


def session_rollup(sessions: DataFrame) -> DataFrame:
    """AG-10 / CAP-8: fleet -> server -> database session counts (``rollup``)."""
    return sessions.rollup(S, "database_name").agg(F.count(F.lit(1)).cast("long").alias("sessions"),
                                                   F.sum("cpu_ms").cast("long").alias("cpu_ms"))


def cpu_efficiency(sessions: DataFrame, *, cpu: str = "cpu_ms", elapsed: str = "elapsed_ms") -> DataFrame:
    """CAP-11: cpu ÷ elapsed (NULL when elapsed is 0)."""
    return sessions.withColumn("cpu_efficiency", F.round(try_ratio(cpu, elapsed), 6))
