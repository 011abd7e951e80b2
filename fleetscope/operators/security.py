"""Security analytics (SEC-1 ... SEC-4, PRJ-7).

Principals are edges ``member -> role``; permissions are ``grantee,
object_name, permission, state``.  Transitive role membership is computed
by squaring the known paths (equi-joins), keeping the shortest per pair, until
nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def permission_listing(members: DataFrame, permissions: DataFrame) -> DataFrame:
    """SEC-1: every member with the permissions granted to its role
    (left join: members of roles without grants are kept)."""
    p = permissions.withColumnRenamed("grantee", "role")
    return members.join(p, "role", "left").select("member", "role", "object_name", "permission", "state")


def role_closure(members: DataFrame) -> DataFrame:
    """SEC-2: transitive membership ``(member, role, depth)``; depth 1 is the
    direct membership (the reference's one-hop expansion), otherwise the
    shortest chain.

    Known paths are joined with themselves and the shortest kept, so the
    reach doubles every round: ``ceil(log2 depth) + 1`` rounds without a depth
    limit.  Each round is checkpointed, so the plan never holds more than one
    join.  Pairs and depths can only improve, so cycles end too."""
    ensure_checkpoint_dir(members.sparkSession)
    edges = members.select("member", "role").where("member IS NOT NULL AND role IS NOT NULL").distinct()
    paths = edges.withColumn("depth", F.lit(1).cast("long")).checkpoint()
    known = None
    while True:
        state = tuple(paths.agg(F.count("*"), F.sum("depth")).first())
        if state == known:
            return paths
        known = state
        onward = paths.select(F.col("member").alias("__mid"), F.col("role").alias("__to"), F.col("depth").alias("__d"))
        longer = paths.join(onward, F.col("role") == F.col("__mid")).select(
            "member", F.col("__to").alias("role"), (F.col("depth") + F.col("__d")).alias("depth"))
        paths = paths.unionByName(longer).groupBy("member", "role").agg(F.min("depth").alias("depth")).checkpoint()


def high_risk_principals(closure: DataFrame, logins: DataFrame, *, admin_roles=("sysadmin", "db_owner")) -> DataFrame:
    """SEC-3 / ST-4: members of administrative roles unioned with disabled
    logins, one row per (principal, reason)."""
    admins = closure.filter(F.col("role").isin(list(admin_roles))).select(
        F.col("member").alias("principal"), F.concat(F.lit("member of "), F.col("role")).alias("reason"))
    disabled = logins.filter(F.col("is_disabled")).select(F.col("login_name").alias("principal"),
                                                           F.lit("disabled login").alias("reason"))
    return admins.unionByName(disabled).distinct()


def orphaned_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """SEC-4 / JN-5: database users whose login does not exist (left anti join)."""
    return users.join(logins.select(F.col("login_name").alias("user_name")), "user_name", "left_anti")


def visible_rows(rows: DataFrame, entitlements: DataFrame, *, owner: str = "owner", context: str) -> DataFrame:
    """PRJ-7: row-level security as a filter: a row is visible to ``context``
    when it owns the row or manages its owner (semi join against the
    entitlement pairs ``(viewer, owner)``; the viewer's own rows are a plain
    predicate)."""
    allowed = entitlements.filter(F.col("viewer") == F.lit(context)).select(F.col("owner").alias(owner))
    own = rows.filter(F.col(owner) == F.lit(context))
    managed = rows.join(allowed, owner, "left_semi")
    return own.unionByName(managed).distinct()
