"""Graph iteration over parent edges (BLK-2 blocking chains, SEC-2 role closure).

Pointer jumping: every node carries ``(anc, dist)``; one round joins the
state with itself on ``anc = node`` and replaces ``anc`` by the ancestor's
ancestor, so a chain of depth ``d`` resolves in ``ceil(log2 d)`` rounds --
each round is one shuffle join of the node table, never a per-node Python
loop.  Nodes that still do not point at a root when a round changes nothing
sit on (or behind) a cycle and are flagged.  Every round's state is written
with ``checkpoint()`` into the session's checkpoint folder and read from there, so
a round's plan holds one join, no executor keeps a state, and a lost one costs one round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def resolve_roots(edges: DataFrame, *, node: str, parent: str, group: Sequence[str] = (),
                  no_parent_values: Sequence = (0,), max_rounds: int | None = None) -> DataFrame:
    """Root ancestor and depth of every node of a parent forest.

    ``edges`` has one row per node with its ``parent`` (NULL or one of
    ``no_parent_values`` for roots).  Parents that never appear as nodes
    are roots.  Returns ``group, node, root, depth, is_cycle`` for every
    node (including parent-only nodes); cycle members get NULL root/depth.
    """
    g = list(group)
    spark = edges.sparkSession
    has_parent = F.col(parent).isNotNull()
    for v in no_parent_values:
        has_parent = has_parent & (F.col(parent) != F.lit(v))
    e = edges.select(*g, F.col(node).alias("node"), F.when(has_parent, F.col(parent)).alias("parent"))
    parents_only = (e.filter(F.col("parent").isNotNull()).select(*g, F.col("parent").alias("node"))
                    .join(e.select(*g, "node"), [*g, "node"], "left_anti").distinct()
                    .select(*g, "node", F.lit(None).cast(e.schema["parent"].dataType).alias("parent")))
    allnodes = e.unionByName(parents_only)
    state = allnodes.select(
        *g, "node",
        F.coalesce("parent", "node").alias("anc"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"),
        F.col("parent").isNull().alias("done"),
    )
    # the node table's own "is root" flag, needed to know when anc is a root
    roots = allnodes.select(*g, F.col("node").alias("anc"), F.col("parent").isNull().alias("anc_is_root"))
    ensure_checkpoint_dir(spark)
    state = state.join(roots, [*g, "anc"], "left").select(
        *g, "node", "anc", "dist", F.coalesce("anc_is_root", F.lit(False)).alias("done")).checkpoint()
    total, unresolved = state.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).collect()[0]
    if max_rounds is None:
        max_rounds = int(math.ceil(math.log2(max(total, 2)))) + 2
    rounds = 0
    while unresolved > 0 and rounds < max_rounds:
        rounds += 1
        # resolved rows stay out of the join: with one lead blocker nearly all of them share that ancestor
        open_rows, resolved = state.filter(~F.col("done")), state.filter(F.col("done"))
        a = open_rows.alias("a")
        b = state.select(*g, F.col("node").alias("b_node"), F.col("anc").alias("b_anc"),
                         F.col("dist").alias("b_dist"), F.col("done").alias("b_done"))
        cond = [F.col("a.anc") == F.col("b_node")] + [F.col(f"a.{c}") == b[c] for c in g]
        j = a.join(b, cond, "left")
        nxt = resolved.unionByName(j.select(
            *[F.col(f"a.{c}").alias(c) for c in g], F.col("a.node").alias("node"), F.col("b_anc").alias("anc"),
            (F.col("a.dist") + F.col("b_dist")).alias("dist"), F.coalesce(F.col("b_done"), F.lit(False)).alias("done"),
        ))
        state = nxt.checkpoint()
        now = state.filter(~F.col("done")).count()
        if now == unresolved:
            break
        unresolved = now
    return state.select(
        *g, "node",
        F.when(F.col("done"), F.col("anc")).alias("root"),
        F.when(F.col("done"), F.col("dist")).alias("depth"),
        (~F.col("done")).alias("is_cycle"),
    )


def one_hop(nodes: DataFrame, edges: DataFrame, *, node_key: str, src: str, dst: str,
            group: Sequence[str] = ()) -> DataFrame:
    """BLK-12: node -> edge -> node traversal as two equi-joins."""
    g = list(group)
    left = nodes.select(*g, *[F.col(c).alias(f"from_{c}") for c in nodes.columns if c not in g])
    right = nodes.select(*g, *[F.col(c).alias(f"to_{c}") for c in nodes.columns if c not in g])
    e = edges.select(*g, F.col(src).alias("__src"), F.col(dst).alias("__dst"))
    j = e.join(left.withColumnRenamed(f"from_{node_key}", "__src"), [*g, "__src"]).join(
        right.withColumnRenamed(f"to_{node_key}", "__dst"), [*g, "__dst"])
    return j.withColumnRenamed("__src", f"from_{node_key}").withColumnRenamed("__dst", f"to_{node_key}")
