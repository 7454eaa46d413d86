"""Nested-set numbering of a parent/child table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shardline.operators.ordered import with_sum_before
from shardline.session import cut_lineage


def climbed(edges: DataFrame, root: int | None) -> DataFrame:
    """(node_id, parent_id, depth, size) of every node below ``root`` or, with None, the nodes without parent.

    By pointer doubling: after round k every node knows the ancestor 2^k levels up and how many nodes lie less than 2^k
    levels below it, so a tree of any depth takes about log2(depth) rounds, with one row for each node and
    never a list. Each round is written once. ``size`` counts the node itself. Nodes that no start reaches are left out; a start that
    is its own ancestor is an error.
    """
    start = F.col("parent_id").isNull() if root is None else F.col("node_id") == root
    linked = ~start & (F.col("parent_id") != F.col("node_id"))
    state = edges.select(
        "node_id",
        "parent_id",
        F.when(linked, F.col("parent_id")).alias("jump"),
        F.coalesce(linked.cast("long"), F.lit(0)).alias("depth"),
        F.lit(1).cast("long").alias("size"),
        start.alias("reached"),
    )
    state = cut_lineage(state, "climb")
    rounds, rows = 0, state.count()
    while 1 << rounds <= 2 * rows and not state.where("jump IS NOT NULL").isEmpty():
        below = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node_id")).agg(F.sum("size").alias("_more"))
        above = state.select(
            F.col("node_id").alias("jump"),
            F.col("jump").alias("_jump"),
            F.col("depth").alias("_depth"),
            F.col("reached").alias("_reached"),
        )
        joined = state.join(below, "node_id", "left").join(above, "jump", "left")
        reached = F.when(F.col("jump").isNull(), F.col("reached")).otherwise(F.coalesce("_reached", F.lit(False)))
        state = cut_lineage(
            joined.select(
                "node_id",
                "parent_id",
                F.col("_jump").alias("jump"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
                reached.alias("reached"),
            ),
            "climb",
        )
        rounds += 1
    found = state.where("jump IS NULL AND reached").select("node_id", "parent_id", "depth", "size")
    if root is not None:
        again = found.where(F.col("node_id") == root).select(F.col("parent_id").alias("node_id")).join(found, "node_id")
        if not again.isEmpty():
            raise ValueError("a node of the tree is its own ancestor: there is a cycle")
    return found


def nested_set(edges: DataFrame, root: int | None = None, start: int = 1) -> DataFrame:
    """(node_id, parent_id, depth, l_idx, r_idx): depth first, children by id.

    l = 2 * preorder - depth + start and r = l + 2 * subtree - 1, so no tree walk is needed. A node comes one
    after its parent and the subtrees of its elder siblings; preorder is the sum of that along its ancestors, by
    pointer doubling again. Siblings are summed in ranges, so a parent of very many children is no hot key.
    """
    nodes = climbed(edges, root)
    top = F.col("depth") == 0
    placed = nodes.withColumn("_above", F.when(~top, F.col("parent_id")))
    elder = with_sum_before(placed, ["_above"], ["node_id"], "size", "_elder")
    state = cut_lineage(
        elder.select(
            "node_id",
            "parent_id",
            F.col("depth").cast("int").alias("depth"),
            "size",
            F.col("_above").alias("jump"),
            (F.col("_elder") + (~top).cast("long")).alias("_pre"),
        ),
        "preorder",
    )
    while not state.where("jump IS NOT NULL").isEmpty():
        above = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("_jump"), F.col("_pre").alias("_more"))
        state = cut_lineage(
            state.join(above, "jump", "left").select(
                "node_id", "parent_id", "depth", "size", F.col("_jump").alias("jump"), (F.col("_pre") + F.coalesce("_more", F.lit(0))).alias("_pre")
            ),
            "preorder",
        )
    left = 2 * F.col("_pre") - F.col("depth") + start
    return state.select(
        "node_id", "parent_id", "depth", left.alias("l_idx"), (left + 2 * F.col("size") - 1).alias("r_idx")
    )


def children_of(classes: DataFrame, parent_path: str) -> DataFrame:
    """Immediate children of the class with the given path; none when the path is unknown."""
    parent = classes.where(F.col("path") == parent_path).select(F.col("class_id").alias("parent_id"))
    return classes.join(parent, "parent_id", "left_semi")


def with_children_flag(df: DataFrame, key: str, parent: str, name: str = "has_children") -> DataFrame:
    """1 when some row names this row as its parent, else 0."""
    parents = df.select(F.col(parent).alias("_parent")).distinct().withColumn(name, F.lit(1))
    joined = df.join(parents, F.col(key) == F.col("_parent"), "left").drop("_parent")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)))
