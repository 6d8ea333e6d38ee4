"""Bounded traversals, level by level; each level is one join and is cut from its lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeweft.operators.graph import top_n
from codeweft.session import cut, discard
from codeweft.skew import salted_join


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """(root, node, depth) of every node within ``depth`` steps of each root, the root itself at 0.

    ``edges`` has (src, dst), ``seeds`` the column root. Every (root, node) appears once, at its
    least depth, so loops end. ``per_node`` follows only so many edges of a node, the least ids
    first. Null ends are ignored. Hot nodes are salted.
    """
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    if per_node is not None:
        e = top_n(e, ["src"], [F.col("dst")], per_node)
    e = cut(e, "edges")
    front = cut(seeds.filter(F.col("root").isNotNull()).select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    levels = [front]
    for level in range(1, depth + 1):
        reached = salted_join(front.select("root", F.col("node").alias("src")), e, ["src"]).select("root", F.col("dst").alias("node")).distinct()
        seen = reduce(lambda a, b: a.unionByName(b), levels)  # each level stays where it was written
        front = cut(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level)), "level")
        if front.isEmpty():
            discard(front)
            break
        levels.append(front)
    discard(e)
    return reduce(lambda a, b: a.unionByName(b), levels)


def capped(levels: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes of each root by (depth, node), with their position from 0."""
    first = top_n(levels, ["root"], [F.col("depth"), F.col("node")], limit)
    return first.withColumn("step_order", F.row_number().over(W.partitionBy("root").orderBy("depth", "node")) - 1)


def blast_radius(incoming: DataFrame, outgoing: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, depth) of what a change of each root can touch.

    Edges of ``incoming`` are followed against their direction (callers, users of a type,
    children), those of ``outgoing`` along it (callees, dispatches, tables).
    """
    back = incoming.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs(back.unionByName(outgoing.select("src", "dst")), seeds, depth).filter("depth > 0")


def chain(first: DataFrame, second: DataFrame, third: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    """Chains whose step is three edges in a row, such as defines, dispatches, listens: (root, node, depth)."""
    step = (
        first.select(F.col("src"), F.col("dst").alias("a"))
        .join(second.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a")
        .join(third.select(F.col("src").alias("dst"), F.col("dst").alias("b")), "b")
        .select("src", "dst")
    )
    return bfs(step, seeds, depth).filter("depth > 0")


def entry_points(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(node_id, entry_type): nodes from which flows begin; a node of several kinds has the first."""
    rows = None
    for i, (kind, df) in enumerate(kinds):
        part = df.select("node_id", F.lit(kind).alias("entry_type"), F.lit(i).alias("prio"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("node_id").agg(F.min_by("entry_type", "prio").alias("entry_type"))


def live_nodes(candidates: DataFrame, exempt: list[DataFrame], overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dead, live) of candidate nodes: dead unless in an exempt set or overriding a live one.

    ``overrides`` has (node_id, parent_id). One pass revives the overrides of live parents, as
    deeper ones follow from their own parents' exemption.
    """
    keys = exempt[0].select("node_id")
    for e in exempt[1:]:
        keys = keys.unionByName(e.select("node_id"))
    dead = candidates.join(keys, "node_id", "left_anti")
    if overrides is not None:
        live = candidates.join(keys, "node_id", "left_semi").select(F.col("node_id").alias("parent_id"))
        revived = overrides.join(live, "parent_id", "left_semi").select("node_id")
        dead = dead.join(revived, "node_id", "left_anti")
    return dead, candidates.join(dead.select("node_id"), "node_id", "left_anti")
