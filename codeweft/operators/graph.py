"""A typed property graph as two frames, with the patterns that queries are made of.

Nodes are rows (node_id, label, ...), edges rows (src, rel, dst, ...). A repeated edge is kept as
long as nobody asks for one edge a pair (:func:`single_edges`), so counts of call sites hold.
Joins leave the choice of algorithm to the optimizer; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Parts of a group that are cut down before the whole of it is ordered.
TOP_PARTS = 64


def node_id(label: str | Column, *parts: Column) -> Column:
    """label:part::part with doubled name separators made single; null parts count as empty."""
    head = F.lit(label) if isinstance(label, str) else label
    joined = F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "::")
    return F.concat(head, F.lit(":"), F.replace(joined, F.lit("\\\\"), F.lit("\\")))


def nodes_all(by_label: dict[str, DataFrame]) -> DataFrame:
    """All labels in one frame; a property that a label lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("label", F.lit(k)) for k, df in by_label.items()])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns])


def hop(left: DataFrame, edges: DataFrame, right: DataFrame, at: str, to: str, rels: str | Sequence[str] | None = None, reverse: bool = False, how: str = "inner") -> DataFrame:
    """One step of a pattern from the column ``at`` (a node id) over edges to ``right``, whose columns come prefixed ``to_``.

    ``rels`` is one relation, several, or None for any. With ``how='left'`` rows without a match
    stay with nulls (an optional match). Edge properties come along prefixed ``to_e_``.
    """
    e = edges
    if rels is not None:
        e = e.filter(F.col("rel").isin([rels] if isinstance(rels, str) else list(rels)))
    here, there = ("dst", "src") if reverse else ("src", "dst")
    step = _prefixed(e, f"{to}_e")
    target = _prefixed(right, to)
    if how == "inner":  # what the pattern has left so far decides which edges matter, and those which targets
        return left.join(step, left[at] == step[f"{to}_e_{here}"]).join(target, F.col(f"{to}_e_{there}") == target[f"{to}_node_id"]).select(*left.columns, *[c for c in (*step.columns, *target.columns) if c != f"{to}_e_{here}"])
    reach = step.join(target, step[f"{to}_e_{there}"] == target[f"{to}_node_id"])
    return left.join(reach, left[at] == reach[f"{to}_e_{here}"], how).drop(f"{to}_e_{here}")


def start(nodes: DataFrame, name: str) -> DataFrame:
    """The first node of a pattern, its columns prefixed."""
    return _prefixed(nodes, name)


def exists_any(nodes: DataFrame, key: str, *patterns: DataFrame) -> DataFrame:
    """Nodes for which at least one pattern holds; each pattern is a frame with the column ``key``.

    OR over EXISTS as one semi-join against the union of the keys.
    """
    keys = reduce(lambda a, b: a.unionByName(b), [p.select(key) for p in patterns])
    return nodes.join(keys, key, "left_semi")


def not_exists(nodes: DataFrame, key: str, *patterns: DataFrame) -> DataFrame:
    """Nodes for which no pattern holds; a node whose key is null stays."""
    keys = reduce(lambda a, b: a.unionByName(b), [p.select(key) for p in patterns])
    return nodes.join(keys, key, "left_anti")


def optional_sets(nodes: DataFrame, key: str, **sides: DataFrame) -> DataFrame:
    """Several optional matches at once: each side, a frame of (key, value), comes as a sorted set.

    Sides are aggregated before they are joined, so they do not multiply one another.
    """
    out = nodes
    for name, side in sides.items():
        k, v = side.columns
        sets = side.groupBy(F.col(k).alias(key)).agg(F.sort_array(F.collect_set(v)).alias(name))
        out = out.join(sets, key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(sets.schema[name].dataType)))
    return out


def single_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, rel, dst), the least of its other properties kept."""
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    if not rest:
        return edges.distinct()
    return edges.groupBy("src", "rel", "dst").agg(F.min(F.struct(*rest)).alias("x")).select("src", "rel", "dst", "x.*")


# ---- writing


def upsert_nodes(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces nodes by id and, as the old node goes with all its edges, drops the edges at either end."""
    ids = new.select("node_id").distinct()
    kept = nodes.join(ids, "node_id", "left_anti").unionByName(new, allowMissingColumns=True)
    return kept, detach(edges, ids)


def insert_ignore(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Adds nodes whose id is not there yet; repeats within ``new`` count once, the least row."""
    cols = [c for c in new.columns if c != "node_id"]
    once = new.groupBy("node_id").agg(F.min(F.struct(*cols)).alias("x")).select("node_id", "x.*") if cols else new.distinct()
    return nodes.unionByName(once.join(nodes.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)


def detach(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids`` (column node_id)."""
    return edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes nodes with all their edges."""
    return nodes.join(ids.select("node_id"), "node_id", "left_anti"), detach(edges, ids)


def delete_by_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame, column: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Deletes the symbols of files (column of ``paths``: file_path) with their edges."""
    gone = nodes.join(paths.select(F.col("file_path").alias(column)), column, "left_semi").select("node_id")
    return detach_delete(nodes, edges, gone)


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, legal: DataFrame | None = None, multi: bool = False) -> DataFrame:
    """Adds edges whose two ends exist and, where ``legal`` (rel, src_label, dst_label) is given, whose pair of labels is declared.

    Without ``multi`` an edge replaces those of the same (src, rel, dst).
    """
    ends = new.join(nodes.select(F.col("node_id").alias("src"), F.col("label").alias("src_label")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    if legal is not None:
        ends = ends.join(legal, ["rel", "src_label", "dst_label"], "left_semi")
    ok = ends.drop("src_label", "dst_label").select(*new.columns)
    if multi:
        return edges.unionByName(ok, allowMissingColumns=True)
    return edges.join(ok.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti").unionByName(single_edges(ok), allowMissingColumns=True)


def undeclared_pairs(edges: DataFrame, nodes: DataFrame, legal: DataFrame) -> DataFrame:
    """(rel, src_label, dst_label, n) of edges between labels that no declaration allows."""
    e = edges.join(nodes.select(F.col("node_id").alias("src"), F.col("label").alias("src_label")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    return e.join(legal, ["rel", "src_label", "dst_label"], "left_anti").groupBy("rel", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots by a hash of the columns ``digest``."""
    h = lambda df, n: df.select(key, F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in digest]), 256).alias(n))
    both = h(old, "a").join(h(new, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


# ---- aggregation forms


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_out, n_in): both directions in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node_id").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order.

    A group is cut into parts by a hash of the row, of which each gives its first ``n``, so that one
    huge group is not one task.
    """
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(TOP_PARTS))
    first = df.withColumn("_p", part).withColumn("_r", F.row_number().over(W.partitionBy(*group, "_p").orderBy(*order))).filter(F.col("_r") <= n).drop("_r", "_p")
    return first.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def mode_of(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least one on ties; null values do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("x"))
    return best.select(*group, F.col(f"x.{value}").alias(value), (-F.col("x.m")).alias("n"))


def fan_in(sites: DataFrame, target: str, unit: str, layer: str, min_units: int, min_layers: int, high_units: int, high_layers: int) -> DataFrame:
    """Targets used from many places: (target, n_units, n_layers, severity) above both thresholds, HIGH beyond either higher one."""
    x = sites.groupBy(target).agg(F.count_distinct(unit).alias("n_units"), F.count_distinct(layer).alias("n_layers"))
    x = x.filter((F.col("n_units") >= min_units) & (F.col("n_layers") >= min_layers))
    return x.withColumn("severity", F.when((F.col("n_units") >= high_units) | (F.col("n_layers") >= high_layers), "HIGH").otherwise("MEDIUM"))


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, rounded; zero when there is nothing to divide by."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))
