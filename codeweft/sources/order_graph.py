"""The order tables as a property graph: customers place orders, orders contain parts, parts come from suppliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.graph import node_id
from codeweft.sources.tables import table

#: label -> (table, key, name, columns kept)
LABELS = {
    "Region": ("region", "r_regionkey", "r_name", ()), "Nation": ("nation", "n_nationkey", "n_name", ()), "Customer": ("customer", "c_custkey", "c_name", ("c_mktsegment", "c_acctbal")),
    "Supplier": ("supplier", "s_suppkey", "s_name", ("s_acctbal",)), "Part": ("part", "p_partkey", "p_name", ("p_brand", "p_type", "p_size")), "Order": ("orders", "o_orderkey", None, ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
}
#: (relation, table, source label, source key, target label, target key, properties)
RELATIONS = (
    ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey", ()), ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", ("l_linenumber", "l_quantity")),
    ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey", ()), ("LOCATED_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey", ()),
    ("LOCATED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", ()), ("LOCATED_IN", "nation", "Nation", "n_nationkey", "Region", "n_regionkey", ()),
)


def nodes(spark: SparkSession, folder: str, *labels: str) -> DataFrame:
    """(node_id, label, name, ...) of the labels, or of all; only the tables asked for are read."""
    parts = []
    for label in labels or LABELS:
        t, key, name, more = LABELS[label]
        parts.append(table(spark, folder, t).select(node_id(label, F.col(key)).alias("node_id"), F.lit(label).alias("label"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"), *more))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def edges(spark: SparkSession, folder: str, *rels: str) -> DataFrame:
    """(src, rel, dst, ...) of the relations, or of all; one edge for each row they come from."""
    parts = []
    for rel, t, a, ak, b, bk, more in RELATIONS:
        if not rels or rel in rels:
            parts.append(table(spark, folder, t).select(node_id(a, F.col(ak)).alias("src"), F.lit(rel).alias("rel"), node_id(b, F.col(bk)).alias("dst"), *more))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
