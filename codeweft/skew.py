"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 256
#: Hot keys of tables smaller than this are not worth salting.
HOT_MIN_ROWS = 100_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The keys that hold more than ``share`` of all rows: at most ``1/share`` rows, so safe to broadcast.

    Counts are combined before the shuffle. A key with a null part is never hot, as it joins nothing.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    found = counts.crossJoin(F.broadcast(total))  # one row
    ok = F.col("_n") > F.greatest(F.col("_total") * F.lit(share), F.lit(min_rows))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return found.filter(ok).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS, share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS, hot: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Equi-join in which the rows of ``left`` under a hot key are spread over ``salts`` sub-keys.

    The few matching rows of ``right`` are repeated once per sub-key. ``how`` may be inner, left,
    left_semi or left_anti. The salt is a hash of the row, so a retried task deals rows out alike.
    ``hot`` takes the hot keys where they are known, as from :func:`hot_keys` of the same rows;
    ``most`` a number that the rows of ``left`` cannot exceed: with too few for a hot key none is looked for.
    """
    if most is not None and most <= min_rows:
        return left.join(right, list(keys), how)
    known = hot_keys(left, keys, share, min_rows) if hot is None else hot
    hot = F.broadcast(known.withColumn("_hot", F.lit(True)))
    plain = [c for c, t in left.dtypes if not t.startswith("map")]
    lhs = left.join(hot, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    every = F.array(*[F.lit(i) for i in range(salts)])
    rhs = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")


def grouped_rank(df: DataFrame, group: Sequence[str], score: str, order: Sequence[Column], rank: str, bins: int = 256) -> DataFrame:
    """Row number within ``group`` by ``score`` descending and then ``order``, for a score in [0, 1].

    A group is cut into ``bins`` score ranges that are ranked apart and offset by the rows in
    the ranges above, so a group with a third of all rows is not one task. Null scores come last.
    """
    b = df.withColumn("_bin", F.coalesce(F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (bins - 1)), F.lit(-1)).cast("int"))
    sizes = b.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    above = sizes.withColumn("_above", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy(*group, "_bin").orderBy(F.desc_nulls_last(score), *order)
    ranked = b.withColumn("_in", F.row_number().over(inner))
    return ranked.join(above.drop("_n"), [*group, "_bin"]).withColumn(rank, (F.col("_in") + F.col("_above")).cast(T.LongType())).drop("_in", "_above", "_bin")


def global_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """Row number within each group of ``by`` in ``order``, also for one group of all rows.

    The rows are sorted by range over all tasks and written; the place of a row is that in its task
    plus the rows of the tasks before, so no group is one task, however many rows or ties it has.
    ``order`` must be total within a group.
    """
    from codeweft.session import cut

    at = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    s = cut(df.orderBy(*by, *order).select("*", F.shiftright(at, 33).alias("_task"), at.bitwiseAND(low).alias("_in")), "ranked")
    sizes = s.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = sizes.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = s.join(F.broadcast(before), "_task").withColumn("_at", F.col("_before") + F.col("_in")).drop("_task", "_in", "_before")
    if not by:
        return placed.withColumn(rank, F.col("_at") + 1).drop("_at")
    first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
    return placed.join(first, list(by)).withColumn(rank, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
