"""Which parse of a symbol holds, and which symbols are alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import class_key


def latest(df: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; a null in ``order`` is the least value.

    One aggregation with map-side combine instead of a window, so a key with many repeats is
    reduced before the shuffle. Rows with a null key fall away.
    """
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    best = F.max_by(F.struct(*take), F.struct(*order)).alias("_row")
    return df.filter(ok).groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in take if c not in keys])


def living_symbols(parsed_classes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``key`` and the chosen columns of every living symbol.

    The row with the greatest (parsed_at, class_id) of a name holds; a symbol whose row that
    holds has removed_at is gone. Names that are null or blank declare nothing.
    """
    take = ["class_id", "fqn", "removed_at", *[c for c in (extra or []) if c not in ("class_id", "fqn", "removed_at")]]
    df = parsed_classes.select(class_key(F.col("fqn")).alias("key"), "parsed_at", *take)
    return latest(df, ["key"], ["parsed_at", "class_id"], take).filter(F.col("removed_at").isNull()).drop("removed_at")
