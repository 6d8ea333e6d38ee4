"""One ranking from several differently scaled scores: closeness to the ideal point."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.skew import grouped_rank, hot_keys, salted_join

SCORES = ("bm25_score", "vector_score", "fuzzy_score")
#: Share of the values of a query cut off at either end before scaling.
WINSOR = 0.05
#: Entries of the quantile sketch of a query and score.
ACCURACY = 10_000
#: Allowance for rounding when two values of closeness are compared.
SLACK = 1e-9


def present(c: Column) -> Column:
    """A score, or null where the strategy did not return the hit (null, NaN, 0.0)."""
    return F.when(~F.isnan(c) & (c != 0.0), c)


def ideal_point(hits: DataFrame, query: str = "query_id", item: str = "node_id", scores: Sequence[str] = SCORES, weights: Sequence[float] | None = None, winsor: float = WINSOR) -> DataFrame:
    """(query, item, scores, closeness, floor, n_above) of each distinct hit of each query.

    Repeats of an item in a query are one hit with the best of each score. Scores are winsorised
    at the ``winsor`` quantiles of their query, divided by their vector norm and compared with
    the best and the worst value of the query; closeness is the weighted distance from the worst
    point over that from both. An absent score counts as the worst, a query whose hits are all
    alike gives 0.5. ``floor`` is the closeness of the point made of the second greatest value of
    each score of the query: distances change one way with each score, so no hit that is first or
    second in every score is less close. ``n_above`` is the greatest number, over the scores and
    counting no further than two, of hits strictly above this one; null where a score is absent. Rows
    without a query or an item are left out. Statistics of a query are combined before the
    shuffle and joined back with hot queries salted, so no query is one task.
    """
    weights = list(weights or [1.0] * len(scores))
    cols = [f"s{i}" for i in range(len(scores))]
    rows = hits.filter(F.col(query).isNotNull() & F.col(item).isNotNull()).select(F.col(query).alias("q"), F.col(item).alias("i"), *[present(F.col(s).cast("double")).alias(c) for s, c in zip(scores, cols)])
    best = rows.groupBy("q", "i").agg(*[F.max(c).alias(c) for c in cols])
    first = best.groupBy("q").agg(*[x for c in cols for x in (F.max(c).alias(f"{c}_max"), F.percentile_approx(c, [winsor, 1 - winsor], ACCURACY).alias(f"{c}_cut"))])
    hot = hot_keys(best, ["q"])
    with_first = salted_join(best, first, ["q"], hot=hot)
    clipped = with_first.withColumns({f"{c}_w": F.least(F.greatest(F.col(c), F.col(f"{c}_cut")[0]), F.col(f"{c}_cut")[1]) for c in cols})
    second = clipped.groupBy("q").agg(
        *[
            x
            for c in cols
            for x in (
                F.sqrt(F.sum(F.col(f"{c}_w") * F.col(f"{c}_w"))).alias(f"{c}_norm"), F.max(f"{c}_w").alias(f"{c}_best"), F.min(f"{c}_w").alias(f"{c}_worst"),
                F.count(F.when(F.col(c) == F.col(f"{c}_max"), 1)).alias(f"{c}_n"), F.max(F.when(F.col(c) < F.col(f"{c}_max"), F.col(c))).alias(f"{c}_next"),
            )
        ]
    )
    x = salted_join(clipped, second, ["q"], hot=hot)
    near, far, above = F.lit(0.0), F.lit(0.0), []
    near2, far2 = F.lit(0.0), F.lit(0.0)
    for c, w in zip(cols, weights):
        norm = F.when(F.col(f"{c}_norm") > 0, F.col(f"{c}_norm"))
        value = F.coalesce(F.col(f"{c}_w"), F.col(f"{c}_worst"))
        near = near + F.lit(w) * F.coalesce(F.pow((F.col(f"{c}_best") - value) / norm, 2), F.lit(0.0))
        far = far + F.lit(w) * F.coalesce(F.pow((value - F.col(f"{c}_worst")) / norm, 2), F.lit(0.0))
        second_ = F.when((F.col(f"{c}_n") > 1) | F.col(f"{c}_next").isNull(), F.col(f"{c}_max")).otherwise(F.col(f"{c}_next"))
        second_ = F.least(F.greatest(second_, F.col(f"{c}_worst")), F.col(f"{c}_best"))
        near2 = near2 + F.lit(w) * F.coalesce(F.pow((F.col(f"{c}_best") - second_) / norm, 2), F.lit(0.0))
        far2 = far2 + F.lit(w) * F.coalesce(F.pow((second_ - F.col(f"{c}_worst")) / norm, 2), F.lit(0.0))
        # 0: at the greatest value; 1: one hit above; 2: two or more
        over = F.when(F.col(c) == F.col(f"{c}_max"), 0).when((F.col(c) == F.col(f"{c}_next")) & (F.col(f"{c}_n") == 1), 1).otherwise(2)
        above.append(F.when(F.col(c).isNotNull(), over))
    relative = lambda a, b: F.when(a + b > 0, b / (a + b)).otherwise(F.lit(0.5))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return x.select(
        F.col("q").alias(query), F.col("i").alias(item), *[F.col(c).alias(s) for c, s in zip(cols, scores)],
        relative(F.sqrt(near), F.sqrt(far)).alias("closeness"), relative(F.sqrt(near2), F.sqrt(far2)).alias("floor"), F.when(whole, F.greatest(*above)).alias("n_above"),
    )


def ranking(hits: DataFrame, query: str = "query_id", item: str = "node_id", scores: Sequence[str] = SCORES) -> DataFrame:
    """(query, item, closeness, rank, n_above): every hit of a query once, the closest to the ideal point first; ties by item."""
    return grouped_rank(ideal_point(hits, query, item, scores).select(query, item, "closeness", "n_above"), [query], "closeness", [F.col(item)], "rank")


def heads(hits: DataFrame) -> DataFrame:
    """(query_id, node_id) of the hits that have all three scores and in each at most one other hit of the query strictly above.

    Closeness decides first: only hits at least as close to the ideal point as the second greatest
    values of the query can belong to the head, and those are then counted exactly. An absent
    score means that the strategy did not return the hit, so it has no place in that list, as it
    also counts as the worst there for the closeness; such a hit belongs to no head.
    """
    near = ideal_point(hits).filter(F.col("closeness") >= F.col("floor") - SLACK)
    return near.filter(F.col("n_above") <= 1).select("query_id", "node_id")
