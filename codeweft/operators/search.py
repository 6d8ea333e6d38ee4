"""Hybrid search: BM25, cosine and fuzzy lists merged by weighted reciprocal ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeweft.skew import global_rank

#: Documented defaults of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Weights of the lists and the constant of the ranks.
WEIGHTS, RRF_K = {"bm25": 0.4, "vector": 0.4, "fuzzy": 0.2}, 60
BOOSTS = {"vendor": 0.1, "test": 0.5, "app": 1.2}


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def symbol_corpus(symbols: DataFrame, doc: str | None = None) -> DataFrame:
    """(id, text): name, fqn with spaces for separators, the first 200 characters of the documentation and the role, lower-cased."""
    parts = [F.col("name"), F.translate("fqn", "\\:", "  ")]
    if doc:
        parts.append(F.substring(doc, 1, 200))
    if "laravel_role" in symbols.columns:
        parts.append(F.col("laravel_role"))
    return symbols.select(F.col("node_id").alias("id"), F.lower(F.concat_ws(" ", *parts)).alias("text"))


def bm25(corpus: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(key, score) of the documents with a positive score, divided by the greatest.

    Okapi BM25; a term in more than half of the documents has ``epsilon`` times the average
    idf. The corpus is read once for its statistics (one row, fetched) and once for its scores;
    only a query with such a frequent term needs the frequencies of all terms, and only then they
    are counted. A query without words finds nothing.
    """
    terms = sorted({t for t in query.lower().split() if t})
    if not terms:
        return corpus.select(key, F.lit(0.0).alias("score")).limit(0)
    t = tokens(F.col(text))
    same = lambda w: lambda x: x == F.lit(w)
    tf = [F.size(F.filter(t, same(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    d = corpus.select(key, F.size(t).alias("n"), *tf)
    total = d.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    docs, avgdl = total["docs"], total["avgdl"] or 1.0
    weights = [math.log(docs - df + 0.5) - math.log(df + 0.5) if (df := total[f"df{i}"] or 0) else 0.0 for i in range(len(terms))]
    if min(weights) < 0:
        vocabulary = corpus.select(F.explode(F.array_distinct(t)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        mean = vocabulary.agg(F.avg(F.log(F.lit(docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("m")).first()["m"]
        weights = [w if w >= 0 else epsilon * mean for w in weights]
    score = F.lit(0.0)
    for i, w in enumerate(weights):
        f = F.col(f"tf{i}")
        score = score + F.lit(w) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.lit(avgdl)))
    s = d
    found = s.select(key, score.alias("raw")).filter("raw > 0")
    return found.crossJoin(F.broadcast(found.agg(F.max("raw").alias("top")))).select(key, (F.col("raw") / F.col("top")).alias("score"))


def cosine(vectors: DataFrame, query: Sequence[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): cosine of each vector with the query, positive ones only; vectors of another length have none."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, c: a.cast("double") * c), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    qn = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.filter(F.size(vector) == len(query)).select(key, (dot / (norm * F.lit(qn) + 1e-10)).alias("score")).filter("score > 0")


def fuzzy(names: DataFrame, query: str, key: str, name: str, cutoff: float = 60.0, limit: int = 50) -> DataFrame:
    """(key, score): likeness of names to a query from 0 to 100, by edit distance, from ``cutoff`` on, the best ``limit``."""
    a, q = F.lower(F.coalesce(name, F.lit(""))), F.lit(query.lower())
    longest = F.greatest(F.length(a), F.length(q))
    score = F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, q) / longest)).otherwise(100.0)
    return names.select(key, score.alias("score")).filter(F.col("score") >= cutoff).orderBy(F.desc("score"), key).limit(limit)


def rrf(lists: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, k: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, score): sum over the lists of weight / (k + rank), every entry of each list counted.

    ``by`` names the columns that tell apart rankings, as one for each query. A list without a
    weight counts with 1. Equal scores rank by the key; null scores are no entries.
    """
    weights = WEIGHTS if weights is None else weights
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(*by, key, "score", F.lit(n).alias("_list"), F.lit(float(weights.get(n, 1.0))).alias("_w")) for n, df in lists.items()]).filter("score is not null")
    ranked = global_rank(rows, [*by, "_list"], [F.desc("score"), F.col(key)], "_r")
    return ranked.groupBy(*by, key).agg(F.sum(F.col("_w") / (k + F.col("_r"))).alias("score"))


def boosted(hits: DataFrame, path: Column, boosts: dict[str, float] | None = None) -> DataFrame:
    """Scores weighed by the kind of path: third-party, test or other."""
    b = boosts or BOOSTS
    factor = F.when(path.contains("vendor/"), b["vendor"]).when(F.lower(path).contains("test"), b["test"]).when(path.isNotNull() & (path != ""), b["app"]).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def page(hits: DataFrame, key: str, limit: int, keep: Column | None = None, compat: bool = True) -> DataFrame:
    """The first ``limit`` hits and of those the ones to keep; without ``compat`` the filter comes first, so the page is full."""
    order = [F.desc("score"), F.col(key)]
    if keep is None:
        return hits.orderBy(*order).limit(limit)
    if compat:
        return hits.orderBy(*order).limit(limit).filter(keep)
    return hits.filter(keep).orderBy(*order).limit(limit)


def grouped_by_flow(hits: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """(flow, n_hits, best): hits by their first flow, by id; those of none under null."""
    first = steps.groupBy(key).agg(F.min("flow").alias("flow"))
    return hits.join(first, key, "left").groupBy("flow").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"))


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k nearest of each query vector by cosine, the query itself left out.

    A stated set of queries goes in blocks of bounded size to the executors, which scan all
    vectors in Arrow batches and keep the best k of each batch; ties go to the least key.
    """
    import numpy as np
    import pandas as pd

    block = 2_000
    kind = dict(vectors.dtypes)[key]
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // block))):
        part = queries.select(key, vector) if n <= block else queries.select(key, vector).filter(F.pmod(F.xxhash64(key), F.lit(-(-n // block))) == b)
        rows = part.collect()
        if not rows:
            continue
        ids = np.array([r[key] for r in rows])
        q = np.array([r[vector] for r in rows], dtype=np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-10
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, sent=sent):
            ids, q = sent.value
            for x in batches:
                if not len(x):
                    continue
                v = np.array(x[vector].tolist(), dtype=np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
                keys = x[key].to_numpy()
                s = np.round(q @ v.T, 9)
                s[keys[None, :] == ids[:, None]] = -np.inf  # a query is no neighbour of itself
                n = min(k, len(keys))
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                row, col = np.nonzero(s >= least[:, None])  # the best n of each query and what ties with the last
                ok = np.isfinite(s[row, col])
                row, col = row[ok], col[ok]
                order = np.lexsort((keys[col], -s[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pd.DataFrame({"query_id": ids[row], key: keys[col], "score": s[row, col]})

        found = vectors.select(key, vector).mapInPandas(run, f"query_id {kind}, `{key}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", r).filter(F.col("rank") <= k)
