"""Analytics over the graph: coupling, clusters, links, communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeweft.operators.graph import mode_of, top_n
from codeweft.operators.labels import labelled
from codeweft.session import cut, discard, rows as rows_of, seen
from codeweft.skew import global_rank, salted_join

#: Label propagation over at most so many links runs in one task; it changes the plan, not the rows.
TASK_LINKS = 5_000_000


def co_change(changes: DataFrame, group: str, item: str, min_strength: float = 0.3, max_items: int | None = None) -> DataFrame:
    """(a, b, co_changes, total_a, total_b, strength) of items that change together.

    ``changes`` has one row for an item in a commit. Strength is the common commits over the
    greater total; commits with one item count nowhere. ``max_items`` leaves out commits with more
    items, which say little and make many pairs; without it every commit counts.
    """
    rows = changes.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    if max_items is not None:
        sizes = sizes.filter(F.col("n") <= max_items)
    rows = rows.join(sizes.select("g"), "g", "left_semi")
    totals = rows.groupBy("i").agg(F.count(F.lit(1)).alias("total"))
    # items have no more commits in common than the rarer one has, so unlike totals need not meet
    rows = rows.join(totals, "i")
    fit = F.least("total_a", "total_b") >= F.floor(F.lit(min_strength - 5e-5) * F.greatest("total_a", "total_b"))
    met = rows.select("g", F.col("i").alias("a"), F.col("total").alias("total_a")).join(rows.select("g", F.col("i").alias("b"), F.col("total").alias("total_b")), "g").filter((F.col("a") < F.col("b")) & fit)
    x = met.groupBy("a", "b", "total_a", "total_b").agg(F.count(F.lit(1)).alias("co_changes"))
    return x.withColumn("strength", F.round(F.col("co_changes") / F.greatest("total_a", "total_b"), 4)).filter(F.col("strength") >= min_strength).select("a", "b", "co_changes", "total_a", "total_b", "strength")


def inferred_links(evidence: DataFrame, column: str = "column", target: str = "target", confidence: str = "confidence", least: float = 0.2) -> DataFrame:
    """(column, target, n_evidence, confidence): evidence for a foreign key added up.

    The average confidence plus 0.05 for each further piece of evidence, at most four, never above 1.
    """
    x = evidence.filter(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(column, target).agg(F.count(F.lit(1)).alias("n_evidence"), F.avg(confidence).alias("mean"))
    score = F.least(F.lit(1.0), F.col("mean") + 0.05 * F.least(F.col("n_evidence") - 1, F.lit(4)))
    return x.withColumn("confidence", F.round(score, 6)).drop("mean").filter(F.col("confidence") >= least)


def first_of(candidates: Sequence[tuple[DataFrame, int]], key: str, order: Sequence[Column]) -> DataFrame:
    """Lookup with a chain of fallbacks: of all candidates for a key the one of least priority, then of ``order``."""
    rows = None
    for df, prio in candidates:
        part = df.withColumn("prio", F.lit(prio))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return top_n(rows, [key], [F.col("prio"), *order], 1)


def enclosing(sites: DataFrame, spans: DataFrame, by: str, at: str, begin: str, end: str) -> DataFrame:
    """As-of join: each site gets the span of its group with the greatest begin not after it, if it also ends after it.

    The nearest begin is chosen first and its end looked at then, so that of nested spans the
    inner one decides. Sites and spans are merged in one sort by (group, place), which needs one
    shuffle and no pairs. Sites of a null group or place have no span.
    """
    s = sites.select(F.col(by).alias("_g"), F.col(at).alias("_at"), F.lit(1).alias("_k"), F.struct(*sites.columns).alias("site"))
    span = F.struct(*spans.columns)
    p = spans.filter(F.col(begin).isNotNull()).select(F.col(by).alias("_g"), F.col(begin).alias("_at"), F.lit(0).alias("_k"), span.alias("span"))
    both = s.unionByName(p, allowMissingColumns=True)
    w = W.partitionBy("_g").orderBy("_at", "_k", "span").rowsBetween(W.unboundedPreceding, 0)  # equal begins: the greatest span
    last = both.withColumn("span", F.last("span", ignorenulls=True).over(w)).filter("_k = 1")
    ok = F.col(f"span.{end}") >= F.col("_at")
    held = last.select("site.*", *[F.when(ok & F.col("_g").isNotNull() & F.col("_at").isNotNull(), F.col(f"span.{c}")).alias(f"span_{c}") for c in spans.columns])
    return held


def longest_match(left: DataFrame, tokens: DataFrame, key: str, text: str, token: str) -> DataFrame:
    """Each left row with the token it equals, else the longest it contains, else one with the same first four letters.

    Ties go to the least token; null and empty tokens match nothing. Texts are cut into the pieces
    of the lengths that tokens have, so that containing is an equi-join and no pairs are compared.
    """
    t = tokens.select(F.col(token).alias("_t")).filter("_t <> ''").distinct()
    lengths = sorted(r["n"] for r in t.select(F.length("_t").alias("n")).distinct().collect())  # one number a length
    c = left.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_c")).distinct()
    pieces = c.select(key, "_c", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_n")).filter(F.col("_n") <= F.length("_c"))
    held = pieces.select(key, "_c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_c") - F.col("_n") + 1), lambda i: F.substring("_c", i, F.col("_n"))))).alias("_t")).join(t, "_t")
    whole = held.select(key, "_t", F.when(F.col("_c") == F.col("_t"), 0).otherwise(1).alias("_k"))
    heads = t.filter(F.length("_t") >= 4).groupBy(F.substring("_t", 1, 4).alias("_h")).agg(F.max_by("_t", F.struct(F.length("_t"))).alias("_any"), F.max(F.length("_t")).alias("_m"))
    longest = t.filter(F.length("_t") >= 4).select("_t", F.substring("_t", 1, 4).alias("_h")).join(heads.select("_h", "_m"), "_h").filter(F.length("_t") == F.col("_m")).groupBy("_h").agg(F.min("_t").alias("_t"))
    near = c.select(key, F.substring("_c", 1, 4).alias("_h")).join(longest, "_h").select(key, "_t", F.lit(2).alias("_k"))
    best = whole.unionByName(near).groupBy(key).agg(F.min_by(F.struct(F.col("_t").alias("token"), F.col("_k").alias("k")), F.struct("_k", -F.length("_t"), "_t")).alias("x"))
    return best.select(key, "x.token", F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("prefix")), F.col("x.k") + 1).alias("match_type"))


def typed_pairs(columns: DataFrame) -> DataFrame:
    """(table, base): tables with both base_id and base_type, the mark of a polymorphic link."""
    ids = columns.filter(F.col("column").endswith("_id")).select("table", F.regexp_replace("column", "_id$", "").alias("base"))
    types = columns.filter(F.col("column").endswith("_type")).select("table", F.regexp_replace("column", "_type$", "").alias("base"))
    return ids.join(types, ["table", "base"], "left_semi").distinct()


def model_tables(models: DataFrame, tables: DataFrame) -> DataFrame:
    """(model_id, repo, table_key, source): the table of each model, a live one before one of a migration, else a stub."""
    rank = F.when(F.col("source") == "live_db", 0).when(F.col("source") == "migration", 1).otherwise(2)
    best = tables.groupBy("repo", "table_key").agg(F.min_by("source", F.struct(rank, "source")).alias("source"))
    return models.join(best, ["repo", "table_key"], "left").select("model_id", "repo", "table_key", F.coalesce("source", F.lit("stub")).alias("source"))


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by label propagation on the undirected multigraph, deterministic, until nothing moves.

    A node takes the label with most edges to it, its own counting once more, the least on ties.
    Of the nodes that would move only those move in a round whose hash, new each round, is the
    least among their neighbours that would. No two neighbours move at once, so each move adds
    to the edges within communities and the rounds come to an end by themselves. The nodes are
    numbered in the order of their names; up to ``TASK_LINKS`` links all rounds are gone over in
    one task, more in jobs, with the same rows.
    """
    named = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    named = cut(named, "edges")
    nodes = cut(global_rank(named.select(F.explode(F.array("a", "b")).alias("name")).distinct(), [], [F.col("name")], "node").select("name", (F.col("node") - 1).alias("node")), "nodes")
    links = named
    for end in ("a", "b"):
        links = salted_join(links, nodes.select(F.col("name").alias(end), F.col("node").alias(f"_{end}")), [end], most=rows_of(named)).drop(end)
    links = cut(links.groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.count(F.lit(1)).alias("w")), "links")
    discard(named)
    if rows_of(links) <= TASK_LINKS:
        both = links.unionByName(nodes.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.xxhash64("name").alias("w")))
        label = cut(both.coalesce(1).mapInArrow(labelled, "node long, community long"), "label")
    else:
        label = _labels_in_jobs(links, nodes)
    discard(links)
    label = label.join(nodes, "node").select("name", F.col("community").alias("node")).withColumnRenamed("name", "_own")
    return salted_join(label, nodes, ["node"]).select(F.col("_own").alias("node"), F.col("name").alias("community"))


def _labels_in_jobs(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community) of numbered nodes: the rounds of :func:`communities`, each in jobs.

    After the first round only the nodes beside one that moved, and that one, are counted again.
    """
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "both")
    label = cut(nodes.select("node", "name", F.col("node").alias("community"), F.col("node").alias("to")), "label")
    beside, r = None, 0
    while True:
        near = both if beside is None else both.join(beside.select(F.col("node").alias("a")), "a", "left_semi")
        own = label if beside is None else label.join(beside, "node", "left_semi")
        votes = near.join(label.select(F.col("node").alias("b"), "community"), "b").select(F.col("a").alias("node"), "community", "w")
        votes = votes.unionByName(own.select("node", "community", F.lit(1).cast("long").alias("w")))
        best = votes.groupBy("node", "community").agg(F.sum("w").alias("w")).groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("x"))
        new = cut(label.join(best.select("node", F.col("x.community").alias("best")), "node", "left").select("node", "name", "community", F.coalesce("best", "to").alias("to")), "label", would=F.count_if(F.expr("to <> community")))
        discard(label, beside)
        if seen(new, "would") == 0:
            discard(both)
            return new.select("node", "community")
        would = new.filter("to <> community").select("node", "to", F.xxhash64("name", F.lit(r)).alias("h"))
        met = both.join(would.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(would.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        held = met.filter("hb < ha or (hb = ha and b < a)").select(F.col("a").alias("node")).distinct()
        moved = cut(would.join(held, "node", "left_anti").select("node", "to"), "moved")
        label = cut(new.join(moved.select("node", F.col("to").alias("taken")), "node", "left").select("node", "name", F.coalesce("taken", "community").alias("community"), "to"), "label")
        beside = cut(both.join(moved.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).unionByName(moved.select("node")).distinct(), "beside")
        discard(new, moved)
        r += 1


def community_names(members: DataFrame, namespace: Column) -> DataFrame:
    """(community, name): the most frequent namespace of the members, its last two parts."""
    m = mode_of(members.withColumn("_ns", namespace), ["community"], "_ns")
    parts = F.split("_ns", r"\\")
    return m.select("community", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "\\").alias("name"))


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """Modularity of a partition of the undirected multigraph."""
    e = edges.filter("src <> dst").select("src", "dst")
    m = e.count()
    if m == 0:
        return 0.0
    x = e.join(label.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(label.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
    inside = x.filter("ca = cb").count()
    degree = x.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("s")).first()["s"] or 0
    return inside / m - degree / (4.0 * m * m)


def test_links(tests: DataFrame, routes: DataFrame, classes: DataFrame) -> DataFrame:
    """(test_id, target, kind): what tests exercise.

    ``tests`` has (test_id, uris, class_refs), ``routes`` (route_id, uri), ``classes`` (class_id,
    name). A uri meets the route of the same uri, else the longest route it begins with or that
    begins with it; a class reference meets the least class of that name.
    """
    uri = tests.select("test_id", F.explode("uris").alias("uri")).distinct()
    exact = uri.join(routes, "uri").select("test_id", "uri", "route_id", F.lit(0).alias("prio"), F.length("uri").alias("n"))
    # prefixes of either side become keys, so this is an equi-join
    cuts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(c, "/")), F.lit(1))), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    down = uri.withColumn("key", F.explode(cuts(F.col("uri")))).join(routes.select(F.col("uri").alias("key"), "route_id"), "key").select("test_id", "uri", "route_id", F.lit(1).alias("prio"), F.length("key").alias("n"))
    up = routes.select("route_id", F.col("uri").alias("r"), F.explode(cuts(F.col("uri"))).alias("uri")).join(uri, "uri").select("test_id", "uri", "route_id", F.lit(1).alias("prio"), F.length("uri").alias("n"))
    met = exact.unionByName(down.filter("n > 1")).unionByName(up.filter("n > 1"))
    by_uri = met.groupBy("test_id", "uri").agg(F.min_by("route_id", F.struct("prio", -F.col("n"), "route_id")).alias("target")).select("test_id", "target", F.lit("route").alias("kind"))
    refs = tests.select("test_id", F.explode("class_refs").alias("name")).distinct()
    by_class = refs.join(classes.groupBy("name").agg(F.min("class_id").alias("target")), "name").select("test_id", "target", F.lit("class").alias("kind"))
    return by_uri.unionByName(by_class).distinct()
