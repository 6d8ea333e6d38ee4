"""Questions people ask of a code graph, each a lazy frame over nodes and edges.

All tools take the frames of :class:`codeweft.sources.code_graph.CodeGraph` or of any graph of
the same shape. Reports are ordered and whole; ``limit`` cuts one only where the caller says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import fixed, naming
from codeweft.operators import analytics, traverse
from codeweft.operators.graph import ratio

KINDS = ("Class_", "Trait_", "Interface_", "Enum_")
#: Relations by which a change reaches the users of a symbol, and those by which it reaches further.
USERS = ("CALLS", "USES_TYPE", "EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT", "ROUTES_TO")
REACH = ("CALLS", "DISPATCHES", "QUERIES_TABLE")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): labels and relations with their numbers."""
    a = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def find(nodes: DataFrame, text: str) -> DataFrame:
    """(node_id, label, name, prio) of what a text may mean, best first: id, qualified name, name, part of a qualified name."""
    t = text.lower()
    key = F.lower(F.coalesce("fqn", F.lit("")))
    prio = F.when(F.col("node_id") == text, 0).when(key == t, 1).when(F.lower("name") == t, 2).when(key.contains(t), 3)
    return nodes.select("node_id", "label", "name", "fqn", prio.alias("prio")).filter("prio is not null").orderBy("prio", F.length("fqn"), "node_id").select("node_id", "label", "name", "prio")


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, direction, rel, other, other_label, other_name, n): everything one step from each seed (column node_id)."""
    out = edges.select(F.col("src").alias("node_id"), F.lit("out").alias("direction"), "rel", F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("node_id"), F.lit("in").alias("direction"), "rel", F.col("src").alias("other"))
    near = out.unionByName(back).join(seeds.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id", "direction", "rel", "other").agg(F.count(F.lit(1)).alias("n"))
    return near.join(nodes.select(F.col("node_id").alias("other"), F.col("label").alias("other_label"), F.col("name").alias("other_name")), "other", "left").select("node_id", "direction", "rel", "other", "other_label", "other_name", "n")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, label, name, depth): what a change can touch: users of a symbol and what it reaches in turn."""
    users = edges.filter(F.col("rel").isin(*USERS)).select("src", "dst")
    reach = edges.filter(F.col("rel").isin(*REACH)).select("src", "dst")
    hit = traverse.blast_radius(users, reach, seeds.select(F.col("node_id").alias("root")), min(depth, 5))
    return hit.join(nodes.select(F.col("node_id").alias("node"), "label", "name"), "node").select("root", "node", "label", "name", "depth")


def request_flow(nodes: DataFrame, edges: DataFrame, routes: DataFrame, hops: int = 3, callees: int | None = None) -> DataFrame:
    """(root, node, label, name, depth): what a request runs through: handler, calls, dispatches, tables; ``callees`` follows only so many edges of a node."""
    e = edges.filter(F.col("rel").isin("ROUTES_TO", "CALLS", "DISPATCHES", "QUERIES_TABLE")).select("src", "dst")
    x = traverse.bfs(e, routes.select(F.col("node_id").alias("root")), hops, callees).filter("depth > 0")
    return x.join(nodes.select(F.col("node_id").alias("node"), "label", "name"), "node").select("root", "node", "label", "name", "depth")


def flows(nodes: DataFrame, edges: DataFrame, depth: int = 5, limit: int = 200) -> DataFrame:
    """(root, node, depth, step_order): the methods that each entry point runs, level by level, the first ``limit`` steps of each by (depth, id)."""
    methods = nodes.filter("label = 'Method'").select(F.col("node_id").alias("dst"))
    calls = edges.filter("rel = 'CALLS'").select("src", "dst").join(methods, "dst", "left_semi").select("src", "dst")
    starts = traverse.entry_points(("route", edges.filter("rel = 'ROUTES_TO'").select(F.col("dst").alias("node_id"))), ("handler", nodes.filter("label = 'Method' and name = 'handle'").select("node_id")))
    return traverse.capped(traverse.bfs(calls, starts.select(F.col("node_id").alias("root")), depth), limit)


def dead_methods(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """(node_id, name, file_path) of methods that nothing needs.

    Exempt are methods that an edge reaches, those the framework calls by name, scopes, accessors and
    mutators, methods of traits and of classes whose role the framework calls, methods that declare a
    relation of a model (``sources``: method, role, source), methods named like the action of a route
    (``actions``: action), and overrides of a method of the class above. Third-party and legacy files are left out.
    """
    m = nodes.filter("label = 'Method'")
    used = edges.filter(F.col("rel").isin("CALLS", "ROUTES_TO", "DISPATCHES", "LISTENS_TO", "HANDLES", "SCHEDULES", "BLADE_CALLS")).select(F.col("dst").alias("node_id"))
    n = F.col("name")
    known = n.isin(*fixed.EXEMPT_METHODS) | n.rlike("^scope[A-Z]") | n.rlike("^get[A-Z].*Attribute$") | n.rlike("^set[A-Z].*Attribute$") | F.coalesce("file_path", F.lit("")).rlike(r"/(?:vendor|legacy)/")
    owner = edges.filter("rel = 'DEFINES'").select(F.col("src").alias("owner"), F.col("dst").alias("node_id")).join(m.select("node_id", "name"), "node_id")
    kind = nodes.filter(F.col("label").isin(*KINDS)).select(F.col("node_id").alias("owner"), "label", "role")
    framed = owner.join(kind.filter((F.col("label") == "Trait_") | F.col("role").isin(*fixed.EXEMPT_ROLES)), "owner").select("node_id")
    up = edges.filter("rel = 'EXTENDS_CLASS'").select(F.col("src").alias("owner"), F.col("dst").alias("parent")).distinct()
    over = owner.join(up, "owner").join(owner.select(F.col("owner").alias("parent"), "name"), ["parent", "name"], "left_semi").select("node_id")
    exempt = used.unionByName(framed).unionByName(over)
    if sources is not None:
        calls = "|".join(fixed.RELATION_CALLS)
        exempt = exempt.unionByName(sources.filter((F.col("role") == "model") & F.col("source").rlike(rf"\$this->(?:{calls})\(")).select(F.col("method").alias("node_id")))
    left = m.filter(~F.coalesce(known, F.lit(False)))
    if actions is not None:
        left = left.join(actions.filter("action is not null").select(F.col("action").alias("name")).distinct(), "name", "left_anti")
    return left.join(exempt.distinct(), "node_id", "left_anti").select("node_id", "name", "file_path")


def cross_cutting(nodes: DataFrame, edges: DataFrame, files: int = 3, layers: int = 2) -> DataFrame:
    """(node_id, n_units, n_layers, severity): methods called from many files in several layers."""
    from codeweft.operators.graph import fan_in

    at = nodes.filter("label = 'Method'").select(F.col("node_id").alias("src"), "file_path", F.regexp_extract("file_path", r"^(?:app/)?([^/]+)", 1).alias("layer"))
    sites = edges.filter("rel = 'CALLS'").select("src", "dst").join(at, "src").join(at.select(F.col("src").alias("dst")), "dst", "left_semi")
    return fan_in(sites, "dst", "file_path", "layer", files, layers, 8, 4).withColumnRenamed("dst", "node_id")


def table_access(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, n_reads, n_writes, n_deletes, readers, writers, conflict): who reads and who writes each table."""
    a = edges.filter("rel = 'QUERIES_TABLE'").select("src", F.col("dst").alias("node_id"), F.col("detail").alias("op"))
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    who = lambda *ops: F.count_distinct(F.when(F.col("op").isin(*ops), F.col("src")))
    x = a.groupBy("node_id").agg(n("read").alias("n_reads"), n("write").alias("n_writes"), n("delete").alias("n_deletes"), who("read").alias("readers"), who("write", "delete").alias("writers"))
    return nodes.filter("label = 'DatabaseTable'").join(x, "node_id").select(F.col("node_id").alias("table"), "n_reads", "n_writes", "n_deletes", "readers", "writers", ((F.col("readers") > 0) & (F.col("writers") > 0)).alias("conflict"))


def write_impact(nodes: DataFrame, edges: DataFrame, tables: DataFrame) -> DataFrame:
    """(table, method, target, target_name): what is dispatched by methods that write to each table."""
    w = edges.filter("rel = 'QUERIES_TABLE' and detail in ('write', 'delete')").join(tables.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("table"), F.col("src").alias("method")).distinct()
    d = edges.filter("rel = 'DISPATCHES'").select(F.col("src").alias("method"), F.col("dst").alias("target")).distinct()
    return w.join(d, "method", "left").join(nodes.select(F.col("node_id").alias("target"), F.col("name").alias("target_name")), "target", "left").select("table", "method", "target", "target_name")


def setting_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, kind, n_files, n_sites, declared): settings that code reads, and whether a file declares them."""
    u = edges.filter(F.col("rel").isin("USES_CONFIG", "USES_ENV")).groupBy(F.col("dst").alias("node_id"), F.when(F.col("rel") == "USES_ENV", "env").otherwise("config").alias("kind")).agg(F.count_distinct("src").alias("n_files"), F.count(F.lit(1)).alias("n_sites"))
    known = nodes.filter(F.col("label").isin("ConfigKey", "EnvVariable")).select("node_id", F.lit(True).alias("declared"))
    return u.join(known, "node_id", "left").select(F.substring_index("node_id", "::", -1).alias("key"), "kind", "n_files", "n_sites", F.coalesce("declared", F.lit(False)).alias("declared"))


def suggested_tests(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_name, test_id): tests whose text names a class (column name)."""
    from codeweft.operators.extract import test_references

    refs = test_references(files).select("test_id", F.explode("class_refs").alias("class_name"))
    return refs.join(classes.select(F.col("name").alias("class_name")).distinct(), "class_name", "left_semi").distinct()


def coverage(routes: DataFrame, links: DataFrame) -> DataFrame:
    """(n_routes, n_tested, percent): how many routes (column route_id) a test reaches."""
    hit = links.filter("kind = 'route'").select(F.col("target").alias("route_id")).distinct().withColumn("t", F.lit(1))
    x = routes.select("route_id").distinct().join(hit, "route_id", "left").agg(F.count(F.lit(1)).alias("n_routes"), F.count("t").alias("n_tested"))
    return x.withColumn("percent", ratio(F.col("n_tested"), F.col("n_routes")))


def features(routes: DataFrame, symbols: DataFrame, general: int = 20) -> DataFrame:
    """(feature, title, node_id, match_type): routes in buckets by their telling word, and symbols by theirs.

    The bucket of routes without one is left out when it grows beyond ``general``. A symbol joins
    a feature by an equal word, singular and plural alike, else by a shared beginning of four
    letters, the longest and then the least feature.
    """
    r = routes.select("node_id", naming.feature_slug(F.col("uri")).alias("feature"))
    sizes = r.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    names = sizes.filter((F.col("feature") != "general") | (F.col("n") <= general)).select("feature")
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, "ies$", "y"), "(?<=[a-z]{3})(?:es|s)$", "")
    words = symbols.select("node_id", F.explode(naming.name_tokens(F.col("name"))).alias("w")).select("node_id", stem(F.col("w")).alias("w"))
    keyed = names.select("feature", stem(F.col("feature")).alias("w"))
    exact = words.join(keyed, "w").select("node_id", "feature", F.lit(0).alias("k"), F.length("w").alias("n"))
    near = words.filter(F.length("w") >= 4).select("node_id", F.substring("w", 1, 4).alias("p")).join(keyed.filter(F.length("w") >= 4).select("feature", F.substring("w", 1, 4).alias("p")), "p").select("node_id", "feature", F.lit(1).alias("k"), F.lit(4).alias("n"))
    best = exact.unionByName(near).groupBy("node_id").agg(F.min_by(F.struct("feature", "k"), F.struct("k", -F.col("n"), "feature")).alias("x"))
    linked = best.select("node_id", "x.feature", F.when(F.col("x.k") == 0, "exact").otherwise("prefix").alias("match_type"))
    return r.join(names, "feature", "left_semi").withColumn("match_type", F.lit("route")).unionByName(linked).select("feature", naming.slug_title(F.col("feature")).alias("title"), "node_id", "match_type")


def changed_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(node_id, label, change) of the symbols in changed files (columns file_path, change)."""
    return nodes.filter(F.col("label").isin("Method", *KINDS)).join(changed.select("file_path", "change"), "file_path").select("node_id", "label", "change")


def symbols_without_use(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, name) of classes that no edge but their definition reaches."""
    used = edges.filter(~F.col("rel").isin("DEFINES", "CONTAINS")).select(F.col("dst").alias("node_id"))
    return nodes.filter(F.col("label").isin(*KINDS)).join(used, "node_id", "left_anti").select("node_id", "name")


def coupled_files(commits: DataFrame, least: float = 0.3) -> DataFrame:
    """Files that change together, from (commit, file)."""
    return analytics.co_change(commits, "commit", "file", least)
