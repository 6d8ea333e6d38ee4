"""Inventories of a code base: routes, models, events, bindings, schemas, connections, interfaces, repositories.

Each takes a :class:`codeweft.sources.code_graph.CodeGraph` (or frames) and gives a lazy frame. Lists
are whole; rows are told apart by repository where the tables are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import naming
from codeweft.functions.names import class_key, table_key
from codeweft.operators import extract, quality
from codeweft.operators.graph import ratio



def route_list(g) -> DataFrame:
    """(node_id, repo, http_method, uri, controller, action, middleware, handler): every route, its handling method where one is known."""
    to = g.edges("ROUTES_TO").groupBy("src").agg(F.min("dst").alias("handler"))
    r = g.routes().select("node_id", "repo", "http_method", "uri", "controller", "action", "middleware")
    return r.join(to.withColumnRenamed("src", "node_id"), "node_id", "left")


def api_surface(g) -> DataFrame:
    """(repo, feature, http_method, n_routes, n_guarded, n_handled): routes by their telling word and verb; guarded by any auth middleware."""
    r = route_list(g)
    guarded = F.exists("middleware", lambda m: F.lower(m).contains("auth"))
    return r.groupBy("repo", naming.feature_slug(F.col("uri")).alias("feature"), "http_method").agg(F.count(F.lit(1)).alias("n_routes"), F.sum(guarded.cast("long")).alias("n_guarded"), F.count("handler").alias("n_handled"))


def route_contracts(g) -> DataFrame:
    """(node_id, request, rule_fields): validated fields of the request classes that the handler of a route asks for."""
    rules = extract.validation_rules(g.php()).groupBy("file_id").agg(F.count_distinct("field").alias("rule_fields"))
    requests = g.symbols().filter("role = 'request'").select(F.col("node_id").alias("dst"), "file_id", F.col("name").alias("request")).join(rules, "file_id", "left").drop("file_id")
    asks = g.edges("USES_TYPE").filter("detail = 'param'").select(F.col("src").alias("handler"), "dst")
    return g.edges("ROUTES_TO").select(F.col("src").alias("node_id"), F.col("dst").alias("handler")).join(asks, "handler").join(requests, "dst").select("node_id", "request", F.coalesce("rule_fields", F.lit(0)).alias("rule_fields")).distinct()


def model_list(g) -> DataFrame:
    """(node_id, repo, name, fqn, table_name, table_node, soft_deletes, timestamps, n_fillable, n_casts): models by the row that holds, with their table."""
    from codeweft.operators.symbols import latest

    m = latest(g.read("eloquent_models"), ["node_id"], ["parsed_at", "model_id"], ["repo", "name", "fqn", "db_table", "fillable", "casts", "soft_deletes", "timestamps"])
    m = m.withColumn("table_name", F.coalesce(table_key(F.col("db_table")), naming.table_of_class(F.col("name"))))
    t = g.live_tables().select("repo", F.col("table_key").alias("table_name"), F.col("node_id").alias("table_node"))
    size = lambda c, kind: F.coalesce(F.size(F.from_json(c, kind)), F.lit(0))
    sized = m.withColumns({"n_fillable": F.greatest(F.lit(0), size("fillable", "array<string>")), "n_casts": F.greatest(F.lit(0), size("casts", "map<string,string>"))})
    return sized.join(t, ["repo", "table_name"], "left").select("node_id", "repo", "name", "fqn", "table_name", "table_node", "soft_deletes", "timestamps", "n_fillable", "n_casts")


def event_list(g) -> DataFrame:
    """(node_id, repo, name, kind, n_dispatchers, n_listeners): events and jobs, what raises them and what listens."""
    s = g.symbols().filter("role in ('event', 'job')").select("node_id", "repo", "name", F.col("role").alias("kind"))
    by = g.edges("DISPATCHES").groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("n_dispatchers"))
    l = extract.listeners(g.php()).join(g.files().select("file_id", "repo"), "file_id").groupBy("repo", naming.short_name(F.col("event")).alias("name")).agg(F.count_distinct("listener").alias("n_listeners"))
    return s.join(by, "node_id", "left").join(l, ["repo", "name"], "left").select("node_id", "repo", "name", "kind", F.coalesce("n_dispatchers", F.lit(0)).alias("n_dispatchers"), F.coalesce("n_listeners", F.lit(0)).alias("n_listeners"))


def binding_list(g) -> DataFrame:
    """(repo, binding_type, abstract, concrete, node_id): container bindings and the symbol behind each."""
    b = extract.bindings(g.php()).join(g.files().select("file_id", "repo"), "file_id")
    s = g.symbols().select(F.col("key").alias("k"), "node_id")
    return b.withColumn("k", class_key(F.col("concrete"))).join(s, "k", "left").select("repo", "binding_type", "abstract", "concrete", "node_id")


def schema_list(g) -> DataFrame:
    """(repo, table_name, connection, source, columns): living tables with the sorted columns that migrations give them."""
    c = g.columns().groupBy("repo", F.col("table").alias("table_key")).agg(F.array_sort(F.collect_set("column")).alias("columns"))
    return g.live_tables().join(c, ["repo", "table_key"], "left").select("repo", F.col("table_key").alias("table_name"), "connection", "source", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def table_context(g) -> DataFrame:
    """(node_id, repo, name, n_columns, n_models, n_readers, n_writers): what stands around each living table."""
    t = g.live_tables().select("node_id", "repo", F.col("table_key").alias("name"))
    cols = g.edges("HAS_COLUMN").groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("dst").alias("n_columns"))
    mods = g.edges("USES_TABLE").groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("n_models"))
    use = g.edges("QUERIES_TABLE").groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct(F.when(F.col("detail") == "read", F.col("src"))).alias("n_readers"), F.count_distinct(F.when(F.col("detail") != "read", F.col("src"))).alias("n_writers"))
    x = t.join(cols, "node_id", "left").join(mods, "node_id", "left").join(use, "node_id", "left")
    return x.select("node_id", "repo", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_columns", "n_models", "n_readers", "n_writers")])


def column_context(g) -> DataFrame:
    """(repo, table_name, column, type, references_table, is_discriminator, n_models): each column, what it points to and whose models fill it."""
    m = model_list(g).select("repo", "table_name", "node_id")
    n = m.groupBy("repo", "table_name").agg(F.count_distinct("node_id").alias("n_models"))
    c = g.columns().select("repo", F.col("table").alias("table_name"), "column", "type", "references_table")
    return c.join(n, ["repo", "table_name"], "left").select("repo", "table_name", "column", "type", "references_table", quality.discriminator(F.col("column"), F.col("type")).alias("is_discriminator"), F.coalesce("n_models", F.lit(0)).alias("n_models"))


def procedure_list(procedures: DataFrame) -> DataFrame:
    """(repo, name, reads, writes, n_reads, n_writes) of stored procedures (repo, name, body)."""
    return extract.sql_tables(procedures, "body").select("repo", "name", "reads", "writes", F.size("reads").alias("n_reads"), F.size("writes").alias("n_writes"))


def procedure_context(procedures: DataFrame, g) -> DataFrame:
    """(repo, name, table_node, operation): the living tables that each procedure reads and writes."""
    p = extract.sql_tables(procedures, "body").select("repo", "name", F.explode(F.concat(F.transform("reads", lambda t: F.struct(t.alias("t"), F.lit("read").alias("op"))), F.transform("writes", lambda t: F.struct(t.alias("t"), F.lit("write").alias("op"))))).alias("x"))
    t = g.live_tables().select("repo", F.col("table_key").alias("k"), F.col("node_id").alias("table_node"))
    return p.select("repo", "name", F.col("x.op").alias("operation"), table_key(F.col("x.t")).alias("k")).join(t, ["repo", "k"]).select("repo", "name", "table_node", "operation")


def connection_map(g) -> DataFrame:
    """(repo, connection, n_tables, n_models, n_methods): what hangs on each database connection; a missing one is the default."""
    t = g.live_tables().select("repo", F.coalesce("connection", F.lit("default")).alias("connection"), "node_id")
    m = g.edges("USES_TABLE").select(F.col("dst").alias("node_id"), F.col("src").alias("model"))
    q = g.edges("QUERIES_TABLE").select(F.col("dst").alias("node_id"), F.col("src").alias("method"))
    tables = t.groupBy("repo", "connection").agg(F.count(F.lit(1)).alias("n_tables"))
    models = t.join(m, "node_id").groupBy("repo", "connection").agg(F.count_distinct("model").alias("n_models"))
    methods = t.join(q, "node_id").groupBy("repo", "connection").agg(F.count_distinct("method").alias("n_methods"))
    out = tables.join(models, ["repo", "connection"], "left").join(methods, ["repo", "connection"], "left")
    return out.select("repo", "connection", "n_tables", F.coalesce("n_models", F.lit(0)).alias("n_models"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


#: Setting of a connection -> the variables that may name it, first come first served.
CONNECTION_KEYS = {"host": ("DB_HOST",), "port": ("DB_PORT",), "database": ("DB_DATABASE",), "username": ("DB_USERNAME",), "driver": ("DB_CONNECTION",)}


def resolved_connections(connections: DataFrame, env: DataFrame) -> DataFrame:
    """(name, key, value, source): settings of connections (name, settings map) with their variables put in.

    ``env`` has (key, value). A setting ``${NAME}`` or ``env:NAME`` takes the value of that
    variable, null where it has none; a setting left out takes the usual variable; others stay.
    """
    usual = reduce(lambda a, b: a.unionByName(b), [connections.select("name", F.lit(k).alias("key"), F.lit(v[0]).alias("var")) for k, v in CONNECTION_KEYS.items()])
    given = connections.select("name", F.explode("settings").alias("key", "raw"))
    var = F.regexp_extract("raw", r"^(?:\$\{(\w+)\}|env:(\w+))$", 1)
    var2 = F.regexp_extract("raw", r"^(?:\$\{(\w+)\}|env:(\w+))$", 2)
    named = given.withColumn("var", F.when(var != "", var).when(var2 != "", var2))
    missing = usual.join(given.select("name", "key"), ["name", "key"], "left_anti").withColumn("raw", F.lit(None).cast("string"))
    all_ = named.select("name", "key", "raw", "var").unionByName(missing.select("name", "key", "raw", "var"))
    x = all_.join(env.groupBy(F.col("key").alias("var")).agg(F.max("value").alias("found")), "var", "left")
    return x.select("name", "key", F.when(F.col("var").isNotNull(), F.col("found")).otherwise(F.col("raw")).alias("value"), F.when(F.col("var").isNotNull(), "env").otherwise("given").alias("source")).filter("value is not null or source = 'given'")


def explained(g) -> DataFrame:
    """(node_id, label, n_methods, n_parents, n_children, n_users): the place of every symbol in numbers."""
    s = g.symbols().select("node_id", "label")
    heir = g.edges("EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT").select("src", "dst").distinct()
    count = lambda df, at, name: df.groupBy(F.col(at).alias("node_id")).agg(F.count(F.lit(1)).alias(name))
    own = g.edges("DEFINES").select("src", "dst").distinct().join(s.select(F.col("node_id").alias("src")), "src", "left_semi")
    users = g.edges("USES_TYPE").select("src", "dst").distinct()
    parts = [count(own, "src", "n_methods"), count(heir, "src", "n_parents"), count(heir, "dst", "n_children"), count(users, "dst", "n_users")]
    x = reduce(lambda a, b: a.join(b, "node_id", "left"), parts, s)
    return x.select("node_id", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_methods", "n_parents", "n_children", "n_users")])


def repo_list(g) -> DataFrame:
    """(repo, n_files, n_lines, n_symbols, n_methods, n_models, n_tables): every repository in numbers."""
    f = g.read("source_files").groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum("line_count").alias("n_lines"))
    parts = [(g.symbols(), "n_symbols"), (g.methods(), "n_methods"), (g.nodes("EloquentModel"), "n_models"), (g.live_tables(), "n_tables")]
    x = reduce(lambda a, p: a.join(p[0].groupBy("repo").agg(F.count(F.lit(1)).alias(p[1])), "repo", "left"), parts, f)
    return x.select("repo", "n_files", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), *[F.coalesce(n, F.lit(0)).alias(n) for _, n in parts])


def layer_map(g) -> DataFrame:
    """(repo, layer, role, n_files): files by the folder below app, or the first folder, and their role."""
    layer = F.coalesce(F.nullif(F.regexp_extract("path", r"^(?:app/)?([^/]+)/", 1), F.lit("")), F.lit("."))
    return g.files().groupBy("repo", layer.alias("layer"), "role").agg(F.count(F.lit(1)).alias("n_files"))


def risk_list(g) -> DataFrame:
    """(method, kind, detail, severity, n): costly queries and races by method."""
    m = g.method_sources()
    q = extract.query_risks(m).select("method", F.lit("query").alias("kind"), F.col("risk").alias("detail"), "severity")
    r = quality.race_conditions(m).select("method", F.lit("race").alias("kind"), F.col("pattern").alias("detail"), F.lit("MEDIUM").alias("severity"))
    return q.unionByName(r).groupBy("method", "kind", "detail", "severity").agg(F.count(F.lit(1)).alias("n"))


def outbound_calls(g) -> DataFrame:
    """(repo, path, client, verb, n): requests that code sends, by file."""
    return extract.http_calls(g.php()).join(g.files().select("file_id", "repo", "path"), "file_id").groupBy("repo", "path", "client", "verb").agg(F.count(F.lit(1)).alias("n"))


def test_map(g) -> DataFrame:
    """(test_id, test_type, kind, target): routes and classes that tests reach."""
    from codeweft.operators.analytics import test_links

    t = extract.test_references(g.files())
    links = test_links(t.select("test_id", "uris", "class_refs"), g.routes().select(F.col("node_id").alias("route_id"), "uri"), g.symbols().select(F.col("node_id").alias("class_id"), "name"))
    return links.join(t.select("test_id", "test_type"), "test_id").select("test_id", "test_type", "kind", "target")


def feature_context(features: DataFrame) -> DataFrame:
    """(feature, n_routes, n_exact, n_near): features (feature, node_id, match_type) in numbers."""
    n = lambda *k: F.sum(F.col("match_type").isin(*k).cast("long"))
    return features.groupBy("feature").agg(n("route").alias("n_routes"), n("exact").alias("n_exact"), n("contains", "prefix").alias("n_near"))


def security_surface(g) -> DataFrame:
    """(severity, kind, repo, location): unverified webhooks, secrets that stay in tables, routes without auth among guarded ones.

    A webhook is a POST route whose path tells of one, without auth or csrf middleware, whose handler
    checks no signature. A column that holds secrets counts where no method that writes its table sets
    it to null. Routes without auth count where more than half of three or more under the same first
    part of the path have it.
    """
    r = route_list(g)
    names = F.lower(F.array_join("middleware", " "))
    src = g.method_sources().select(F.col("method").alias("handler"), F.lower("source").alias("source"))
    hook = r.filter((F.col("http_method") == "POST") & F.lower("uri").rlike("webhook|callback|notify|ipn") & ~names.rlike("auth|csrf|verifycsrftoken")).join(src, "handler", "left")
    hooks = hook.filter(~F.coalesce(F.col("source").rlike("hash_hmac|constructevent|signature|verifysignature|validate"), F.lit(False))).select(F.lit("CRITICAL").alias("severity"), F.lit("UNVERIFIED_WEBHOOK").alias("kind"), "repo", F.concat_ws(" ", "http_method", "uri").alias("location"))
    t = g.live_tables().filter("connection <> ''").select("repo", "table_key", F.col("node_id").alias("dst"))
    cols = quality.sensitive_columns(g.columns().select("repo", F.col("table").alias("table_key"), F.lower("column").alias("name"))).join(t, ["repo", "table_key"])
    writers = g.edges("QUERIES_TABLE").filter("detail <> 'read'").select(F.col("src").alias("handler"), "dst").distinct().join(src, "handler")
    nulled = F.concat("name", F.lit(r"\s*['\"]?\s*=>\s*null|"), "name", F.lit(r"\s*=\s*null"))
    cleared = cols.join(writers, "dst").filter(F.rlike("source", nulled)).select("dst", "name").distinct()
    kept = cols.join(cleared, ["dst", "name"], "left_anti").select(F.lit("HIGH").alias("severity"), F.lit("SENSITIVE_DATA_RETENTION").alias("kind"), "repo", F.concat_ws(".", "table_key", "name").alias("location")).distinct()
    auth = F.exists("middleware", lambda m: F.lower(m).contains("auth"))
    p = r.select("repo", "http_method", "uri", auth.alias("auth"), F.regexp_extract("uri", r"^/*([^/]*)", 1).alias("prefix"))
    most = p.groupBy("repo", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("auth").cast("long")).alias("a")).filter("n >= 3 and a > n / 2").select("repo", "prefix")
    open_ = p.filter(~F.col("auth")).join(most, ["repo", "prefix"], "left_semi").select(F.lit("MEDIUM").alias("severity"), F.lit("MISSING_AUTH").alias("kind"), "repo", F.concat_ws(" ", "http_method", "uri").alias("location"))
    return hooks.unionByName(kept).unionByName(open_)


def guarded_share(g) -> DataFrame:
    """(repo, n_routes, n_guarded, percent): how many routes of a repository have auth middleware."""
    x = api_surface(g).groupBy("repo").agg(F.sum("n_routes").alias("n_routes"), F.sum("n_guarded").alias("n_guarded"))
    return x.withColumn("percent", ratio(F.col("n_guarded"), F.col("n_routes")))
