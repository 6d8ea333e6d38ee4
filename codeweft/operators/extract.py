"""Facts from source text by patterns, all as built-in column expressions.

Each extractor takes files (file_id, path, content) and gives one row for each fact. A cheap
``contains`` stands before every pattern, null content gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeweft.functions import fixed, naming
from codeweft.functions.names import class_key
from codeweft.operators.routes import routes  # noqa: F401


def _files(files: DataFrame, *needles: str) -> DataFrame:
    df = files.filter(F.col("content").isNotNull())
    if needles:
        df = df.filter(reduce(lambda a, b: a | b, [F.col("content").contains(n) for n in needles]))
    return df


def _all(files: DataFrame, pattern: str, names: list[str], *needles: str) -> DataFrame:
    """(file_id, names...) of every match, a column for each group."""
    groups = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    rows = _files(files, *needles).select("file_id", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])).alias("x"))
    return rows.select("file_id", *[F.col(f"x.{n}").alias(n) for n in names])


def placed(files: DataFrame, pattern: str, names: list[str], *needles: str) -> DataFrame:
    """(file_id, line, names...) of every match, which may span lines; ``line`` is that of its beginning.

    The text before each match is taken along, so line breaks are counted without leaving the JVM.
    """
    rx = F.lit(rf"\G(?s)(.*?)({pattern})")  # from the last match on, so a text is read once
    groups = [F.regexp_extract_all("content", rx, F.lit(i)) for i in range(1, len(names) + 3)]
    x = _files(files, *needles).select("file_id", F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]).alias("x")).filter(F.size("x") > 0)
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    walked = F.aggregate("x", F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, m: F.struct((acc["at"] + breaks(m["g0"]) + breaks(m["g1"])).alias("at"), F.concat(acc["all"], F.array(acc["at"] + breaks(m["g0"]))).alias("all")))["all"]
    rows = x.select("file_id", F.explode(F.arrays_zip(walked.alias("line"), "x")).alias("y"))
    return rows.select("file_id", F.col("y.line").alias("line"), *[F.col(f"y.x.g{i + 2}").alias(n) for i, n in enumerate(names)])


def code_lines(files: DataFrame, *needles: str) -> DataFrame:
    """(file_id, line, text): the lines of files that hold one of the needles."""
    return _files(files, *needles).select("file_id", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("i", "text")).select("file_id", (F.col("i") + 1).alias("line"), "text")


# ---- declarations


def imports(files: DataFrame) -> DataFrame:
    """(file_id, fqn, alias) of use statements at the head of a file; the alias is the short name unless one is given."""
    x = _all(files, r"(?m)^use\s+([A-Za-z_\\][\w\\]*)(?:\s+as\s+(\w+))?\s*;", ["fqn", "given"], "use ")
    return x.select("file_id", F.regexp_replace("fqn", r"^\\", "").alias("fqn"), F.coalesce(F.when(F.col("given") != "", F.col("given")), naming.short_name(F.col("fqn"))).alias("alias"))


def import_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, target_file_id, n_symbols): one edge for each pair of files, from (fqn, file_id) of the symbols."""
    x = imports(files).join(symbols.select("fqn", F.col("file_id").alias("target_file_id")).distinct(), "fqn").filter("file_id <> target_file_id")
    return x.groupBy("file_id", "target_file_id").agg(F.count_distinct("alias").alias("n_symbols"))


def declared_classes(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, fqn, parent) of classes, interfaces, traits and enums."""
    ns = F.regexp_extract("content", r"(?m)^\s*namespace\s+([\w\\]+)\s*[;{]", 1)
    x = _all(files.withColumn("content", F.col("content")), r"(?m)^(?:abstract\s+|final\s+|readonly\s+)*(class|interface|trait|enum)\s+(\w+)(?:[^\n{]*?\bextends\s+([\w\\]+))?", ["kind", "name", "parent"], "class ", "interface ", "trait ", "enum ")
    spaces = _files(files).select("file_id", ns.alias("ns"))
    return x.join(spaces, "file_id").select("file_id", "kind", "name", F.when(F.col("ns") != "", F.concat_ws("\\", "ns", "name")).otherwise(F.col("name")).alias("fqn"), F.when(F.col("parent") != "", F.col("parent")).alias("parent"))


def heritage(classes: DataFrame) -> DataFrame:
    """(child, rel, parent) from rows (fqn, extends, implements, traits); names as written, blank ones left out."""
    none = F.array().cast("array<string>")
    rels = F.concat(
        F.array(F.struct(F.lit("EXTENDS_CLASS").alias("rel"), F.col("extends").alias("parent"))),
        F.transform(F.coalesce("implements", none), lambda x: F.struct(F.lit("IMPLEMENTS_INTERFACE").alias("rel"), x.alias("parent"))),
        F.transform(F.coalesce("traits", none), lambda x: F.struct(F.lit("USES_TRAIT").alias("rel"), x.alias("parent"))),
    )
    return classes.select(F.col("fqn").alias("child"), F.explode(rels).alias("x")).select("child", "x.rel", "x.parent").filter(F.trim("parent") != "")


def type_uses(methods: DataFrame) -> DataFrame:
    """(method_id, type, role): classes among the declared parameter and return types; parameters come as a JSON list."""
    params = F.coalesce(F.from_json("param_types", "array<string>"), F.array().cast("array<string>"))
    each = F.concat(F.flatten(F.transform(params, lambda p: F.transform(naming.class_types(p), lambda t: F.struct(t.alias("type"), F.lit("param").alias("role"))))), F.transform(naming.class_types(F.col("return_type")), lambda t: F.struct(t.alias("type"), F.lit("return").alias("role"))))
    return methods.select("method_id", F.explode(F.array_distinct(each)).alias("x")).select("method_id", "x.type", "x.role")


# ---- calls


#: Words before a parenthesis that are no calls.
_CONSTRUCTS = ("if", "elseif", "while", "for", "foreach", "switch", "match", "array", "list", "function", "fn", "return", "catch", "use", "and", "or", "xor", "declare", "include", "require", "include_once", "require_once")


def calls(files: DataFrame) -> DataFrame:
    """(file_id, line, kind, receiver, name): self, static, instance and free calls; plain and magic ones left out.

    ``receiver`` is this, self or static, a class or a variable without its marks, null for free calls.
    """
    lines = code_lines(files, "(")
    rx = r"(?:(\$this->|\$\w+->|\\?[A-Za-z_][\w\\]*::)|(?<![\w>:$\\])(?<!new ))([A-Za-z_]\w*)\("
    recv, name = F.regexp_extract_all("text", F.lit(rx), F.lit(1)), F.regexp_extract_all("text", F.lit(rx), F.lit(2))
    x = lines.filter(~F.col("text").rlike(r"^\s*(?:\*|//|#|/\*)|\bfunction\s+&?\w+\(")).select("file_id", "line", F.explode(F.arrays_zip(recv.alias("r"), name.alias("n"))).alias("x")).select("file_id", "line", F.col("x.r").alias("raw"), F.col("x.n").alias("name"))
    bare = F.regexp_replace("raw", r"^[$\\]|->$|::$", "")
    x = x.withColumn("receiver", F.when(F.col("raw") != "", bare))
    kind = F.when(F.col("receiver").isin("this", "self", "static"), "self").when(F.col("raw").endswith("::"), "static").when(F.col("raw").endswith("->"), "instance").otherwise("free")
    return x.withColumn("kind", kind).filter(~F.col("name").startswith("__") & ~F.col("name").isin(*fixed.PLAIN_CALLS) & ~((F.col("kind") == "free") & F.lower("name").isin(*_CONSTRUCTS))).select("file_id", "line", "kind", "receiver", "name")


#: Confidence of a call whose method is known, and of one of which only the class is.
CALL_CONFIDENCE = {"facade": (0.85, 0.75), "self": (0.9, 0.6), "static": (0.85, 0.7), "instance": (0.5, 0.4)}


def short_targets(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(by..., name, key): the symbol that a short name means: one of the preferred name spaces first, then the least key."""
    prefer = reduce(lambda a, b: a | b, [F.col("fqn").startswith(p) for p in fixed.PREFERRED_SPACES])
    return symbols.groupBy(*by, "name").agg(F.min_by("key", F.struct(F.when(prefer, 0).otherwise(1), "key")).alias("key"))


def resolved_calls(sites: DataFrame, methods: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """The sites with ``target``, ``target_kind`` (method or class), ``call_type`` and ``confidence``; calls of the unknown are left out.

    ``sites`` are :func:`calls` with (repo, caller_key: class that holds the site, or null), ``methods``
    (class_key, name, node_id), ``symbols`` (key, fqn, name, repo, node_id), ``aliases`` (file_id, alias, key).
    The receiver says which class is meant: a service behind a short static name; the own class for
    this, self, static and, inside a class, for no receiver; else the import of that alias, the
    symbol of that full name, or the one of that short name in the repository. Then the method of
    that name in the class counts, else the class itself, at the lesser confidence.
    """
    facade = F.create_map(*[F.lit(x) for k, v in fixed.FACADES.items() for x in (k, v)])
    own = (F.col("kind") == "self") | ((F.col("kind") == "free") & F.col("caller_key").isNotNull())
    x = sites.withColumn("_behind", F.when(F.col("kind") == "static", class_key(facade[F.col("receiver")])))
    x = x.withColumn("_named", F.when(~own & F.col("_behind").isNull(), F.col("receiver")))
    x = x.join(aliases.select("file_id", F.col("alias").alias("_named"), F.col("key").alias("_k1")).dropDuplicates(["file_id", "_named"]), ["file_id", "_named"], "left")
    x = x.withColumn("_full", class_key(F.col("_named"))).join(symbols.select(F.col("key").alias("_full"), F.col("key").alias("_k2")), "_full", "left")
    x = x.join(short_targets(symbols, ["repo"]).select("repo", F.col("name").alias("_named"), F.col("key").alias("_k3")), ["repo", "_named"], "left")
    x = x.withColumn("call_type", F.when(F.col("_behind").isNotNull(), "facade").when(own, "self").otherwise(F.col("kind"))).withColumn("_key", F.coalesce("_behind", F.when(own, F.col("caller_key")), "_k1", "_k2", "_k3"))
    m = methods.groupBy(F.col("class_key").alias("_key"), "name").agg(F.min("node_id").alias("_m"))
    x = x.filter("_key is not null").join(m, ["_key", "name"], "left").join(symbols.select(F.col("key").alias("_key"), F.col("node_id").alias("_c")), "_key", "left").filter("_m is not null or _c is not null")
    sure = reduce(lambda acc, kv: F.when(F.col("call_type") == kv[0], F.when(F.col("_m").isNotNull(), kv[1][0]).otherwise(kv[1][1])).otherwise(acc), CALL_CONFIDENCE.items(), F.lit(None).cast("double"))
    return x.select(*sites.columns, F.coalesce("_m", "_c").alias("target"), F.when(F.col("_m").isNotNull(), "method").otherwise("class").alias("target_kind"), "call_type", sure.alias("confidence"))


def dispatches(files: DataFrame) -> DataFrame:
    """(file_id, line, target, dispatch_type): events raised and jobs dispatched, by the short name of their class.

    What the event helper or the event facade gets is an event whatever its name; what a dispatch
    call gets is one if its name ends in Event, and a class that dispatches itself also when it
    ends in Notification; all else is a job.
    """
    some = r"(?:If|Now|AfterResponse|Sync)?"
    forms = (
        (r"\bevent\s*\(\s*new\s+([\w\\]+)\s*\(", "event(", F.lit("event")), (r"Event::dispatch\s*\(\s*new\s+([\w\\]+)\s*\(", "Event::dispatch", F.lit("event")),
        (rf"(?<!:)dispatch{some}\s*\(\s*(?:[^,;]+,\s*)?new\s+([\w\\]+)\s*\(", "dispatch", F.when(F.col("target").endswith("Event"), "event").otherwise("job")),
        (rf"([\w\\]+)::dispatch{some}\s*\(", "::dispatch", F.when(F.lower("target").isin(*fixed.DISPATCH_FACADES), None).when(F.col("target").rlike("(?:Event|Notification)$"), "event").otherwise("job")),
    )
    found = [placed(files, rx, ["t"], needle).withColumn("target", naming.short_name(F.col("t"))).withColumn("dispatch_type", kind) for rx, needle, kind in forms]
    return reduce(lambda a, b: a.unionByName(b), found).filter("dispatch_type is not null").select("file_id", "line", "target", "dispatch_type")


def guards(files: DataFrame, sites: DataFrame, window: int = 4) -> DataFrame:
    """(file_id, line, condition): the nearest if, elseif, case or switch within the last non-empty lines before a site, at most 120 characters."""
    lines = code_lines(files).filter(F.trim("text") != "")
    at = W.partitionBy("file_id").orderBy("line")
    cond = F.regexp_extract("text", r"\b(?:if|elseif|switch)\s*\((.*)|\bcase\s+(.*?):", 0)
    before = lines.withColumn("cond", F.when(cond != "", F.substring(F.trim(cond), 1, 120))).withColumn("condition", F.last("cond", ignorenulls=True).over(at.rowsBetween(-window, -1)))
    return sites.select("file_id", "line").distinct().join(before.select("file_id", "line", "condition"), ["file_id", "line"]).filter(F.col("condition").isNotNull())


# ---- framework constructs


def middleware(spec: DataFrame, groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """(route_id, middleware, parameters, position): groups replaced by their members and aliases by classes, in order.

    ``spec`` has (route_id, middleware array), ``groups`` (name, members array), ``aliases`` (alias, class).
    A name with parameters after a colon keeps them; a name that is neither stays.
    """
    one = spec.select("route_id", F.posexplode("middleware").alias("p", "m"))
    one = one.join(groups.withColumnRenamed("name", "m"), "m", "left").select("route_id", "p", F.posexplode(F.coalesce("members", F.array("m"))).alias("q", "m"))
    named = one.select("route_id", "p", "q", F.split("m", ":", 2)[0].alias("alias"), F.get(F.split("m", ":", 2), F.lit(1)).alias("parameters"))
    full = named.join(aliases, "alias", "left").select("route_id", F.coalesce("class", "alias").alias("middleware"), "parameters", "p", "q")
    r = F.row_number().over(W.partitionBy("route_id").orderBy("p", "q", "middleware")) - 1
    return full.select("route_id", "middleware", "parameters", r.alias("position"))


def middleware_registry(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, members) of the middleware that kernels and application files declare.

    Kinds are global (no name), group (name and members) and alias (name and one member): from the
    arrays of a kernel and from calls of append, prepend, group and alias. Members are classes
    and names in order.
    """
    some = r"(?:\\?([\w\\]+)::class|['\"]([^'\"]+)['\"])"
    names = lambda c: F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit(some), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(some), F.lit(2)).alias("b")), lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"]))
    body = lambda name: _blocks(files, rf"\$(?:{name})\s*=\s*\[", "$middleware", "$routeMiddleware")
    row = lambda df, kind, name, members: df.select("file_id", F.lit(kind).alias("kind"), name.alias("name"), members.alias("members"))
    none = F.lit(None).cast("string")
    top = row(body("middleware"), "global", none, names("body"))
    added = row(_all(files, r"\$middleware->(?:append|prepend)\s*\(\s*([^)]+)\)", ["body"], "$middleware->"), "global", none, names("body"))
    entry = F.lit(r"['\"](\w+)['\"]\s*=>\s*\[([^\]]*)\]")
    pairs = lambda df, rx: df.select("file_id", F.explode(F.arrays_zip(F.regexp_extract_all("body", rx, F.lit(1)).alias("n"), F.regexp_extract_all("body", rx, F.lit(2)).alias("m"))).alias("x")).select("file_id", "x.n", "x.m")
    groups = row(pairs(body("middlewareGroups"), entry), "group", F.col("n"), names("m"))
    called = row(_all(files, r"\$middleware->group\s*\(\s*['\"](\w+)['\"]\s*,\s*\[([^\]]*)\]\s*\)", ["n", "m"], "$middleware->group"), "group", F.col("n"), names("m"))
    one = F.lit(r"['\"]([\w.-]+)['\"]\s*=>\s*(\\?[\w\\]+::class|['\"][^'\"]+['\"])")
    aliases = row(pairs(body("routeMiddleware|middlewareAliases"), one).unionByName(pairs(_all(files, r"\$middleware->alias\s*\(\s*\[([^\]]*)\]\s*\)", ["body"], "$middleware->alias"), one)), "alias", F.col("n"), names("m"))
    return top.unionByName(added).unionByName(groups).unionByName(called).unionByName(aliases)


def bindings(files: DataFrame) -> DataFrame:
    """(file_id, binding_type, abstract, concrete) of container bindings; the concrete class is null for closures that name none.

    Tags give a row a tagged class, with the tag as abstract; contextual ones (when, needs, give) have the type contextual.
    """
    return _plain_bindings(files).unionByName(_tagged(files)).unionByName(_contextual(files))


_APP = r"(?:\$this->app|\$app|app\(\s*\))"


def _tagged(files: DataFrame) -> DataFrame:
    x = _all(files, rf"{_APP}\s*->\s*tag\s*\(\s*\[([^\]]+)\]\s*,\s*['\"]([^'\"]+)['\"]\s*\)", ["many", "tag"], "->tag(")
    return x.select("file_id", F.lit("tag").alias("binding_type"), F.col("tag").alias("abstract"), F.explode(F.regexp_extract_all("many", F.lit(r"\\?([\w\\]+)::class"), F.lit(1))).alias("concrete"))


def _contextual(files: DataFrame) -> DataFrame:
    x = _all(files, rf"{_APP}\s*->\s*when\s*\(\s*\\?([\w\\]+)::class\s*\)\s*->\s*needs\s*\(\s*\\?([\w\\]+)::class\s*\)\s*->\s*give\s*\(\s*(?:\\?([\w\\]+)::class)?", ["user", "abstract", "concrete"], "->needs(")
    return x.select("file_id", F.lit("contextual").alias("binding_type"), "abstract", F.when(F.col("concrete") != "", F.col("concrete")).alias("concrete"))


def _plain_bindings(files: DataFrame) -> DataFrame:
    x = _all(files, r"(?:\$this->app|app\(\))->(singleton|bind|scoped|instance)\(\s*\\?([\w\\]+)::class\s*,\s*(?:\\?([\w\\]+)::class|function|fn|new\s+\\?([\w\\]+)|\$)", ["binding_type", "abstract", "c1", "c2"], "->singleton(", "->bind(", "->scoped(", "->instance(")
    return x.select("file_id", "binding_type", "abstract", F.coalesce(F.when(F.col("c1") != "", F.col("c1")), F.when(F.col("c2") != "", F.col("c2"))).alias("concrete"))


def listeners(files: DataFrame) -> DataFrame:
    """(file_id, event, listener, source): from maps, listen calls, attributes, and listeners whose handle method names its event; the first source counts."""
    inmap = _all(files, r"([\w\\]+)::class\s*=>\s*\[([^\]]*)\]", ["event", "many"], "$listen")
    a = inmap.select("file_id", "event", F.explode(F.regexp_extract_all("many", F.lit(r"([\w\\]+)::class"), F.lit(1))).alias("listener"), F.lit("map").alias("source"), F.lit(0).alias("prio"))
    b = _all(files, r"Event::listen\(\s*\\?([\w\\]+)::class\s*,\s*\[?\s*\\?([\w\\]+)::class", ["event", "listener"], "Event::listen").select("file_id", "event", "listener", F.lit("call").alias("source"), F.lit(1).alias("prio"))
    hint = _all(files.filter(F.col("path").contains("/Listeners/")), r"function\s+handle\(\s*\\?([A-Z][\w\\]*)\s+\$", ["event"], "handle")
    own = files.select("file_id", F.regexp_extract("path", r"(\w+)\.php$", 1).alias("listener"))
    c = hint.join(own, "file_id").select("file_id", "event", "listener", F.lit("type").alias("source"), F.lit(2).alias("prio"))
    attribute = _all(files, r"#\[Listen\s*\(\s*\\?([\w\\]+)::class", ["event"], "#[Listen")
    e = attribute.join(own, "file_id").select("file_id", "event", "listener", F.lit("attribute").alias("source"), F.lit(1).alias("prio"))
    rows = a.unionByName(b).unionByName(c).unionByName(e)
    return rows.groupBy("event", "listener").agg(F.min_by("source", F.struct("prio", "file_id")).alias("source"), F.min("file_id").alias("file_id"))


def templates(files: DataFrame) -> DataFrame:
    """(file_id, rel, target): what templates extend, include and use as components."""
    b = files.filter(F.col("path").endswith(".blade.php")).withColumn("content", F.regexp_replace("content", r"(?s)\{\{--.*?--\}\}", ""))
    ext = _all(b, r"@extends\(\s*'([^']+)'", ["target"], "@extends").withColumn("rel", F.lit("EXTENDS_TEMPLATE"))
    inc = _all(b, r"@(?:include(?:If)?|each)\(\s*'([^']+)'", ["target"], "@include", "@each").withColumn("rel", F.lit("INCLUDES_TEMPLATE"))
    com = _all(b, r"<x-([\w.:-]+)", ["target"], "<x-").withColumn("rel", F.lit("HAS_COMPONENT"))
    return ext.unionByName(inc).unionByName(com).select("file_id", "rel", "target").distinct()


def renders(files: DataFrame) -> DataFrame:
    """(file_id, template) of templates that code asks for."""
    return _all(files, r"\bview\(\s*'([\w./:-]+)'", ["template"], "view(").distinct()


def migration_columns(files: DataFrame) -> DataFrame:
    """(file_id, table, column, type, nullable, is_unique, references_table) of the tables that migrations make.

    Shorthands are spelled out: id, timestamps, soft deletes and remember tokens; a foreign id
    points to the plural of its name unless it says otherwise.
    """
    body = _all(files.filter(F.col("path").contains("database/migrations/")), r"(?s)Schema::(?:create|table)\(\s*'(\w+)'\s*,\s*(?:static\s+)?function\s*\([^)]*\)[^{]*\{(.*?)\n\s*\}\);", ["table", "body"], "Schema::")
    stm = body.select("file_id", "table", F.explode(F.split("body", ";")).alias("s")).filter(F.col("s").contains("$table->"))
    kind, name = F.regexp_extract("s", r"\$table->(\w+)\(", 1), F.regexp_extract("s", r"\$table->\w+\(\s*'(\w+)'", 1)
    x = stm.select("file_id", "table", "s", kind.alias("kind"), name.alias("name"))
    col = lambda n, t, null: F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.lit(null).alias("nullable"))
    made = (
        F.when((F.col("kind") == "id") & (F.col("name") == ""), F.array(col("id", "bigint", False)))
        .when(F.col("kind").isin("timestamps", "nullableTimestamps"), F.array(col("created_at", "timestamp", True), col("updated_at", "timestamp", True)))
        .when(F.col("kind") == "softDeletes", F.array(col("deleted_at", "timestamp", True)))
        .when(F.col("kind") == "rememberToken", F.array(col("remember_token", "string", True)))
        .when((F.col("name") != "") & ~F.col("kind").isin("index", "unique", "primary", "foreign", "dropColumn", "dropIndex", "renameColumn", "dropForeign"), F.array(F.struct(F.col("name").alias("column"), F.when(F.col("kind").isin("foreignId", "unsignedBigInteger", "bigInteger", "bigIncrements"), "bigint").when(F.col("kind").isin("increments", "unsignedInteger"), "integer").otherwise(F.lower("kind")).alias("type"), F.col("s").contains("->nullable(").alias("nullable"))))
    )
    ref = F.regexp_extract("s", r"->(?:on|constrained)\(\s*'(\w+)'", 1)
    target = F.when(ref != "", ref).when(F.col("kind") == "foreignId", naming.plural(F.regexp_replace("name", "_id$", "")))
    return x.select("file_id", "table", F.explode(made).alias("c"), F.col("s").contains("->unique(").alias("is_unique"), target.alias("references_table")).select("file_id", "table", "c.column", "c.type", "c.nullable", "is_unique", "references_table")


def config_uses(files: DataFrame) -> DataFrame:
    """(file_id, line, kind, key) of settings read in code."""
    lines = code_lines(files, "config(", "env(")
    rx = r"\b(config|env)\(\s*'([\w.-]+)'"
    x = lines.select("file_id", "line", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(rx), F.lit(2)).alias("n"))).alias("x"))
    return x.select("file_id", "line", F.col("x.k").alias("kind"), F.col("x.n").alias("key"))


def config_keys(files: DataFrame) -> DataFrame:
    """(file_id, key): top-level keys of configuration files as file.key."""
    c = files.filter(F.col("path").rlike(r"^config/\w+\.php$"))
    x = _all(c, r"(?m)^    '(\w+)'\s*=>", ["k"])
    return x.join(c.select("file_id", F.regexp_extract("path", r"(\w+)\.php$", 1).alias("f")), "file_id").select("file_id", F.concat_ws(".", "f", "k").alias("key"))


def env_file(files: DataFrame) -> DataFrame:
    """(file_id, key, value) of KEY=VALUE lines, quotes off, comments left out."""
    x = _all(files, r"(?m)^([A-Z][A-Z0-9_]*)=(.*)$", ["key", "value"], "=")
    return x.select("file_id", "key", F.regexp_replace(F.trim("value"), r"^[\"']|[\"']$", "").alias("value"))


def injections(files: DataFrame) -> DataFrame:
    """(file_id, method, type, parameter, injection): classes that constructors and other methods ask for; scalars left out."""
    sig = _all(files, r"function\s+(\w+)\(([^)]*)\)", ["method", "params"], "function ")
    rx = r"(?:^|[,(\s])\??\\?([A-Z][\w\\]*)\s+\$(\w+)"
    x = sig.select("file_id", "method", F.explode(F.arrays_zip(F.regexp_extract_all("params", F.lit(rx), F.lit(1)).alias("t"), F.regexp_extract_all("params", F.lit(rx), F.lit(2)).alias("p"))).alias("x"))
    return x.select("file_id", "method", F.col("x.t").alias("type"), F.col("x.p").alias("parameter"), F.when(F.col("method") == "__construct", "constructor").otherwise("method").alias("injection"))


def validation_rules(files: DataFrame) -> DataFrame:
    """(file_id, field, rules): rules of request classes, texts and arrays alike."""
    body = _all(files, r"(?s)function\s+rules\(\)[^{]*\{(.*?)\n    \}", ["body"], "function rules")
    rx = r"'([\w.*]+)'\s*=>\s*(?:'([^']*)'|\[([^\]]*)\])"
    x = body.select("file_id", F.explode(F.arrays_zip(*[F.regexp_extract_all("body", F.lit(rx), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])).alias("x"))
    return x.select("file_id", F.col("x.g1").alias("field"), F.when(F.col("x.g2") != "", F.split("x.g2", r"\|")).otherwise(F.regexp_extract_all("x.g3", F.lit("'([^']*)'"), F.lit(1))).alias("rules"))


def schedules(files: DataFrame) -> DataFrame:
    """(file_id, task, frequency, cron, disabled, timezone, without_overlapping, on_one_server, in_background): scheduled commands and jobs; a commented statement is disabled."""
    rx = r"(?m)^([ \t]*(?://|#)?)[ \t]*(?:\$schedule|Schedule::?)(?:->|::)?(?:command|job|call|exec)\(\s*(?:'([^']*)'|new\s+([\w\\]+)|([\w\\]+)::class)?\s*\)?\s*->(\w+)\(\s*(?:'([^']*)')?([^;]*)"
    x = _all(files, rx, ["lead", "t1", "t2", "t3", "frequency", "arg", "rest"], "chedule")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return x.select("file_id", F.coalesce(some("t1"), some("t2"), some("t3"), F.lit("closure")).alias("task"), "frequency", F.when(F.col("frequency") == "cron", F.col("arg")).alias("cron"), (F.trim("lead") != "").alias("disabled"), F.nullif(F.regexp_extract("rest", r"->timezone\(\s*['\"]([^'\"]+)", 1), F.lit("")).alias("timezone"), *[F.col("rest").contains(f"->{call}(").alias(name) for name, call in (("without_overlapping", "withoutOverlapping"), ("on_one_server", "onOneServer"), ("in_background", "inBackground"))])


#: Words that follow FROM or JOIN without being tables.
NO_TABLES = ("select", "dual", "where", "set", "values", "lateral", "unnest", "information_schema")


def sql_tables(bodies: DataFrame, text: str = "sql") -> DataFrame:
    """The rows with reads and writes: sorted arrays of the tables that a statement reads and writes."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[`\"]", "")
    got = lambda rx: F.regexp_extract_all(t, F.lit(rx), F.lit(1))
    writes = F.concat(got(r"\binsert\s+(?:ignore\s+)?into\s+([\w.]+)"), got(r"\bupdate\s+([\w.]+)\s+set\b"), got(r"\bdelete\s+from\s+([\w.]+)"), got(r"\breplace\s+into\s+([\w.]+)"), got(r"\btruncate\s+(?:table\s+)?([\w.]+)"))
    reads = F.concat(got(r"(?<!delete )\bfrom\s+([\w.]+)"), got(r"\bjoin\s+([\w.]+)"))
    stop = F.array(*[F.lit(x) for x in NO_TABLES])
    return bodies.withColumns({"reads": F.array_sort(F.array_except(F.array_distinct(reads), stop)), "writes": F.array_sort(F.array_except(F.array_distinct(writes), stop))})


def procedure_parameters(procedures: DataFrame, text: str = "body") -> DataFrame:
    """(repo, name, position, mode, parameter, type) of stored procedures (repo, name, body), from their heads."""
    rx = F.lit(r"(?i)\b(IN|OUT|INOUT)\s+(\w+)\s+(\w+(?:\([\d, ]*\))?)")
    head = F.regexp_extract(F.col(text), r"(?is)^(.*?)\bbegin\b", 1)
    source = F.when(head != "", head).otherwise(F.col(text))
    x = procedures.withColumn("_s", source).select("repo", "name", F.posexplode(F.arrays_zip(*[F.regexp_extract_all("_s", rx, F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])).alias("position", "x"))
    return x.select("repo", "name", "position", F.upper("x.g1").alias("mode"), F.col("x.g2").alias("parameter"), F.col("x.g3").alias("type"))


def db_access(files: DataFrame) -> DataFrame:
    """(file_id, line, target, operation, via, confidence): query builder, joins, raw SQL, static ORM calls and instance writes."""
    lines = code_lines(files, "DB::", "::", "->save(", "->delete(", "join(", "()->").filter(~F.col("text").rlike(r"^\s*(?:\*|//|#|/\*)"))
    op = F.when(F.col("text").rlike(r"(?:->|::)(?:insert|create|upsert|insertGetId|firstOrCreate|updateOrCreate|save)\("), "write").when(F.col("text").rlike(r"(?:->|::)(?:update|increment|decrement)\("), "write").when(F.col("text").rlike(r"(?:->|::)(?:delete|truncate|destroy)\("), "delete").otherwise("read")
    kinds = (
        ("query_builder", r"DB::table\(\s*'(\w+)'", 0.95, op), ("join", r"->(?:left|right|cross)?[jJ]oin\(\s*'(\w+)'", 0.90, F.lit("read")),
        ("raw_sql", r"(?i)DB::(?:select|statement|insert|update|delete|raw)\(\s*[\"'][^\"']*?\b(?:from|into|update|join)\s+`?(\w+)", 0.75, F.when(F.lower("text").rlike(r"insert|update|delete"), "write").otherwise("read")),
        ("static_orm", r"\b([A-Z]\w*)::(?:query|where\w*|find\w*|all|create|first\w*|update\w*|with|insert|destroy|count)\(", 0.90, op), ("instance_write", r"\$(\w+)->(?:save|delete|update|forceDelete)\(", 0.85, F.when(F.col("text").rlike(r"->(?:delete|forceDelete)\("), "delete").otherwise("write")),
    )
    out = None
    for via, rx, confidence, operation in kinds:
        x = lines.withColumn("target", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(1)))).select("file_id", "line", "target", operation.alias("operation"), F.lit(via).alias("via"), F.lit(confidence).alias("confidence"))
        out = x if out is None else out.unionByName(x)
    # writes through a relation: the target is the relation's method
    relation = r"\$\w+\s*->\s*(\w+)\s*\(\s*\)\s*->\s*(?:create|createMany|save|saveMany|update|updateOrCreate|firstOrCreate|firstOrNew|attach|detach|sync|syncWithoutDetaching|toggle|updateExistingPivot)\s*\("
    x = lines.withColumn("target", F.explode(F.regexp_extract_all("text", F.lit(relation), F.lit(1)))).select("file_id", "line", "target", F.lit("write").alias("operation"), F.lit("relation_write").alias("via"), F.lit(0.8).alias("confidence"))
    # tables named by a variable cannot be told; their sites are kept for review
    y = lines.withColumn("target", F.explode(F.regexp_extract_all("text", F.lit(r"\bDB::(?:connection\([^)]*\)\s*->\s*)?table\(\s*(\$\w+)"), F.lit(1)))).select("file_id", "line", "target", op.alias("operation"), F.lit("dynamic_table").alias("via"), F.lit(0.2).alias("confidence"))
    return out.unionByName(x).unionByName(y).filter(~F.col("target").isin("DB", "Route", "Schema", "Cache", "Log", "this"))


def right_side(expression: Column) -> Column:
    """Confidence that an assigned value tells about a column: literals and numbers, model properties, requests, variables."""
    e = F.trim(expression)
    return (
        F.when(e.rlike(r"^(?:'[^']*'|\"[^\"]*\"|true|false|null|[A-Z_]+::\w+)$"), 1.0).when(e.rlike(r"^-?\d+(?:\.\d+)?$"), 1.0).when(e.rlike(r"\$request\b|request\("), 0.05)
        .when(e.rlike(r"^\$\w+->\w+_?id$|^\$\w+->id$"), 0.85).when(e.rlike(r"^\$\w+->\w+$"), 0.35).when(e.rlike(r"^\$\w+$"), 0.1).otherwise(0.05)
    )


def model_facts(files: DataFrame) -> DataFrame:
    """(file_id, db_table, soft_deletes, timestamps, fillable, guarded, eager, casts) of model classes; casts maps fields to types."""
    m = _files(files.filter(F.col("path").contains("Models/")))
    lst = lambda p: F.regexp_extract_all(F.regexp_extract("content", rf"(?s)\${p}\s*=\s*\[(.*?)\]", 1), F.lit("'([^']*)'"), F.lit(1))
    pairs = F.regexp_extract("content", r"(?s)\$casts\s*=\s*\[([^\]]*)\]", 1)
    rx = F.lit("['\"]([^'\"]+)['\"]\\s*=>\\s*['\"]([^'\"]+)['\"]")
    names = F.regexp_extract_all(pairs, rx, F.lit(1))
    casts = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.get(F.regexp_extract_all(pairs, rx, F.lit(2)), F.size(names) - F.array_position(F.reverse(names), n).cast("int"))))
    t = F.regexp_extract("content", r"protected\s+(?:string\s+)?\$table\s*=\s*'([^']*)'", 1)
    name = F.regexp_extract("path", r"(\w+)\.php$", 1)
    return m.select("file_id", F.when(t != "", t).otherwise(naming.table_of_model(name)).alias("db_table"), F.col("content").contains("SoftDeletes").alias("soft_deletes"), (~F.col("content").rlike(r"\$timestamps\s*=\s*false")).alias("timestamps"), lst("fillable").alias("fillable"), lst("guarded").alias("guarded"), lst("with").alias("eager"), casts.alias("casts"))


def model_relations(files: DataFrame) -> DataFrame:
    """(file_id, method, relation, target, foreign_key, is_polymorphic) of the relations that models declare."""
    rx = r"function\s+(\w+)\(\)[^{]*\{[^}]*?\$this->(hasOne|hasMany|belongsTo|belongsToMany|hasOneThrough|hasManyThrough|morphOne|morphMany|morphTo|morphToMany|morphedByMany)\(\s*(?:\\?([\w\\]+)::class)?(?:\s*,\s*'([^']*)')?"
    x = _all(files, rx, ["method", "relation", "target", "foreign_key"], "$this->")
    return x.select("file_id", "method", "relation", F.when(F.col("target") != "", F.col("target")).alias("target"), F.when(F.col("foreign_key") != "", F.col("foreign_key")).alias("foreign_key"), F.col("relation").startswith("morph").alias("is_polymorphic"))


def contracts(files: DataFrame) -> DataFrame:
    """(file_id, kind, subject): rules that code lays down: validation, authorization, lifecycle hooks, mass assignment."""
    val = validation_rules(files).select("file_id", F.lit("validation").alias("kind"), F.col("field").alias("subject"))
    auth = _all(files.filter(F.col("path").contains("/Policies/")), r"public\s+(?:static\s+)?function\s+(\w+)\(", ["subject"], "function ").filter(~F.col("subject").startswith("__")).select("file_id", F.lit("authorization").alias("kind"), "subject")
    life = _all(files, r"static::(creating|created|updating|updated|saving|saved|deleting|deleted|restoring|restored)\(", ["subject"], "static::").select("file_id", F.lit("lifecycle").alias("kind"), "subject")
    mass = model_facts(files).select("file_id", F.explode("fillable").alias("subject")).select("file_id", F.lit("mass_assignment").alias("kind"), "subject")
    return val.unionByName(auth).unionByName(life).unionByName(mass)


def test_references(files: DataFrame) -> DataFrame:
    """(test_id, test_type, uris, class_refs) of test files."""
    t = _files(files.filter(F.col("path").rlike(r"^tests/.*\.php$")))
    uris = F.regexp_extract_all("content", F.lit(r"->(?:get|post|put|patch|delete)(?:Json)?\(\s*'([^']+)'"), F.lit(1))
    refs = F.regexp_extract_all("content", F.lit(r"\b([A-Z]\w+)(?:::class|::factory|::create|\()"), F.lit(1))
    kind = F.when(F.col("path").contains("/Feature/"), "feature").when(F.col("path").contains("/Unit/"), "unit").otherwise("other")
    return t.select(F.col("file_id").alias("test_id"), kind.alias("test_type"), F.array_distinct(uris).alias("uris"), F.array_distinct(refs).alias("class_refs"))


def method_sources(files: DataFrame, methods: DataFrame) -> DataFrame:
    """The methods (file_id, line_start, line_end, ...) with ``source``, their lines from first to last.

    A missing or earlier end means the end of the file. The spans of a file are gathered and cut from
    its lines at once, so a text crosses the shuffle once and not once a method.
    """
    keep = [c for c in methods.columns if c != "file_id"]
    spans = methods.filter("file_id is not null and line_start >= 1").groupBy("file_id").agg(F.collect_list(F.struct(*keep)).alias("_spans"))
    x = files.filter("content is not null").select("file_id", F.split("content", r"\r\n|\n|\r").alias("_l")).join(spans, "file_id")
    last = lambda s: F.when(s["line_end"] >= s["line_start"], s["line_end"]).otherwise(F.size("_l"))
    cutout = lambda s: F.array_join(F.slice("_l", s["line_start"], F.greatest(F.lit(0), F.least(last(s), F.size("_l")) - s["line_start"] + 1)), "\n")
    return x.select("file_id", F.explode(F.transform("_spans", lambda s: F.struct(s.alias("m"), cutout(s).alias("source")))).alias("y")).select("file_id", *[F.col(f"y.m.{c}").alias(c) for c in keep], "y.source")


def query_risks(sources: DataFrame, window: int = 20) -> DataFrame:
    """(method, line, risk, severity) from methods (method, role, file_path, source): costly habits, each method by itself.

    Only methods of controllers, services, repositories and models outside of tests are looked at.
    A loop whose first chained access within the lines after it goes through its own variable is a
    query for each row; where the method loads relations ahead it is a lesser finding. ``line``
    counts from the first line of the method. Repeated counts give one row, raw statements one each.
    """
    m = sources.filter(F.col("role").isin(*fixed.RISK_ROLES) & ~F.lower(F.coalesce("file_path", F.lit(""))).contains("/tests/"))
    m = m.withColumn("_l", F.split("source", "\n"))
    rx = r"foreach\s*\(\s*\$\w+\s+as\s+(?:\$\w+\s*=>\s*)?\$(\w+)\s*\)"
    ahead = lambda i: F.regexp_extract(F.array_join(F.slice("_l", i + 2, window), "\n"), r"\$(\w+)\s*->\s*\w+\s*->", 1)
    loops = F.filter(F.transform("_l", lambda t, i: F.struct((i + 1).alias("line"), F.regexp_extract(t, rx, 1).alias("var"), F.when(t.rlike(rx), ahead(i)).alias("first"))), lambda s: (s["var"] != "") & (s["var"] == s["first"]))
    eager = F.col("source").rlike(r"->with\s*\(|\$with\s*=")
    n1 = m.filter(F.col("source").contains("foreach")).select("method", F.explode(loops).alias("x"), eager.alias("e")).select("method", "x.line", F.when(F.col("e"), "missing_eager_load").otherwise("n_plus_one").alias("risk"), F.when(F.col("e"), "MEDIUM").otherwise("HIGH").alias("severity"))
    line_of = lambda pattern: F.size(F.split(F.regexp_extract("source", rf"(?s)^(.*?){pattern}", 1), "\n"))
    count = r"->\s*count\s*\(\s*\)"
    counts = m.filter(F.size(F.regexp_extract_all("source", F.lit(count), F.lit(0))) >= 2).select("method", line_of(count).alias("line"), F.lit("repeated_count").alias("risk"), F.lit("MEDIUM").alias("severity"))
    raw = placed(m.select(F.struct("method").alias("file_id"), F.col("source").alias("content")), r"\bDB\s*::\s*(select|statement)\s*\(", ["verb"], "DB").select("file_id.method", "line", F.lit("raw_query_bypass").alias("risk"), F.lit("MEDIUM").alias("severity"))
    return n1.unionByName(counts).unionByName(raw)


def http_calls(files: DataFrame) -> DataFrame:
    """(file_id, line, client, verb, caller): requests that code sends, with the nearest function before."""
    lines = code_lines(files, "Http::", "Guzzle", "new Client", "curl_", "->request(", "->get('http", "->post('http")
    at = W.partitionBy("file_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    fn = F.regexp_extract("text", r"function\s+(\w+)\(", 1)
    x = lines.withColumn("caller", F.last(F.when(fn != "", fn), ignorenulls=True).over(at))
    client = F.when(F.col("text").contains("Http::"), "facade").when(F.col("text").rlike(r"new\s+\\?(?:GuzzleHttp\\)?Client\b|->request\(\s*'(?:GET|POST|PUT|PATCH|DELETE)'"), "guzzle").when(F.col("text").rlike(r"\bcurl_(?:init|exec)\("), "curl").when(F.col("text").rlike(r"->(?:get|post|put|patch|delete)\(\s*'https?://"), "shorthand")
    verb = F.upper(F.regexp_extract("text", r"(?i)(?:::|->)(get|post|put|patch|delete|head)\(|'(GET|POST|PUT|PATCH|DELETE)'", 1))
    return x.withColumn("client", client).filter(F.col("client").isNotNull()).select("file_id", "line", "client", F.when(verb != "", verb).otherwise("ANY").alias("verb"), "caller")


def notification_channels(files: DataFrame) -> DataFrame:
    """(file_id, channel) of notifications by their via method, and mailables as mail."""
    via = _all(files, r"(?s)function\s+via\([^)]*\)[^{]*\{[^}]*?return\s*\[([^\]]*)\]", ["many"], "function via")
    a = via.select("file_id", F.explode(F.regexp_extract_all("many", F.lit("'(\\w+)'"), F.lit(1))).alias("channel"))
    b = _all(files, r"class\s+\w+\s+extends\s+(Mailable)\b", ["c"], "Mailable").select("file_id", F.lit("mail").alias("channel"))
    return a.unionByName(b).distinct()


def switch_maps(files: DataFrame) -> DataFrame:
    """(file_id, key, value) of match arms from texts to literals, where an expression has two or more, and of switch cases.

    A case counts by what it returns first: a property (its name) or a text (in quotes); a switch counts with two or more of those.
    """
    return _match_maps(files).unionByName(_case_maps(files))


def _blocks(files: DataFrame, opening: str, *needles: str) -> DataFrame:
    """(file_id, body) of what stands in the brackets that a pattern opens, which may nest.

    Balance is no matter for patterns of the JVM, which would run out of stack on long texts, so the
    few files that hold a needle go through Arrow batches.
    """
    from codeweft.operators.routes import closing

    kind = dict(files.dtypes)["file_id"]
    rx = re.compile(opening)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(i, text[m.end() : closing(text, m.end() - 1) - 1]) for i, text in zip(x["file_id"], x["content"]) for m in rx.finditer(text)]
            yield pd.DataFrame(rows, columns=["file_id", "body"])

    return _files(files, *needles).select("file_id", "content").mapInPandas(run, f"file_id {kind}, body string")


def _case_maps(files: DataFrame) -> DataFrame:
    body = _blocks(files, r"\bswitch\s*\([^)]+\)\s*\{", "switch")
    key = r"^\s*(?:(\d+)|'([^']+)'|\"([^\"]+)\")\s*:"
    block = lambda c: F.struct(F.concat(*[F.regexp_extract(c, key, i) for i in (1, 2, 3)]).alias("key"), F.regexp_extract(c, r"return\s+\$\w+->(\w+)", 1).alias("prop"), F.concat(F.regexp_extract(c, r"return\s+'([^']+)'", 1), F.regexp_extract(c, r"return\s+\"([^\"]+)\"", 1)).alias("text"))
    cases = F.filter(F.transform(F.split("body", r"\bcase\b"), block), lambda x: (x["key"] != "") & ((x["prop"] != "") | (x["text"] != "")))
    x = body.select("file_id", cases.alias("cases")).filter(F.size("cases") >= 2).select("file_id", F.explode("cases").alias("c"))
    return x.select("file_id", "c.key", F.when(F.col("c.prop") != "", F.col("c.prop")).otherwise(F.concat(F.lit('"'), "c.text", F.lit('"'))).alias("value"))


def _match_maps(files: DataFrame) -> DataFrame:
    body = _all(files, r"(?s)match\s*\([^)]*\)\s*\{(.*?)\};", ["body"], "match (")
    numbered = body.withColumn("n", F.size(F.regexp_extract_all("body", F.lit("=>"), F.lit(0)))).filter("n >= 2")
    arm = F.regexp_extract_all("body", F.lit(r"([^,{}\n][^{}\n]*?)\s*=>\s*([^,\n]+)"), F.lit(0))
    x = numbered.select("file_id", F.explode(arm).alias("arm")).select("file_id", F.trim(F.split("arm", "=>")[0]).alias("keys"), F.trim(F.split("arm", "=>")[1]).alias("value"))
    return x.select("file_id", F.explode(F.split("keys", r"\s*,\s*")).alias("key"), "value").select("file_id", F.regexp_replace("key", "^'|'$", "").alias("key"), "value").filter("key <> ''")


def snippet(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_id, line_start, line_end, text): the lines of each span; an end before the start or beyond the file gives what there is."""
    parts = files.select("file_id", F.split("content", r"\r\n|\n|\r").alias("_l"))
    n = F.greatest(F.lit(0), F.least(F.col("line_end"), F.size("_l")) - F.col("line_start") + 1)
    return spans.join(parts, "file_id").select("file_id", "line_start", "line_end", F.array_join(F.when(F.col("line_start") >= 1, F.slice("_l", F.col("line_start"), n)), "\n").alias("text"))
