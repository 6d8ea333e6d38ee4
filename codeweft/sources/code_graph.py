"""A code graph from the tables of analysed repositories: nodes, edges, and where each comes from.

Each part is a plain projection or join of one or two tables, so the optimizer drops the parts
that a query does not ask for: ``nodes`` and ``edges`` take the labels and relations wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import naming
from codeweft.functions.names import class_key, table_key
from codeweft.operators import extract
from codeweft.operators.analytics import enclosing
from codeweft.operators.graph import node_id
from codeweft.operators.symbols import latest, living_symbols
from codeweft.sources.files import folders

_NODE = ("node_id", "label", "name", "fqn", "repo", "file_id", "file_path", "role", "line_start", "line_end")
_EDGE = ("src", "rel", "dst", "line", "confidence", "detail")
_TYPES = {"file_id": "bigint", "line_start": "int", "line_end": "int", "line": "int", "confidence": "double"}


def _shape(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in columns])


class CodeGraph:
    """Lazy nodes and edges over tables named as in a data folder; ``read`` gives a table by name."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self.read = read

    # ---- nodes

    def files(self) -> DataFrame:
        f = self.read("source_files")
        return f.select("file_id", "repo", "path", "extension", "content", F.coalesce(F.col("laravel_role"), naming.file_role(F.col("path"), F.col("content"))).alias("role"))

    def php(self) -> DataFrame:
        return self.files().filter("extension = '.php'")

    def symbols(self) -> DataFrame:
        """(key, node_id, label, name, fqn, ...) of the living symbols."""
        s = living_symbols(self.read("parsed_classes"), ["kind", "name", "repo", "file_id", "file_path", "line_start", "line_end", "extends", "implements", "traits"])
        label = F.when(F.col("kind") == "trait", "Trait_").when(F.col("kind") == "interface", "Interface_").when(F.col("kind") == "enum", "Enum_").otherwise("Class_")
        role = naming.class_role(naming.file_role(F.col("file_path")), F.col("extends"))
        return s.withColumn("label", label).withColumn("role", role).withColumn("node_id", node_id(F.lower("label"), F.col("key")))

    def methods(self) -> DataFrame:
        """(node_id, class_key, ...) of the methods, repeated rows once."""
        m = self.read("methods")
        one = latest(m, ["node_id"], ["parsed_at", "method_id"], ["repo", "file_id", "file_path", "name", "fqn", "line_start", "line_end", "param_types", "return_type", "method_id"])
        return one.withColumn("class_key", class_key(F.substring_index("fqn", "::", 1)))

    def routes(self) -> DataFrame:
        """Routes of the route files with ids: by name, else by verb and path."""
        r = extract.routes(self.php().filter("path like 'routes/%'")).join(self.files().select("file_id", "repo", "path"), "file_id")
        return r.withColumn("node_id", node_id("route", F.col("repo"), F.coalesce("name", F.concat_ws(":", "http_method", "uri")))).withColumn("name", F.coalesce("name", F.concat_ws(" ", "http_method", "uri")))

    def method_sources(self) -> DataFrame:
        """(method, name, fqn, class_key, repo, file_path, role, source) of the methods whose file is there; ``role`` is that of the class."""
        s = self.symbols().select(F.col("key").alias("class_key"), "role")
        m = self.methods().select("file_id", "line_start", "line_end", F.col("node_id").alias("method"), "name", "fqn", "class_key", "repo", "file_path")
        return extract.method_sources(self.php(), m).join(s, "class_key", "left").drop("file_id", "line_start", "line_end")

    def templates(self) -> DataFrame:
        t = self.files().filter("extension = '.blade.php'")
        view = F.translate(F.regexp_replace(F.regexp_replace("path", r"^.*?views/", ""), r"\.blade\.php$", ""), "/", ".")
        return t.withColumn("view", view).withColumn("node_id", node_id("blade_template", F.col("repo"), F.col("view")))

    def columns(self) -> DataFrame:
        c = extract.migration_columns(self.files()).join(self.files().select("file_id", "repo"), "file_id").dropDuplicates(["repo", "table", "column"])
        return c.withColumn("node_id", node_id("db_column", F.col("repo"), F.col("table"), F.col("column")))

    def live_tables(self) -> DataFrame:
        """(repo, table_key, node_id, connection): the latest table of each name that is not dropped."""
        t = self.read("db_tables").withColumn("table_key", table_key(F.col("name")))
        return latest(t, ["repo", "table_key"], ["created_at", "table_id"], ["node_id", "name", "connection", "dropped_at", "source"]).filter("dropped_at is null")

    def nodes(self, *labels: str) -> DataFrame:
        """Nodes of the labels, or of all that are built."""
        parts = {
            "Folder": lambda: folders(self.files()).select(node_id("folder", F.col("repo"), F.col("folder")).alias("node_id"), F.lit("Folder").alias("label"), F.col("folder").alias("name"), "repo"),
            "File": lambda: self.files().select(node_id("file", F.col("repo"), F.col("path")).alias("node_id"), F.lit("File").alias("label"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "repo", "file_id", F.col("path").alias("file_path"), "role"),
            "Method": lambda: self.methods().withColumn("label", F.lit("Method")),
            "Route": lambda: self.routes().select("node_id", F.lit("Route").alias("label"), "name", "repo", "file_id", F.col("path").alias("file_path")).dropDuplicates(["node_id"]),
            "BladeTemplate": lambda: self.templates().select("node_id", F.lit("BladeTemplate").alias("label"), F.col("view").alias("name"), "repo", "file_id", F.col("path").alias("file_path")),
            "DatabaseTable": lambda: self.live_tables().withColumn("label", F.lit("DatabaseTable")),
            "DatabaseColumn": lambda: self.columns().select("node_id", F.lit("DatabaseColumn").alias("label"), F.col("column").alias("name"), "repo", F.col("type").alias("role")),
            "EloquentModel": lambda: latest(self.read("eloquent_models"), ["node_id"], ["parsed_at", "model_id"], ["name", "fqn", "repo", "file_path"]).withColumn("label", F.lit("EloquentModel")),
            "ConfigKey": lambda: extract.config_keys(self.files()).join(self.files().select("file_id", "repo"), "file_id").select(node_id("config_key", F.col("repo"), F.col("key")).alias("node_id"), F.lit("ConfigKey").alias("label"), F.col("key").alias("name"), "repo").dropDuplicates(["node_id"]),
            "Middleware": lambda: self._middleware().select(F.col("dst").alias("node_id"), F.lit("Middleware").alias("label"), F.substring_index("dst", "::", -1).alias("name"), "repo").distinct(),
            "PerformanceRisk": lambda: self._risks().select(F.col("dst").alias("node_id"), F.lit("PerformanceRisk").alias("label"), F.col("detail").alias("name")).distinct(),
            "HttpClientCall": lambda: self._external().select(F.col("dst").alias("node_id"), F.lit("HttpClientCall").alias("label"), F.col("detail").alias("name")).distinct(),
            "Feature": lambda: self._features().select(F.col("dst").alias("node_id"), F.lit("Feature").alias("label"), F.substring_index("dst", ":", -1).alias("name")).distinct(),
            "TestCase": lambda: self._tests().select(F.col("src").alias("node_id"), F.lit("TestCase").alias("label"), F.substring_index("src", ":", -1).alias("name")).distinct(),
            "EnvVariable": lambda: extract.config_uses(self.php()).filter("kind = 'env'").join(self.files().select("file_id", "repo"), "file_id").select(node_id("env", F.col("repo"), F.col("key")).alias("node_id"), F.lit("EnvVariable").alias("label"), F.col("key").alias("name"), "repo").dropDuplicates(["node_id"]),
        }
        kinds = {"Class_", "Trait_", "Interface_", "Enum_"}
        wanted = set(labels or [*parts, *kinds])
        out = [_shape(parts[k](), _NODE) for k in parts if k in wanted]
        if wanted & kinds:
            out.append(_shape(self.symbols().filter(F.col("label").isin(list(wanted & kinds))), _NODE))
        return reduce(lambda a, b: a.unionByName(b), out)

    # ---- edges

    def _heritage(self, rel: str) -> DataFrame:
        s = self.symbols()
        e = extract.heritage(s.select(F.col("node_id").alias("fqn"), "extends", "implements", "traits")).filter(F.col("rel") == rel)
        return e.select(F.col("child").alias("src"), "rel", class_key(F.col("parent")).alias("key")).join(s.select("key", F.col("node_id").alias("dst")), "key")

    def _inside(self, sites: DataFrame) -> DataFrame:
        """Sites (file_id, line, ...) with the method that holds them as src."""
        m = self.methods().filter("file_id is not null and line_start is not null").select("file_id", "line_start", F.coalesce("line_end", F.lit(2**31 - 1)).alias("line_end"), "node_id")
        x = enclosing(sites, m, "file_id", "line", "line_start", "line_end")
        return x.filter("span_node_id is not null").withColumnRenamed("span_node_id", "src").drop("span_file_id", "span_line_start", "span_line_end")

    def _aliases(self) -> DataFrame:
        """(file_id, alias, key): what the imports of a file stand for."""
        return extract.imports(self.php()).select("file_id", "alias", class_key(F.col("fqn")).alias("key")).groupBy("file_id", "alias").agg(F.min("key").alias("key"))

    def _by_alias(self, names: DataFrame, column: str) -> DataFrame:
        """Names as a file writes them, with the symbol they mean: through its imports, else the one of that short name in the repository."""
        repo = self.files().select("file_id", "repo")
        s = self.symbols()
        used = self._aliases().withColumnRenamed("alias", column)
        direct = names.join(used, ["file_id", column], "left").join(s.select("key", F.col("node_id").alias("d0")), "key", "left").drop("key")
        short = extract.short_targets(s, ["repo"]).join(s.select("key", F.col("node_id").alias("d1")), "key").select("repo", F.col("name").alias(column), "d1")
        return direct.join(repo, "file_id", "left").join(short, ["repo", column], "left").withColumn("dst", F.coalesce("d0", "d1")).drop("d0", "d1", "repo").filter("dst is not null")

    def edges(self, *rels: str) -> DataFrame:
        """Edges of the relations, or of all that are built; one for each site they come from."""
        build = {
            "CONTAINS": self._contains, "DEFINES": self._defines, "IMPORTS": self._imports, "CALLS": self._calls, "DISPATCHES": self._dispatches, "USES_TYPE": self._uses_type, "ROUTES_TO": self._routes_to, "USES_TABLE": self._uses_table, "QUERIES_TABLE": self._queries_table,
            "HAS_COLUMN": self._has_column, "EXTENDS_TEMPLATE": lambda: self._template("EXTENDS_TEMPLATE"), "INCLUDES_TEMPLATE": lambda: self._template("INCLUDES_TEMPLATE"), "USES_CONFIG": lambda: self._settings("config"), "USES_ENV": lambda: self._settings("env"),
            "INJECTS": self._injects, "RENDERS_TEMPLATE": self._renders, "HAS_COMPONENT": self._components, "LISTENS_TO": self._listens, "BINDS_TO": self._binds, "HAS_RELATIONSHIP": self._relationships, "REFERENCES_TABLE": self._references, "APPLIES_MIDDLEWARE": self._middleware,
            "VALIDATES_WITH": lambda: self._asks_for("request"), "TRANSFORMS_WITH": lambda: self._asks_for("resource"), "HAS_PERFORMANCE_RISK": self._risks, "CALLS_EXTERNAL": self._external, "BELONGS_TO_FEATURE": self._features, "TESTS": self._tests,
            **{r: (lambda r=r: self._heritage(r)) for r in ("EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT")},
        }
        return reduce(lambda a, b: a.unionByName(b), [_shape(build[r]().withColumn("rel", F.lit(r)), _EDGE) for r in (rels or build)])

    def _file_id(self) -> DataFrame:
        return self.files().select("file_id", node_id("file", F.col("repo"), F.col("path")).alias("file_node"))

    def _contains(self) -> DataFrame:
        f = folders(self.files())
        up = f.filter("parent <> ''").select(node_id("folder", F.col("repo"), F.col("parent")).alias("src"), node_id("folder", F.col("repo"), F.col("folder")).alias("dst"))
        leaf = self.files().filter("path like '%/%'").select(node_id("folder", F.col("repo"), F.regexp_replace("path", "/[^/]*$", "")).alias("src"), node_id("file", F.col("repo"), F.col("path")).alias("dst"))
        return up.unionByName(leaf)

    def _defines(self) -> DataFrame:
        s = self.symbols()
        a = s.select("file_id", F.col("node_id").alias("dst"), F.col("line_start").alias("line")).join(self._file_id(), "file_id").select(F.col("file_node").alias("src"), "dst", "line")
        b = self.methods().select(F.col("class_key").alias("key"), F.col("node_id").alias("dst"), F.col("line_start").alias("line")).join(s.select("key", F.col("node_id").alias("src")), "key").select("src", "dst", "line")
        c = self.routes().select("file_id", F.col("node_id").alias("dst")).distinct().join(self._file_id(), "file_id").select(F.col("file_node").alias("src"), "dst", F.lit(None).cast("int").alias("line"))
        d = self.templates().select(node_id("file", F.col("repo"), F.col("path")).alias("src"), F.col("node_id").alias("dst"), F.lit(None).cast("int").alias("line"))
        return a.unionByName(b).unionByName(c).unionByName(d)

    def _imports(self) -> DataFrame:
        u = self.read("parsed_uses").select("file_id", class_key(F.col("fqn")).alias("key"), "line", F.col("alias").alias("detail"))
        at = self.symbols().select("key", F.col("file_id").alias("target")).filter("target is not null")
        x = u.join(at, "key").filter("file_id <> target")
        ids = self._file_id()
        return x.join(ids.withColumnRenamed("file_node", "src"), "file_id").drop("file_id").join(ids.select(F.col("file_id").alias("target"), F.col("file_node").alias("dst")), "target")

    def calls(self) -> DataFrame:
        """(src, target, target_kind, call_type, line, confidence) of the calls inside methods that can be told."""
        m = self.methods().select("class_key", "name", "node_id")
        at = self._inside(extract.calls(self.php())).join(m.select(F.col("node_id").alias("src"), F.col("class_key").alias("caller_key")), "src").join(self.files().select("file_id", "repo"), "file_id")
        return extract.resolved_calls(at, m, self.symbols().select("key", "fqn", "name", "repo", "node_id"), self._aliases())

    def _calls(self) -> DataFrame:
        return self.calls().select("src", F.col("target").alias("dst"), "line", "confidence", F.col("call_type").alias("detail"))

    def _dispatches(self) -> DataFrame:
        d = extract.dispatches(self.php())
        return self._by_alias(self._inside(d), "target").select("src", "dst", "line", F.col("dispatch_type").alias("detail"))

    def _uses_type(self) -> DataFrame:
        m = self.methods()
        t = extract.type_uses(m.select("node_id", "method_id", "param_types", "return_type"))
        at = m.select("method_id", "file_id", F.col("node_id").alias("src"))
        names = t.join(at, "method_id").select("file_id", "src", naming.short_name(F.col("type")).alias("type"), F.col("role").alias("detail"))
        return self._by_alias(names, "type").select("src", "dst", "detail")

    def _routes_to(self) -> DataFrame:
        """Routes to the method that handles them: the controller by its full name, else by its short name in the repository."""
        r = self.routes().filter("controller is not null").select("repo", F.col("node_id").alias("src"), class_key(F.col("controller")).alias("full"), naming.short_name(F.col("controller")).alias("name"), "action").distinct()
        s = self.symbols()
        c = r.join(s.select(F.col("key").alias("full"), F.col("key").alias("k0")), "full", "left").join(extract.short_targets(s, ["repo"]).withColumnRenamed("key", "k1"), ["repo", "name"], "left")
        m = self.methods().groupBy("class_key", F.col("name").alias("action")).agg(F.min("node_id").alias("dst"))
        return c.withColumn("class_key", F.coalesce("k0", "k1")).join(m, ["class_key", "action"]).select("src", "dst")

    def _model_tables(self) -> DataFrame:
        """(node_id, name, repo, table) of the models; one without a named table has that of its name."""
        m = self.read("eloquent_models").select("node_id", "name", "repo", F.coalesce(table_key(F.col("db_table")), naming.table_of_class(F.col("name"))).alias("table_key")).distinct()
        return m.join(self.live_tables().select("repo", "table_key", F.col("node_id").alias("table")), ["repo", "table_key"])

    def _uses_table(self) -> DataFrame:
        return self._model_tables().select(F.col("node_id").alias("src"), F.col("table").alias("dst"))

    def _queries_table(self) -> DataFrame:
        a = self._inside(extract.db_access(self.php())).join(self.files().select("file_id", "repo"), "file_id")
        models = self._model_tables().groupBy("repo", F.col("name").alias("target")).agg(F.min("table").alias("m"))
        tables = self.live_tables().select("repo", F.col("table_key").alias("target"), F.col("node_id").alias("t"))
        x = a.join(models, ["repo", "target"], "left").join(tables, ["repo", "target"], "left").withColumn("dst", F.coalesce("m", "t"))
        return x.filter("dst is not null").select("src", "dst", "line", "confidence", F.col("operation").alias("detail"))

    def _has_column(self) -> DataFrame:
        t = self.live_tables().select("repo", F.col("table_key").alias("table"), F.col("node_id").alias("src"))
        return self.columns().select("repo", "table", F.col("node_id").alias("dst")).join(t, ["repo", "table"]).select("src", "dst")

    def _template(self, rel: str) -> DataFrame:
        t = self.templates()
        e = extract.templates(self.files()).filter(F.col("rel") == rel).join(t.select("file_id", "repo", F.col("node_id").alias("src")), "file_id")
        return e.join(t.select("repo", F.col("view").alias("target"), F.col("node_id").alias("dst")), ["repo", "target"]).select("src", "dst")

    def _settings(self, kind: str) -> DataFrame:
        u = extract.config_uses(self.php()).filter(F.col("kind") == kind).join(self.files().select("file_id", "repo"), "file_id")
        label = "config_key" if kind == "config" else "env"
        return u.join(self._file_id(), "file_id").select(F.col("file_node").alias("src"), node_id(label, F.col("repo"), F.col("key")).alias("dst"), "line")

    # ---- relations of the framework

    def _owner(self) -> DataFrame:
        """(file_id, src): the least symbol of each file, which stands for what the file does."""
        return self.symbols().filter("file_id is not null").groupBy("file_id").agg(F.min("node_id").alias("src"))

    def _injects(self) -> DataFrame:
        i = extract.injections(self.php()).select("file_id", naming.short_name(F.col("type")).alias("type"), F.col("injection").alias("detail"))
        return self._by_alias(i, "type").join(self._owner(), "file_id").select("src", "dst", "detail").distinct()

    def _renders(self) -> DataFrame:
        v = extract.placed(self.php(), r"\bview\(\s*'([\w./:-]+)'", ["view"], "view(")
        t = self.templates().select("repo", "view", F.col("node_id").alias("dst"))
        return self._inside(v).join(self.files().select("file_id", "repo"), "file_id").join(t, ["repo", "view"]).select("src", "dst", "line")

    def _components(self) -> DataFrame:
        t = self.templates()
        e = extract.templates(self.files()).filter("rel = 'HAS_COMPONENT'").join(t.select("file_id", "repo", F.col("node_id").alias("src")), "file_id")
        return e.withColumn("view", F.concat(F.lit("components."), "target")).join(t.select("repo", "view", F.col("node_id").alias("dst")), ["repo", "view"]).select("src", "dst")

    def _named(self, names: DataFrame, column: str, out: str) -> DataFrame:
        """Class names of a file with the symbol they mean, as ``out``."""
        return self._by_alias(names.withColumn(column, naming.short_name(F.col(column))), column).withColumnRenamed("dst", out)

    def _listens(self) -> DataFrame:
        l = extract.listeners(self.php()).select("file_id", "event", "listener", F.col("source").alias("detail"))
        return self._named(self._named(l, "event", "to"), "listener", "src").select("src", F.col("to").alias("dst"), "detail")

    def _binds(self) -> DataFrame:
        b = extract.bindings(self.php()).filter("concrete is not null").select("file_id", "abstract", "concrete", F.col("binding_type").alias("detail"))
        return self._named(self._named(b, "concrete", "to"), "abstract", "src").select("src", F.col("to").alias("dst"), "detail")

    def _relationships(self) -> DataFrame:
        models = self.read("eloquent_models").select("repo", "name", "file_path", "node_id").distinct()
        at = self.files().select("file_id", "repo", F.col("path").alias("file_path")).join(models.select("repo", "file_path", F.col("node_id").alias("src")), ["repo", "file_path"]).drop("file_path")
        r = extract.model_relations(self.php()).filter("target is not null").select("file_id", naming.short_name(F.col("target")).alias("name"), F.col("relation").alias("detail"))
        return r.join(at, "file_id").join(models.select("repo", "name", F.col("node_id").alias("dst")), ["repo", "name"]).select("src", "dst", "detail")

    def _references(self) -> DataFrame:
        t = self.live_tables().select("repo", F.col("table_key").alias("references_table"), F.col("node_id").alias("dst"))
        return self.columns().filter("references_table is not null").select("repo", "references_table", F.col("node_id").alias("src")).join(t, ["repo", "references_table"]).select("src", "dst")

    def _middleware(self) -> DataFrame:
        m = self.routes().select("repo", F.col("node_id").alias("src"), F.posexplode("middleware").alias("line", "m"))
        return m.select("src", node_id("middleware", F.col("repo"), F.split("m", ":", 2)[0]).alias("dst"), "line", F.get(F.split("m", ":", 2), F.lit(1)).alias("detail"), "repo")

    def _asks_for(self, role: str) -> DataFrame:
        s = self.symbols().filter(F.col("role") == role).select(F.col("node_id").alias("dst"))
        return self._uses_type().join(s, "dst", "left_semi").select("src", "dst", "detail").distinct()

    def _risks(self) -> DataFrame:
        r = extract.query_risks(self.method_sources())
        return r.select(F.col("method").alias("src"), node_id("perfrisk", F.col("method"), F.col("risk"), F.col("line")).alias("dst"), "line", F.col("risk").alias("detail"))

    def _external(self) -> DataFrame:
        h = self._inside(extract.http_calls(self.php()))
        return h.select("src", node_id("http_call", F.col("src"), F.col("client"), F.col("verb"), F.col("line")).alias("dst"), "line", F.concat_ws(" ", "client", "verb").alias("detail"))

    def _features(self) -> DataFrame:
        from codeweft.plans.tools import features

        f = features(self.routes().select("node_id", "uri").distinct(), self.symbols().filter("label = 'Class_'").select("node_id", "name"))
        return f.select(F.col("node_id").alias("src"), node_id("feature", F.col("feature")).alias("dst"), F.col("match_type").alias("detail"))

    def _tests(self) -> DataFrame:
        from codeweft.operators.analytics import test_links

        t = extract.test_references(self.files())
        links = test_links(t.select("test_id", "uris", "class_refs"), self.routes().select(F.col("node_id").alias("route_id"), "uri"), self.symbols().filter("label = 'Class_'").select(F.col("node_id").alias("class_id"), "name"))
        return links.select(node_id("test", F.col("test_id")).alias("src"), F.col("target").alias("dst"), F.col("kind").alias("detail"))
