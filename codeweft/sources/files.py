"""Source trees as tables: walking, folders, manifests, catalogs, change logs; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.naming import file_role

#: Directories that are never walked, and prefixes below the root.
SKIPPED_DIRS = ("vendor", "storage", "node_modules", ".git")
SKIPPED_PREFIXES = ("bootstrap/cache/", "public/")
MAX_BYTES = 512 * 1024


def walked(path: Column, size: Column | None = None, ignore: list[str] | None = None) -> Column:
    """Whether a path is walked: outside skipped directories and ignore patterns (globs), and not too large."""
    ok = ~path.rlike(r"(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + r")/")
    for p in SKIPPED_PREFIXES:
        ok = ok & ~path.startswith(p)
    for g in ignore or []:
        rx = g.strip("/").replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*")
        ok = ok & ~path.rlike(rf"(?:^|/){rx}(?:/|$)")
    return ok if size is None else ok & F.coalesce(size <= MAX_BYTES, F.lit(True))


def walk(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] | None = None) -> DataFrame:
    """(path, size_bytes, modified_at, role, content) of the files below a folder, read in parallel, names relative to it."""
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + base.lstrip("/").replace(".", r"\.") + "/+", "")
    x = df.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return x.filter(walked(F.col("path"), F.col("size_bytes"), ignore)).select("path", "size_bytes", "modified_at", file_role(F.col("path")).alias("role"), F.decode("content", "UTF-8").alias("content"))


def line_stats(files: DataFrame) -> DataFrame:
    """(file_id, n_lines, n_chars) counted from the content; null content gives nulls."""
    ends = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    tail = F.when((F.col("content") != "") & ~F.col("content").endswith("\n"), 1).otherwise(0)
    return files.select("file_id", (ends + tail).cast("long").alias("n_lines"), F.length("content").cast("long").alias("n_chars"))


def folders(files: DataFrame) -> DataFrame:
    """(repo, folder, parent, n_files): every folder on the way to a file, with the files right in it or below."""
    parts = F.split("path", "/")
    deep = files.select("repo", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("folder"))
    parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise("")
    return deep.groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("n_files")).select("repo", "folder", parent.alias("parent"), "n_files")


def manifest(files: DataFrame) -> DataFrame:
    """(file_id, name, php_constraint, packages, psr4) of composer manifests; nulls where the text is no JSON."""
    schema = "name string, require map<string,string>, `require-dev` map<string,string>, autoload struct<`psr-4`: map<string,string>>"
    m = files.filter(F.col("path").rlike(r"(?:^|/)composer\.json$")).select("file_id", F.from_json("content", schema).alias("j"))
    none = F.create_map().cast("map<string,string>")
    return m.select("file_id", "j.name", F.col("j.require")["php"].alias("php_constraint"), F.map_concat(F.coalesce("j.require", none), F.map_filter(F.coalesce("j.require-dev", none), lambda k, _: ~F.map_contains_key(F.coalesce("j.require", none), k))).alias("packages"), F.col("j.autoload.psr-4").alias("psr4"))


def psr4_path(fqn: Column, prefix: Column, folder: Column) -> Column:
    """Where a class should lie by its prefix and folder; null when the prefix does not fit."""
    rest = F.replace(F.substr(fqn, F.length(prefix) + 1), F.lit("\\"), F.lit("/"))
    return F.when(fqn.startswith(prefix), F.concat(F.regexp_replace(folder, "/*$", "/"), rest, F.lit(".php")))


def change_log(commits: DataFrame, months: int, now: str, limit: int = 5000) -> DataFrame:
    """The (commit, ts, file) rows of the latest commits, at most ``limit`` of them, none older than 30 days a month before ``now``."""
    recent = commits.filter(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {30 * months} DAYS"))
    last = recent.select("commit", "ts").distinct().orderBy(F.desc("ts"), "commit").limit(limit)
    return recent.join(last.select("commit"), "commit", "left_semi")


def jdbc_catalog(spark: SparkSession, url: str, what: str, schema: str, **options: str) -> DataFrame:
    """A view of a live database's catalog over JDBC: tables, columns, keys, routines or views.

    The driver's jar is the caller's to provide; the filter on the schema runs in the database.
    """
    safe = schema.replace("'", "''")
    queries = {
        "tables": f"select table_name, engine, table_collation, table_comment, table_rows from information_schema.tables where table_schema = '{safe}'",
        "columns": f"select table_name, column_name, column_type, data_type, is_nullable, column_key, extra from information_schema.columns where table_schema = '{safe}'",
        "keys": f"select k.table_name, k.column_name, k.referenced_table_name, k.referenced_column_name, r.delete_rule, r.update_rule from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_name = k.constraint_name and r.constraint_schema = k.table_schema where k.table_schema = '{safe}'",
        "routines": f"select routine_name, routine_type, routine_definition from information_schema.routines where routine_schema = '{safe}'",
        "views": f"select table_name, view_definition from information_schema.views where table_schema = '{safe}'",
    }
    return spark.read.format("jdbc").option("url", url).option("query", queries[what]).options(**options).load()


def spark_catalog(spark: SparkSession) -> DataFrame:
    """(table, column, data_type) of the tables and views the session knows."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, data_type string")


# ---- sinks


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two tables partitioned by label and relation; only partitions that come are replaced."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_json(nodes: DataFrame, path: str, labels: list[str], limit: int = 1000) -> None:
    """The first nodes of each label by id as JSON lines; a report, so at most ``limit`` a label."""
    from codeweft.operators.graph import top_n

    top_n(nodes.filter(F.col("label").isin(labels)), ["label"], [F.col("node_id")], limit).write.mode("overwrite").json(path)


def registry_update(registry: DataFrame | None, entry: DataFrame) -> DataFrame:
    """The registry of repositories with an entry added or replaced, by path."""
    return entry if registry is None else registry.join(entry.select("path"), "path", "left_anti").unionByName(entry)


def registry_touch(registry: DataFrame, path: str, at: float) -> DataFrame:
    """The registry with the time of one repository set and all else of it kept; one that is not there is not added."""
    return registry.withColumn("indexed_at", F.when(F.col("path") == path, F.lit(float(at))).otherwise(F.col("indexed_at")))


def registry_remove(registry: DataFrame, path: str) -> DataFrame:
    """The registry without one repository."""
    return registry.filter(F.col("path") != path)


#: What the log of a repository must be written with to be read by :func:`git_log`.
GIT_LOG_FORMAT = "git log --name-only --format=%x1e%H|%ct"


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, ts, file) from logs written as :data:`GIT_LOG_FORMAT` says, one record a commit; a commit without files gives none."""
    r = spark.read.option("lineSep", "\x1e").text(path).select(F.split("value", "\n").alias("l")).filter(F.col("l")[0].contains("|"))
    head = F.split(F.col("l")[0], r"\|")
    x = r.select(head[0].alias("commit"), F.timestamp_seconds(head[1].cast("long")).cast("timestamp_ntz").alias("ts"), F.explode(F.slice("l", 2, F.size("l"))).alias("file"))
    return x.withColumn("file", F.trim("file")).filter("file <> ''")


def schema_hash(columns: DataFrame, by: list[str]) -> DataFrame:
    """(by..., hash): sixteen digits that change when a column of a table (column, type) comes, goes or changes its type."""
    each = F.concat_ws(":", "column", F.coalesce("type", F.lit("")))
    return columns.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(each)), "|"), 256), 1, 16).alias("hash"))


def stale_by_schema(cached: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """The cached entries (by..., hash, ...) whose table has another hash now, or is gone."""
    return cached.join(now.select(*by, "hash"), [*by, "hash"], "left_anti")
