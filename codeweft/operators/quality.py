"""Findings about the quality of data and the safety of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions import fixed


def value_distribution(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """(value, n): how often each value occurs, in order of the value; a report of the first ``limit``."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(limit)


def value_sample(df: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """(value, n, overflow): the most frequent values that are not null; ``overflow`` when there are more than ``limit``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    more = counts.orderBy(F.desc("n"), "value").limit(limit + 1)
    size = more.agg((F.count(F.lit(1)) > limit).alias("overflow"))
    return more.orderBy(F.desc("n"), "value").limit(limit).crossJoin(F.broadcast(size))  # one row


def boolean_drift(df: DataFrame, column: str, min_rows: int = 10) -> DataFrame:
    """(column, n_rows, n_distinct, values): one row when a column meant as a flag holds values other than 0, 1, true and false."""
    v = F.lower(F.trim(F.col(column).cast("string")))
    x = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(v).alias("n_distinct"), F.max(~v.isin("0", "1", "true", "false")).alias("drift"))
    seen = df.filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(50).agg(F.sort_array(F.collect_list("value")).alias("values"))
    return x.filter(F.col("drift") & (F.col("n_rows") >= min_rows)).crossJoin(F.broadcast(seen)).select(F.lit(column).alias("column"), "n_rows", "n_distinct", "values")


def enum_near_duplicates(df: DataFrame, column: str, min_rows: int = 10, max_distinct: int = 30) -> DataFrame:
    """(normal, spellings, n): values of a small set that differ only in case, blanks, hyphens and underscores."""
    v = F.col(column).cast("string")
    normal = F.regexp_replace(F.lower(F.trim(v)), r"[\s_-]+", "")
    counts = df.filter(v.isNotNull()).groupBy(v.alias("value"), normal.alias("normal")).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"))
    groups = counts.groupBy("normal").agg(F.sort_array(F.collect_list("value")).alias("spellings"), F.sum("n").alias("n")).filter(F.size("spellings") > 1)
    return groups.crossJoin(F.broadcast(size)).filter((F.col("k") <= max_distinct) & (F.col("rows") >= min_rows)).select("normal", "spellings", "n")


def mixed_empty(df: DataFrame, column: str, min_rows: int = 10) -> DataFrame:
    """(column, n_null, n_empty, n_rows): one row when a column says nothing in two ways, as null and as an empty text."""
    v = F.col(column).cast("string")
    x = df.agg(F.sum(v.isNull().cast("long")).alias("n_null"), F.sum((F.trim(v) == "").cast("long")).alias("n_empty"), F.count(F.lit(1)).alias("n_rows"))
    return x.filter((F.col("n_null") > 0) & (F.col("n_empty") > 0) & (F.col("n_rows") >= min_rows)).select(F.lit(column).alias("column"), "n_null", "n_empty", "n_rows")


def quality_report(df: DataFrame, name: str, min_rows: int = 10, max_distinct: int = 30, limit: int = 50) -> DataFrame:
    """(table, column, finding, detail, n): all findings over the text and flag columns of a table, the most frequent first."""
    out = None
    for f in df.schema.fields:
        parts = []
        if isinstance(f.dataType, T.StringType):
            parts.append(enum_near_duplicates(df, f.name, min_rows, max_distinct).select(F.lit("ENUM_NEAR_DUPLICATE").alias("finding"), F.array_join("spellings", "|").alias("detail"), "n"))
            parts.append(mixed_empty(df, f.name, min_rows).select(F.lit("STATUS_MIXED_EMPTY").alias("finding"), F.lit("").alias("detail"), (F.col("n_null") + F.col("n_empty")).alias("n")))
        if f.name.startswith(("is_", "has_")) and not isinstance(f.dataType, T.BooleanType):
            parts.append(boolean_drift(df, f.name, min_rows).select(F.lit("BOOLEAN_DRIFT").alias("finding"), F.array_join("values", "|").alias("detail"), F.col("n_rows").alias("n")))
        for p in parts:
            p = p.select(F.lit(name).alias("table"), F.lit(f.name).alias("column"), "finding", "detail", "n")
            out = p if out is None else out.unionByName(p)
    if out is None:
        return df.sparkSession.createDataFrame([], "table string, column string, finding string, detail string, n long")
    return out.orderBy(F.desc("n"), "column", "finding", "detail").limit(limit)


_LOCKS = ("db::transaction", "lockforupdate", "sharedlock", "cache::lock", "->lock(")
_REPORTING = r"(?i)(?:avg|trend|insight|report|stats|analytics|export|download|index$|list$|show$|get[A-Z])"


def race_conditions(sources: DataFrame) -> DataFrame:
    """(method, pattern, columns, evidence) from methods (method, name, role, file_path, source) that check and then act without a lock.

    Each method of models, controllers, services and jobs outside of tests is judged by itself, its
    comments left out. Exempt are methods that take a lock or a transaction, those whose names tell
    of reports, and those that read the request and save nothing. Patterns: a property computed
    from itself and saved within ten lines; a count compared before rows are made; a status
    compared with a text, set and saved. A pattern counts once for each column of a method.
    """
    ok = F.col("role").isin(*fixed.RACE_ROLES) & ~F.coalesce("file_path", F.lit("")).contains("/tests/") & ~F.coalesce("file_path", F.lit("")).endswith(".blade.php") & ~F.col("name").rlike(_REPORTING)
    m = sources.filter(ok).withColumn("code", F.regexp_replace(F.regexp_replace("source", r"//[^\n]*", ""), r"(?s)/\*.*?\*/", ""))
    low = F.lower("code")
    for lock in _LOCKS:
        m = m.filter(~low.contains(lock))
    m = m.filter(~(low.contains("$request->") & ~low.contains("->save()")))
    lines = F.split("code", "\n")
    rows = m.filter(F.col("code").contains("save")).select("method", "code", F.posexplode(lines).alias("i", "text"), lines.alias("l"))
    got = rows.select("*", F.regexp_extract("text", r"\$(\w+)->(\w+)\s*=", 1).alias("v"), F.regexp_extract("text", r"\$(\w+)->(\w+)\s*=", 2).alias("c"), F.regexp_extract("text", r"\$\w+->\w+\s*=(.*)", 1).alias("rhs"), F.array_join(F.slice("l", F.col("i") + 1, 10), "\n").alias("near"))
    got = got.filter("v <> '' and v not in ('request', 'response', 'this', 'data', 'input', 'params') and c not in ('id', 'created_at', 'updated_at', 'deleted_at')")
    own = F.expr(r"""rhs rlike concat('[$]', v, '->', c, '(?:\\s|[-+*/;]|$)') and near rlike concat('[$]', v, '->\\s*save\\s*\\(') and not code rlike concat('(?:decrement|increment)\\(\\s*[\'"]', c, '[\'"]')""")
    prop = got.filter(own).select("method", F.lit("ELOQUENT_PROPERTY").alias("pattern"), F.col("c").alias("columns"), F.substring(F.trim("text"), 1, 120).alias("evidence"))
    cap = r"(?s)(->count\(\)|->sum\([^)]*\))\s*;\s*\n[^;]*if\s*\(\s*\$\w+\s*(?:<|<=|>=|>)\s*\$?\w+"
    capacity = m.filter(F.col("code").rlike(cap) & F.col("code").rlike(r"::create\(|->insert\(")).select("method", F.lit("CAPACITY_CHECK").alias("pattern"), F.lit("count/capacity").alias("columns"), F.trim(F.substring(F.regexp_extract("code", cap, 0), 1, 100)).alias("evidence"))
    gate = r"if\s*\(\s*\$(\w+)->\s*(\w+)\s*(?:===|==)\s*['\"]\w+['\"]"
    pairs = F.arrays_zip(F.regexp_extract_all("code", F.lit(gate), F.lit(1)).alias("v"), F.regexp_extract_all("code", F.lit(gate), F.lit(2)).alias("c"), F.regexp_extract_all("code", F.lit(gate), F.lit(0)).alias("t"))
    gates = m.filter(F.col("code").contains("save")).select("method", "code", F.explode(pairs).alias("x")).select("method", "code", "x.v", "x.c", "x.t").filter(F.col("c").rlike("(?:status|state|stage)$") & (F.col("v") != "request"))
    status = gates.filter(F.expr(r"""code rlike concat('[$]', v, '->\\s*', c, '\\s*=\\s*[\'"]') and code rlike concat('[$]', v, '->\\s*save\\s*\\(')""")).select("method", F.lit("STATUS_GATE").alias("pattern"), F.col("c").alias("columns"), F.substring("t", 1, 120).alias("evidence"))
    return prop.unionByName(capacity).unionByName(status).groupBy("method", "pattern", "columns").agg(F.min("evidence").alias("evidence"))


def sensitive_columns(names: DataFrame, column: str = "name") -> DataFrame:
    """Columns whose name tells of secrets or payment data, names that only look so left out."""
    low = F.lower(F.col(column))
    some = lambda words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)), True)
    return names.filter(some(fixed.SENSITIVE) & ~some(fixed.NOT_SENSITIVE))


def discriminator(name: Column, kind: Column | None = None, guards: Column | None = None) -> Column:
    """Whether a column tells kinds of rows apart: by a condition on it, by its name, or by a small whole or enumerated type."""
    low = F.lower(name)
    out = low.rlike(r"_(?:type|status|state|kind|mode|flag)$|^(?:is|has)_")
    if kind is not None:
        out = out | F.lower(kind).rlike("tinyint|smallint|enum")
    if guards is not None:
        out = out | (guards > 0)
    return F.coalesce(out, F.lit(False))


def log_stats(logs: DataFrame, level: str = "level") -> DataFrame:
    """(level, n) of log rows; rows without a level count as unknown."""
    return logs.groupBy(F.upper(F.coalesce(F.col(level), F.lit("unknown"))).alias("level")).agg(F.count(F.lit(1)).alias("n"))
