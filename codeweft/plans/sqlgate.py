"""Read-only access: guards, limits and a cache of results."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, DEFAULT_ROWS, TTL = 500, 50, 300.0
_READ = ("select", "show", "describe", "desc", "explain", "with")
_WRITE = re.compile(r"\b(?:insert|update|delete|drop|create|alter|truncate|replace|merge|grant|revoke|call|load|set|lock|rename|cache|uncache|refresh|add|use)\b", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_CYPHER_WRITE = re.compile(r"\b(?:create|merge|delete|set|remove|drop|detach|load|copy)\b", re.I)


def _bare(sql: str) -> str:
    """A statement without its literals and comments, so that words inside them do not count."""
    return _QUOTED.sub(" ", sql)


def read_only(sql: str) -> str | None:
    """Why a SQL statement is refused, or None: one statement, of a reading kind, without writing words."""
    bare = _bare(sql).strip().rstrip(";").strip()
    if not bare:
        return "empty statement"
    if ";" in bare:
        return "more than one statement"
    first = bare.split(None, 1)[0].lower()
    if first not in _READ:
        return f"{first.upper()} is not allowed"
    if first != "show" and (m := _WRITE.search(bare)):
        return f"{m[0].upper()} is not allowed"
    return None


def read_only_pattern(query: str) -> str | None:
    """The same for graph patterns."""
    if m := _CYPHER_WRITE.search(_bare(query)):
        return f"{m[0].upper()} is not allowed"
    return None


def limited(sql: str, rows: int = DEFAULT_ROWS) -> str:
    """A SELECT with a LIMIT between 1 and MAX_ROWS, one that is there already included; other kinds stay as they are."""
    text = sql.strip().rstrip(";").rstrip()
    bare = _bare(text)
    if bare.split(None, 1)[0].lower() not in ("select", "with"):
        return text
    clamp = lambda n: min(MAX_ROWS, max(1, n))
    if m := re.search(r"\blimit\s+(\d+|all)(\s+offset\s+\d+)?\s*$", text, re.I):
        n = MAX_ROWS if m[1].lower() == "all" else int(m[1])
        return f"{text[: m.start()]}LIMIT {clamp(n)}{m[2] or ''}"
    if re.search(r"\blimit\b[^)]*$", bare, re.I):  # a limit by expression or parameter: the outer one decides
        return f"SELECT * FROM ({text}) LIMIT {MAX_ROWS}"
    return f"{text} LIMIT {clamp(rows)}"


def run_sql(spark: SparkSession, sql: str, rows: int = DEFAULT_ROWS, **params: object) -> DataFrame:
    """Runs a guarded statement over the session's views; parameters are bound by name, never pasted."""
    if why := read_only(sql):
        raise PermissionError(why)
    return spark.sql(limited(sql, rows), args=params or None)


class ResultCache:
    """Results of guarded statements for a time; keys ignore white space and case outside literals."""

    def __init__(self, ttl: float = TTL, clock: Callable[[], float] = time.time) -> None:
        self.ttl, self.clock, self.kept = ttl, clock, {}

    @staticmethod
    def key(sql: str) -> str:
        return hashlib.sha1(re.sub(r"\s+", " ", sql).strip().upper().encode()).hexdigest()[:16]

    def get(self, connection: str, sql: str) -> list | None:
        hit = self.kept.get((connection, self.key(sql)))
        if hit is None or self.clock() - hit[0] > self.ttl:
            self.kept.pop((connection, self.key(sql)), None)
            return None
        return hit[1]

    def set(self, connection: str, sql: str, rows: list) -> None:
        self.kept[connection, self.key(sql)] = (self.clock(), rows)

    def invalidate(self, connection: str | None = None) -> int:
        gone = [k for k in self.kept if connection is None or k[0] == connection]
        for k in gone:
            del self.kept[k]
        return len(gone)

    def evict(self) -> int:
        now = self.clock()
        gone = [k for k, (t, _) in self.kept.items() if now - t > self.ttl]
        for k in gone:
            del self.kept[k]
        return len(gone)

    def stats(self) -> dict[str, dict[str, int]]:
        now, out = self.clock(), {}
        for (c, _), (t, _) in self.kept.items():
            x = out.setdefault(c, {"live": 0, "expired": 0})
            x["expired" if now - t > self.ttl else "live"] += 1
        return out


def cached_sql(spark: SparkSession, cache: ResultCache, sql: str, connection: str = "spark", rows: int = DEFAULT_ROWS) -> list:
    """The rows of a guarded statement, from the cache while they are fresh; at most MAX_ROWS reach the driver."""
    hit = cache.get(connection, sql)
    if hit is None:
        hit = run_sql(spark, sql, rows).limit(MAX_ROWS).collect()
        cache.set(connection, sql, hit)
    return hit


def warm_queries(access: DataFrame, tables: int = 10) -> list[str]:
    """Statements to warm the cache with: a sample of the most used tables, from rows (table)."""
    from pyspark.sql import functions as F

    top = access.groupBy("table").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "table").limit(tables).collect()
    return [f"SELECT * FROM `{r['table']}` LIMIT 10" for r in top if re.fullmatch(r"[\w.]+", r["table"] or "")]
