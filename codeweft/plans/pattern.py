"""A subset of the graph pattern language, translated to joins.

    MATCH (a:Label {k: 'v'})-[e:REL|OTHER]->(b:Label)<-[:REL*1..3]-(c)
    [OPTIONAL MATCH ...]  [WHERE ... AND [NOT] EXISTS {(a)-[:REL]->(:Label) [WHERE ...]}]
    [WITH a, count(b) AS n [WHERE n > 2]]
    RETURN [DISTINCT] a.name AS n, count(*) AS k | * [ORDER BY n DESC] [SKIP i] [LIMIT j]
    [UNION [ALL] MATCH ...]

A step of variable length gives each end once for each start, whatever the number of ways; an open
upper bound means :data:`LONGEST` steps. ``RETURN *`` gives the id of every named node and the
relation of every named edge. Labels may be written without the underscore that some of them end in.

Each node and edge variable becomes the prefix of its columns, so conditions, projections,
groups and orders are handed to the SQL parser of Spark as expressions and the whole is one plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.schema import LABELS
from codeweft.plans.sqlgate import read_only_pattern

#: Steps of a variable length without an upper bound.
LONGEST = 10
_CLAUSE = re.compile(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|WITH|RETURN|ORDER\s+BY|SKIP|LIMIT)\b", re.I)
_UNION = re.compile(r"\bUNION(\s+ALL)?\b", re.I)
_EXISTS = re.compile(r"(NOT\s+)?EXISTS\s*\{\s*(?:MATCH\s+)?(.*)\}", re.I | re.S)
_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_EDGE = re.compile(r"(<)?-(?:\[\s*(\w+)?\s*(?::\s*([\w|\s:]+?))?\s*(\*\s*\d*\s*(?:\.\.\s*\d*)?)?\s*(\{[^}]*\})?\s*\])?-(>)?")
_PROP = re.compile(r"(\w+)\s*:\s*('(?:[^'\\]|\\.)*'|-?\d+(?:\.\d+)?|true|false|\$\w+)")
_STRING = re.compile(r"'(?:[^'\\]|\\.)*'")
_AGGREGATE = re.compile(r"\b(?:count|sum|avg|min|max|collect)\s*\(", re.I)


class PatternError(ValueError):
    """A query outside the subset."""


def _masked(query: str) -> str:
    """A query of the same length whose literals hold nothing that reads like syntax."""
    return _STRING.sub(lambda m: "'" + "x" * (len(m[0]) - 2) + "'", query)


def _conjuncts(text: str) -> list[str]:
    """The parts of a condition between the ANDs that stand in no brackets."""
    masked, out, depth, last = _masked(text), [], 0, 0
    for m in re.finditer(r"[({\[]|[)}\]]|\bAND\b", masked, re.I):
        if m[0] in "({[":
            depth += 1
        elif m[0] in ")}]":
            depth -= 1
        elif depth == 0:
            out.append(text[last : m.start()])
            last = m.end()
    return [x.strip() for x in [*out, text[last:]]]


def _clauses(query: str) -> list[tuple[str, str]]:
    masked = re.sub(r"(?i)(\bEXISTS\s*)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", lambda m: m[1] + "{" + "x" * (len(m[0]) - len(m[1]) - 2) + "}", _masked(query))
    masked = re.sub(r"(?i)\b(STARTS|ENDS)(\s+)WITH\b", lambda m: m[1] + m[2] + "xxxx", masked)
    at = [(m.start(), m.end(), re.sub(r"\s+", " ", m[1].upper())) for m in _CLAUSE.finditer(masked)]
    if not at or at[0][2] != "MATCH" or masked[: at[0][0]].strip():
        raise PatternError("a query begins with MATCH")
    ends = [x[0] for x in at[1:]] + [len(query)]
    return [(kind, query[e:z].strip().rstrip(";")) for (_, e, kind), z in zip(at, ends)]


class Translator:
    """Runs queries over one graph of nodes (node_id, label, ...) and edges (src, rel, dst, ...)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        self.fresh = 0

    def _name(self, given: str | None) -> str:
        self.fresh += 1
        return given or f"_v{self.fresh}"

    def _value(self, text: str, params: dict) -> object:
        if text.startswith("$"):
            if text[1:] not in params:
                raise PatternError(f"no parameter {text}")
            return params[text[1:]]
        if text.startswith("'"):
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        return {"true": True, "false": False}.get(text, float(text) if "." in text else int(text) if text.lstrip("-").isdigit() else text)

    def _node_frame(self, name: str, label: str | None, props: str | None, params: dict) -> DataFrame:
        df = self.nodes
        if label:
            df = df.filter(F.col("label") == (f"{label}_" if label not in LABELS and f"{label}_" in LABELS else label))
        for k, v in _PROP.findall(props or ""):
            df = df.filter(F.col(k) == F.lit(self._value(v, params)))
        return df.select(*[F.col(c).alias(f"{name}__{c}") for c in df.columns])

    def _path(self, text: str, frame: DataFrame | None, bound: set[str], params: dict) -> tuple[DataFrame, set[str]]:
        m = _NODE.match(text)
        if not m:
            raise PatternError(f"no node at {text[:30]!r}")
        name = self._name(m[1])
        new = set(bound)
        if name in bound:
            df = frame
        else:
            df = self._node_frame(name, m[2], m[3], params)
            if frame is not None:
                raise PatternError("a further pattern must share its first node")
            new.add(name)
        at = m.end()
        while at < len(text):
            e = _EDGE.match(text, at)
            n = _NODE.match(text, e.end()) if e else None
            if not e or not n or (e[1] and e[6]):
                raise PatternError(f"no step at {text[at : at + 30]!r}")
            edge, to = self._name(e[2]), self._name(n[1])
            step = self.edges
            if e[3]:
                step = step.filter(F.col("rel").isin([r.strip().lstrip(":") for r in e[3].split("|")]))
            for k, v in _PROP.findall(e[5] or ""):
                step = step.filter(F.col(k) == F.lit(self._value(v, params)))
            if e[4]:
                step = self._far(step, e[4], bool(e[1]) - bool(e[6]))
            step = step.select(*[F.col(c).alias(f"{edge}__{c}") for c in step.columns])
            ends = [("src", "dst")] if e[6] or (e[4] and not e[1]) else [("dst", "src")] if e[1] else [("src", "dst"), ("dst", "src")]
            parts = None
            for here, there in ends:
                p = df.join(step, F.col(f"{name}__node_id") == F.col(f"{edge}__{here}"))
                if to in new:
                    p = p.filter(F.col(f"{to}__node_id") == F.col(f"{edge}__{there}"))
                else:
                    target = self._node_frame(to, n[2], n[3], params)
                    p = p.join(target, F.col(f"{edge}__{there}") == F.col(f"{to}__node_id"))
                parts = p if parts is None else parts.unionByName(p)
            df, name = parts, to
            new |= {edge, to}
            at = n.end()
        return df, new

    def _far(self, step: DataFrame, length: str, direction: int) -> DataFrame:
        """The edges that steps of a length make: each pair of ends once; both ways when no direction is given."""
        low, dots, high = re.fullmatch(r"\*\s*(\d*)\s*(\.\.)?\s*(\d*)", length).groups()
        least = int(low or 1)
        most = int(high) if high else LONGEST if dots or not low else least
        one = step.select("src", "dst")
        if direction == 0:
            one = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        one = one.distinct()
        reach, out = one, one if least <= 1 else None
        for k in range(2, most + 1):
            reach = reach.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct()
            if k >= least:
                out = reach if out is None else out.unionByName(reach)
        if least == 0:
            zero = self.nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
            out = zero if out is None else out.unionByName(zero)
        return out.distinct().withColumn("rel", F.lit(None).cast("string"))

    def _where(self, body: str, frame: DataFrame, bound: set[str], params: dict) -> DataFrame:
        plain = []
        for c in _conjuncts(body):
            m = _EXISTS.fullmatch(c)
            if not m:
                plain.append(c)
                continue
            inner, _, condition = re.split(r"(?i)(\bWHERE\b)", m[2], maxsplit=1) if re.search(r"(?i)\bWHERE\b", _masked(m[2])) else (m[2], "", "")
            first = _NODE.match(inner.strip())
            if not first or first[1] not in bound:
                raise PatternError("EXISTS begins at a known node")
            key = f"{first[1]}__node_id"
            met, names = self._path(inner.strip(), frame.select(*[x for x in frame.columns if x.startswith(f"{first[1]}__")]).distinct(), {first[1]}, params)
            if condition:
                met = met.filter(F.expr(self._expression(condition.strip(), names, params)))
            frame = frame.join(met.select(key).distinct(), key, "left_anti" if m[1] else "left_semi")
        return frame.filter(F.expr(self._expression(" AND ".join(plain), bound, params))) if plain else frame

    def _with(self, body: str, frame: DataFrame, bound: set[str], params: dict) -> tuple[DataFrame, set[str]]:
        """The frame with what WITH carries on: named nodes and edges whole, expressions by their names."""
        distinct = bool(re.match(r"DISTINCT\b", body, re.I))
        keys, values, keep = [], [], set()
        for x in self._split(re.sub(r"^DISTINCT\b", "", body, flags=re.I)):
            if x in bound:
                keep.add(x)
                keys += [F.col(c) for c in frame.columns if c.startswith(f"{x}__")]
                continue
            e, n, agg = self._item(x, bound, params)
            (values if agg else keys).append(F.expr(e).alias(n))
        out = frame.groupBy(*keys).agg(*values) if values else frame.select(*keys)
        return (out.distinct() if distinct else out), keep

    @staticmethod
    def _split(text: str) -> list[str]:
        out, depth, last = [], 0, 0
        for m in re.finditer(r"'(?:[^'\\]|\\.)*'|[()\[\]{},]", text):
            c = m[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "," and depth == 0:
                out.append(text[last : m.start()])
                last = m.end()
        return [x.strip() for x in [*out, text[last:]] if x.strip()]

    def _expression(self, text: str, bound: set[str], params: dict) -> str:
        kept: list[str] = []

        def hide(m: re.Match) -> str:
            kept.append(m[0])
            return f"\x00{len(kept) - 1}\x00"

        t = _STRING.sub(hide, text)
        t = re.sub(r"(\S+)\s+CONTAINS\s+(\S+)", r"contains(\1, \2)", t, flags=re.I)
        t = re.sub(r"(\S+)\s+STARTS\s+WITH\s+(\S+)", r"startswith(\1, \2)", t, flags=re.I)
        t = re.sub(r"(\S+)\s+ENDS\s+WITH\s+(\S+)", r"endswith(\1, \2)", t, flags=re.I)
        t = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", t, flags=re.I)
        t = re.sub(r"\btoLower\b", "lower", t, flags=re.I)
        t = re.sub(r"\btoUpper\b", "upper", t, flags=re.I)
        t = re.sub(r"\bcollect\s*\(", "collect_list(", t, flags=re.I)
        t = re.sub(r"\blabels\(\s*(\w+)\s*\)(?:\[0\])?", r"\1.label", t, flags=re.I)
        t = re.sub(r"\btype\(\s*(\w+)\s*\)", r"\1.rel", t, flags=re.I)
        t = re.sub(r"\bid\(\s*(\w+)\s*\)", r"\1.node_id", t, flags=re.I)
        t = re.sub(r"\b(\w+)\.(\w+)\b", lambda m: f"{m[1]}__{m[2]}" if m[1] in bound else m[0], t)
        t = re.sub(r"\bcount\(\s*(DISTINCT\s+)?(\w+)\s*\)", lambda m: f"count({m[1] or ''}{m[2]}__node_id)" if m[2] in bound else m[0], t, flags=re.I)

        def literal(m: re.Match) -> str:
            v = self._value(m[0], params)
            if isinstance(v, (list, tuple)):
                return "(" + ", ".join(_sql_literal(x) for x in v) + ")"
            return _sql_literal(v)

        t = re.sub(r"\$\w+", literal, t)
        return re.sub("\x00(\\d+)\x00", lambda m: _sql_literal(re.sub(r"\\(.)", r"\1", kept[int(m[1])][1:-1])), t)

    def run(self, query: str, **params: object) -> DataFrame:
        """The result of a query as a lazy frame. Writing words outside literals are refused."""
        if why := read_only_pattern(query):
            raise PermissionError(why)
        cuts = list(_UNION.finditer(_masked(query)))
        out, at = None, 0
        for m in [*cuts, None]:
            part = self._single(query[at : m.start()] if m else query[at:], params)
            if out is None:
                out = part
            else:
                if len(part.columns) != len(out.columns):
                    raise PatternError("the parts of a UNION return different columns")
                out = out.union(part)
                if not whole:
                    out = out.distinct()
            if m:
                at, whole = m.end(), bool(m[1])
        return out

    def _single(self, query: str, params: dict) -> DataFrame:
        frame, bound, result, distinct, order, skip, limit = None, set(), None, False, None, None, None
        for kind, body in _clauses(query):
            if kind == "MATCH":
                for part in self._split(body):
                    frame, bound = self._path(part, frame, bound, params)
            elif kind == "OPTIONAL MATCH":
                frame, bound = self._optional(body, frame, bound, params)
            elif kind == "WHERE":
                frame = self._where(body, frame, bound, params)
            elif kind == "WITH":
                frame, bound = self._with(body, frame, bound, params)
            elif kind == "RETURN":
                distinct = bool(re.match(r"DISTINCT\b", body, re.I))
                items = self._split(re.sub(r"^DISTINCT\b", "", body, flags=re.I))
                if items == ["*"]:
                    items = [f"{b}.{'node_id' if f'{b}__node_id' in frame.columns else 'rel'} AS {b}" for b in sorted(bound) if not b.startswith("_v")]
                result = [self._item(x, bound, params) for x in items]
            elif kind == "ORDER BY":
                order = self._split(body)
            elif kind == "SKIP":
                skip = int(body)
            else:
                limit = int(body)
        if result is None:
            raise PatternError("a query needs RETURN")
        if any(agg for _, _, agg in result):
            keys = [F.expr(e).alias(n) for e, n, agg in result if not agg]
            values = [F.expr(e).alias(n) for e, n, agg in result if agg]
            out = (frame.groupBy(*keys) if keys else frame).agg(*values).select(*[n for _, n, _ in result])
        else:
            out = frame.select(*[F.expr(e).alias(n) for e, n, _ in result])
        if distinct:
            out = out.distinct()
        if order:
            cols = []
            for o in order:
                m = re.match(r"(.*?)(?:\s+(ASC|DESC))?$", o, re.I | re.S)
                text = next((f"`{n}`" for e, n, _ in result if self._expression(m[1], bound, params) in (e, n)), None)
                if text is None:
                    raise PatternError(f"ORDER BY needs a returned column: {m[1]}")
                cols.append(F.expr(text).desc() if (m[2] or "").upper() == "DESC" else F.expr(text).asc())
            out = out.orderBy(*cols)
        if skip:
            out = out.offset(skip)
        return out if limit is None else out.limit(limit)

    def _optional(self, body: str, frame: DataFrame, bound: set[str], params: dict) -> tuple[DataFrame, set[str]]:
        m = _NODE.match(body)
        if not m or m[1] not in bound:
            raise PatternError("OPTIONAL MATCH begins at a known node")
        key = f"{m[1]}__node_id"
        base = frame.select(F.col(key)).distinct()
        path, names = self._path(body, base, {m[1]}, params)
        return frame.join(path, key, "left"), bound | names

    def _item(self, text: str, bound: set[str], params: dict) -> tuple[str, str, bool]:
        m = re.match(r"(.*?)\s+AS\s+(\w+)$", text, re.I | re.S)
        body, name = (m[1], m[2]) if m else (text, re.sub(r"\W+", "_", text).strip("_"))
        if body.strip() in bound:
            body = f"{body.strip()}.node_id"
        return self._expression(body, bound, params), name, bool(_AGGREGATE.search(body))


def _sql_literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
