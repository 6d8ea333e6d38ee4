"""Oversized methods cut into pieces at natural boundaries, with overlap."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.names import ascii_lower
from codeweft.llm.php_outline import _PIECE, Method, line_starts, methods
from codeweft.skew import salted_join

LIMIT = 80
OVERLAP = 8


def boundary_strengths(text: str, method: Method, starts: list[int]) -> list[int]:
    """How natural a cut after each line of the method is; 0 inside strings, comments and statements.

    A blank line in the outermost block is strongest, then the end of a block, then the end of
    a statement; each level of nesting weakens it.
    """
    first, last = method.line, method.end_line or len(starts)
    n = last - first + 1
    depth = [0] * (n + 1)  # braces open at the end of each line
    inside = [False] * (n + 1)  # the line end is inside a string, comment or heredoc
    row, level = 0, 0
    region_end = method.end if method.end is not None else len(text)

    def to(offset: int) -> int:
        nonlocal row
        while row + 1 < n and starts[first + row] <= offset:
            depth[row] = level
            row += 1
        return row

    for m in _PIECE.finditer(text, starts[first - 1], region_end):
        if m.lastgroup == "brace":
            to(m.end() - 1)
            level += 1 if m["brace"] == "{" else -1
        elif m.lastgroup in ("skip", "doc"):
            a = to(m.start(m.lastgroup))
            b = to(m.end() - 1)
            for r in range(a, b):
                inside[r] = True
    to(region_end)
    out = []
    for r in range(n):
        line = text[starts[first - 1 + r] : starts[first + r] if first + r < len(starts) else len(text)].strip()
        kind = 3 if not line else 2 if line in ("}", "};", "});", "},") else 1 if line.endswith((";", "}")) else 0
        out.append(0 if inside[r] or not kind or depth[r] < 1 else kind + 4 * max(0, 8 - depth[r]))
    return out


def piece_ranges(strengths: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first, last, strength of the cut after it) of each piece, in line numbers from 0, both included.

    Cuts that are no boundary are made only where none lies within the limit, and of such ways
    to cut the one with the fewest pieces counts. Its cuts get targets at equal distances; each
    moves to the strongest boundary near its target, nearer ones first on ties, among those from
    which the rest still fits, or else to the nearest of these.
    """
    n = len(strengths)
    if n <= limit:
        return [(0, n - 1, 0)]
    # rest[c]: cuts that are no boundary, times n, and pieces behind a cut after line c; cost[c] counts that cut too
    rest, cost = [0] * n, [n * n * n] * n
    for c in range(n - 1, -1, -1):
        begin = c - overlap if c else 0
        rest[c] = 1 if n - begin <= limit else 1 + min(cost[c + overlap + 1 : begin + limit + 1], default=n * n * n)
        cost[c] = rest[c] + (0 if c and strengths[c - 1] else n)
    k = rest[0] % n
    reach = max(1, (limit - overlap) // 4)
    cuts: list[int] = []
    at, begin = 0, 0
    while n - begin > limit:
        target = round((len(cuts) + 1) * n / k)
        fit = [c for c in range(at + overlap + 1, min(begin + limit + 1, n)) if cost[c] + 1 == rest[at]]
        at = max(fit, key=lambda c: ((near := abs(c - target) <= reach), strengths[c - 1] if near else 0, -abs(c - target)))
        cuts.append(at)
        begin = at - overlap
    edges = [0, *[c - overlap for c in cuts]]
    return [(edges[i], (cuts[i] if i < len(cuts) else n) - 1, strengths[cuts[i] - 1] if i < len(cuts) else 0) for i in range(k)]


_PIECES = "file_id bigint, class_key string, name_key string, sig_line int, last_line int, n_lines int, pieces array<struct<piece:int,first_line:int,last_line:int,strength:int,text:string>>"


def _extractor(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file_id, text in zip(b["file_id"], b["content"]):
                found = [m for m in methods(text) if m.end_line is not None and m.has_body]
                by_name = defaultdict(list)
                for m in found:
                    by_name[m.name.lower()].append(m)
                starts = line_starts(text)
                for name, same in by_name.items():
                    # shorter methods of the same name come along, so that rows are matched to the right one
                    if all(m.end_line - m.line + 1 <= limit for m in same):
                        continue
                    for m in same:
                        n = m.end_line - m.line + 1
                        pieces = None
                        if n > limit:
                            pieces = [
                                {"piece": i, "first_line": m.line + a, "last_line": m.line + z, "strength": s, "text": text[starts[m.line - 1 + a] : starts[m.line + z] if m.line + z < len(starts) else len(text)]}
                                for i, (a, z, s) in enumerate(piece_ranges(boundary_strengths(text, m, starts), limit, overlap))
                            ]
                        rows.append((file_id, m.class_fqn.lower(), name, m.line, m.end_line, n, pieces))
            yield pd.DataFrame(rows, columns=["file_id", "class_key", "name_key", "sig_line", "last_line", "n_lines", "pieces"])

    return run


def long_methods(methods_: DataFrame, source_files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(method_id, file_id, sig_line, last_line, n_lines, pieces) of each row whose method really has more than ``limit`` lines.

    The length is that in the file, from the signature line to the closing brace; the row's own
    line_end is not used. A row is matched by file and name without case, then by the class in
    its fqn and then by the nearest signature line; repeated rows each match. Files too short to
    hold such a method are left out before any parsing. Null content, rows without a file or
    name and methods without a closing brace give nothing.
    """
    # a file of so few line ends cannot hold a method beyond the limit
    ends = F.length("content") - F.length(F.translate("content", "\n\r", ""))
    files = source_files.filter(F.col("content").isNotNull() & F.lower("extension").isin(".php") & (ends >= limit)).select("file_id", "content")
    found = files.mapInPandas(_extractor(limit, overlap), _PIECES)
    rows = methods_.select("method_id", "file_id", ascii_lower(F.col("name")).alias("name_key"), "line_start", F.lower(F.regexp_replace(F.substring_index("fqn", "::", 1), r"^\s*\\", "")).alias("row_class"))
    rows = rows.filter(F.col("file_id").isNotNull() & F.col("name_key").isNotNull())
    met = salted_join(rows, found, ["file_id", "name_key"])
    other = F.coalesce((F.col("row_class") != F.col("class_key")).cast("int"), F.lit(1))
    away = F.coalesce(F.abs(F.col("line_start") - F.col("sig_line")), F.lit(1 << 30))
    best = met.groupBy("method_id").agg(F.min_by(F.struct("file_id", "sig_line", "last_line", "n_lines", "pieces"), F.struct(other, away, F.col("sig_line"))).alias("x"))
    return best.select("method_id", "x.*").filter(F.col("n_lines") > limit)


def method_pieces(methods_: DataFrame, source_files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(method_id, piece, n_pieces, first_line, last_line, strength, text): the pieces of each oversized method.

    Pieces have at most ``limit`` lines, cover the method, and each begins ``overlap`` lines
    before the end of the one before; ``strength`` tells how natural the cut after it is.
    """
    x = long_methods(methods_, source_files, limit, overlap)
    return x.select("method_id", F.size("pieces").alias("n_pieces"), F.explode("pieces").alias("p")).select("method_id", "p.piece", "n_pieces", "p.first_line", "p.last_line", "p.strength", "p.text")
