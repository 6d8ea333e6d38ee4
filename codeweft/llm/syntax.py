"""Source files that do not parse: flags, causes and rates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import blade_syntax, js_syntax, json_syntax, php_syntax

LANGUAGES = {".php": "php", ".blade.php": "blade", ".js": "js", ".json": "json"}
_MARKER = re.compile(r"^(<{7}|={7}|>{7})(?=[ \r\n]|\Z)", re.M)


def conflict(language: str, text: str) -> int:
    """The offset of an unresolved merge, else -1.

    In a template a lone opening or closing marker at the start of a line is one: all else is
    text there, so no parser would trip over half a merge. In the other languages a lone marker
    breaks the parse by itself unless it stands in a comment or a string, so there an opening, a
    middle and a closing marker in order are asked for. A line of ``=`` alone is a heading.
    """
    if "<<<<<<<" not in text and ">>>>>>>" not in text:
        return -1
    opened = -1
    middle = False
    for m in _MARKER.finditer(text):
        c = m[1][0]
        if c != "=" and language == "blade":
            return m.start()
        if c == "<":
            opened, middle = m.start(), False
        elif c == "=":
            middle = opened >= 0
        elif middle:
            return opened
    return -1


_TAGGED = re.compile(r"<[A-Za-z!/]|\{\{|\{!!|(?<![\w@.])@[a-z]+")


def _other_language(language: str, text: str) -> str | None:
    """Why a text that parses is nevertheless of another language."""
    bare = text.strip()
    if language == "js" and bare[:1] in ("[", "{") and bare[-1:] in ("]", "}"):
        return "a JSON document" if not json_syntax.errors(bare) else None
    if language == "blade" and bare and not _TAGGED.search(text):
        # text without a tag, an echo or a directive: a template only if it is no program
        if not json_syntax.errors(bare) and bare[:1] in "[{":
            return "a JSON document"
        if re.search(r"^(?:'use strict'|import |export |(?:async )?function \w+\s*\(|(?:const|let|var) \w+ ?=|def \w+\(|[A-Z_]+=)", bare, re.M):
            return "a program"
    if language == "blade" and re.match(r"<\?php\s", bare) and re.search(r"^\s*(?:namespace\s+[\w\\]+;|(?:abstract |final )?(?:class|interface|trait|enum)\s+\w+)", text, re.M) and "?>" not in text:
        return "a PHP class"
    return None


def check(language: str, text: str) -> list[tuple[int, str]]:
    """(offset, message) of every error of one file, in order."""
    if language == "php":
        found = php_syntax.errors(text)
    elif language == "blade":
        found = blade_syntax.errors(text)
    elif language == "js":
        found = js_syntax.errors(text)
    else:
        found = json_syntax.errors(text)
    at = conflict(language, text)
    if at >= 0:
        found = sorted([*[x for x in found if x[0] < at], (at, "unresolved merge"), *[x for x in found if x[0] > at]])
    if not found and (why := _other_language(language, text)):
        found = [(0, why)]
    return found


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [check(lang, text) for lang, text in zip(b["language"], b["content"])]
        yield pd.DataFrame(
            {
                "file_id": b["file_id"], "repo": b["repo"], "language": b["language"],
                "errors": [[f"line {text.count(chr(10), 0, at) + 1}: {why}" for at, why in e] for e, text in zip(found, b["content"])],
            }
        )


def _judged(source_files: DataFrame) -> DataFrame:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    language = F.create_map(*pairs)[F.lower("extension")]
    return source_files.select("file_id", "repo", language.alias("language"), "content").filter(F.col("content").isNotNull() & F.col("language").isNotNull())


def file_errors(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, language, errors, first_error, valid) of every php, blade, js and json file with content.

    Each file is parsed by itself in a map-side pass; nothing is shuffled. ``errors`` holds all
    errors in order of place, ``first_error`` the first cause (null for a valid file). Null
    content and other extensions are not judged. An empty php file lacks its opening tag and an
    empty json file its value; empty templates and scripts are valid.
    """
    out = _judged(source_files).mapInPandas(_checked, "file_id bigint, repo string, language string, errors array<string>")
    return out.withColumns({"first_error": F.get("errors", F.lit(0)), "valid": F.size("errors") == 0})


def broken_files(source_files: DataFrame) -> DataFrame:
    """(file_id) of the files that are broken, hold an unresolved merge or are of another language."""
    return file_errors(source_files).filter(~F.col("valid")).select("file_id")


def error_rates(source_files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, rate) per repository and language; a null repository is one of its own."""
    f = file_errors(source_files).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_broken"))
    return f.withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
