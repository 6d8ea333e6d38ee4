"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.php_syntax import _DQ, _NAME, _SQ
from codeweft.session import cut, rows
from codeweft.skew import salted_join

#: What generators write into a comment of their output.
MARKERS = re.compile(
    r"""(?ix) @generated\b | <auto-?generated\b | \bauto(?:matically)?[- ]?generated\b | \bautomatisch\s+erzeugt\b | \berzeugt\s+(?:vom|von|mit|durch)\b
    | \bgenerated\s+(?:code|file|with|by|from|using)\b | \bcode\s+(?:is\s+)?(?:generated|scaffolded)\b | \bmachine[- ](?:written|generated|made)\b | \bcompiled\s+(?:from|by|with)\b
    | \bproduced\s+by\s+\S+ .* \b(?:regenerate|instead\s+of\s+patching|do\s+not)\b | \bregenerate\s+instead\b | \bscaffolded\s+and\s+owned\b | \bgénéré\s+(?:automatiquement|par)\b | \bgenerado\s+(?:automáticamente|por)\b
    | \boutput\s+of\s+[`'"] | \bdo\s+not\s+touch:\s | \bwritten\s+by\s+the\s+\w+\s+(?:exporter|generator|builder|compiler|dumper)\b | \brun\s+[`'"].+[`'"]\s+to\s+(?:rebuild|regenerate|refresh)\b
    | \bthis\s+file\s+(?:is|was)\s+(?:auto|generated|created\s+by|built\s+by)"""
)
#: Each marker holds one of these in lower case; they are looked for first, as that is fast.
_MARKER_PARTS = ("generat", "erzeugt", "génér", "scaffold", "machine", "compiled ", "produced by", "output of", "do not touch", "written by", "to rebuild", "to refresh", "this file ")
#: A licence banner as third parties ship it, in the first comment of a file.
BANNER = re.compile(r"(?is)@license\b.*\bLICENSE\b|\bv?\d+\.\d+(?:\.\d+)?\b.*(?:released|licen[sc]ed)\s+under\b")
_FIRST_COMMENT = re.compile(r"\s*(?:<\?php\s*)?/\*", re.I)
_STRINGS_AND_COMMENTS = re.compile(
    rf"(?P<c>/\*(?s:.*?)\*/|(?://|\#(?!\[))[^\r\n]*)|{_SQ}|{_DQ}|<<<[ \t]*(?:'(?P<a>{_NAME})'|\"?(?P<b>{_NAME})\"?)\r?\n(?:(?s:.*?)\n)?[ \t]*(?:(?P=a)|(?P=b))\b"
)
#: Directories of tools and third parties at any level, written as they are written there.
_TOOL_DIRS = r"(?:^|/)(?:node_modules|bower_components)/|^vendor/|(?:^|/)public/vendor/|(?:^|/)bootstrap/cache/|^storage/(?:framework|views)/|(?:^|/)public/build/"
_TOOL_NAMES = r"(?:\.min\.(?:js|css)|\.map|\.lock|(?:^|[.-])[0-9a-f]{8,}\.(?:js|css)|(?:^|/)[0-9a-f]{32,}\.php)$|(?:^|/)(?:package-lock|npm-shrinkwrap)\.json$|(?:^|/)_ide_helper\w*\.php$"
#: A shared file or directory must have this many characters without comments and blanks, lest trivial files count as copies.
MIN_SHARED = 150
#: Characters from which a text can be minified, or data of each kind; smaller ones are fixtures that people write.
MINIFIED, MAP_DATA, JSON_DATA, JS_DATA, PHP_DATA = 300, 1000, 4000, 1500, 600


def _marked(text: str) -> bool:
    """Whether a comment outside strings names a generator, in the head of the file or after its last code."""
    low = text.lower()
    if not any(x in low for x in _MARKER_PARTS) or not MARKERS.search(text):
        return False
    at = depth = 0
    for m in _STRINGS_AND_COMMENTS.finditer(text):
        depth += text.count("{", at, m.start()) - text.count("}", at, m.start())
        at = m.end()
        # inside a class or function a comment speaks about other things
        if m["c"] and depth <= 0 and MARKERS.search(m["c"]):
            return True
    return False


_NUMBER = re.compile(r"-?\b\d[\d.]*(?:e[+-]?\d+)?\b")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{60,}+")
_TRAILER = re.compile(r"<\?php /\*\*\s*(?:PATH|SRC)\s(?s:.*?)\*/ \?>\s*")
_STUB = re.compile(r"^\s*\*\s*@(?:method|property(?:-read|-write)?|mixin)\b.*$", re.M)


def _numbers(text: str, share: float, solid: int) -> bool:
    """Whether numbers make up more than a share of the characters; counted exactly only where the digits allow it."""
    if sum(map(text.count, "0123456789")) < 0.6 * share * solid:
        return False
    return sum(len(m[0]) for m in _NUMBER.finditer(text)) > share * solid


def layout(extension: str, text: str) -> str | None:
    """Why the layout of a text is a tool's and not a person's."""
    n = len(text)
    if n == 0 or extension not in (".json", ".js", ".php"):
        return None
    space = sum(map(text.count, " \t\r\n"))
    solid = n - space
    if extension == ".json":
        if '"mappings"' in text and '"sources"' in text and re.search(r'"version"\s*:\s*\d', text):
            return "source map"
        if re.search(r'"(?:content-hash|lockfileVersion|shasum|integrity)"\s*:', text) and re.search(r'"(?:packages|dependencies|dist)"\s*:', text):
            return "lock file"
        if n > MAP_DATA and re.search(r'"type"\s*:\s*"FeatureCollection"', text):
            return "data"
        return "data" if n > JSON_DATA and _numbers(text, 0.35, solid) else None
    if extension == ".js":
        if n > MINIFIED and space < 0.15 * n and (space < 0.10 * n or sum(len(x) for x in text.split("\n") if len(x) > 300) > 0.8 * n):
            return "minified"
        return "data" if n > JS_DATA and _numbers(text, 0.85, solid) else None
    if text.startswith("<?php return") and re.match(r"<\?php\s+return\s+array\s*\(\s*\n", text) and re.search(r"=>\s\n\s*array\s\(\n", text):
        return "cache"
    if re.match(r"(?:<\?php|\s)*(?:\$__\w+->|/\*\*? ?(?:PATH|SRC)\b)", text) or _TRAILER.fullmatch(text, max(0, text.rfind("<?php /**"))):
        return "compiled template"
    if "@method" in text or "@property" in text:
        stubs = _STUB.findall(text)
        if len(stubs) >= 3 and sum(map(len, stubs)) > 0.5 * n:
            return "stubs"
    if n > PHP_DATA:
        if _numbers(text, 0.4, solid):
            return "data"
        # prose and code have more blanks than this
        if space < 0.22 * n:
            if sum(len(m[0]) for m in _BLOB.finditer(text)) > 0.5 * solid:
                return "data"
            longest = max(map(len, text.split("\n")))
            if longest > 500 and re.search(r"(?:'[^']{1,40}'\s*=>\s*[\w.'-]+,\s*){20}", text):
                return "data"
            if space < 0.06 * n and longest > 1000:
                return "minified"
    return None


def _banner(text: str) -> bool:
    """Whether the first comment of a file, however long, is a licence banner of a third party."""
    m = _FIRST_COMMENT.match(text)
    if not m:
        return False
    end = text.find("*/", m.end())
    return end >= 0 and BANNER.search(text, m.end(), end) is not None


_TEXTS = r"'(?:[^'\\\r\n]++|\\(?s:.))*+'|\"(?:[^\"\\\r\n]++|\\(?s:.))*+\""
#: What is a comment, and what only looks like one, by extension.
_COMMENTS = {
    ".php": re.compile(rf"(?P<keep>{_SQ}|{_DQ}|<<<[ \t]*(?:'(?P<a>{_NAME})'|\"?(?P<b>{_NAME})\"?)\r?\n(?:(?s:.*?)\n)?[ \t]*(?:(?P=a)|(?P=b))\b)|/\*(?s:.*?)\*/|(?://|\#(?!\[))[^\r\n]*"),
    ".js": re.compile(rf"(?P<keep>{_TEXTS}|`(?:[^`\\]++|\\(?s:.))*+`|(?<=[=(,:\[!&|?{{}};\n])[ \t]*/(?![*/])(?:[^/\\\[\r\n]++|\\.|\[(?:[^\]\\\r\n]++|\\.)*+\])++/)|/\*(?s:.*?)\*/|//[^\r\n]*"),
    ".css": re.compile(rf"(?P<keep>{_TEXTS})|/\*(?s:.*?)\*/"),
    ".blade.php": re.compile(r"(?P<keep>(?!))|\{\{--(?s:.*?)--\}\}|<!--(?s:.*?)-->"),
}
_BLANKS = str.maketrans("", "", " \t\r\n")
_SPACE = re.compile(r"^\s*namespace\s+([A-Za-z_]\w*)", re.M)


def bare(extension: str, text: str) -> str:
    """A text without its comments, by the rules of its language, and without white space, for the hash of a file."""
    rx = _COMMENTS.get(extension)
    if rx is not None and ("/*" in text or "//" in text or "#" in text or "--" in text):
        text = rx.sub(lambda m: m["keep"] or "", text)
    return text.translate(_BLANKS)


def _looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for ext, text, judge in zip(b["ext"], b["content"], b["judge"]):
            why = None
            if judge:
                why = layout(ext, text) or ("generated" if ext in (".php", ".js", ".blade.php") and _marked(text) else None) or ("licence banner" if ext in (".php", ".js") and _banner(text) else None)
            plain = bare(ext, text)
            space = _SPACE.search(text) if ext == ".php" else None
            rows.append((why, len(plain), hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest(), space[1] if space else ""))
        yield pd.DataFrame({"file_id": b["file_id"], "repo": b["repo"], "path": b["path"], "ext": b["ext"], **{n: pd.Series([r[i] for r in rows], dtype=object if i != 1 else "int64") for i, n in enumerate(("why", "n_chars", "leaf", "root"))}})


def path_reason(path: Column) -> Column:
    """Why a path belongs to a tool or a third party; null otherwise."""
    return F.when(path.rlike(_TOOL_NAMES), F.lit("tool file name")).when(path.rlike(_TOOL_DIRS), F.lit("tool directory"))


def merkle_tree(files: DataFrame) -> DataFrame:
    """(repo, dir, hash, n_files, n_chars) of every directory, from (repo, path, leaf, n_chars) of its files.

    A directory's hash is that of the multiset of names and hashes right below it, written as sums so
    that it combines on the map side and no directory is gathered in one task. Levels are built
    from the deepest up; there are as many rounds as levels.
    """
    parts = F.split("path", "/")
    rows = files.select("repo", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), (F.size(parts) - 1).alias("depth"), F.element_at(parts, -1).alias("name"), "leaf", F.lit(1).cast("long").alias("n_files"), "n_chars")
    deepest = rows.agg(F.max("depth").alias("d")).first()["d"] or 0
    out = rows.filter(F.lit(False)).select("repo", "dir", F.col("leaf").alias("hash"), "n_files", "n_chars")
    pending = None
    for level in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == level).select("repo", "dir", "name", "leaf", "n_files", "n_chars")
        if pending is not None:
            here = here.unionByName(pending)
        # each level is written once, as the next one and the result both read it
        dirs = cut(here.groupBy("repo", "dir").agg(
            F.sum(F.xxhash64("name", "leaf").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("leaf", "name", F.lit(7)).cast("decimal(38,0)")).alias("s2"), F.sum("n_files").alias("n_files"), F.sum("n_chars").alias("n_chars")
        ).select("repo", "dir", F.sha2(F.concat_ws(":", F.col("s1").cast("string"), F.col("s2").cast("string"), F.col("n_files").cast("string")), 256).alias("hash"), "n_files", "n_chars"), "level")
        out = out.unionByName(dirs)
        pending = dirs.select("repo", F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", "")).otherwise("").alias("dir"), F.regexp_extract("dir", "([^/]*)$", 1).alias("name"), F.col("hash").alias("leaf"), "n_files", "n_chars")
    return out


def _shared(hashes: DataFrame) -> DataFrame:
    """The hashes that occur in two repositories or more."""
    return hashes.groupBy("hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter(F.col("a") != F.col("b")).select("hash")


def file_origins(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, path, reason, hand_written) of every file.

    ``reason`` is, in this order: the path (directories and names of tools), the text (layout
    rules, comments of generators, licence banners), a file that unrelated repositories share, a
    subtree of the Merkle tree that they share (told apart, so that its own share can be seen), a namespace or script name known from such copies; null for
    hand-written files. Null or empty content is judged by its path alone. Null paths and
    repositories count as empty names. Trivially small files are never copies.
    """
    ext = F.lower(F.coalesce("extension", F.lit("")))
    base = source_files.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), ext.alias("ext"), "content")
    by_path = base.select("file_id", "repo", "path", "ext", path_reason(F.col("path")).alias("by_path"))
    # one pass reads the texts, judges those that the path does not and hashes all; what follows reads its small table
    texts = base.filter(F.col("content").isNotNull()).withColumn("judge", path_reason(F.col("path")).isNull() & (F.col("ext") != ""))
    looked = cut(texts.mapInPandas(_looked, "file_id bigint, repo string, path string, ext string, why string, n_chars bigint, leaf string, root string"), "leaves")
    by_text, leaves = looked.select("file_id", "why"), looked.drop("why")
    big = leaves.filter(F.col("n_chars") >= MIN_SHARED)
    same_file = _shared(big.select("repo", F.col("leaf").alias("hash")))
    # a file that very many repositories hold is a hot key of this join, its directories of the next
    copies = salted_join(big, same_file.withColumnRenamed("hash", "leaf"), ["leaf"], "left_semi", most=rows(looked)).select("file_id", F.lit("copy in other repositories").alias("copy"))
    tree = merkle_tree(leaves)
    same_dirs = tree.filter((F.col("n_files") >= 2) & (F.col("n_chars") >= 2 * MIN_SHARED))
    shared_dirs = same_dirs.join(_shared(same_dirs.select("repo", "hash")), "hash", "left_semi").select("repo", "dir").distinct()
    parts = F.split("path", "/")
    above = leaves.select("file_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    copies = cut(copies.unionByName(salted_join(above, shared_dirs, ["repo", "dir"], "left_semi").select("file_id", F.lit("subtree of other repositories").alias("copy"))).groupBy("file_id").agg(F.min("copy").alias("copy")), "copies")

    # names of libraries: roots of namespaces and scripts seen where third parties live, and of copies
    lib_path = F.regexp_extract("path", r"(?:^|/)(?:node_modules|public/vendor)/([^/]+)/", 1)
    placed = leaves.filter(path_reason(F.col("path")).isNotNull()).select(F.when(F.col("ext") == ".php", F.col("root")).otherwise(lib_path).alias("lib"), "ext")
    copied = leaves.join(copies.select("file_id"), "file_id", "left_semi").filter("ext = '.php'").select(F.col("root").alias("lib"), "ext")
    libs = placed.unionByName(copied).filter("lib <> ''").distinct()
    # the root that most of a repository's other files have is its own, whoever else copies it
    rest_of = leaves.filter("ext = '.php' and root <> ''").filter(path_reason(F.col("path")).isNull()).join(copies, "file_id", "left_anti")
    own = rest_of.groupBy("repo", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.max_by("root", F.struct("n", "root")).alias("lib")).withColumn("ext", F.lit(".php"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?:\.min)?\.js$", "")
    named = leaves.select("file_id", "repo", F.when(F.col("ext") == ".php", F.col("root")).otherwise(stem).alias("lib"), "ext")
    known = salted_join(named, libs, ["lib", "ext"], "left_semi", most=rows(looked)).join(own, ["repo", "lib", "ext"], "left_anti").select("file_id", F.lit(True).alias("known"))

    joined = by_path.join(by_text, "file_id", "left").join(copies, "file_id", "left").join(known, "file_id", "left")
    reason = F.coalesce("by_path", "why", F.col("copy"), F.when(F.col("known"), F.lit("name of a library")))
    return joined.select("file_id", "repo", "path", reason.alias("reason")).withColumn("hand_written", F.col("reason").isNull())


def tool_files(source_files: DataFrame) -> DataFrame:
    """(file_id) of the files not written by hand in their repository."""
    return file_origins(source_files).filter(~F.col("hand_written")).select("file_id")


def hand_written_files(source_files: DataFrame) -> DataFrame:
    """The rows of ``source_files`` that were written by hand in their repository."""
    return source_files.join(tool_files(source_files), "file_id", "left_anti")
