"""Routes of route files: groups, resources, closures.

Groups nest, so patterns alone cannot say which ones a route is in. Each file is walked once in an
Arrow batch: every chain that begins with ``Route::`` is cut into its calls, a group's body is
walked with the group's settings, all else gives routes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERBS = ("get", "post", "put", "patch", "delete", "options", "any")
#: Action of a resource -> (verb, what follows the path).
ACTIONS = {"index": ("GET", ""), "create": ("GET", "/create"), "store": ("POST", ""), "show": ("GET", "/{id}"), "edit": ("GET", "/{id}/edit"), "update": ("PUT", "/{id}"), "destroy": ("DELETE", "/{id}")}
#: Classes in a closure's body that are no controllers.
NO_CONTROLLERS = frozenset(
    "Request Response JsonResponse StreamedResponse Redirect RedirectResponse View Route Auth Session Cache DB Log Event Mail Queue Storage Validator Hash Str Arr Config Facade Gate Bus "
    "Crypt Cookie File Lang URL Password RateLimiter Artisan Broadcast Notification Pipeline Model Controller FormRequest Middleware ServiceProvider Job Listener Observer Collection Carbon "
    "Closure Exception Illuminate Laravel App Container Observable Scope Builder Relation HasMany BelongsTo BelongsToMany HasOne Http Console".split()
)
_SKIPPED = r"/\*(?s:.*?)\*/|(?://|#(?!\[))[^\r\n]*|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_START = re.compile(rf"(?P<skip>{_SKIPPED})|(?P<route>\bRoute\s*::\s*)")
_BALANCE = re.compile(rf"(?P<skip>{_SKIPPED})|(?P<b>[()\[\]{{}}])|(?P<comma>,)")
_CALL = re.compile(r"\s*(?:->\s*)?(\w+)\s*\(")
_TEXT = re.compile(r"['\"]([^'\"]*)['\"]")
_CLASS = r"\\?([A-Za-z_][\w\\]*)"
_ARRAY_HANDLER = re.compile(rf"\[\s*{_CLASS}(?:::class)?\s*,\s*['\"](\w+)['\"]\s*\]")
_AT_HANDLER = re.compile(rf"['\"]{_CLASS}@(\w+)['\"]")
_CLASS_HANDLER = re.compile(rf"\s*{_CLASS}::class\s*\Z")
_CLOSURE = re.compile(r"\s*(?:static\s+)?(?:function|fn)\s*\(")
#: ways a closure hands over to a controller, best first: pattern and confidence
_HANDOVER = (
    (re.compile(rf"\bnew\s+{_CLASS}\s*(?:\([^)]*\))?\s*\)?\s*->\s*(\w+)\s*\("), 0.85),
    (re.compile(rf"\b(?:app|resolve)\s*\(\s*['\"]?{_CLASS}(?:::class)?['\"]?\s*\)\s*->\s*(\w+)\s*\("), 0.90),
    (re.compile(rf"(?:app\s*\(\s*\)|\$\w+)\s*->\s*make\s*\(\s*['\"]?{_CLASS}(?:::class)?['\"]?\s*\)\s*->\s*(\w+)\s*\("), 0.85),
)
_PARAMETER = re.compile(rf"{_CLASS}\s+\$(\w+)")
_ON_VARIABLE = re.compile(r"\$(\w+)\s*->\s*(\w+)\s*\(")
_STATIC = re.compile(rf"{_CLASS}\s*::\s*(\w+)\s*\(")


@dataclass(frozen=True)
class _Group:
    prefixes: tuple[str, ...] = ()
    middleware: tuple[str, ...] = ()
    domain: str = ""
    controller: str = ""


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in _BALANCE.finditer(text, at):
        if m["b"]:
            depth += 1 if m["b"] in "([{" else -1
            if depth == 0:
                return m.end()
    return len(text)


def _arguments(text: str) -> list[str]:
    """The arguments of a call, split at its own commas."""
    out, depth, last = [], 0, 0
    for m in _BALANCE.finditer(text):
        if m["b"]:
            depth += 1 if m["b"] in "([{" else -1
        elif m["comma"] and depth == 0:
            out.append(text[last : m.start()])
            last = m.end()
    out.append(text[last:])
    return [a.strip() for a in out if a.strip()]


def _chain(text: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The calls (name, arguments) of a chain and the place after it."""
    calls = []
    while (m := _CALL.match(text, at)) and (not calls or "->" in m[0]):
        end = closing(text, m.end() - 1)
        calls.append((m[1], text[m.end() : end - 1]))
        at = end
    return calls, at


def _names(raw: str) -> list[str]:
    """Texts and class names of an argument list or an array."""
    return [m[1] or m[2] for m in re.finditer(rf"['\"]([^'\"]+)['\"]|{_CLASS}::class", raw)]


def _settings(group: _Group, calls: list[tuple[str, str]]) -> _Group:
    """The group with what its calls and its array of settings add: prefixes are stacked, all else the inner one decides."""
    for name, raw in calls:
        if name == "group" and (args := _arguments(raw)) and args[0].startswith("["):
            pairs = {m[1]: m[2] for m in re.finditer(r"['\"](prefix|middleware|domain|controller)['\"]\s*=>\s*(\[[^\]]*\]|[^,\]]+)", args[0])}
            group = _settings(group, list(pairs.items()))
        elif name in ("prefix", "domain", "middleware", "controller"):
            got = _names(raw)
            if not got:
                continue
            if name == "prefix":
                group = replace(group, prefixes=(*group.prefixes, got[0].strip("/")))
            elif name == "middleware":
                group = replace(group, middleware=tuple(got))
            else:
                group = replace(group, **{name: got[0]})
    return group


def _uri(group: _Group, uri: str) -> str:
    prefix = "/".join(p for p in group.prefixes if p)
    return f"/{prefix}/{uri.lstrip('/')}".replace("//", "/") if prefix else uri


def _controller_name(name: str) -> bool:
    return name.lstrip("\\").split("\\")[-1] not in NO_CONTROLLERS and name.split("\\")[0] not in ("Illuminate", "Laravel") and name[:1].isupper()


def _handover(closure: str) -> tuple[str, str]:
    """The controller and method to which the body of a closure hands over, or blanks."""
    opened = closure.index("(")
    params_end = closing(closure, opened)
    params, body = closure[opened:params_end], closure[params_end:]
    for rx, _ in _HANDOVER:
        for m in rx.finditer(body):
            if _controller_name(m[1]):
                return m[1], m[2]
    typed = {m[2]: m[1] for m in _PARAMETER.finditer(params) if _controller_name(m[1])}
    for m in _ON_VARIABLE.finditer(body):
        if m[1] in typed:
            return typed[m[1]], m[2]
    for m in _STATIC.finditer(body):
        if _controller_name(m[1]) and m[1].endswith("Controller") and m[2] not in ("class", "make", "getInstance"):
            return m[1], m[2]
    return "", ""


def _handler(raw: str, group: _Group) -> tuple[str, str]:
    if m := _ARRAY_HANDLER.match(raw) or _AT_HANDLER.match(raw):
        return m[1], m[2]
    if m := _CLASS_HANDLER.match(raw):
        return m[1], "__invoke"
    if (m := _TEXT.fullmatch(raw)) and group.controller:
        return group.controller, m[1]
    return _handover(raw) if _CLOSURE.match(raw) else ("", "")


def parse(text: str) -> list[dict]:
    """The routes of one file, in order."""
    aliases = {m[2] or m[1].split("\\")[-1]: m[1].lstrip("\\") for m in re.finditer(r"(?m)^use\s+([\w\\]+?)(?:\s+as\s+(\w+))?\s*;", text)}
    out: list[dict] = []
    work: list[tuple[str, int, _Group]] = [(text, 0, _Group())]
    while work:
        body, at, group = work.pop()
        m = _START.search(body, at)
        if not m:
            continue
        if not m["route"]:
            work.append((body, m.end(), group))
            continue
        calls, end = _chain(body, m.end())
        work.append((body, end, group))
        names = dict(calls)
        own = _settings(_Group(), calls)
        where = _settings(group, [c for c in calls if c[0] in ("prefix", "domain", "middleware", "controller", "group")]) if "group" in names else group
        if "group" in names:
            work.append((_arguments(names["group"])[-1] if _arguments(names["group"]) else "", 0, where))
            continue
        stack = tuple(dict.fromkeys([*group.middleware, *own.middleware]))
        called = (_names(names.get("name", "")) or [""])[0]
        outer = replace(group, prefixes=(*group.prefixes, *own.prefixes))

        def row(verb: str, uri: str, controller: str, action: str, name: str) -> None:
            out.append({"http_method": verb, "uri": uri, "controller": aliases.get(controller, controller.lstrip("\\")) or None, "action": action or None, "name": name or None, "middleware": list(stack), "domain": own.domain or group.domain or None})

        for call, raw in calls:
            args = _arguments(raw)
            if call.lower() in VERBS and len(args) > 1 and _TEXT.fullmatch(args[0]):
                row(call.upper(), _uri(outer, _TEXT.fullmatch(args[0])[1]), *_handler(args[1], group), called)
            elif call == "match" and len(args) > 2 and _TEXT.fullmatch(args[1]):
                for verb in _names(args[0]):
                    row(verb.upper(), _uri(outer, _TEXT.fullmatch(args[1])[1]), *_handler(args[2], group), called)
            elif call in ("resource", "apiResource") and len(args) > 1 and _TEXT.fullmatch(args[0]):
                base = _uri(outer, _TEXT.fullmatch(args[0])[1])
                only, skip = _names(names.get("only", "")), _names(names.get("except", ""))
                for action, (verb, tail) in ACTIONS.items():
                    if (call == "apiResource" and action in ("create", "edit")) or (only and action not in only) or action in skip:
                        continue
                    row(verb, base + tail, re.sub(r"::class\Z|['\"]", "", args[1]).lstrip("\\"), action, f"{base.strip('/').replace('/', '.')}.{action}")
            else:
                continue
            break
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [{"file_id": i, "position": n, **r} for i, text in zip(b["file_id"], b["content"]) for n, r in enumerate(parse(text))]
        yield pd.DataFrame(rows, columns=["file_id", "position", "http_method", "uri", "controller", "action", "name", "middleware", "domain"])


def routes(files: DataFrame) -> DataFrame:
    """(file_id, position, http_method, uri, controller, action, name, middleware, domain) of files (file_id, content).

    Handlers are arrays, texts with @, classes to be invoked, names of methods of the group's
    controller, and closures that hand over to a controller; else controller and action are null.
    Group prefixes are stacked; of the groups around a route the innermost one with middleware, a
    domain or a controller decides, and the route's own middleware follows. Resources give one row
    an action, less those that only and except leave out, named by path and action. Only files
    that hold a route reach Python; null content has none.
    """
    with_routes = files.filter(F.col("content").rlike(r"Route\s*::")).select("file_id", "content")
    t = dict(files.dtypes)["file_id"]
    return with_routes.mapInPandas(_parsed, f"file_id {t}, position int, http_method string, uri string, controller string, action string, name string, middleware array<string>, domain string")
