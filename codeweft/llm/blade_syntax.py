"""Template syntax: directives as a stack of blocks, echoes and arguments as PHP."""

from __future__ import annotations

import re

from codeweft.llm import php_syntax

#: Directive that opens a block -> directives that may close it.
_BLOCKS = {
    "if": ("endif",), "unless": ("endunless",), "isset": ("endisset",), "empty": ("endempty",), "auth": ("endauth",), "guest": ("endguest",), "env": ("endenv",),
    "production": ("endproduction",), "can": ("endcan",), "cannot": ("endcannot",), "canany": ("endcanany",), "error": ("enderror",), "once": ("endonce",), "session": ("endsession",),
    "foreach": ("endforeach",), "forelse": ("endforelse",), "for": ("endfor",), "while": ("endwhile",), "switch": ("endswitch",),
    "section": ("endsection", "stop", "show", "append", "overwrite"), "push": ("endpush",), "prepend": ("endprepend",), "pushOnce": ("endPushOnce",), "prependOnce": ("endPrependOnce",), "pushIf": ("endPushIf",),
    "component": ("endcomponent", "endComponentClass"), "slot": ("endslot",), "fragment": ("endfragment",), "hasSection": ("endif",), "sectionMissing": ("endif",), "elsecan": (), "php": ("endphp",), "verbatim": ("endverbatim",),
    "componentFirst": ("endcomponentFirst",), "lang": ("endlang",), "volt": ("endvolt",), "teleport": ("endteleport",), "persist": ("endpersist",), "script": ("endscript",), "assets": ("endassets",),
}
_MIDDLES = {
    "else": ("if", "unless", "isset", "auth", "guest", "env", "production", "can", "cannot", "canany", "error", "hasSection", "sectionMissing", "session", "pushIf", "empty"),
    "elseif": ("if", "unless", "isset", "hasSection", "sectionMissing"), "elsecan": ("can", "cannot", "canany"), "elsecannot": ("can", "cannot", "canany"), "elsecanany": ("can", "cannot", "canany"),
    "elseauth": ("auth", "guest"), "elseguest": ("auth", "guest"), "elsePush": ("pushIf",), "elsePushIf": ("pushIf",), "case": ("switch",), "default": ("switch",),
}
_CLOSERS = {e for ends in _BLOCKS.values() for e in ends}
_NEEDS_ARGUMENTS = {"if", "elseif", "unless", "isset", "foreach", "forelse", "for", "while", "switch", "case", "can", "cannot", "canany", "error", "include", "extends", "yield", "section", "push", "stack", "each", "includeIf", "includeWhen", "includeUnless", "includeFirst", "component", "slot"}
#: a block of these only without arguments, or with one argument where noted
_PIECE = re.compile(
    r"(?P<comment>\{\{--(?s:.*?)--\}\})|(?P<open>\{\{--)|(?P<skip>@@(?=[A-Za-z{])|@(?=\{\{|\{!!))|(?P<raw>\{!!)|(?P<echo>\{\{\{?)|(?P<tag><\?(?:php(?=\s|\Z)|=)(?s:.*?)(?:\?>|\Z))"
    r"|(?<![\w@.])@(?P<dir>[A-Za-z]+(?:::\w+)?)"
)
_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_BALANCE = re.compile(rf"(?s:{_STRING})|/\*(?s:.*?)\*/|[()\[\]{{}}'\"]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def _parens(text: str, at: int) -> int:
    """The end of the parentheses that open at ``at``, or -1."""
    depth: list[str] = []
    for m in _BALANCE.finditer(text, at):
        c = m[0]
        if len(c) > 1:
            continue
        if c in "([{":
            depth.append(c)
        elif c in _PAIR:
            if not depth or depth.pop() != _PAIR[c]:
                return -1
            if not depth:
                return m.end()
        else:
            return -1
    return -1


def _two_arguments(code: str) -> bool:
    """Whether the parenthesised list has a comma at its top level."""
    depth = 0
    for m in re.finditer(rf"(?s:{_STRING})|[()\[\]{{}},]", code):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 1:
            return True
    return False


def errors(text: str) -> list[tuple[int, str]]:
    """(offset, message) of every error: unpaired directives, broken echoes, arguments and code."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    at, n = 0, len(text)
    while True:
        m = _PIECE.search(text, at)
        if not m:
            break
        at, kind = m.end(), m.lastgroup
        if kind in ("comment", "skip"):
            if kind == "skip" and m[0] == "@":  # an echo that is not ours
                end = text.find("}}" if text.startswith("{{", at) else "!!}", at)
                at = at + 2 if end < 0 else end
            continue
        if kind == "open":
            found.append((m.start(), "a comment has no end"))
            at = n
        elif kind in ("raw", "echo"):
            close = "!!}" if kind == "raw" else "}}}" if m[0] == "{{{" else "}}"
            end = text.find(close, at)
            if end < 0:
                found.append((m.start(), "an echo has no end"))
                continue
            if not php_syntax.expression_ok(text[at:end]):
                found.append((m.start(), "an echo is no expression"))
                nxt = text.find("\n", at)
                at = end + len(close) if nxt < 0 or nxt > end else nxt
                continue
            at = end + len(close)
        elif kind == "tag":
            code = m[0]
            bad = php_syntax.code_errors("?>" + code)
            found += [(m.start() + max(0, i - 2), why) for i, why in bad]
        else:
            at = _directive(text, m, at, stack, found)
    found += [(i, f"@{d} has no end") for d, i in stack]
    return sorted(found)


def _directive(text: str, m: re.Match, at: int, stack: list[tuple[str, int]], found: list[tuple[int, str]]) -> int:
    d, start = m["dir"], m.start()
    known = d in _BLOCKS or d in _MIDDLES or d in _CLOSERS or d in _NEEDS_ARGUMENTS
    ws = at
    while ws < len(text) and text[ws] in " \t":
        ws += 1
    args = ""
    if text.startswith("(", ws) and known and d not in ("else", "default", "verbatim", *_CLOSERS):
        end = _parens(text, ws)
        if end < 0:
            found.append((start, f"the arguments of @{d} have no end"))
            at = ws + 1
        else:
            args, at = text[ws:end], end
            ok = php_syntax.foreach_ok(args) if d in ("foreach", "forelse") and not (d == "forelse" and args == "()") else not php_syntax.code_errors(f"for {args};") if d == "for" else php_syntax.arguments_ok(args)
            if not ok:
                found.append((start, f"the arguments of @{d} do not parse"))
    elif d in _NEEDS_ARGUMENTS:
        found.append((start, f"@{d} without arguments"))
    if d == "verbatim":
        end = text.find("@endverbatim", at)
        if end < 0:
            found.append((start, "@verbatim has no end"))
            return len(text)
        return end + len("@endverbatim")
    if d == "php" and not args:
        end = text.find("@endphp", at)
        if end < 0:
            found.append((start, "@php has no end"))
            return len(text)
        found.extend((at + i, why) for i, why in php_syntax.code_errors(text[at:end]))
        return end + len("@endphp")
    if d == "php":
        return at
    if d == "empty" and not args:
        if not stack or stack[-1][0] != "forelse":
            found.append((start, "@empty outside @forelse"))
        return at
    if d in _MIDDLES:
        if not stack or stack[-1][0] not in _MIDDLES[d]:
            found.append((start, f"@{d} outside its block"))
        return at
    if d in _CLOSERS:
        if not stack:
            found.append((start, f"@{d} closes nothing"))
        elif d in _BLOCKS[stack[-1][0]]:
            stack.pop()
        else:
            found.append((start, f"@{d} closes @{stack[-1][0]}"))
            for i in range(len(stack) - 1, -1, -1):
                if d in _BLOCKS[stack[i][0]]:
                    del stack[i:]
                    break
        return at
    if d in _BLOCKS and d not in ("elsecan",):
        if d in ("section", "push", "prepend", "slot") and args and _two_arguments(args):
            return at
        if d in ("component", "lang", "session", "script", "assets", "persist", "teleport", "volt") and d == "lang" and args:
            return at
        if not args and d in ("error", "session", "script", "assets", "persist", "teleport", "volt", "lang"):
            return at
        stack.append((d, start))
    return at
