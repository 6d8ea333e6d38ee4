"""JSON syntax: an automaton over tokens with its own stack and panic-mode recovery."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"(?P<p>[{}\[\]:,])|(?P<s>\"(?:[^\"\\\x00-\x1f]++|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")|(?P<v>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.+-])|(?:true|false|null)(?!\w))"
    r"|(?P<open>\"(?:[^\"\\\r\n]++|\\.)*+\"?)|(?P<x>[^\s{}\[\]:,\"]++)|(?P<ws>[ \t\r\n]++)|(?P<blank>\s)"
)
_OPENER = {"}": "{", "]": "["}
_WANTS = {"value": "a value", "first": "a value or ]", "key": "a name", "key1": "a name or }", "colon": ":", "after": ", or the end of the block", "end": "the end"}


def errors(text: str) -> list[tuple[int, str]]:
    """(offset, message) of every error; empty for one JSON value, a leading byte order mark aside.

    After an error the automaton goes on in the nearest state in which the token has a meaning; a
    token that is wrong right after an error, with nothing accepted between, belongs to that error.
    """
    found: list[tuple[int, str]] = []
    stack: list[str] = []
    state, quiet = "value", False
    start = 1 if text.startswith("﻿") else 0

    def bad(at: int, why: str) -> None:
        nonlocal quiet
        if not quiet:
            found.append((at, why))
        quiet = True

    def closed() -> str:
        return "after" if stack else "end"

    for m in _TOKEN.finditer(text, start):
        g = m.lastgroup
        if g == "ws":
            continue
        at, c = m.start(), m[0]
        if g in ("blank", "x", "open"):
            bad(at, "a stray character" if g != "open" else "a broken string")
            # what is broken still stands for a name or a value
            if state in ("value", "first") and g != "blank":
                state = closed()
            elif state in ("key", "key1") and g != "blank":
                state = "colon"
            continue
        if g in ("s", "v"):
            if state in ("value", "first"):
                state = closed()
            elif state in ("key", "key1"):
                if g == "v":
                    bad(at, "a name without quotes")
                else:
                    quiet = False
                state = "colon"
                continue
            elif state == "end":
                bad(at, "something after the end")
                continue
            else:
                bad(at, f"expected {_WANTS[state]}")
                state = closed() if state == "colon" or stack[-1] == "[" else "colon"
                continue
            quiet = False
        elif c in "{[":
            if state not in ("value", "first"):
                bad(at, f"expected {_WANTS[state]}")
            else:
                quiet = False
            stack.append(c)
            state = "key1" if c == "{" else "first"
        elif c in "}]":
            fits = bool(stack) and stack[-1] == _OPENER[c]
            if fits and state in ("after", "first", "key1"):
                quiet = False
                stack.pop()
                state = closed()
                continue
            bad(at, f"expected {_WANTS[state]}" if fits else f"{c} closes nothing")
            if _OPENER[c] in stack:
                while stack.pop() != _OPENER[c]:
                    pass
                state = closed()
        elif c == ",":
            if state == "after":
                quiet = False
            else:
                bad(at, f"expected {_WANTS[state]}")
            if state != "end" and stack:
                state = "key" if stack[-1] == "{" else "value"
        else:
            if state == "colon":
                state, quiet = "value", False
            else:
                bad(at, f"expected {_WANTS[state]}")
    if state != "end" and (not found or not quiet or stack):
        found.append((len(text), "the text ends early"))
    return found
