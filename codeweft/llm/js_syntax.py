"""JavaScript module syntax: a lexer to one character a token and a recursive-descent parser.

As for PHP: statements by recursive descent, expressions by precedence climbing, panic-mode
recovery, and a memory of brace-free statements that have parsed.
"""

from __future__ import annotations

import re

from codeweft.llm.nesting import TOO_DEEP, deep

_WORD = r"[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*"
_SKIP = re.compile(r"(?:[ \t\v\f\xa0﻿]++|//[^\r\n  ]*+)*+")
_TOKEN = re.compile(
    rf"(?P<w>#?{_WORD})|(?P<s>'(?:[^'\\\r\n]++|\\(?:\r\n|(?s:.)))*+'|\"(?:[^\"\\\r\n]++|\\(?:\r\n|(?s:.)))*+\")"
    r"|(?P<n>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)n?)"
    r"|(?P<l>[\r\n  ]\s*+)|(?P<c>/\*(?s:.*?)\*/)|(?P<t>`)"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]++|\\[^\r\n]|\[(?:[^\]\\\r\n]++|\\[^\r\n])*+\])++/([A-Za-z]*)")
_RESERVED = (
    "await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof "
    "new return super switch this throw try typeof var void while with yield null true false implements interface package private protected public"
).split()
KW = {w: chr(0x100 + n) for n, w in enumerate(_RESERVED)}
#: words that are names except where the grammar asks for them
_SOFT = {w: chr(0x200 + n) for n, w in enumerate(("async", "let", "static", "get", "set", "of", "from", "as"))}
_K = {**KW, **_SOFT}
_KIND = {
    "=>": "R", "...": "L", "?.": "O", "++": "I", "--": "I", "??": "Q", "||": "b", "&&": "B", "===": "E", "!==": "E", "==": "E", "!=": "E", "<=": "G", ">=": "G", "<": "G", ">": "G",
    "<<": "S", ">>": "S", ">>>": "S", "+": "P", "-": "P", "*": "*", "/": "M", "%": "M", "**": "W",
    **{f"{o}=": "A" for o in ("+", "-", "*", "/", "%", "&", "|", "^", "**", "<<", ">>", ">>>", "&&", "||", "??")},
}
#: after these a slash begins a regular expression
_BEFORE_REGEX = frozenset("{}([;,GEPSM*WQbB|^&!~?:=ARLI") | {KW[w] for w in ("return", "typeof", "case", "delete", "void", "throw", "new", "in", "instanceof", "do", "else", "await", "yield", "default")} | {""}
_NAMES = frozenset(["i", *_SOFT.values()])
_PROPERTY = _NAMES | frozenset(KW.values())
_BINARY = {
    "Q": (4, "l"), "b": (4, "l"), "B": (5, "l"), "|": (6, "l"), "^": (7, "l"), "&": (8, "l"), "E": (9, "l"), "G": (10, "l"), KW["in"]: (10, "l"), KW["instanceof"]: (10, "l"),
    "S": (11, "l"), "P": (12, "l"), "*": (13, "l"), "M": (13, "l"), "W": (14, "r"),
}
_END = "\0"
_FLAT = re.compile(r"[^{};\0]*;")
_BRACKET = re.compile(r"[()\[\]{}]")


class Broken(Exception):
    """A syntax error at a token position."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


def lex(text: str, at: int = 0, inner: bool = False) -> tuple[str, list[int], set[int], int]:
    """(token characters, offsets, indexes of tokens after a line break, end); ``inner`` ends at an unmatched ``}``."""
    out: list[str] = []
    where: list[int] = []
    breaks: set[int] = set()
    last, depth, n = "", 0, len(text)
    parens: list[str] = []
    while True:
        at = _SKIP.match(text, at).end()
        if at >= n:
            break
        c = text[at]
        if c == "/" and last in _BEFORE_REGEX:
            m = _REGEX.match(text, at)
            if m:
                out.append(last := "r" if len(set(m[1])) == len(m[1]) and not m[1].strip("dgimsuvy") else "X")
                where.append(at)
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        if not m:
            out.append(last := "X")
            where.append(at)
            at += 1
            continue
        g = m.lastgroup
        if g == "l":
            breaks.add(len(out))
            at = m.end()
            continue
        if g == "c":
            if "\n" in m[0] or "\r" in m[0]:
                breaks.add(len(out))
            at = m.end()
            continue
        where.append(at)
        if g == "w":
            t = m[0]
            k = "#" if t[0] == "#" else KW.get(t) or _SOFT.get(t) or "i"
            if last in (".", "O") and k != "#":
                k = "i"
        elif g == "s":
            k = "s"
        elif g == "n":
            k = "n" if not text[m.end() : m.end() + 1].isalnum() else "X"
        elif g == "t":
            k, end = _template(text, at)
            out.append(last := k)
            at = end
            continue
        else:
            t = m[0]
            if t == "(":
                parens.append(last)
            k = _KIND.get(t, t)
            if t == "{":
                depth += 1
            elif t == "}":
                if inner and depth == 0:
                    where.pop()
                    return "".join(out), [*where, at], breaks, at
                depth -= 1
        out.append(k)
        at = m.end()
        last = k
        if k == ")":
            # a slash after the head of an if or while begins a regular expression
            head = parens.pop() if parens else ""
            last = "!" if head in (KW["if"], KW["while"], KW["for"]) else ")"
        elif k == "I":
            last = "I" if len(out) < 2 or out[-2] in _BEFORE_REGEX else ")"
        elif k == "}":
            last = "}"
    return "".join(out), [*where, n], breaks, -1 if inner else n


def _template(text: str, at: int) -> tuple[str, int]:
    """The kind (s, or X when broken) and end of a template literal that starts at ``at``."""
    i, n, kind = at + 1, len(text), "s"
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return kind, i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            k, where, breaks, end = lex(text, i + 2, True)
            if end < 0:
                return "X", n
            if ("x", k) not in Parser.good:
                q = Parser(k, breaks)
                try:
                    q.comma()
                    if q.k[q.p] != _END:
                        kind = "X"
                    elif len(k) < 100:
                        Parser.good.add(("x", k))
                except Broken:
                    kind = "X"
            i = end + 1
        else:
            i += 1
    return "X", n


class Parser:
    good: set[tuple[str, str]] = set()

    def __init__(self, kinds: str, breaks: set[int]) -> None:
        self.k, self.p, self.breaks = kinds + _END, 0, breaks
        self.in_ok = True
        self.pairs: dict[int, int] | None = None

    def fail(self, why: str) -> None:
        raise Broken(self.p, why)

    def need(self, c: str) -> None:
        if self.k[self.p] != c:
            self.fail(f"expected {_name(c)} before {_name(self.k[self.p])}")
        self.p += 1

    def semicolon(self) -> None:
        c = self.k[self.p]
        if c == ";":
            self.p += 1
        elif c not in "}\0" and self.p not in self.breaks:
            self.fail(f"expected ; before {_name(c)}")

    def name(self) -> None:
        if self.k[self.p] not in _NAMES:
            self.fail(f"expected a name before {_name(self.k[self.p])}")
        self.p += 1

    def file(self) -> None:
        while self.k[self.p] != _END:
            self.statement(True)

    def recover(self) -> list[tuple[int, str]]:
        found: list[tuple[int, str]] = []
        while self.k[self.p] != _END:
            try:
                self.file()
            except Broken as e:
                found.append((e.at, e.why))
                at = max(self.p, e.at)
                while self.k[at] not in ";}\0":
                    at += 1
                self.p = at + (self.k[at] != _END)
        return found

    def block(self) -> None:
        self.need("{")
        while self.k[self.p] != "}":
            if self.k[self.p] == _END:
                self.fail("the file ends inside a block")
            self.statement(False)
        self.p += 1

    def parens(self) -> None:
        self.need("(")
        self.comma()
        self.need(")")

    def statement(self, top: bool) -> None:
        k, start = self.k, self.p
        m = _FLAT.match(k, start)
        if m and m[0] in self.good and not top:
            self.p = m.end()
            return
        c = k[start]
        f = _STATEMENTS.get(c)
        if f and not (c == KW["import"] and k[start + 1] in "(."):
            f(self, top)
        elif c == _SOFT["let"] and (k[start + 1] in _NAMES or k[start + 1] in "[{"):
            self.declaration()
            self.semicolon()
        elif c == _SOFT["async"] and k[start + 1] == KW["function"] and start + 1 not in self.breaks:
            self.p += 1
            self.s_function(top)
        elif c in _NAMES and k[start + 1] == ":":
            self.p += 2
            self.statement(False)
        else:
            self.comma()
            self.semicolon()
        # only a statement that ends in ; and does not rest on line breaks is remembered
        if m and m.end() == self.p and not top and self.p - start < 60 and not any(i in self.breaks for i in range(start + 1, self.p)):
            if len(self.good) > 300_000:
                self.good.clear()
            self.good.add(m[0])

    def s_empty(self, top: bool) -> None:
        self.p += 1

    def s_block(self, top: bool) -> None:
        self.block()

    def s_var(self, top: bool) -> None:
        self.declaration()
        self.semicolon()

    def declaration(self, loop: bool = False) -> None:
        const = self.k[self.p] == KW["const"]
        self.p += 1
        while True:
            pattern = self.k[self.p] in "[{"
            self.binding()
            if self.k[self.p] == "=":
                self.p += 1
                self.assign()
            elif (const or pattern) and not (loop and self.k[self.p] in (KW["in"], _SOFT["of"])):
                self.fail("a declaration without a value")
            if self.k[self.p] != ",":
                return
            self.p += 1

    def binding(self) -> None:
        c = self.k[self.p]
        if c == "[":
            self.p += 1
            while self.k[self.p] != "]":
                if self.k[self.p] == ",":
                    self.p += 1
                    continue
                if self.k[self.p] == "L":
                    self.p += 1
                self.binding()
                self.default()
                if self.k[self.p] != ",":
                    break
                self.p += 1
            self.need("]")
        elif c == "{":
            self.p += 1
            while self.k[self.p] != "}":
                if self.k[self.p] == "L":
                    self.p += 1
                    self.binding()
                else:
                    plain = self.k[self.p] in _NAMES
                    self.key()
                    if self.k[self.p] == ":":
                        self.p += 1
                        self.binding()
                    elif not plain:
                        self.fail("expected : in a pattern")
                    self.default()
                if self.k[self.p] != ",":
                    break
                self.p += 1
            self.need("}")
        else:
            self.name()

    def default(self) -> None:
        if self.k[self.p] == "=":
            self.p += 1
            self.assign()

    def key(self) -> None:
        c = self.k[self.p]
        if c in _PROPERTY or c in "sn#":
            self.p += 1
        elif c == "[":
            self.p += 1
            self.assign()
            self.need("]")
        else:
            self.fail(f"expected a property before {_name(c)}")

    def s_if(self, top: bool) -> None:
        self.p += 1
        self.parens()
        self.statement(False)
        if self.k[self.p] == KW["else"]:
            self.p += 1
            self.statement(False)

    def s_while(self, top: bool) -> None:
        self.p += 1
        self.parens()
        self.statement(False)

    def s_do(self, top: bool) -> None:
        self.p += 1
        self.statement(False)
        self.need(KW["while"])
        self.parens()
        if self.k[self.p] == ";":
            self.p += 1

    def s_for(self, top: bool) -> None:
        k = self.k
        self.p += 1
        if k[self.p] == KW["await"]:
            self.p += 1
        self.need("(")
        self.in_ok = False
        if k[self.p] in (KW["var"], KW["const"]) or (k[self.p] == _SOFT["let"] and (k[self.p + 1] in _NAMES or k[self.p + 1] in "[{")):
            self.declaration(True)
        elif k[self.p] != ";":
            self.comma()
        self.in_ok = True
        if k[self.p] in (KW["in"], _SOFT["of"]):
            self.p += 1
            self.comma()
        else:
            self.need(";")
            if k[self.p] != ";":
                self.comma()
            self.need(";")
            if k[self.p] != ")":
                self.comma()
        self.need(")")
        self.statement(False)

    def s_switch(self, top: bool) -> None:
        k = self.k
        self.p += 1
        self.parens()
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] == KW["case"]:
                self.p += 1
                self.comma()
            else:
                self.need(KW["default"])
            self.need(":")
            while k[self.p] not in (KW["case"], KW["default"], "}"):
                if k[self.p] == _END:
                    self.fail("a switch has no end")
                self.statement(False)
        self.p += 1

    def s_try(self, top: bool) -> None:
        self.p += 1
        self.block()
        n = 0
        if self.k[self.p] == KW["catch"]:
            self.p += 1
            if self.k[self.p] == "(":
                self.p += 1
                self.binding()
                self.need(")")
            self.block()
            n = 1
        if self.k[self.p] == KW["finally"]:
            self.p += 1
            self.block()
            n = 1
        if not n:
            self.fail("try without catch")

    def s_return(self, top: bool) -> None:
        self.p += 1
        if self.k[self.p] not in ";}\0" and self.p not in self.breaks:
            self.comma()
        self.semicolon()

    def s_throw(self, top: bool) -> None:
        self.p += 1
        if self.p in self.breaks:
            self.fail("a line break after throw")
        self.comma()
        self.semicolon()

    def s_jump(self, top: bool) -> None:
        self.p += 1
        if self.k[self.p] in _NAMES and self.p not in self.breaks:
            self.p += 1
        self.semicolon()

    def s_function(self, top: bool) -> None:
        self.p += 1
        if self.k[self.p] == "*":
            self.p += 1
        self.name()
        self.function()

    def function(self) -> None:
        self.parameters()
        self.block()

    def parameters(self) -> None:
        self.need("(")
        while self.k[self.p] != ")":
            rest = self.k[self.p] == "L"
            if rest:
                self.p += 1
            self.binding()
            self.default()
            if rest or self.k[self.p] != ",":
                break
            self.p += 1
        self.need(")")

    def s_class(self, top: bool) -> None:
        self.p += 1
        self.name()
        self.class_body()

    def class_body(self) -> None:
        k = self.k
        if k[self.p] == KW["extends"]:
            self.p += 1
            self.postfix()
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] == ";":
                self.p += 1
                continue
            if k[self.p] == _SOFT["static"] and k[self.p + 1] not in "(=;}":
                self.p += 1
                if k[self.p] == "{":
                    self.block()
                    continue
            self.accessor()
            self.key()
            if k[self.p] == "(":
                self.function()
            else:
                self.default()
                self.semicolon()
        self.p += 1

    def accessor(self) -> None:
        k = self.k
        if k[self.p] in (_SOFT["get"], _SOFT["set"], _SOFT["async"]) and k[self.p + 1] not in "(=;},:":
            self.p += 1
        if k[self.p] == "*":
            self.p += 1

    def s_import(self, top: bool) -> None:
        k = self.k
        if not top:
            self.fail("import inside a block")
        self.p += 1
        if k[self.p] != "s":
            if k[self.p] in _NAMES:
                self.p += 1
                if k[self.p] == ",":
                    self.p += 1
            if k[self.p] == "*":
                self.p += 1
                self.need(_SOFT["as"])
                self.name()
            elif k[self.p] == "{":
                self.specifiers()
            self.need(_SOFT["from"])
        self.need("s")
        if k[self.p] == KW["with"]:
            self.p += 1
            self.object()
        self.semicolon()

    def specifiers(self) -> None:
        k = self.k
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] not in _PROPERTY and k[self.p] != "s":
                self.fail("expected a name in braces")
            self.p += 1
            if k[self.p] == _SOFT["as"]:
                self.p += 1
                if k[self.p] not in _PROPERTY and k[self.p] != "s":
                    self.fail("expected a name after as")
                self.p += 1
            if k[self.p] != ",":
                break
            self.p += 1
        self.need("}")

    def s_export(self, top: bool) -> None:
        k = self.k
        if not top:
            self.fail("export inside a block")
        self.p += 1
        c = k[self.p]
        if c == "*":
            self.p += 1
            if k[self.p] == _SOFT["as"]:
                self.p += 2
            self.need(_SOFT["from"])
            self.need("s")
            self.semicolon()
        elif c == "{":
            self.specifiers()
            if k[self.p] == _SOFT["from"]:
                self.p += 1
                self.need("s")
            self.semicolon()
        elif c == KW["default"]:
            self.p += 1
            q = self.p + (k[self.p] == _SOFT["async"])
            if k[q] == KW["function"]:
                self.p = q + 1
                if k[self.p] == "*":
                    self.p += 1
                if k[self.p] in _NAMES:
                    self.p += 1
                self.function()
            elif k[self.p] == KW["class"]:
                self.p += 1
                if k[self.p] in _NAMES:
                    self.p += 1
                self.class_body()
            else:
                self.assign()
                self.semicolon()
        elif c in (KW["var"], KW["const"], KW["function"], KW["class"], _SOFT["let"], _SOFT["async"]):
            self.statement(False)
        else:
            self.fail(f"cannot export {_name(c)}")

    def s_with(self, top: bool) -> None:
        self.fail("with in a module")

    # ---- expressions

    def comma(self) -> None:
        self.assign()
        while self.k[self.p] == ",":
            self.p += 1
            self.assign()

    def arrow_ahead(self) -> bool:
        """Whether the parenthesis at ``p`` opens the parameters of an arrow function."""
        if self.pairs is None:
            self.pairs, opened = {}, []
            for m in _BRACKET.finditer(self.k):
                if m[0] in "([{":
                    opened.append(m.start())
                elif opened:
                    self.pairs[opened.pop()] = m.start()
        end = self.pairs.get(self.p)
        return end is not None and self.k[end + 1] == "R"

    def assign(self) -> None:
        k = self.k
        c = k[self.p]
        if c == KW["yield"]:
            self.p += 1
            if k[self.p] == "*":
                self.p += 1
            if k[self.p] not in ")]},;:\0" and self.p not in self.breaks:
                self.assign()
            return
        q = self.p + (c == _SOFT["async"] and k[self.p + 1] in ("(", *_NAMES) and self.p + 1 not in self.breaks)
        if k[q] in _NAMES and k[q + 1] == "R":
            self.p = q + 2
            return self.arrow_body()
        if k[q] == "(" and (q == self.p or k[q] == "("):
            keep, self.p = self.p, q
            if self.arrow_ahead():
                self.parameters()
                self.need("R")
                return self.arrow_body()
            self.p = keep
        start = self.p
        self.conditional()
        c = k[self.p]
        if c == "=" or c == "A":
            if not self.assignable(start, c):
                self.fail("assignment to something that is no variable")
            self.p += 1
            self.assign()
        return None

    def arrow_body(self) -> None:
        if self.k[self.p] == "{":
            keep, self.in_ok = self.in_ok, True
            self.block()
            self.in_ok = keep
        else:
            self.assign()

    def assignable(self, start: int, op: str) -> bool:
        last = self.k[self.p - 1]
        if start == self.p - 1:
            return last in _NAMES
        if self.k[start] in "[{":
            return op == "="
        return last in _PROPERTY or last in "]#" or (last == ")" and self.k[start] == "(")

    def conditional(self) -> None:
        self.binary(0)
        if self.k[self.p] == "?":
            self.p += 1
            keep, self.in_ok = self.in_ok, True
            self.assign()
            self.in_ok = keep
            self.need(":")
            self.assign()

    def binary(self, least: int) -> None:
        k = self.k
        if k[self.p] == "#" and k[self.p + 1] == KW["in"]:
            self.p += 1
        else:
            self.unary()
        while True:
            c = k[self.p]
            b = _BINARY.get(c)
            if b is None or b[0] < least or (c == KW["in"] and not self.in_ok):
                return
            self.p += 1
            self.binary(b[0] if b[1] == "r" else b[0] + 1)

    def unary(self) -> None:
        k = self.k
        c = k[self.p]
        if c in "!~P" or c in _UNARY_WORDS:
            self.p += 1
            return self.unary()
        if c == "I":
            self.p += 1
            start = self.p
            self.unary()
            if not self.assignable(start, "A"):
                self.fail("++ or -- before something that is no variable")
            return None
        start = self.p
        self.postfix()
        if k[self.p] == "I" and self.p not in self.breaks:
            if not self.assignable(start, "A"):
                self.fail("++ or -- after something that is no variable")
            self.p += 1
        return None

    def postfix(self) -> None:
        k = self.k
        c = k[self.p]
        if c in _NAMES:
            if c == _SOFT["async"] and k[self.p + 1] == KW["function"]:
                self.p += 1
                return self.postfix()
            self.p += 1
        elif c in "snr":
            self.p += 1
        elif c in _VALUES:
            self.p += 1
        elif c == "(":
            self.p += 1
            keep, self.in_ok = self.in_ok, True
            self.comma()
            self.in_ok = keep
            self.need(")")
        elif c == "[":
            self.p += 1
            keep, self.in_ok = self.in_ok, True
            while k[self.p] != "]":
                if k[self.p] == ",":
                    self.p += 1
                    continue
                if k[self.p] == "L":
                    self.p += 1
                self.assign()
                if k[self.p] != ",":
                    break
                self.p += 1
            self.in_ok = keep
            self.need("]")
        elif c == "{":
            self.object()
        elif c == KW["function"]:
            self.p += 1
            if k[self.p] == "*":
                self.p += 1
            if k[self.p] in _NAMES:
                self.p += 1
            self.function()
        elif c == KW["class"]:
            self.p += 1
            if k[self.p] in _NAMES:
                self.p += 1
            self.class_body()
        elif c == KW["new"]:
            self.p += 1
            if k[self.p] == ".":
                self.p += 2
            else:
                self.postfix()  # its call belongs to new
        elif c == KW["import"]:
            self.p += 1
            if k[self.p] == ".":
                self.p += 2
            elif k[self.p] != "(":
                self.fail("unexpected import")
        elif c == KW["super"]:
            self.p += 1
            if k[self.p] not in "(.[":
                self.fail("unexpected super")
        else:
            self.fail(f"unexpected {_name(c)}")
        while True:
            c = k[self.p]
            if c == ".":
                self.p += 1
                if k[self.p] not in _PROPERTY and k[self.p] != "#":
                    self.fail(f"expected a property before {_name(k[self.p])}")
                self.p += 1
            elif c == "(":
                self.arguments()
            elif c == "[":
                self.p += 1
                keep, self.in_ok = self.in_ok, True
                self.comma()
                self.in_ok = keep
                self.need("]")
            elif c == "O":
                self.p += 1
                n = k[self.p]
                if n in _PROPERTY or n == "#":
                    self.p += 1
                elif n not in "([":
                    self.fail("expected a member after ?.")
            elif c == "s" and self.p > 0 and k[self.p - 1] in (*_NAMES, ")", "]"):
                self.p += 1  # a tagged template
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        keep, self.in_ok = self.in_ok, True
        while self.k[self.p] != ")":
            if self.k[self.p] == "L":
                self.p += 1
            self.assign()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.in_ok = keep
        self.need(")")

    def object(self) -> None:
        k = self.k
        keep, self.in_ok = self.in_ok, True
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] == "L":
                self.p += 1
                self.assign()
            else:
                self.accessor()
                plain = k[self.p] in _NAMES
                self.key()
                if k[self.p] == "(":
                    self.function()
                elif k[self.p] == ":":
                    self.p += 1
                    self.assign()
                elif plain:
                    self.default()
                else:
                    self.fail(f"expected : before {_name(k[self.p])}")
            if k[self.p] != ",":
                break
            self.p += 1
        self.need("}")
        self.in_ok = keep


_UNARY_WORDS = frozenset(KW[w] for w in ("typeof", "void", "delete", "await"))
_VALUES = frozenset(KW[w] for w in ("this", "null", "true", "false"))
_STATEMENTS = {
    ";": Parser.s_empty, "{": Parser.s_block, **{KW[w]: Parser.s_var for w in ("var", "const")},
    **{KW[w]: getattr(Parser, f"s_{w}") for w in ("if", "while", "do", "for", "switch", "try", "return", "throw", "function", "class", "import", "export", "with")},
    **{KW[w]: Parser.s_jump for w in ("break", "continue", "debugger")},
}
_WORDS = {v: w for w, v in _K.items()} | {"i": "a name", "n": "a number", "s": "a string", "r": "a regular expression", "X": "a stray character", "\0": "the end", "R": "=>", "L": "..."}


def _name(c: str) -> str:
    return _WORDS.get(c, c)


def errors(text: str) -> list[tuple[int, str]]:
    """(offset, message) of every syntax error of a module; empty when it parses."""
    start = 0
    if text.startswith("#!"):
        start = len(text.split("\n", 1)[0])
    with deep():
        try:
            k, where, breaks, _ = lex(text, start)
            try:
                Parser(k, breaks).file()
                return []
            except Broken:
                pass
            return [(where[min(i, len(where) - 1)], why) for i, why in Parser(k, breaks).recover()]
        except RecursionError:
            return [(0, TOO_DEEP)]
