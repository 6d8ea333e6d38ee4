"""PHP syntax: a lexer to one character a token and a recursive-descent parser over it.

Statements are parsed by recursive descent, expressions by precedence climbing; after an error
the parser skips to the next statement (panic mode) and goes on, so all errors of a file are
kept. Two things make it fast on plain Python: tokens come from one compiled pattern, and a
statement or header without braces is remembered by its token string once it has parsed, as the
same shapes recur throughout a corpus. The memory is emptied when it is full.
"""

from __future__ import annotations

import re

from codeweft.llm.nesting import TOO_DEEP, deep

_COMMENT = r"/\*(?s:.*?)\*/|(?://|\#(?!\[))[^\r\n?]*(?:\?(?!>)[^\r\n?]*)*"
_SKIP = rf"(?:\s++|{_COMMENT})*+"
_NAME = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*"
_SUB = r"\{\$(?:[^{}]|\{[^{}]*\})*\}"
_DQ = rf'"(?:[^"\\{{]++|\\(?s:.)|{_SUB}|\{{(?!\$))*+"'
_TICK = rf"`(?:[^`\\{{]++|\\(?s:.)|{_SUB}|\{{(?!\$))*+`"
_SQ = r"'(?:[^'\\]++|\\(?s:.))*+'"
_HTML = r"\?>(?s:.*?)(?:<\?(?:php(?=\s|\Z)|=)|\Z)"
_CAST = r"\([ \t]*(?i:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)[ \t]*\)"
_NUM = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?"
_OPS = r"===|!==|<=>|\*\*=|<<=|>>=|\.\.\.|\?\?=|\?->|->|=>|::|\+\+|--|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\#\["
_TOKEN = rf"\$+{_NAME}|\\?{_NAME}(?:\\{_NAME})*|{_HTML}|{_OPS}|{_SQ}|{_DQ}|{_NUM}|{_CAST}|{_TICK}|(?s:.)"
_FAST = re.compile(rf"{_SKIP}({_TOKEN}|\Z)")
_FULL = re.compile(rf"{_SKIP}(<<<[ \t]*(?:'(?P<a>{_NAME})'|\"?(?P<b>{_NAME})\"?)\r?\n(?:(?s:.*?)\n)?[ \t]*(?:(?P=a)|(?P=b))(?![A-Za-z0-9_])|{_TOKEN}|\Z)")
_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)

_KEYWORDS = (
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor "
    "endforeach endif endswitch endwhile exit die extends final finally fn for foreach function global goto if implements include include_once "
    "instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return "
    "static switch throw trait try unset use var while xor yield enum eval halt from"
).split()
#: keyword -> its character
KW = {w: chr(0x100 + n) for n, w in enumerate(_KEYWORDS)}
#: contextual words that are also ordinary names
_SOFT = frozenset(KW[w] for w in ("enum", "match", "readonly", "from", "halt"))
_KW_SET = frozenset(KW.values())
_WORDS = _KW_SET | {"i"}
_FIXED = {
    "": "", ";": ";", ",": ",", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "$": "$", "@": "@", "=>": "R", "->": "O", "?->": "O", "::": "D", "...": "L",
    "?": "?", ":": ":", "??": "Q", "??=": "A", "=": "=", "&": "&", "|": "|", "!": "!", "~": "~", "+": "P", "-": "P", ".": ".", "*": "M", "/": "M", "%": "M",
    "**": "W", "++": "I", "--": "I", "<": "G", ">": "G", "<=": "G", ">=": "G", "==": "E", "!=": "E", "===": "E", "!==": "E", "<>": "E", "<=>": "E",
    "<<": "S", ">>": "S", "&&": "B", "||": "b", "^": "^", "#[": "T",
    **{f"{o}=": "A" for o in ("+", "-", "*", "/", ".", "%", "&", "|", "^", "**", "<<", ">>")},
}
_NUMBER = re.compile(rf"(?:{_NUM})\Z")


class _Kinds(dict):
    """Token text -> its character (two for an echo tag), remembered."""

    def __missing__(self, t: str) -> str:
        if len(self) > 400_000:
            self.clear()
            self.update(_FIXED)
        self[t] = k = self._kind(t)
        return k

    @staticmethod
    def _kind(t: str) -> str:
        c = t[0]
        if c in _FIXED and t in _FIXED:
            return _FIXED[t]
        if c == "$":
            return "v" if len(t) > 1 else "$"
        if c == "?" and t[:2] == "?>":
            return ";" + KW["echo"] if t.endswith("<?=") else ";"
        if c in "'\"`":
            return "s" if len(t) > 1 else "X"
        if c == "<":
            return "s" if t[:3] == "<<<" and len(t) > 3 else "X"
        if c == "(":
            return "C"
        if c in "0123456789.":
            return "n" if _NUMBER.match(t) else "X"
        if c.isalpha() or c == "_" or c == "\\" or c >= "\x80":
            if t == "\\" or (c >= "\x80" and not re.match(_NAME, t)):
                return "X"
            return KW.get(t.lower(), "i") if "\\" not in t else "i"
        return "X"


_KINDS = _Kinds(_FIXED)


def has_open_tag(text: str) -> bool:
    return _OPEN.search(text) is not None


def tokens(text: str, at: int = 0) -> list[str]:
    if "<<<" in text:
        return [m[1] for m in _FULL.finditer(text, at)]
    return _FAST.findall(text, at)


def kinds(toks: list[str]) -> str:
    return "".join(map(_KINDS.__getitem__, toks))


def offsets(text: str, at: int = 0) -> list[int]:
    """The place of each character of ``kinds`` in the text, and the end."""
    out: list[int] = []
    for m in _FULL.finditer(text, at):
        out += [m.start(1)] * len(_KINDS[m[1]])
    return [*out, len(text)]


class Broken(Exception):
    """A syntax error at a token position."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


#: Binary operators: character -> (binding power, associativity: left, right or none).
_BINARY = {
    KW["or"]: (1, "l"), KW["xor"]: (2, "l"), KW["and"]: (3, "l"),
    "?": (7, "n"), "Q": (8, "r"), "b": (9, "l"), "B": (10, "l"), "|": (11, "l"), "^": (12, "l"), "&": (13, "l"),
    "E": (14, "n"), "G": (15, "n"), ".": (16, "l"), "S": (17, "l"), "P": (18, "l"), "M": (19, "l"), KW["instanceof"]: (22, "l"), "W": (24, "r"),
}
_ASSIGN = 5
_MODIFIERS = frozenset(KW[w] for w in ("public", "protected", "private", "static", "abstract", "final", "readonly", "var"))
_TYPE_WORDS = frozenset([KW["array"], KW["callable"], KW["static"], "i", *_SOFT])
_END = "\0"
_FLAT_STATEMENT = re.compile(r"[^{};\0]*;")
_FLAT_HEADER = re.compile(r"[^{};\0]*\{")
_PREFIX = frozenset("!~@PC") | {"&"}
_PREFIX_WORDS = frozenset(KW[w] for w in ("include", "include_once", "require", "require_once"))
_K = {w: KW[w] for w in _KEYWORDS}


class Parser:
    """Parses a token string; ``p`` is the place in it."""

    good: set[tuple[str, str]] = set()

    def __init__(self, kinds_: str, toks: list[str] | None = None) -> None:
        self.k, self.p, self.toks = kinds_ + _END, 0, toks

    def fail(self, why: str) -> None:
        raise Broken(self.p, why)

    def need(self, c: str) -> None:
        if self.k[self.p] != c:
            self.fail(f"expected {_name(c)} before {_name(self.k[self.p])}")
        self.p += 1

    def word(self) -> None:
        if self.k[self.p] not in _WORDS:
            self.fail(f"expected a name before {_name(self.k[self.p])}")
        self.p += 1

    # ---- files and statements

    def file(self) -> None:
        while self.k[self.p] != _END:
            self.statement(True)

    def recover(self) -> list[tuple[int, str]]:
        """All errors of a file: after each one, on to the next statement."""
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

    def remembered(self, pattern: re.Pattern, context: str) -> bool:
        m = pattern.match(self.k, self.p)
        if m and (context, m[0]) in self.good:
            self.p = m.end()
            return True
        return False

    def remember(self, start: int, pattern: re.Pattern, context: str) -> None:
        m = pattern.match(self.k, start)
        if m and m.end() == self.p:
            if len(m[0]) > 500:
                return
            if len(self.good) > 500_000:
                self.good.clear()
            self.good.add((context, m[0]))

    def block(self) -> None:
        self.need("{")
        while self.k[self.p] != "}":
            if self.k[self.p] == _END:
                self.fail("the file ends inside a block")
            self.statement(False)
        self.p += 1

    def statement(self, top: bool) -> None:
        context = "t" if top else "s"
        if self.remembered(_FLAT_STATEMENT, context):
            return
        start = self.p
        c = self.k[start]
        f = _STATEMENTS.get(c)
        if f is None or (c in _SOFT and not self.soft_statement(c)) or (c == _K["static"] and self.k[start + 1] != "v") or (c in (_K["function"], _K["fn"]) and not self.named_function()):
            if c == "i" and self.k[start + 1] == ":":
                self.p += 2
                return
            self.expr()
            self.need(";")
        else:
            f(self, top)
        self.remember(start, _FLAT_STATEMENT, context)

    def soft_statement(self, c: str) -> bool:
        n = self.k[self.p + 1]
        return (c == _K["enum"] and n == "i") or (c == _K["readonly"] and n in (_K["class"], _K["final"], _K["abstract"])) or (c == _K["halt"])

    def named_function(self) -> bool:
        q = self.p + 1 + (self.k[self.p + 1] == "&")
        return self.k[self.p] == _K["function"] and self.k[q] in _WORDS and self.k[q + 1] == "("

    def s_empty(self, top: bool) -> None:
        self.p += 1

    def s_block(self, top: bool) -> None:
        self.block()

    def s_echo(self, top: bool) -> None:
        self.p += 1
        self.comma_list()
        self.need(";")

    def comma_list(self) -> None:
        self.expr()
        while self.k[self.p] == ",":
            self.p += 1
            self.expr()

    def parens(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def body(self, *ends: str) -> str:
        """A statement, or a colon and statements up to one of ``ends``, which is returned."""
        if self.k[self.p] != ":":
            self.statement(False)
            return ""
        self.p += 1
        while self.k[self.p] not in ends:
            if self.k[self.p] in "\0}":
                self.fail("a block with a colon has no end")
            self.statement(False)
        self.p += 1
        return self.k[self.p - 1]

    def header(self, context: str, parse) -> None:
        if self.remembered(_FLAT_HEADER, context):
            self.p -= 1
            return
        start = self.p
        parse()
        if self.k[self.p] == "{":
            self.p += 1
            self.remember(start, _FLAT_HEADER, context)
            self.p -= 1

    def s_if(self, top: bool) -> None:
        self.p += 1
        self.header("if", self.parens)
        if self.k[self.p] == ":":
            end = self.body(_K["elseif"], _K["else"], _K["endif"])
            while end != _K["endif"]:
                if end == _K["elseif"]:
                    self.parens()
                elif self.k[self.p] == _K["if"]:
                    return self.s_if(top)
                if self.k[self.p] != ":":
                    self.fail("expected : in an if with colons")
                end = self.body(*((_K["elseif"], _K["else"], _K["endif"]) if end == _K["elseif"] else (_K["endif"],)))
            return self.need(";")
        self.statement(False)
        while self.k[self.p] == _K["elseif"]:
            self.p += 1
            self.header("if", self.parens)
            self.statement(False)
        if self.k[self.p] == _K["else"]:
            self.p += 1
            if self.k[self.p] == ":":
                self.fail("else with a colon after if without one")
            self.statement(False)

    def s_while(self, top: bool) -> None:
        self.p += 1
        self.header("if", self.parens)
        if self.body(_K["endwhile"]):
            self.need(";")

    def s_do(self, top: bool) -> None:
        self.p += 1
        self.statement(False)
        self.need(_K["while"])
        self.parens()
        self.need(";")

    def s_for(self, top: bool) -> None:
        self.p += 1
        self.need("(")
        for end in (";", ";", ")"):
            if self.k[self.p] != end:
                self.comma_list()
            self.need(end)
        if self.body(_K["endfor"]):
            self.need(";")

    def foreach_head(self) -> None:
        self.need("(")
        self.expr()
        self.need(_K["as"])
        self.target()
        if self.k[self.p] == "R":
            self.p += 1
            self.target()
        self.need(")")

    def target(self) -> None:
        if self.k[self.p] == "&":
            self.p += 1
        if not self.postfix():
            self.fail("foreach into something that is no variable")

    def s_foreach(self, top: bool) -> None:
        self.p += 1
        self.header("foreach", self.foreach_head)
        if self.body(_K["endforeach"]):
            self.need(";")

    def s_switch(self, top: bool) -> None:
        self.p += 1
        self.parens()
        end = "}"
        if self.k[self.p] == ":":
            end = _K["endswitch"]
        elif self.k[self.p] != "{":
            self.fail("switch without a body")
        self.p += 1
        while self.k[self.p] == ";":
            self.p += 1
        while self.k[self.p] != end:
            if self.k[self.p] == _K["case"]:
                self.p += 1
                self.expr()
            else:
                self.need(_K["default"])
            if self.k[self.p] not in ":;":
                self.fail("expected : after a case")
            self.p += 1
            while self.k[self.p] not in (_K["case"], _K["default"], end):
                if self.k[self.p] in "\0}":
                    self.fail("a switch has no end")
                self.statement(False)
        self.p += 1
        if end != "}":
            self.need(";")

    def s_try(self, top: bool) -> None:
        self.p += 1
        self.block()
        n = 0
        while self.k[self.p] == _K["catch"]:
            self.p += 1
            self.need("(")
            self.type()
            if self.k[self.p] == "v":
                self.p += 1
            self.need(")")
            self.block()
            n += 1
        if self.k[self.p] == _K["finally"]:
            self.p += 1
            self.block()
            n += 1
        if not n:
            self.fail("try without catch")

    def s_return(self, top: bool) -> None:
        self.p += 1
        if self.k[self.p] != ";":
            self.expr()
        if self.k[self.p] == _END and top:
            return
        self.need(";")

    def s_jump(self, top: bool) -> None:
        self.p += 1
        if self.k[self.p] == "n":
            self.p += 1
        self.need(";")

    def s_goto(self, top: bool) -> None:
        self.p += 1
        self.need("i")
        self.need(";")

    def s_global(self, top: bool) -> None:
        self.p += 1
        while True:
            if self.k[self.p] == "$":
                self.p += 1
                self.need("{")
                self.expr()
                self.need("}")
            else:
                self.need("v")
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(";")

    def s_static(self, top: bool) -> None:
        self.p += 1
        self.variables()

    def variables(self) -> None:
        """$a, $b = 1; of properties and static variables."""
        while True:
            self.need("v")
            if self.k[self.p] == "=":
                self.p += 1
                self.expr()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(";")

    def s_unset(self, top: bool) -> None:
        self.p += 1
        self.arguments()
        self.need(";")

    def s_const(self, top: bool) -> None:
        self.p += 1
        while True:
            self.word()
            self.need("=")
            self.expr()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(";")

    def s_namespace(self, top: bool) -> None:
        if self.k[self.p + 1] == "i" and self.toks is not None and self.k[self.p + 2] not in ";{":
            self.p += 2
            self.fail("namespace without an end")
        self.p += 1
        if self.k[self.p] in _WORDS:
            self.p += 1
        if self.k[self.p] == "{":
            self.p += 1
            while self.k[self.p] != "}":
                if self.k[self.p] == _END:
                    self.fail("the file ends inside a namespace")
                self.statement(True)
            self.p += 1
        else:
            self.need(";")

    def s_use(self, top: bool) -> None:
        if not top:
            self.fail("use inside a block")
        self.p += 1
        if self.k[self.p] in (_K["function"], _K["const"]):
            self.p += 1
        while True:
            self.word()
            if self.k[self.p] == "X":  # Name\{...}
                self.p += 1
            if self.k[self.p] == "{":
                self.p += 1
                while self.k[self.p] != "}":
                    if self.k[self.p] in (_K["function"], _K["const"]):
                        self.p += 1
                    self.word()
                    self.alias()
                    if self.k[self.p] != ",":
                        break
                    self.p += 1
                self.need("}")
            self.alias()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(";")

    def alias(self) -> None:
        if self.k[self.p] == _K["as"]:
            self.p += 1
            self.word()

    def s_declare(self, top: bool) -> None:
        self.p += 1
        self.need("(")
        while True:
            self.word()
            self.need("=")
            self.expr()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(")")
        if self.k[self.p] == ";":
            self.p += 1
        elif self.body(_K["enddeclare"]):
            self.need(";")

    def s_halt(self, top: bool) -> None:
        self.p = len(self.k) - 1

    def s_attribute(self, top: bool) -> None:
        self.attributes()
        self.statement(top)

    def attributes(self) -> None:
        while self.k[self.p] == "T":
            self.p += 1
            while self.k[self.p] != "]":
                self.word()
                if self.k[self.p] == "(":
                    self.arguments()
                if self.k[self.p] != ",":
                    break
                self.p += 1
            self.need("]")

    def s_function(self, top: bool) -> None:
        self.p += 1
        self.header("function", self.signature)
        self.block()

    def signature(self) -> None:
        if self.k[self.p] == "&":
            self.p += 1
        self.word()
        self.parameters()
        self.returns()

    def parameters(self) -> None:
        self.need("(")
        while self.k[self.p] != ")":
            self.attributes()
            while self.k[self.p] in _MODIFIERS:
                self.p += 1
            if self.k[self.p] not in "v&L":
                self.type()
            if self.k[self.p] == "&":
                self.p += 1
            if self.k[self.p] == "L":
                self.p += 1
            self.need("v")
            if self.k[self.p] == "=":
                self.p += 1
                self.expr()
            if self.k[self.p] == "{":
                self.hooks()
            if self.k[self.p] != ",":
                break
            self.p += 1
        self.need(")")

    def returns(self) -> None:
        if self.k[self.p] == ":":
            self.p += 1
            self.type()

    def type(self) -> None:
        if self.k[self.p] == "?":
            self.p += 1
        while True:
            if self.k[self.p] == "(":
                self.p += 1
                self.type()
                self.need(")")
            elif self.k[self.p] in _TYPE_WORDS:
                self.p += 1
            else:
                self.fail(f"expected a type before {_name(self.k[self.p])}")
            c = self.k[self.p]
            if c == "|" or (c == "&" and self.k[self.p + 1] not in "v&L"):
                self.p += 1
            else:
                return

    def s_class(self, top: bool) -> None:
        while self.k[self.p] in (_K["abstract"], _K["final"], _K["readonly"]):
            self.p += 1
        kind = self.k[self.p]
        if kind not in (_K["class"], _K["interface"], _K["trait"], _K["enum"]):
            self.fail("expected a class")
        self.p += 1
        self.header("class", self.class_head)
        self.members()

    def class_head(self) -> None:
        if self.k[self.p] not in _SOFT and self.k[self.p] != "i":
            self.fail(f"expected a class name before {_name(self.k[self.p])}")
        self.p += 1
        if self.k[self.p] == ":":
            self.p += 1
            self.type()
        self.parents()

    def parents(self) -> None:
        for w in (_K["extends"], _K["implements"]):
            if self.k[self.p] == w:
                self.p += 1
                self.word()
                while self.k[self.p] == ",":
                    self.p += 1
                    self.word()

    def members(self) -> None:
        self.need("{")
        while self.k[self.p] != "}":
            if self.k[self.p] == _END:
                self.fail("the file ends inside a class")
            if not self.remembered(_FLAT_STATEMENT, "m"):
                start = self.p
                self.member()
                self.remember(start, _FLAT_STATEMENT, "m")
        self.p += 1

    def member(self) -> None:
        self.attributes()
        c = self.k[self.p]
        if c == ";":  # only a tag can stand here
            self.fail("unexpected ; in a class")
        if c == _K["use"]:
            self.p += 1
            self.word()
            while self.k[self.p] == ",":
                self.p += 1
                self.word()
            if self.k[self.p] == "{":
                self.p += 1
                while self.k[self.p] != "}":
                    self.word()
                    if self.k[self.p] == "D":
                        self.p += 1
                        self.word()
                    if self.k[self.p] == _K["insteadof"]:
                        self.p += 1
                        self.word()
                        while self.k[self.p] == ",":
                            self.p += 1
                            self.word()
                    else:
                        self.need(_K["as"])
                        if self.k[self.p] in _MODIFIERS:
                            self.p += 1
                        if self.k[self.p] in _WORDS:
                            self.p += 1
                    self.need(";")
                self.p += 1
            else:
                self.need(";")
            return
        if c == _K["case"]:
            self.p += 1
            self.word()
            if self.k[self.p] == "=":
                self.p += 1
                self.expr()
            return self.need(";")
        mods = self.p
        while self.k[self.p] in _MODIFIERS and self.k[self.p + 1] not in "=,":
            self.p += 1
        c = self.k[self.p]
        if c == _K["function"]:
            self.p += 1
            self.header("function", self.signature)
            if self.k[self.p] == ";":
                self.p += 1
            else:
                self.block()
        elif c == _K["const"]:
            self.p += 1
            if self.k[self.p + 1] not in "=":
                self.type()
            while True:
                self.word()
                self.need("=")
                self.expr()
                if self.k[self.p] != ",":
                    break
                self.p += 1
            self.need(";")
        else:
            if self.p == mods:
                self.fail(f"unexpected {_name(c)} in a class")
            if c != "v":
                self.type()
            if self.k[self.p] == "v" and self.k[self.p + 1] == "{":
                self.p += 1
                return self.hooks()
            start = self.p
            self.need("v")
            if self.k[self.p] == "=":
                self.p += 1
                self.expr()
                if self.k[self.p] == "{":
                    return self.hooks()
            self.p = start
            self.variables()

    def hooks(self) -> None:
        self.need("{")
        while self.k[self.p] != "}":
            self.attributes()
            while self.k[self.p] in _MODIFIERS or self.k[self.p] == "&":
                self.p += 1
            self.need("i")
            if self.k[self.p] == "(":
                self.parameters()
            if self.k[self.p] == "R":
                self.p += 1
                self.expr()
                self.need(";")
            elif self.k[self.p] == ";":
                self.p += 1
            else:
                self.block()
        self.p += 1

    # ---- expressions

    def expr(self, least: int = 0) -> None:
        self.unary()
        used = 99
        k = self.k
        while True:
            c = k[self.p]
            b = _BINARY.get(c)
            if b is None or b[0] < least:
                return
            power, side = b
            if side == "n" and power == used:
                self.fail(f"{_name(c)} cannot be chained")
            self.p += 1
            if c == "?":
                if k[self.p] == ":":
                    self.p += 1
                    used = 99
                else:
                    self.expr(_ASSIGN)
                    self.need(":")
                    used = power
                self.expr(power + 1)
                continue
            if c == _K["instanceof"]:
                if k[self.p] in _WORDS:
                    self.p += 1
                else:
                    self.unary()
            elif c == "&" and k[self.p] == "&":
                self.fail("& twice")
            else:
                self.expr(power if side == "r" else power + 1)
            used = power

    def unary(self) -> None:
        k = self.k
        c = k[self.p]
        if c in _PREFIX:
            if c == "&":
                self.fail("unexpected &")
            self.p += 1
            return self.expr(21 if c == "!" else 23) if c != "@" else self.expr(23)
        if c == "I":
            self.p += 1
            if not self.postfix():
                self.fail("++ or -- before something that is no variable")
            return None
        if c in _PREFIX_WORDS or c == _K["print"]:
            self.p += 1
            return self.expr(_ASSIGN)
        if c == _K["throw"]:
            self.p += 1
            return self.expr(0)
        if c == _K["clone"]:
            self.p += 1
            return self.expr(23)
        if c == _K["yield"]:
            self.p += 1
            if k[self.p] == _K["from"]:
                self.p += 1
                return self.expr(4)
            if k[self.p] in ";),]":
                return None
            self.expr(4)
            if k[self.p] == "R":
                self.p += 1
                self.expr(4)
            return None
        changeable = self.postfix()
        c = k[self.p]
        if c == "I":
            if not changeable:
                self.fail("++ or -- after something that is no variable")
            self.p += 1
        elif c in "=A":
            if not changeable:
                self.fail("assignment to something that is no variable")
            self.p += 1
            if c == "=" and k[self.p] == "&":
                self.p += 1
            self.expr(_ASSIGN)
        return None

    def postfix(self) -> bool:
        """A primary and what follows it; whether one can assign to it."""
        k = self.k
        c = k[self.p]
        changeable = False
        callable_ = True
        if c == "v":
            self.p += 1
            changeable = True
        elif c == "i":
            self.p += 1
            if k[self.p] not in "(D[O{":
                return False
        elif c == "s":
            self.p += 1
        elif c == "n":
            self.p += 1
            return False
        elif c == "(":
            self.p += 1
            self.expr()
            self.need(")")
        elif c == "[":
            self.p += 1
            self.elements("]")
            changeable = True
        elif c in (_K["array"], _K["list"]):
            self.p += 1
            self.need("(")
            self.elements(")")
            changeable = c == _K["list"]
        elif c == "$":
            self.p += 1
            if k[self.p] == "{":
                self.p += 1
                self.expr()
                self.need("}")
            else:
                self.need("v")
            changeable = True
        elif c == _K["new"]:
            self.p += 1
            self.new()
        elif c == _K["static"] and k[self.p + 1] in (_K["function"], _K["fn"]):
            self.p += 1
            self.closure()
        elif c in (_K["function"], _K["fn"]):
            self.closure()
        elif c == "T":
            self.attributes()
            if k[self.p] == _K["static"]:
                self.p += 1
            self.closure()
        elif c == _K["static"]:
            self.p += 1
            if k[self.p] != "D":
                self.fail("unexpected static")
        elif c == _K["match"] and k[self.p + 1] == "(":
            self.match()
        elif c in (_K["isset"], _K["empty"], _K["eval"]):
            self.p += 1
            if k[self.p] != "(":
                self.fail("expected ( after isset or empty")
            self.arguments()
            return False
        elif c in (_K["exit"], _K["die"]):
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
            return False
        elif c in _SOFT or c == _K["namespace"]:
            self.p += 1
        else:
            self.fail(f"unexpected {_name(c)}")
        while callable_:
            c = k[self.p]
            if c == "O":
                self.p += 1
                n = k[self.p]
                if n in _WORDS or n == "v":
                    self.p += 1
                elif n == "{":
                    self.p += 1
                    self.expr()
                    self.need("}")
                elif n == "$":
                    self.p += 1
                    self.need("{") if k[self.p] == "{" else self.need("v")
                    if k[self.p - 1] == "{":
                        self.expr()
                        self.need("}")
                else:
                    self.fail(f"expected a member before {_name(n)}")
                changeable = True
            elif c == "(":
                self.arguments()
                changeable = False
            elif c == "[":
                self.p += 1
                if k[self.p] != "]":
                    self.expr()
                self.need("]")
                changeable = True
            elif c == "D":
                self.p += 1
                n = k[self.p]
                if n == "v":
                    self.p += 1
                    changeable = True
                elif n in _WORDS:
                    self.p += 1
                    changeable = False
                elif n == "{" or n == "$":
                    self.p += 1
                    if n == "$":
                        self.need("v")
                        changeable = True
                    else:
                        self.expr()
                        self.need("}")
                else:
                    self.fail(f"expected a member before {_name(n)}")
            elif c == "{" and False:
                return changeable
            else:
                return changeable
        return changeable

    def elements(self, end: str) -> None:
        k = self.k
        while k[self.p] != end:
            c = k[self.p]
            if c == ",":
                self.p += 1
                continue
            if c == "&":
                self.p += 1
            if c == "L":
                self.p += 1
            self.expr()
            if k[self.p] == "R":
                self.p += 1
                if k[self.p] == "&":
                    self.p += 1
                self.expr()
            if k[self.p] != ",":
                break
            self.p += 1
        self.need(end)

    def arguments(self) -> None:
        k = self.k
        self.need("(")
        if k[self.p] == "L" and k[self.p + 1] == ")":
            self.p += 2
            return
        while k[self.p] != ")":
            c = k[self.p]
            if c in _WORDS and k[self.p + 1] == ":":
                self.p += 2
            elif c == "L":
                self.p += 1
            self.expr()
            if k[self.p] != ",":
                break
            self.p += 1
        self.need(")")

    def new(self) -> None:
        k = self.k
        self.attributes()
        if k[self.p] == _K["readonly"] and k[self.p + 1] == _K["class"]:
            self.p += 1
        if k[self.p] == _K["class"]:
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
            self.parents()
            return self.members()
        if k[self.p] in _WORDS:
            self.p += 1
        elif k[self.p] == "(":
            self.parens()
        elif k[self.p] == "v":
            self.p += 1
            while k[self.p] in "OD[":
                c = k[self.p]
                self.p += 1
                if c == "[":
                    self.expr()
                    self.need("]")
                elif k[self.p] in _WORDS or k[self.p] == "v":
                    self.p += 1
                else:
                    self.fail("expected a member after new")
        else:
            self.fail(f"expected a class before {_name(k[self.p])}")
        if k[self.p] == "(":
            self.arguments()
        return None

    def closure(self) -> None:
        k = self.k
        c = k[self.p]
        if c not in (_K["function"], _K["fn"]):
            self.fail("expected a function")
        self.p += 1
        if k[self.p] == "&":
            self.p += 1
        self.parameters()
        if c == _K["fn"]:
            self.returns()
            self.need("R")
            return self.expr(_ASSIGN)
        if k[self.p] == _K["use"]:
            self.p += 1
            self.need("(")
            while k[self.p] != ")":
                if k[self.p] == "&":
                    self.p += 1
                self.need("v")
                if k[self.p] != ",":
                    break
                self.p += 1
            self.need(")")
        self.returns()
        self.block()
        return None

    def match(self) -> None:
        k = self.k
        self.p += 1
        self.parens()
        self.need("{")
        while k[self.p] != "}":
            if k[self.p] == _K["default"]:
                self.p += 1
                if k[self.p] == ",":
                    self.p += 1
            else:
                self.expr()
                while k[self.p] == ",":
                    self.p += 1
                    if k[self.p] == "R":
                        break
                    self.expr()
            self.need("R")
            self.expr()
            if k[self.p] != ",":
                break
            self.p += 1
        self.need("}")


_STATEMENTS = {
    ";": Parser.s_empty, "{": Parser.s_block, "T": Parser.s_attribute,
    **{KW[w]: getattr(Parser, f"s_{w}") for w in ("echo", "if", "while", "do", "for", "foreach", "switch", "try", "return", "goto", "global", "static", "unset", "const", "namespace", "use", "declare", "halt", "function")},
    **{KW[w]: Parser.s_jump for w in ("break", "continue")},
    **{KW[w]: Parser.s_class for w in ("class", "interface", "trait", "enum", "abstract", "final", "readonly")},
}
_NAMES = {v: w for w, v in KW.items()} | {"v": "a variable", "i": "a name", "n": "a number", "s": "a string", "C": "a cast", "X": "a stray character", "\0": "the end", "R": "=>", "O": "->", "D": "::", "L": "...", "T": "#["}


def _name(c: str) -> str:
    return _NAMES.get(c, c)


def errors(text: str) -> list[tuple[int, str]]:
    """(offset, message) of every syntax error of a PHP file with tags; empty when it parses."""
    m = _OPEN.search(text)
    if not m:
        return [(0, "no opening tag")]
    at = m.start() if m[0].endswith("=") else m.end()
    # an echo tag at the start reads as the tag after some text
    body = "?>" + text[at:] if m[0].endswith("=") else text
    start = 0 if m[0].endswith("=") else at
    return _errors(body, start, at - 2 if m[0].endswith("=") else 0)


def code_errors(code: str) -> list[tuple[int, str]]:
    """Like :func:`errors` for statements without tags."""
    return _errors(code, 0, 0)


def _errors(text: str, start: int, shift: int) -> list[tuple[int, str]]:
    toks = tokens(text, start)
    k = kinds(toks)
    with deep():
        try:
            Parser(k, toks).file()
            return []
        except Broken:
            where = offsets(text, start)
        except RecursionError:
            return [(0, TOO_DEEP)]
        try:
            return [(where[min(i, len(where) - 1)] + shift, why) for i, why in Parser(k, toks).recover()]
        except RecursionError:
            return [(0, TOO_DEEP)]


def _whole(k: str, parse) -> bool:
    """Whether ``parse`` takes all of the token string."""
    q = Parser(k)
    with deep():
        try:
            parse(q)
        except (Broken, RecursionError):
            return False
    return q.k[q.p] == _END


def expression_ok(code: str) -> bool:
    """Whether ``code`` is one expression."""
    k = kinds(tokens(code))
    if ("x", k) in Parser.good:
        return True
    if not _whole(k, Parser.expr):
        return False
    if len(k) < 200:
        Parser.good.add(("x", k))
    return True


def arguments_ok(code: str) -> bool:
    """Whether ``code``, with its parentheses, is a list of arguments."""
    return _whole(kinds(tokens(code)), Parser.arguments)


def foreach_ok(code: str) -> bool:
    """Whether ``code``, with its parentheses, is the head of a foreach."""
    return _whole(kinds(tokens(code)), Parser.foreach_head)
