"""The classes and methods of a PHP file with their lines and documentation comments.

A single pass over strings, comments, braces and a few words; no full parse, so files with
syntax errors still yield what is well-formed in them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from codeweft.llm.php_syntax import _DQ, _HTML, _NAME, _OPEN, _SQ, _TICK

_HEAD = r"(?i:function|class|interface|trait|enum|namespace)"
# all other text is passed over inside one match
_PIECE = re.compile(
    rf"(?:[^\w/'\"`<?{{}}\#$]++|\$++\w*+|(?!{_HEAD}\b)\w++|/(?![/*])|<(?!<<)|\?(?!>)|\#(?=\[))*+"
    rf"(?:(?P<brace>\{{|\}})|(?P<word>{_HEAD}\b)|(?P<doc>/\*\*(?=\s)(?s:.*?)\*/)|(?P<skip>{_SQ}|{_DQ}|/\*(?s:.*?)\*/|//[^\r\n?]*(?:\?(?!>)[^\r\n?]*)*|\#[^\r\n?]*(?:\?(?!>)[^\r\n?]*)*|{_TICK}"
    rf"|<<<[ \t]*(?:'(?P<a>{_NAME})'|\"?(?P<b>{_NAME})\"?)\r?\n(?:(?s:.*?)\n)?[ \t]*(?:(?P=a)|(?P=b))(?![A-Za-z0-9_])|{_HTML}|(?s:.)|\Z))"
)
_MODIFIERS = r"(?:(?i:public|protected|private|static|abstract|final|readonly)\s+)*"
_ATTRIBUTE = rf"\#\[(?:[^\[\]'\"]++|{_SQ}|{_DQ}|\[(?:[^\[\]'\"]++|{_SQ}|{_DQ}|\[[^\[\]]*\])*\])*\]"
#: what may stand between a documentation comment and the method it belongs to
_AFTER_DOC = re.compile(rf"(?:\s++|{_ATTRIBUTE})*{_MODIFIERS}(?i:function)\b")
_AFTER_FUNCTION = re.compile(rf"\s*&?\s*({_NAME})\s*\(")
#: the rest of a signature up to its body or semicolon
_SIGNATURE = re.compile(rf"\((?:[^()'\"/\#]++|{_SQ}|{_DQ}|/\*(?s:.*?)\*/|//[^\r\n]*|\#[^\r\n]*|/|\((?:[^()'\"]++|{_SQ}|{_DQ}|\((?:[^()'\"]++|{_SQ}|{_DQ})*\))*\))*\)\s*(?::[^{{;]*)?(?:(?://|\#)[^\r\n]*\s*|/\*(?s:.*?)\*/\s*)*([{{;])")
_AFTER_CLASS = re.compile(rf"\s+({_NAME})")
_AFTER_NAMESPACE = re.compile(rf"\s+({_NAME}(?:\\{_NAME})*)\s*[;{{]")
_LINE = re.compile(r"\r\n|\r|\n")


class Method(NamedTuple):
    class_fqn: str
    name: str
    line: int
    end_line: int | None
    start: int
    end: int | None
    doc: str | None
    has_body: bool


def line_starts(text: str) -> list[int]:
    """Where each line begins; a line ends at \\n, \\r\\n or a lone \\r."""
    return [0, *(m.end() for m in _LINE.finditer(text))]


def methods(text: str) -> list[Method]:
    """Every method of a named class, interface, trait or enum, in order of place.

    ``end`` is None when the closing brace is missing. A documentation comment belongs to a
    method when only white space and attributes stand between the two.
    """
    first = _OPEN.search(text)
    if not first or "function" not in text:
        return []
    starts = line_starts(text)
    line = lambda at: bisect_right(starts, at)
    out: list[Method] = []
    namespace = ""
    classes: list[tuple[str | None, int]] = []  # an open class: its name, None when it has none, and the depth of its body
    bodies: list[tuple[int, int]] = []  # an open method: its index and the depth of its body
    pending: tuple[str | None] | None = None
    waiting = -1
    depth = 0
    docs: dict[int, str] = {}  # place of the word function -> its comment
    for m in _PIECE.finditer(text, first.end()):
        g = m.lastgroup
        if g == "brace":
            if m["brace"] == "{":
                depth += 1
                if pending:
                    classes.append((pending[0], depth))
                    pending = None
                elif waiting >= 0:
                    bodies.append((waiting, depth))
                    waiting = -1
            else:
                if bodies and bodies[-1][1] == depth:
                    i = bodies.pop()[0]
                    out[i] = out[i]._replace(end_line=line(m.end() - 1), end=m.end(), has_body=True)
                elif classes and classes[-1][1] == depth:
                    classes.pop()
                depth = max(0, depth - 1)
        elif g == "doc":
            n = _AFTER_DOC.match(text, m.end())
            if n:
                docs[n.end() - 8] = m["doc"]
        elif g == "word":
            at, end = m.span("word")
            if text[at - 1] in ">\\" or text[at - 2 : at] == "::" or text[end : end + 1] == "\\":
                continue
            w = m["word"].lower()
            if w == "function":
                n = _AFTER_FUNCTION.match(text, end)
                if n and classes and classes[-1][1] == depth and classes[-1][0] is not None:
                    start = _lead(text, at)
                    out.append(Method(classes[-1][0], n[1], line(at), None, start, None, docs.get(at), False))
                    sig = _SIGNATURE.match(text, n.end() - 1)
                    if sig and sig[1] == ";":
                        out[-1] = out[-1]._replace(end_line=line(sig.end() - 1), end=sig.end())
                    else:
                        waiting = len(out) - 1
            elif w == "namespace":
                if n := _AFTER_NAMESPACE.match(text, end):
                    namespace = n[1]
            else:
                n = _AFTER_CLASS.match(text, end)
                if w == "class" and _NEW.search(text, max(0, at - 200), at):
                    pending = (None,)
                elif n and (w != "enum" or n[1].lower() not in ("extends", "implements")) and not bodies:
                    pending = (f"{namespace}\\{n[1]}" if namespace else n[1],)
    return out


_NEW = re.compile(rf"(?i:\bnew)\s+(?:{_ATTRIBUTE}\s*)?(?:(?i:readonly)\s+)?\Z")
_LEAD = re.compile(r"(?:(?i:public|protected|private|static|abstract|final)[ \t]+)+\Z")


def _lead(text: str, at: int) -> int:
    """Where the modifiers before the word function begin."""
    m = _LEAD.search(text, max(0, at - 60), at)
    return m.start() if m else at
