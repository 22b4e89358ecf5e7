"""A tokenizer for languages with C-like lexical rules, and for Ruby."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

from wovengraph.sources.parse.model import check


class Token(NamedTuple):
    kind: str  # name, string, number, mark, line
    text: str
    start: int
    end: int
    line: int
    column: int


_MARKS = "::|->|=>|\\?\\.|\\?->|\\.\\.\\.|&&|\\|\\||==|!=|<=|>=|:=|\\+\\+|--|!!|<<|[^\\s\\w]"


_LONG = frozenset(("comment", "string", "line"))  # what line ends stand in; all others are in a line


@cache
def _pattern(comments: str, strings: str, names: str) -> re.Pattern[str]:
    return re.compile(rf"(?P<comment>{comments})|(?P<string>{strings})|(?P<name>{names})|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<mark>{_MARKS})", re.DOTALL)


def tokenize(text: str, until: float, comments: str = r"//[^\n]*|/\*.*?\*/", strings: str = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', names: str = r"[^\W\d]\w*", keep_lines: bool = False) -> list[Token]:
    """The tokens without comments and blanks; line ends only with `keep_lines`."""
    out, line, begin = [], 1, 0
    for k, m in enumerate(_pattern(comments, strings, names).finditer(text)):
        if not k & 4095:
            check(until)
        kind, (start, end) = m.lastgroup, m.span()
        if kind != "comment" and (kind != "line" or keep_lines):
            out.append(Token(kind, m.group(), start, end, line, start - begin + 1))
        if kind in _LONG and (passed := text.count("\n", start, end)):
            line, begin = line + passed, text.rfind("\n", start, end) + 1
    return out


def partners(tokens: list[Token], pairs: str = "(){}[]") -> list[int]:
    """For each bracket its partner's index; -1 for other tokens and unbalanced brackets."""
    close = {pairs[k + 1]: pairs[k] for k in range(0, len(pairs), 2)}
    out, stack = [-1] * len(tokens), []
    for k, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in close.values():
            stack.append(k)
        elif t.text in close:
            while stack and tokens[stack[-1]].text != close[t.text]:
                stack.pop()
            if stack:
                out[k] = stack.pop()
                out[out[k]] = k
    return out
