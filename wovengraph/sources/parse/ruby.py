"""Ruby, by its keywords and `end`."""

from __future__ import annotations

from wovengraph.sources.parse.model import Analysis, check
from wovengraph.sources.parse.tokens import Token, tokenize

_OPENS = frozenset("class module def do begin case".split())
_MAYBE = frozenset("if unless while until for".split())  # openers at the start of a statement
_WORDS = _OPENS | _MAYBE | frozenset("end else elsif when then rescue ensure return yield super self nil true false and or not in alias undef defined? next break redo retry".split())


class _Scanner:
    def __init__(self, path: str, text: str, until: float) -> None:
        self.out, self.text, self.until = Analysis(path), text, until
        self.tokens = tokenize(text, until, comments=r"#[^\n]*|^=begin.*?^=end", names=r"@{0,2}[^\W\d]\w*[?!]?", keep_lines=True)

    def at(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def fresh(self, k: int) -> bool:
        """Whether a statement begins at k."""
        return k == 0 or self.at(k - 1) in ("\n", ";", "=", "(", "then", "do", "else", "{", "|", "return")

    def close(self, k: int) -> int:
        """The index of the `end` or brace that closes what opens at k."""
        stack = ["}" if self.at(k) == "{" else "end"]
        j, loop = k + 1, self.at(k) in ("while", "until", "for")
        while j < len(self.tokens):
            t = self.at(j)
            if t == "do" and loop:
                loop = False
            elif t in _OPENS and self.at(j - 1) not in (".", ":", "::"):
                stack.append("end")
            elif t in _MAYBE and self.fresh(j):
                stack.append("end")
                loop = t in ("while", "until", "for")
            elif t == "{":
                stack.append("}")
            elif t == stack[-1] and self.at(j - 1) != ".":
                stack.pop()
                if not stack:
                    return j
            j += 1
        return len(self.tokens) - 1

    def line_end(self, k: int) -> int:
        while k < len(self.tokens) and self.at(k) not in ("\n", ";"):
            k += 1
        return k

    def signature(self, t: Token) -> str:
        return self.text[t.start :].split("\n", 1)[0].strip()

    def walk(self, k: int, end: int, parent: str | None, owner: str | None) -> None:
        while k < end:
            if not k & 1023:
                check(self.until)
            t = self.tokens[k]
            if t.text in ("class", "module", "def") and self.at(k - 1) not in (".", ":") and t.kind == "name":
                k = self.declaration(k, end, parent, owner)
                continue
            if t.text == "do" or t.text == "{" and (self.at(k - 1) == ")" or k and self.tokens[k - 1].kind == "name" and self.at(k - 1) not in _WORDS or t.text == "{" and self.at(k - 1) in ("->", "lambda", "proc")):
                stop = min(self.close(k), end)
                self.walk(k + 1, stop, parent, None if not self._loop(k) else owner)
                k = stop + 1
                continue
            if t.kind == "name" and t.text in ("require", "require_relative", "load") and self.at(k - 1) != ".":
                j = k + 1 + (self.at(k + 1) == "(")
                if j < end and self.tokens[j].kind == "string":
                    self.out.imports.append((self.at(j)[1:-1], t.line))
                    k = j + 1
                    continue
            if t.kind == "name" and t.text not in _WORDS and not t.text.startswith("@"):
                member = self.at(k - 1) in (".", "?.", "&.") or self.at(k - 1) == "::" and self.at(k + 1) == "("
                args = self.at(k + 1) == "(" and k + 1 < end and self.tokens[k + 1].start == t.end
                spaced = k + 1 < end and (self.tokens[k + 1].kind in ("string", "number") or self.tokens[k + 1].kind == "name" and self.at(k + 1) not in _WORDS and self.fresh(k)) and self.at(k - 1) not in (":",)
                if member or args or spaced:
                    self.out.call(owner, t.text.rstrip("?!"), t.line, member)
            k += 1

    def _loop(self, k: int) -> bool:
        """Whether the `do` at k belongs to a while, until or for."""
        j = k
        while j > 0 and self.at(j - 1) not in ("\n", ";"):
            j -= 1
        return self.at(k) == "do" and self.at(j) in ("while", "until", "for")

    def declaration(self, k: int, end: int, parent: str | None, owner: str | None) -> int:
        word, j, t = self.at(k), k + 1, self.tokens[k]
        if word == "class" and self.at(j) == "<<":
            stop = self.close(k)
            self.walk(j + 2, min(stop, end), parent, None)
            return stop + 1
        name = self.at(j)
        if word == "def" and self.at(j + 1) in (".",):
            j += 2
            name = self.at(j)
        while word != "def" and self.at(j + 1) == "::":
            name += "::" + self.at(j + 2)
            j += 2
        kind = {"def": "Method", "class": "Class", "module": "Module"}[word]
        params = j + 1
        begin = params
        if word == "def" and self.at(params) == "(":
            depth = 0
            while begin < end:
                depth += (self.at(begin) == "(") - (self.at(begin) == ")")
                begin += 1
                if depth == 0:
                    break
        else:
            begin = self.line_end(params)
        short = word == "def" and self.at(begin) == "=" and self.at(params) in ("(", "=")
        stop = self.line_end(begin) if short else self.close(k)
        last = self.tokens[min(stop, len(self.tokens) - 1)]
        made = self.out.declare(parent, name, kind, (t.line, t.column), last.line, self.signature(t))
        self.walk(params, min(begin, end), parent, owner)
        self.walk(begin, min(stop, end), made, made if word == "def" else None)
        return stop + 1


def parse(path: str, text: str, until: float) -> Analysis:
    s = _Scanner(path, text, until)
    s.walk(0, len(s.tokens), None, None)
    return s.out
