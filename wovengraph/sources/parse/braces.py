"""Declarations, calls and imports of languages whose bodies are in braces."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from wovengraph.functions.imports import expand_use
from wovengraph.sources.parse.model import Analysis, check
from wovengraph.sources.parse.tokens import Token, partners, tokenize

_CONTROL = frozenset("if for while switch catch match when guard return throw sizeof typeof in is as else do try until unless elif synchronized using lock await yield case not and or assert defer delete instanceof foreach new typealias".split())


@dataclass(frozen=True)
class Rules:
    """What tells a language's declarations and calls."""

    functions: str = ""  # keyword before a function's name
    types: dict[str, str] = field(default_factory=dict)  # keyword -> kind
    modifiers: frozenset[str] = frozenset()
    bare_methods: bool = False  # members without keyword: name(...) {
    bare_functions: bool = False  # functions without keyword anywhere outside callables
    closures: str = ""  # which anonymous callables there are
    members: str = ". ?. -> ?->"
    trailing_closures: bool = False
    names: str = r"[^\W\d]\w*"
    strings: str = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''
    comments: str = r"//[^\n]*|/\*.*?\*/"
    extra: str = ""
    name: str = ""


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


_TICKS = r'|`(?:\\.|[^`\\])*`'
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'"
LANGUAGES: dict[str, Rules] = {
    "rs": Rules("fn", {"struct": "Struct", "enum": "Enum", "trait": "Interface", "impl": "Implementation"}, _set("pub async unsafe const extern default"), closures="pipes", strings=r'r#*"(?:.*?)"#*|b?' + _DOUBLE + r"|b?'(?:\\[^']+|[^'\\])'", names=r"'?[^\W\d]\w*", extra="$:", name="rust"),
    "js jsx ts tsx": Rules("function", {"class": "Class", "interface": "Interface"}, _set("async static get set public private protected readonly abstract override"), bare_methods=True, closures="arrow function", strings=_DOUBLE + "|" + _SINGLE + _TICKS, names=r"[#$]?[^\W\d][\w$]*|\$[\w$]*", extra="$:", name="js"),
    "go": Rules("func", {}, closures="function", strings=_DOUBLE + r"|`[^`]*`|'(?:\\.|[^'\\])+'", name="go"),
    "c h": Rules("", {"struct": "Struct"}, bare_functions=True, name="c"),
    "cpp cc cxx hpp": Rules("", {"class": "Class", "struct": "Struct", "namespace": "Namespace"}, bare_functions=True, bare_methods=True, closures="capture", strings=r'R"\w*\(.*?\)\w*"|' + _DOUBLE + "|" + _SINGLE, name="cpp"),
    "java": Rules("", {"class": "Class", "interface": "Interface"}, bare_methods=True, closures="thin", strings=r'""".*?"""|' + _DOUBLE + "|" + _SINGLE, name="java"),
    "kt kts": Rules("fun", {"class": "Class", "object": "Class", "interface": "Interface"}, closures="braces", trailing_closures=True, strings=r'""".*?"""|' + _DOUBLE + "|" + _SINGLE, name="kotlin"),
    "php": Rules("function", {"class": "Class", "interface": "Interface", "trait": "Trait"}, _set("public private protected static abstract final readonly"), closures="function fn", members="-> ?-> ::", comments=r"//[^\n]*|/\*.*?\*/|#(?!\[)[^\n]*", names=r"\$?[^\W\d][\w\\]*|\\[^\W\d][\w\\]*", name="php"),
    "swift": Rules("func", {"class": "Class", "struct": "Struct", "enum": "Enum", "protocol": "Protocol", "extension": "Extension"}, closures="braces", trailing_closures=True, strings=r'""".*?"""|' + _DOUBLE, name="swift"),
}
_METHOD_OWNERS = {"rust": (), "go": (), "kotlin": ("Class", "Interface"), "php": ("Class", "Interface", "Trait"), "swift": ("*",), "js": ()}


class Scanner:
    """One file; `run` gives its analysis."""

    def __init__(self, path: str, text: str, rules: Rules, until: float) -> None:
        self.out, self.text, self.rules, self.until = Analysis(path), text, rules, until
        self.tokens = tokenize(text, until, rules.comments, rules.strings, rules.names)
        self.pair = partners(self.tokens)
        self.kinds: dict[str, str] = {}

    def run(self) -> Analysis:
        # An explicit stack, so deep nesting can't exhaust Python's.
        self.todo: list[tuple[int, int, str | None, str | None]] = [(0, len(self.tokens), None, None)]
        while self.todo:
            self.walk(*self.todo.pop())
        self.out.calls.sort(key=lambda c: c[2])  # bodies are scanned after what surrounds them
        return self.out

    # Reading tokens

    def at(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "name"

    def after_generics(self, k: int) -> int:
        """The index after `<...>` if one stands at k."""
        if self.at(k) != "<":
            return k
        depth, j = 0, k
        while j < len(self.tokens) and j < k + 400:
            t = self.at(j)
            depth += (t == "<") + 2 * (t == "<<") - (t == ">") if t not in ("->", "=>") else 0
            if depth <= 0:
                return j + 1
            if t in (";", "{", "}", "&&", "||"):
                return k
            j = self.pair[j] + 1 if t in ("(", "[") and self.pair[j] > j else j + 1
        return k

    def body(self, k: int, end: int) -> tuple[int, int]:
        """(open, close) of the first body brace from k on; (j, j) at a `;` before, or a line that ends it."""
        while k < end:
            t = self.at(k)
            if t == "{":
                return k, self.pair[k] if self.pair[k] > k else end
            if t in (";", "}"):
                return k, k
            k = self.pair[k] + 1 if t in ("(", "[") and self.pair[k] > k else k + 1
        return end, end

    def expression(self, k: int, end: int) -> int:
        """The index after the expression at k: a block, or up to a separator."""
        if self.at(k) == "{":
            return (self.pair[k] if self.pair[k] > k else end) + 1
        begin = k
        while k < end and self.at(k) not in (",", ";", ")", "]", "}"):
            k = self.pair[k] + 1 if self.at(k) in ("(", "[", "{") and self.pair[k] > k else k + 1
            if self.rules.name in ("kotlin", "swift", "js") and k < end and k > begin and self.tokens[k].line > self.tokens[k - 1].line and self.tokens[k].kind == "name":
                break
        return k

    def signature(self, k: int) -> str:
        start = self.tokens[k].start
        stop = self.text.find("\n", start)
        return self.text[start : stop if stop >= 0 else len(self.text)].strip()

    def declare(self, parent: str | None, name: str, kind: str, first: int, last: int) -> str:
        start, end = self.tokens[first], self.tokens[min(last, len(self.tokens) - 1)]
        made = self.out.declare(parent, name, kind, (start.line, start.column), end.line + end.text.count("\n"), self.signature(first))
        self.kinds[made] = kind
        return made

    def begins(self, k: int, statement: int) -> int:
        """Where a declaration with its keyword at k begins, modifiers included."""
        if not self.rules.modifiers:
            return statement
        while k > statement and (self.at(k - 1) in self.rules.modifiers or self.at(k - 1) == ")" and self.at(self.pair[k - 1] - 1) == "pub" or self.tokens[k - 1].kind == "string" and self.at(k - 2) == "extern"):
            k = self.pair[k - 1] if self.at(k - 1) == ")" else k - 1
        return k

    # Scanning

    def walk(self, k: int, end: int, parent: str | None, owner: str | None) -> None:
        statement = k
        while k < end:
            if not k & 1023:
                check(self.until)
            t = self.tokens[k]
            if self.rules.name == "go" and t.text in ("import", "type") and owner is None or self.rules.name != "go" and t.kind == "name":
                if (to := self.imports(k, end, statement)) is not None:
                    k = statement = to
                    continue
            found = self.declaration(k, end, statement, parent, owner) if t.kind == "name" else None
            if found is None:
                found = self.closure(k, end, parent, owner)
            if found is not None:
                k = found
                if self.at(k - 1) in ("}", ";"):
                    statement = k
                continue
            if t.kind == "name":
                k = self.call(k, end, owner)
                continue
            k += 1
            if t.text in (";", "{", "}"):
                statement = k
            elif self.rules.name == "java" and t.text == ")" and self.at(self.pair[k - 1] - 2 if self.pair[k - 1] > 1 else 0) == "@":
                statement = k

    def enter(self, first: int, begin: int, end: int, made: str, owner: str | None) -> None:
        self.todo.append((begin, end, made, owner))

    def member(self, parent: str | None) -> bool:
        return parent is not None and self.kinds.get(parent) in ("Class", "Struct", "Interface", "Trait", "Enum", "Protocol", "Extension", "Implementation")

    def declaration(self, k: int, end: int, statement: int, parent: str | None, owner: str | None) -> int | None:
        """If a declaration stands at k: record it, leave its body for later, and the index after it."""
        r, word, before = self.rules, self.at(k), self.at(k - 1)
        if before in (".", "?.", "->", "::") and r.name != "cpp":
            return None
        if word == r.functions and r.functions:
            return self.function(k, end, statement, parent, owner)
        if r.name == "go":
            return None
        if word in r.types and not (word == "class" and before in (":", "enum") and r.name in ("swift",)):
            return self.type(k, end, statement, parent, owner)
        if self.at(k + 1) == "(" or self.at(k + 1) in ("<", "::") and r.name in ("cpp", "js"):
            if r.bare_methods and self.member(parent) and owner is None or r.bare_functions and owner is None:
                return self.bare(k, end, statement, parent)
        elif r.name == "js" and self.at(k + 1) == "(":
            return None
        return None

    def function(self, k: int, end: int, statement: int, parent: str | None, owner: str | None) -> int | None:
        r, j = self.rules, k + 1
        if self.at(j) in ("*", "&"):
            j += 1
        receiver = None
        if r.name == "go":
            if self.at(j) == "(" and self.is_name(self.pair[j] + 1) and self.at(self.pair[j] + 2) in ("(", "[") and owner is None and statement == k:
                receiver, j = j, self.pair[j] + 1
            if not self.is_name(j) or self.at(j + 1) not in ("(", "["):
                return None
        if r.name == "kotlin":
            j = self.after_generics(j)
            while self.is_name(j) and (self.at(self.after_generics(j + 1)) in (".", "?.")):
                j = self.after_generics(j + 1) + 1
        if r.name == "js" and self.at(k - 1) in ("=", "(", ",", ":", "return", "=>", "?", "&&", "||", "!", "[", "default", "new", "await", "+", "??"):
            if self.at(k - 1) != "default" or not self.is_name(j):
                return None
        if not self.is_name(j) and not (r.name == "swift" and self.tokens[j].kind == "mark" and self.at(j) not in ("(", "{")):
            return None
        name = self.at(j)
        a, b = self.body(self.after_generics(j + 1), end)
        if r.name == "kotlin":
            params = self.after_generics(j + 1)
            stop = self.pair[params] + 1 if self.at(params) == "(" and self.pair[params] > params else params
            while stop < end and self.at(stop) not in ("{", "=", ";", "}") and self.tokens[stop].line == self.tokens[stop - 1].line:
                stop = self.after_generics(stop + 1)
            if self.at(stop) == "=":
                a, b = stop, self.expression(stop + 1, end)
            elif self.at(stop) != "{":
                a = b = stop - 1
        if r.name in ("swift", "js") and self.at(a) == "{":  # a declaration without a body ends with its line
            params = self.after_generics(j + 1)
            stop = self.pair[params] + 1 if self.at(params) == "(" and self.pair[params] > params else params
            while stop < a and not (self.is_name(stop) and self.at(stop) in ("func", "function", "var", "let", "class", "init")):
                stop = self.pair[stop] + 1 if self.at(stop) in ("(", "[") and self.pair[stop] > stop else stop + 1
            if stop < a:
                a = b = stop - 1
        owners = _METHOD_OWNERS[r.name]
        kind = "Method" if receiver is not None or owners == ("*",) and parent or parent and self.kinds.get(parent) in owners else "Function"
        made = self.declare(parent, name, kind, self.begins(k, statement), min(b, end - 1))
        self.todo.append((self.after_generics(j + 1), a, parent, owner))  # the header belongs outside
        if b > a:
            self.enter(k, a + 1, b, made, made)
        return max(b, a, k) + (0 if r.name == "kotlin" and self.at(a) == "=" else 1)

    def type(self, k: int, end: int, statement: int, parent: str | None, owner: str | None) -> int | None:
        r, word = self.rules, self.at(k)
        kind, j = r.types[word], k + 1
        if word == "object" and self.at(j) in (":", "{") or word in ("class", "interface") and (self.at(k - 1) in ("::", ".", "@")):
            if self.at(k - 1) in ("::", ".", "@") and not (word == "interface" and self.at(k - 1) == "@"):
                return None
            if word == "object":
                return None
        a, b = self.body(j, end)
        if r.name in ("kotlin", "swift") and self.at(a) == "{":
            stop = j
            while stop < a and not (stop > j and self.tokens[stop].line > self.tokens[stop - 1].line and self.at(stop) not in (":", ",", "where") and self.at(stop - 1) not in (":", ",", "(")):
                stop = self.pair[stop] + 1 if self.at(stop) in ("(", "[") and self.pair[stop] > stop else stop + 1
            if stop < a:
                a = b = stop - 1
        if r.name == "rust" and word == "impl":
            head = self.after_generics(j)
            stop = next((x for x in range(head, a) if self.at(x) == "where"), a)
            if self.at(k - 1) in (":", "->", "(", ",", "&", "<", "=", "+"):  # impl Trait in a type
                return None
            name = "impl " + re.sub(r"\s+", " ", self.text[self.tokens[head].start : self.tokens[stop - 1].end]).strip() if stop > head else "impl Type"
        elif self.is_name(j) and self.at(j) not in ("extends", "implements"):
            name = self.at(j)
        else:
            return None
        if r.name in ("c", "cpp") and (self.at(a) != "{" or any(self.at(x) in ("(", "=", "*", "&") for x in range(j, a))):
            return None  # a use of the type, not its definition
        if r.name == "rust" and self.at(a) == ";" and word == "struct":
            b = a
        if r.name == "swift" and word == "extension":
            name = self.at(j)
        begin = k if r.name in ("js", "php", "c", "cpp") and not (r.name == "php" and self.at(k - 1) in ("abstract", "final", "readonly")) else self.begins(k, statement)
        made = self.declare(parent, name, kind, begin, min(b, end - 1))
        if r.name == "java":
            self.last_type = name
        self.todo.append((j + 1, a, made, owner))
        if b > a:
            self.enter(k, a + 1, b, made, None)
        return max(a, b) + 1

    def bare(self, k: int, end: int, statement: int, parent: str | None) -> int | None:
        """A function or member without a keyword: name(...) and then a body."""
        r, name = self.rules, self.at(k)
        if name in _CONTROL or name in ("function", "super", "this", "operator"):
            return None
        opening = k + 1 if self.at(k + 1) == "(" else self.after_generics(k + 1)
        if self.at(opening) != "(" or self.pair[opening] < 0:
            return None
        head = [self.at(x) for x in range(statement, k)]
        if r.name != "js" and any(x in ("=", "return", "new", "throw", "(") and not (x == "(" and "@" in head) for x in head):
            return None
        close = self.pair[opening]
        if r.name == "js":
            if self.at(k - 1) in (".", "?.", "=", "(", ",", "return", "new", "await", "=>", "&&", "||", "!", "@") and self.at(k - 1) != ",":
                return None
            a = close + 1
            if self.at(a) == ":":
                a += 1
                while a < end and self.at(a) not in ("{", ";", "}"):
                    a = self.pair[a] + 1 if self.at(a) in ("(", "[") and self.pair[a] > a else a + 1
            if self.at(a) != "{":
                return None
            b = self.pair[a] if self.pair[a] > a else end
            begin = self.begins(k, statement)
            made = self.declare(parent, name, "Method", begin, min(b, end - 1))
            self.todo.append((opening, a, parent, None))
            self.enter(k, a + 1, b, made, made)
            return b + 1
        a, b = self.body(close + 1, end)
        if r.name == "java":
            if a == b and self.at(a) != ";":
                return None
            kind = "Constructor" if not head or self.at(k - 1) in ("public", "private", "protected") or self.at(k - 1) in (";", "{", "}") else "Method"
            if kind == "Method" and not (self.is_name(k - 1) or self.at(k - 1) in (">", "]")):
                return None
            made = self.declare(parent, name, kind, statement, min(b, end - 1))
            self.todo.append((opening, a, parent, None))
            if b > a:
                self.enter(k, a + 1, b, made, made)
            return max(a, b) + 1
        # C and C++: only definitions are symbols.
        if a == b or any(self.at(x) in ("=", ",") and self.at(x + 1) != "default" for x in range(close + 1, a) if self.at(close + 1) != ":"):
            return None
        if name.isupper() and not head:
            return None
        begin = statement
        while self.at(begin) in ("public", "private", "protected") and self.at(begin + 1) == ":":
            begin += 2
        above, kind = parent, "Method" if parent and self.kinds.get(parent) in ("Class", "Struct") else "Function"
        if self.at(k - 1) == "::" and self.is_name(k - 2):
            above = f"{self.out.path}::{self.at(k - 2)}"
        if self.at(k - 1) == "~":
            name = f"~{name}"
        made = self.declare(above, name, kind, begin, min(b, end - 1))
        self.todo.append((opening, a, parent, None))
        self.enter(k, a + 1, b, made, made)
        return b + 1

    def closure(self, k: int, end: int, parent: str | None, owner: str | None) -> int | None:
        """If an anonymous callable's body begins at or after k: leave it for later, unowned."""
        kinds, t, before = self.rules.closures.split(), self.at(k), self.at(k - 1)
        begin = None
        if "pipes" in kinds and t in ("|", "||") and (before in ("(", ",", "=", "return", "move", "{", ";", "=>", "") or before == "}" ):
            stop = k if t == "||" else next((x for x in range(k + 1, end) if self.at(x) == "|"), None)
            if stop is not None:
                begin = stop + 1
                if self.at(begin) == "->":
                    begin = self.body(begin, end)[0]
        elif "arrow" in kinds and t == "=>" or "thin" in kinds and t == "->" and self.rules.name == "java":
            begin = k + 1
        elif ("function" in kinds and t in ("function", "func") or "fn" in kinds and t == "fn") and before not in (".", "->", "::"):
            j = k + 1
            while j < end and self.at(j) != "(":
                j += 1
            if j < end and self.pair[j] > j:
                self.todo.append((j, self.pair[j], parent, owner))
                if t == "fn":
                    begin = next((x + 1 for x in range(self.pair[j], end) if self.at(x) == "=>"), None)
                else:
                    begin = self.body(self.pair[j] + 1, end)[0]
        elif "capture" in kinds and t == "[" and self.pair[k] > k and not (self.is_name(k - 1) or before in (")", "]")):
            j = self.pair[k] + 1
            if self.at(j) == "(" and self.pair[j] > j:
                j = self.pair[j] + 1
            a, b = self.body(j, min(end, j + 30))
            if b > a and self.at(a) == "{":
                begin = a
        elif "braces" in kinds and t == "{" and self.pair[k] > k and self._is_closure(k):
            begin = k
        if begin is None or begin >= end:
            return None
        stop = self.expression(begin, end)
        if self.at(begin) == "{":
            self.todo.append((begin + 1, stop - 1, parent, None))
        else:
            self.todo.append((begin, stop, parent, None))
        return max(stop, k + 1)

    def _is_closure(self, k: int) -> bool:
        """Whether the brace at k opens a lambda rather than a block."""
        before = self.at(k - 1)
        if before in ("=", "(", ",", "return", "->", "?:", "in", ":"):
            return True
        line = self.tokens[k - 1].line
        j = k - 1
        while j >= 0 and self.tokens[j].line == line and self.at(j) not in (";", "{", "}"):
            if self.at(j) in ("if", "else", "for", "while", "when", "switch", "guard", "do", "try", "catch", "finally", "repeat", "init", "get", "set", "defer", "deinit", "subscript", "willSet", "didSet"):
                return False
            j = self.pair[j] - 1 if self.at(j) in (")", "]") and self.pair[j] >= 0 else j - 1
        if self.at(j + 1) in ("var", "val", "let") and "=" not in [self.at(x) for x in range(j + 1, k)]:
            return False
        return before == ")" or self.is_name(k - 1) and before not in _CONTROL

    def call(self, k: int, end: int, owner: str | None) -> int:
        """Record the call whose callee's name stands at k, if one does; the next index."""
        r, name, before = self.rules, self.at(k), self.at(k - 1)
        if r.name == "rust" and self.at(k + 1) == "!" and self.at(k + 2) in ("(", "[", "{"):
            return self.pair[k + 2] + 1 if self.pair[k + 2] > k else k + 3  # a macro's tokens are no calls
        j = k + 1
        if r.name == "rust" and self.at(j) == "::" and self.at(j + 1) == "<":
            j = self.after_generics(j + 1)
        elif self.at(j) == "<" and r.name in ("cpp", "js", "java", "kotlin", "swift"):
            j = self.after_generics(j)
        if r.name == "js" and self.at(j) == "?." and self.at(j + 1) == "(":
            j += 1
        trailing = r.trailing_closures and self.at(j) == "{" and name not in _CONTROL and j == k + 1 and self._is_closure(j) and before not in ("class", "object", "struct", "enum", "protocol", "extension", "interface", "func", "fun", ":", "var", "val", "let")
        if self.at(j) == "(" and r.trailing_closures and self.tokens[j].line != self.tokens[j - 1].line:
            return k + 1
        if (self.at(j) == "(" or trailing) and name not in _CONTROL and before not in ("new", "fn", "func", "fun", "function", "@", "#") and not name.startswith("$"):
            member = before in r.members.split() or before == "::" and r.name == "kotlin"
            if before == "::" and r.name != "php" and r.name != "kotlin":
                member = False
            plain = name.rsplit("\\", 1)[-1]
            skip = plain in ("require", "import", "super") and r.name in ("js", "rust") or plain in ("require", "require_once", "include", "include_once", "isset", "empty", "array", "list", "echo", "exit", "unset") and r.name == "php"
            if r.name == "java" and plain in ("this", "super"):
                skip = True
            if not skip:
                self.out.call(owner, plain, self.tokens[k].line, member, r.extra)
        return k + 1

    # Imports

    def imports(self, k: int, end: int, statement: int) -> int | None:
        """If an import stands at k: record it, and the index after it."""
        name, word, line = self.rules.name, self.at(k), self.tokens[k].line
        add = self.out.imports.append
        if name == "rust" and word == "use" and self.at(k - 1) not in (".", "::"):
            stop = next((x for x in range(k, end) if self.at(x) == ";"), end)
            if stop > k + 1:
                text = re.sub(r"\s+", " ", "".join(f" {self.at(x)} " if self.at(x) == "as" else self.at(x) for x in range(k + 1, stop)))
                for p in expand_use(text):
                    add((p, line))
            return stop + 1
        if name == "js" and word in ("import", "export") and self.at(k + 1) != "(" and self.at(k - 1) != ".":
            if word == "import" and k + 1 < end and self.tokens[k + 1].kind == "string":
                add((self.at(k + 1)[1:-1], line))
                return k + 2
            for x in range(k + 1, min(end, k + 2000)):
                if self.at(x) == "from" and x + 1 < end and self.tokens[x + 1].kind == "string":
                    add((self.at(x + 1)[1:-1], line))
                    return x + 2
                if self.at(x) in (";", "=", "(") or word == "export" and self.at(x) in ("function", "class", "const", "let", "var", "interface", "default", "async", "enum", "abstract"):
                    break
            return None
        if name == "js" and word == "require" and self.at(k + 1) == "(" and k + 2 < end and self.tokens[k + 2].kind == "string":
            add((self.at(k + 2)[1:-1], line))
            return None
        if name == "go" and word == "import":
            last = self.pair[k + 1] if self.at(k + 1) == "(" and self.pair[k + 1] > k else k + 3
            for x in range(k + 1, min(last, end)):
                if self.tokens[x].kind == "string":
                    add((self.at(x)[1:-1], self.tokens[x].line))
            return min(last + (self.at(k + 1) == "("), end) if self.at(k + 1) == "(" else next((x + 1 for x in range(k, min(k + 3, end)) if self.tokens[x].kind == "string"), k + 1)
        if name == "go" and word == "type":
            return self.go_types(k, end)
        if name in ("c", "cpp") and word == "include" and self.at(k - 1) == "#":
            if k + 1 < end and self.tokens[k + 1].kind == "string":
                add((self.at(k + 1)[1:-1], line))
                return k + 2
            if self.at(k + 1) == "<":
                stop = next((x for x in range(k, min(end, k + 60)) if self.at(x) == ">"), k + 1)
                add((self.text[self.tokens[k + 1].end : self.tokens[stop].start], line))
                return stop + 1
        if name in ("java", "kotlin", "swift") and word == "import" and statement_start(self, k):
            x = k + 1
            while x < end and self.at(x) != ";" and self.tokens[x].line == line:
                x += 1
            parts = [self.at(y) for y in range(k + 1, x)]
            if name == "java" and parts[:1] == ["static"]:
                parts = parts[1:]
            if "as" in parts:
                parts = parts[: parts.index("as")]
            if parts:
                add(("".join(parts) if name != "swift" else parts[-1] if len(parts) > 1 and parts[0] in ("class", "struct", "func", "enum") else "".join(parts), line))
            return x + (self.at(x) == ";")
        if name == "php" and word == "use" and self.at(k - 1) != ")" and not self.at(k + 1) == "(":
            stop = next((x for x in range(k, end) if self.at(x) in (";", "{")), end)
            base = "".join(self.at(x) for x in range(k + 1, stop) if self.at(x) not in ("function", "const")) if stop < end else ""
            for p in base.split(","):
                if p:
                    add((p.split("as")[0] if " as " in self.text[self.tokens[k].start : self.tokens[min(stop, end - 1)].start] else p, line))
            return stop + 1
        if name == "php" and word in ("require", "require_once", "include", "include_once"):
            x = k + 1 + (self.at(k + 1) == "(")
            if x < end and self.tokens[x].kind == "string":
                add((self.at(x)[1:-1], line))
        return None

    def go_types(self, k: int, end: int) -> int:
        """Struct and interface types of a Go type declaration."""
        last = self.pair[k + 1] if self.at(k + 1) == "(" and self.pair[k + 1] > k else end
        x = k + 1 + (self.at(k + 1) == "(")
        while x < last and self.is_name(x):
            first = x
            y = self.pair[x + 1] + 1 if self.at(x + 1) == "[" and self.pair[x + 1] > x and self.is_name(self.pair[x + 1] + 1) else x + 1
            if self.at(y) in ("struct", "interface") and self.at(y + 1) == "{" and self.pair[y + 1] > y:
                made = self.declare(None, self.at(first), self.at(y).capitalize(), first, self.pair[y + 1])
                self.todo.append((y + 2, self.pair[y + 1], made, None)) if self.at(y) == "struct" else None
                x = self.pair[y + 1] + 1
            else:
                line = self.tokens[x].line
                while x < last and self.tokens[x].line == line:
                    x += 1
            if self.at(k + 1) != "(":
                return max(x, k + 1)
        return max(x + 1 if last < end else x, k + 1)


def statement_start(scanner: Scanner, k: int) -> bool:
    """Whether the token at k begins its line or follows a `;`."""
    return k == 0 or scanner.tokens[k - 1].line < scanner.tokens[k].line or scanner.at(k - 1) in (";", "{", "}")


__all__ = ["LANGUAGES", "Rules", "Scanner", "Token"]
