"""Parsers: a file's text to symbols, containment, imports and calls.

Python files go through the standard library's syntax tree.  The other languages share a
tokenizer and a scanner of declarations, bodies and calls with per-language rules; no grammar
is available here, so unusual constructs may be missed, and a file that can't be read gives
an empty analysis rather than an error.  Every parser records a call under the nearest
enclosing named callable's body; default values and headers belong outside it, and the bodies
of anonymous callables and of classes belong to nothing."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cache

from wovengraph.sources.parse.model import Analysis, Expired

#: Seconds that parsing one file may take.
BUDGET = 10.0


@cache
def _by_extension() -> dict[str, Callable[[str, str, float], Analysis]]:
    from wovengraph.sources.parse import braces, python, ruby

    found: dict[str, Callable[[str, str, float], Analysis]] = {"py": python.parse, "rb": ruby.parse}
    for extensions, rules in braces.LANGUAGES.items():
        for e in extensions.split():
            found[e] = lambda path, text, until, rules=rules: braces.Scanner(path, text, rules, until).run()
    return found


def parse_file(path: str, text: str, budget: float = BUDGET) -> Analysis:
    """The analysis of one file; empty for other extensions, on errors and past the budget."""
    name = path.rsplit("/", 1)[-1]
    parser = _by_extension().get(name.rsplit(".", 1)[-1] if "." in name[1:] else "")
    if parser is None:
        return Analysis(path)
    try:
        return parser(path, text, time.monotonic() + budget)
    except (Expired, SyntaxError, ValueError, RecursionError, MemoryError):
        return Analysis(path)
