"""What a parser returns."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


class Expired(Exception):
    """The file's parsing time is used up."""


def check(until: float) -> None:
    if time.monotonic() > until:
        raise Expired


@dataclass
class Symbol:
    id: str
    name: str
    kind: str
    start_line: int
    start_col: int
    end_line: int
    signature: str


@dataclass
class Analysis:
    """Symbols in parse order, their CONTAINS pairs in the same order, imports (path, line) and calls
    (owner, name, line, is_method)."""

    path: str
    symbols: list[Symbol] = field(default_factory=list)
    contains: list[tuple[str, str]] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str | None, str, int, bool]] = field(default_factory=list)

    def declare(self, parent: str | None, name: str, kind: str, start: tuple[int, int], end_line: int, signature: str) -> str:
        """Add a symbol under `parent` (the file without one); its id."""
        above = parent or self.path
        made = f"{above}::{name}"
        self.symbols.append(Symbol(made, name, kind, *start, end_line, signature))
        self.contains.append((above, made))
        return made

    def call(self, owner: str | None, name: str, line: int, is_method: bool, extra: str = "") -> None:
        """Record a call if its name is letters, digits and underscores (or `extra`)."""
        if name and all(c.isalnum() or c == "_" or c in extra for c in name):
            self.calls.append((owner, name, line, is_method))
