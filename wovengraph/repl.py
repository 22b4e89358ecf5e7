"""The interactive shell: dot-commands, anything else is Cypher."""

from __future__ import annotations

from collections.abc import Callable

from wovengraph import render
from wovengraph.api import Graph, shown_cypher
from wovengraph.operators.lookup import NotFound

HELP = """.callers SYMBOL   who calls it
.callees SYMBOL   what it calls
.deps FILE        what it imports and who imports it
.context NAME     all about a symbol or file
.exit, .quit      leave
Anything else is run as Cypher."""


def command(graph: Graph, line: str, write: Callable[[str], None] = print) -> bool:
    """Run one line; False to leave.  Errors are shown and don't end the shell."""
    line = line.strip()
    if not line:
        return True
    word, _, rest = line.partition(" ")
    rest = rest.strip()
    try:
        if word in (".exit", ".quit"):
            return False
        if word == ".help":
            write(HELP)
        elif word in (".callers", ".callees"):
            target, found = graph.call_graph(rest, word[1:], exact=True)
            write(render.rows("table", word[1:], word[1:], {c: None for c in ("id", "kind", "signature")}, found, target))
        elif word == ".deps":
            target, found = graph.dependencies(rest, exact=True)
            write(render.rows("table", "deps", "deps", {"direction": None, "path": None}, found, target))
        elif word == ".context":
            try:
                found = graph.context(symbol=rest)
            except NotFound:
                found = graph.context(file=rest)
            write(render.context("markdown", found))
        elif word.startswith("."):
            write(f"no command {word}; try .help")
        else:
            write(shown_cypher(graph.cypher(line)))
    except Exception as e:  # a shell shows any error and goes on
        write(f"error: {e}")
    return True


def loop(graph: Graph) -> None:
    while True:
        try:
            line = input("graph> ")
        except (EOFError, KeyboardInterrupt):
            return
        if not command(graph, line):
            return
