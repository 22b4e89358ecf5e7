"""The command line: `python -m wovengraph.cli COMMAND ...`."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from wovengraph import render
from wovengraph.api import Graph, shown_cypher
from wovengraph.operators.lookup import Ambiguous, QueryError
from wovengraph.operators.store import StoreError
from wovengraph.operators.vectors import NotEmbedded, embedder_named
from wovengraph.plans.cypher import CypherError
from wovengraph.sources import registry


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("wovengraph").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wovengraph", description="A code-intelligence graph on Spark.")
    p.add_argument("-d", "--db", default="graph.db", help="folder of the stored graph")
    p.add_argument("--embedder", default="wovengraph.operators.vectors:hashed_features", help="module:function from texts to a matrix")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str, **kw) -> argparse.ArgumentParser:
        return sub.add_parser(name, aliases=list(aliases), **kw)

    c = command("index", help="index a source tree")
    c.add_argument("path")
    c.add_argument("--rebuild", action="store_true")
    c.add_argument("--no-register", action="store_true")
    c.add_argument("--force", action="store_true")
    c = command("query", help="run a Cypher statement")
    c.add_argument("text")
    for name in ("callers", "callees"):
        c = command(name)
        c.add_argument("symbol")
        c.add_argument("--exact", action="store_true")
        c.add_argument("--format", default="table")
        if name == "callers":
            c.add_argument("--depth", type=int, default=1)
    c = command("dependencies", "deps")
    c.add_argument("file")
    c.add_argument("--exact", action="store_true")
    c.add_argument("--format", default="table")
    c = command("context")
    c.add_argument("--symbol")
    c.add_argument("--file")
    c.add_argument("-z", "--fuzzy", action="store_true")
    c.add_argument("--format", default="markdown")
    c = command("impact", "blast-radius")
    c.add_argument("symbol")
    c.add_argument("--top", type=int, default=50)
    c.add_argument("--max-depth", type=int)
    c.add_argument("--format", default="markdown")
    for name, top in (("rank", 10), ("dead-code", 50)):
        c = command(name)
        c.add_argument("--top", type=int, default=top)
        c.add_argument("--kind")
        c.add_argument("--format", default="table")
    c = command("similar")
    c.add_argument("text")
    c.add_argument("-k", "--limit", type=int, default=5)
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--format", default="table")
    c = command("embed")
    c.add_argument("--batch-size", type=int, default=256)
    c.add_argument("--index", action="store_true", help="build the vector index that similar then reads")
    command("repl")
    c = command("watch")
    c.add_argument("path")
    c.add_argument("--debounce", type=int, default=2)
    c = command("mcp")
    c.add_argument("--timeout", type=float, default=30)
    c.add_argument("--status", action="store_true")
    return p


def run(args: argparse.Namespace, graph: Graph, write: Callable[[str], None] = print) -> int:
    name = {"deps": "dependencies", "blast-radius": "impact"}.get(args.command, args.command)
    if name == "index":
        report = graph.index(args.path, args.rebuild)
        write(f"{report.written} written ({report.bytes} bytes), {report.unchanged} unchanged, {report.removed} removed")
        if not args.no_register:
            root = os.path.abspath(args.path)
            known = registry.Registry.load()
            known.register(registry.Entry(os.path.basename(root), root, os.path.abspath(args.db), registry.now(), registry.git_head(root) or ""), args.force)
            known.save()
        for f in report.failed:
            write(f"failed: {f}")
        return 1 if report.failed else 0
    if name == "query":
        write(shown_cypher(graph.cypher(args.text)))
    elif name in ("callers", "callees"):
        target, found = graph.call_graph(args.symbol, name, args.exact, getattr(args, "depth", 1))
        columns = render.IMPACT_COLUMNS if getattr(args, "depth", 1) > 1 else {c: p for c, p in render.CALL_COLUMNS.items() if name == "callers" or c != "call_site_line"}
        write(render.rows(args.format, name.capitalize(), name, columns, found, target))
    elif name == "dependencies":
        target, found = graph.dependencies(args.file, args.exact)
        write(render.rows(args.format, "Dependencies", "dependencies", {"direction": None, "path": None}, found, target))
    elif name == "context":
        write(render.context(args.format, graph.context(args.symbol, args.file, args.fuzzy)))
    elif name == "impact":
        render.parse_format(args.format, ("json", "markdown"))
        target, n, found = graph.impact(args.symbol, args.top, args.max_depth)
        if n > 1:
            print(f"{n} symbols match; this is {target}", file=sys.stderr)
        write(render.rows(args.format, "Impact", "impacted", render.IMPACT_COLUMNS, found, target))
    elif name == "rank":
        write(render.rows(args.format, "Rank", "symbols", render.RANK_COLUMNS, graph.rank(args.top, args.kind)))
    elif name == "dead-code":
        found = graph.dead_code(args.top, args.kind)
        write(render.rows(args.format, "Dead code", "rows", render.DEAD_COLUMNS, found["rows"], None, {"count": found["count"], "excluded": found["excluded"]}))
    elif name == "similar":
        write(render.rows(args.format, "Similar", "chunks", render.SIMILAR_COLUMNS, graph.similar(args.text, args.limit, args.threshold), args.text))
    elif name == "embed":
        write(f"{graph.embed(args.batch_size, args.index)} chunks embedded")
    elif name == "repl":
        from wovengraph.repl import loop

        loop(graph)
    elif name == "watch":
        from wovengraph.streaming.watch import poll

        graph.index(args.path)
        poll(graph.store, os.path.abspath(args.path), graph.store.folder, args.debounce)
    elif name == "mcp":
        from wovengraph import server

        if args.status:
            write(server.status())
        else:
            server.serve(graph.spark, args.timeout)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, Graph(session(), args.db, embedder_named(args.embedder)))
    except Ambiguous as e:
        print(e, file=sys.stderr)
        for c in e.candidates:
            print(f"  {c['name']}  {c['file']}:{c['line']}", file=sys.stderr)
    except (QueryError, StoreError, NotEmbedded, CypherError, registry.RegistryError, ValueError) as e:
        print(e, file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
