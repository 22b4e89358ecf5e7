"""A Model Context Protocol server over standard input and output (JSON-RPC, a line a message)."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import asdict
from typing import Any

from pyspark.sql import SparkSession

from wovengraph.api import Graph
from wovengraph.operators.lookup import Ambiguous, InvalidInput, NotFound, QueryError
from wovengraph.operators.vectors import NotEmbedded
from wovengraph.plans.cypher import CypherError
from wovengraph.sources import registry

PREFIX, PROTOCOL = "graph", "2024-11-05"
_INVALID, _MISSING, _INTERNAL = -32602, -32601, -32603


class Tools:
    """The tools by name; each takes the arguments of a call."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tools: dict[str, tuple[str, dict[str, str], list[str], Callable[[Graph, dict], Any]]] = {}
        add = self.register
        add("cypher", "Run a read-only Cypher statement", {"query": "string"}, ["query"], self._cypher)
        add("callers", "Callers of a symbol, of one step or up to `depth`", {"symbol": "string", "exact": "boolean", "depth": "integer"}, ["symbol"], lambda g, a: self._calls(g, a, "callers"))
        add("callees", "What a symbol calls", {"symbol": "string", "exact": "boolean"}, ["symbol"], lambda g, a: self._calls(g, a, "callees"))
        add("deps", "Imports and importers of a file", {"file": "string", "exact": "boolean"}, ["file"], lambda g, a: dict(zip(("target", "dependencies"), g.dependencies(a["file"], a.get("exact", False)), strict=True)))
        add("context", "All about one symbol or one file", {"symbol": "string", "file": "string", "fuzzy": "boolean"}, [], lambda g, a: g.context(a.get("symbol"), a.get("file"), a.get("fuzzy", False)))
        add("query", "Chunks similar to a text", {"text": "string", "limit": "integer", "threshold": "number"}, ["text"], lambda g, a: g.similar(a["text"], a.get("limit", 10), a.get("threshold", 0.5)))
        add("impact", "What a change of a symbol reaches", {"symbol": "string", "top": "integer", "max_depth": "integer"}, ["symbol"], lambda g, a: dict(zip(("target", "matches", "impacted"), g.impact(a["symbol"], a.get("top"), a.get("max_depth")), strict=True)))
        add("rank", "Best scored symbols", {"top": "integer", "kind": "string"}, [], lambda g, a: g.rank(a.get("top", 25), a.get("kind")))
        add("dead_code", "Functions that nothing calls", {"top": "integer", "kind": "string"}, [], lambda g, a: g.dead_code(a.get("top", 100), a.get("kind")))

    def register(self, name: str, about: str, fields: dict[str, str], required: list[str], run: Callable[[Graph, dict], Any]) -> None:
        if f"{PREFIX}_{name}" in self.tools:
            raise ValueError(f"{name} is registered already")
        self.tools[f"{PREFIX}_{name}"] = (about, fields, required, run)

    @staticmethod
    def _cypher(graph: Graph, args: dict) -> list[dict]:
        return [{k: None if v is None else str(v) for k, v in r.asDict(recursive=True).items()} for r in graph.cypher(args["query"]).limit(10_000).collect()]

    @staticmethod
    def _calls(graph: Graph, args: dict, direction: str) -> dict:
        target, found = graph.call_graph(args["symbol"], direction, args.get("exact", False), args.get("depth", 1) if direction == "callers" else 1)
        return {"target": target, direction: found}

    def list(self) -> list[dict]:
        out = []
        for name, (about, fields, required, _) in sorted(self.tools.items()):
            properties = {k: {"type": t} for k, t in fields.items()} | {"repo": {"type": "string"}}
            out.append({"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": required}, "annotations": {"readOnlyHint": True}})
        return out

    def call(self, name: str, args: dict) -> Any:
        if name not in self.tools:
            raise InvalidInput(f"no tool {name}")
        _, fields, required, run = self.tools[name]
        types = {"string": str, "boolean": bool, "integer": int, "number": (int, float)}
        for k in required:
            if k not in args:
                raise InvalidInput(f"{k} is missing")
        for k, v in args.items():
            if k in fields and not isinstance(v, types[fields[k]]):
                raise InvalidInput(f"{k} must be of type {fields[k]}")
        return run(Graph(self.spark, database(args.get("repo"))), args)


def database(repo: str | None) -> str:
    """The stored graph of a registered repository, else that of the working folder."""
    if repo is None:
        return os.path.abspath("graph.db")
    entry = registry.Registry.load().by_name(repo)
    if entry is None:
        raise InvalidInput(f"no repository {repo} is registered")
    return entry.db_path


def repos() -> list[dict]:
    return [asdict(e) | {"stale": registry.is_stale(e)} for e in registry.Registry.load().entries]


def repo_status(spark: SparkSession, name: str) -> dict:
    entry = registry.Registry.load().by_name(name)
    if entry is None:
        raise InvalidInput(f"no repository {name} is registered")
    head = registry.git_head(entry.path) or ""
    return asdict(entry) | {"head": head, "stale": registry.is_stale(entry)} | Graph(spark, entry.db_path).counts()


def status() -> str:
    """A line for each registered repository."""
    return "\n".join(f"{e.name}  {e.path}  {e.indexed_commit[:8]}{'  stale' if registry.is_stale(e) else ''}" for e in registry.Registry.load().entries) or "no repository is registered"


class Server:
    def __init__(self, spark: SparkSession, timeout: float = 30) -> None:
        self.spark, self.timeout, self.tools = spark, timeout, Tools(spark)
        self.pool = ThreadPoolExecutor(4)

    def _tool(self, params: dict) -> dict:
        def bad(text: str) -> dict:
            return {"content": [{"type": "text", "text": text}], "isError": True}

        group = f"call-{id(params)}"

        def work() -> Any:
            self.spark.sparkContext.setJobGroup(group, str(params.get("name")), True)
            return self.tools.call(params.get("name", ""), params.get("arguments") or {})

        future = self.pool.submit(work)
        try:
            found = future.result(self.timeout)
        except Late:
            self.spark.sparkContext.cancelJobGroup(group)
            return bad(f"stopped after {self.timeout:g} s")
        except Ambiguous as e:
            return bad(json.dumps({"error": str(e), "candidates": e.candidates}))
        except NotFound as e:
            return bad(json.dumps({"error": str(e), "suggestions": e.suggestions}))
        except (QueryError, NotEmbedded, CypherError) as e:
            return bad(str(e))
        return {"content": [{"type": "text", "text": json.dumps(found, default=str, ensure_ascii=False)}]}

    def handle(self, message: dict) -> dict | None:
        """The answer to one message; None for a notification."""
        method, params = message.get("method", ""), message.get("params") or {}
        if "id" not in message:
            return None
        try:
            if method == "initialize":
                result: Any = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "wovengraph", "version": "0.1.0"}}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": self.tools.list()}
            elif method == "tools/call":
                result = self._tool(params)
            elif method == "resources/list":
                result = {"resources": [{"uri": f"{PREFIX}://repos", "name": "repos", "mimeType": "application/json"}]}
            elif method == "resources/templates/list":
                result = {"resourceTemplates": [{"uriTemplate": f"{PREFIX}://repo/{{name}}/status", "name": "status", "mimeType": "application/json"}]}
            elif method == "resources/read":
                uri = params.get("uri", "")
                if uri == f"{PREFIX}://repos":
                    found: Any = repos()
                elif uri.startswith(f"{PREFIX}://repo/") and uri.endswith("/status"):
                    found = repo_status(self.spark, uri[len(PREFIX) + 8 : -7])
                else:
                    raise InvalidInput(f"no resource {uri}")
                result = {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(found)}]}
            else:
                return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": _MISSING, "message": f"no method {method}"}}
        except (InvalidInput, registry.RegistryError) as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": _INVALID, "message": str(e)}}
        except Exception as e:  # the server answers any failure and goes on
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": _INTERNAL, "message": str(e)[:500]}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(spark: SparkSession, timeout: float = 30) -> None:
    server = Server(spark, timeout)
    for line in sys.stdin:
        if line.strip():
            answer = server.handle(json.loads(line))
            if answer is not None:
                print(json.dumps(answer), flush=True)
