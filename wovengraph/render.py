"""Text, Markdown and JSON for the answers that people and tools read."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

FORMATS = ("table", "markdown", "json")


def parse_format(name: str, allowed: Iterable[str] = FORMATS) -> str:
    if name not in allowed:
        raise ValueError(f"format {name!r}: use one of {', '.join(allowed)}")
    return name


def cell(value: Any, places: int | None = None) -> str:
    """One value: a dash for a missing score, fixed places for numbers, line ends escaped."""
    if value is None:
        return "—" if places is not None else ""
    if places is not None:
        return f"{value:.{places}f}"
    return str(value).replace("\n", "\\n").replace("\r", "\\r")


def table(headers: list[str], rows: list[list[str]]) -> str:
    """A ruled table; columns are as wide as their longest cell in bytes."""
    width = [max(len(x.encode()) for x in column) for column in zip(headers, *rows, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda row: "|" + "|".join(f" {x}{' ' * (w - len(x.encode()))} " for x, w in zip(row, width, strict=True)) + "|"
    return "\n".join([rule, line(headers), rule, *([*map(line, rows), rule] if rows else [])])


def _escaped(text: str) -> str:
    return text.replace("|", "\\|")


def rows(kind: str, title: str, key: str, columns: dict[str, int | None], found: list[dict], target: str | None = None, extra: dict | None = None) -> str:
    """A list of rows in one of the three formats; `columns` names them with their number of places."""
    parse_format(kind)
    if kind == "json":
        head = {"target": target} if target is not None else {}
        return json.dumps(head | (extra or {}) | {key: [{c: r.get(c) for c in columns} for r in found]}, indent=2, ensure_ascii=False)
    cells = [[cell(r.get(c), p) for c, p in columns.items()] for r in found]
    if kind == "table":
        return table(list(columns), cells)
    out = [f"## {title}" + (f": `{target}`" if target is not None else ""), ""]
    if not found:
        return "\n".join([*out, "None."])
    out += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*out, *("| " + " | ".join(map(_escaped, r)) + " |" for r in cells)])


CALL_COLUMNS = {"id": None, "name": None, "kind": None, "signature": None, "call_site_line": None}
RANK_COLUMNS = {"rank": None, "id": None, "name": None, "kind": None, "file": None, "pagerank": 4}
IMPACT_COLUMNS = {"rank": None, "id": None, "name": None, "kind": None, "file": None, "depth": None, "pagerank": 4}
DEAD_COLUMNS = {"id": None, "name": None, "kind": None, "file": None, "start_line": None, "pagerank": 4}
SIMILAR_COLUMNS = {"score": 2, "file": None, "symbol": None, "line": None, "text": None}
_FENCES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "go": "go", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp"}


def context(kind: str, found: dict) -> str:
    """All about a symbol or file; there is no table form."""
    parse_format(kind, ("json", "markdown"))
    if kind == "json":
        return json.dumps(found, indent=2, ensure_ascii=False, default=str)
    row = found.get("symbol") or found["file"]
    if "symbol" in found:
        out = [f"# {row['kind']} `{row['id']}`", "", f"Lines {row['start_line']} to {row['end_line']}", ""]
        if found.get("source"):
            ext = row["id"].split("::")[0].rsplit(".", 1)[-1]
            out += [f"```{_FENCES.get(ext, '')}", found["source"], "```", ""]
        lists = (("Callers", "callers", "id"), ("Callees", "callees", "id"))
    else:
        out = [f"# File `{row['path']}`", ""]
        lists = (("Imports", "imports", "path"), ("Imported by", "imported_by", "path"), ("Symbols", "symbols", "id"))
    for title, key, shown in lists:
        out += [f"## {title}", "", *([f"- `{r[shown]}`" for r in found[key]] or ["None."]), ""]
    return "\n".join(out).rstrip()
