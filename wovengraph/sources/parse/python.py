"""Python, by its own syntax tree."""

from __future__ import annotations

import ast

from wovengraph.sources.parse.model import Analysis, check


class _Visitor(ast.NodeVisitor):
    def __init__(self, path: str, text: str, until: float) -> None:
        self.out, self.lines, self.until = Analysis(path), text.splitlines(), until
        self.parent: str | None = None
        self.kind = ""
        self.owner: str | None = None

    def visit(self, node: ast.AST) -> None:
        check(self.until)
        super().visit(node)

    def _all(self, nodes: list[ast.AST | None]) -> None:
        for n in nodes:
            if n is not None:
                self.visit(n)

    def _declare(self, node: ast.AST, kind: str, body_owner: bool) -> None:
        line = self.lines[node.lineno - 1]
        column = len(line.encode()[: node.col_offset].decode()) if line.isascii() else node.col_offset
        made = self.out.declare(self.parent, node.name, kind, (node.lineno, column + 1), node.end_lineno, line[column:].strip())
        before = self.parent, self.kind, self.owner
        self.parent, self.kind, self.owner = made, kind, made if body_owner else None
        self._all(node.body)
        self.parent, self.kind, self.owner = before

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._all([*node.decorator_list, *node.bases, *(k.value for k in node.keywords)])
        self._declare(node, "Class", False)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]
        self._all([*node.decorator_list, *a.defaults, *a.kw_defaults, *(x.annotation for x in every), node.returns])
        self._declare(node, "Method" if self.kind == "Class" else "Function", True)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self._all([*node.args.defaults, *node.args.kw_defaults])
        before, self.owner = self.owner, None
        self.visit(node.body)
        self.owner = before

    def visit_Import(self, node: ast.Import) -> None:
        self.out.imports += [(a.name, node.lineno) for a in node.names if not a.asname]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.out.imports.append((module, node.lineno))
        self.out.imports += [(f"{module}::{a.name}", node.lineno) for a in node.names if a.name != "*"]

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Attribute):
            self.out.call(self.owner, node.func.attr, node.lineno, True)
        elif isinstance(node.func, ast.Name):
            self.out.call(self.owner, node.func.id, node.lineno, False)
        self.generic_visit(node)


def parse(path: str, text: str, until: float) -> Analysis:
    v = _Visitor(path, text, until)
    v.visit(ast.parse(text))
    return v.out
