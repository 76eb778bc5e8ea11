"""Functions and control flow of Python by its own parser."""

from __future__ import annotations

import ast

from codestrata.parse.braces import Function, Node, cut

_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _walk(node: ast.AST, depth: int, out: list[Node]) -> None:
    if isinstance(node, ast.If):
        _branch(node, depth, out)
        return
    inner = depth
    if isinstance(node, (*_LOOPS, ast.ExceptHandler, ast.IfExp, ast.Match, ast.match_case)):
        out.append(("Loop" if isinstance(node, _LOOPS) else "Branch", depth))
        inner = depth + 1
    elif isinstance(node, (ast.Try, ast.TryStar)):
        out.append(("Nesting", depth))
        inner = depth + 1
    elif isinstance(node, ast.BoolOp):
        out.extend([("Operator", depth)] * (len(node.values) - 1))
    for child in ast.iter_child_nodes(node):
        _walk(child, inner, out)


def _branch(node: ast.If, depth: int, out: list[Node]) -> None:
    """An if with its elif clauses, which lie side by side one level deeper."""
    out.append(("Branch", depth))
    clause, level = node, depth + 1
    while True:
        for part in (clause.test, *clause.body):
            _walk(part, level, out)
        rest = clause.orelse
        if len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
            clause, level = rest[0], depth + 2
            out.append(("Branch", depth + 1))
            continue
        for part in rest:
            _walk(part, depth + 1, out)
        return


def _params(args: ast.arguments) -> int:
    named = [*args.posonlyargs, *args.args, *args.kwonlyargs, *[a for a in (args.vararg, args.kwarg) if a]]
    return sum(a.arg not in ("self", "cls") for a in named)


def functions(text: str) -> list[Function]:
    """Functions and lambdas in the order of the text; raises SyntaxError for what isn't Python."""
    out = []
    tree = ast.parse(text)
    lines = text.splitlines()
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))]
    for node in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
        nodes: list[Node] = []
        body = node.body if isinstance(node.body, list) else [node.body]
        for part in body:
            _walk(part, 0, nodes)
        name = "<lambda>" if isinstance(node, ast.Lambda) else node.name
        snippet = "\n".join(lines[body[0].lineno - 1 : body[-1].end_lineno])
        out.append(Function(name, node.lineno, node.end_lineno or node.lineno, _params(node.args), 0, cut(snippet), nodes))
    return out
