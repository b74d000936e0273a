"""Which tier a program text goes to, found from the text alone: an operator over tables of programs."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.plans import compiler, programs
from lathe.plans.compiler import Unsupported

LADDER = ("column", "batch")
REFUSED = "refused"

#: Syntax that no tier runs, by the name of what it needs.
_NEEDS = {
    ast.ClassDef: "class", ast.AsyncFunctionDef: "async", ast.AsyncFor: "async", ast.AsyncWith: "async", ast.Await: "async", ast.Yield: "generator", ast.YieldFrom: "generator",
    ast.With: "context manager", ast.TryStar: "exception group", ast.Match: "match", ast.Import: "import", ast.ImportFrom: "import", ast.TypeAlias: "type alias",
}
_COLUMN = (
    ast.Module, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.If, ast.For, ast.FunctionDef, ast.Return, ast.Lambda, ast.arguments, ast.arg, ast.Assert, ast.Delete, ast.Del, ast.Pass,
)


def _detail(node: ast.AST) -> str:
    if isinstance(node, ast.Import):
        return node.names[0].name
    if isinstance(node, ast.ImportFrom):
        return f"{node.module or '.'} *" if node.names[0].name == "*" else node.module or "."
    return getattr(node, "name", None) or type(node).__name__


def route(text: str | None, names: frozenset[str] = frozenset()) -> tuple[str, str | None, str | None]:
    """(engine, kind, detail): the first tier to try, and of a refused program what it needs.

    ``names`` are the columns it may use. What is said to go to columns may still
    turn out to need batches once the columns' types are known, never the reverse.
    """
    try:
        tree = ast.parse(text or "")
        compile(text or "", "<program>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return REFUSED, "syntax", getattr(e, "msg", None) or str(e)
    for node in ast.walk(tree):
        if type(node) in _NEEDS:
            return REFUSED, _NEEDS[type(node)], _detail(node)
        if isinstance(node, ast.FunctionDef) and node.decorator_list:
            return REFUSED, "decorator", ast.unparse(node.decorator_list[0])
        if isinstance(node, ast.Constant) and node.value is ...:
            return REFUSED, "ellipsis", "..."
        if isinstance(node, ast.comprehension) and node.is_async:
            return REFUSED, "async", "comprehension"
    try:
        programs._check(tree, set(names), {"input", "getenv"})
    except Unsupported as e:
        return REFUSED, e.kind, e.detail
    plain = all(isinstance(n, (*_COLUMN, *compiler._ALLOWED)) and not isinstance(n, (ast.Set, ast.Dict, ast.SetComp, ast.DictComp, ast.GeneratorExp)) for n in ast.walk(tree))
    plain = plain and not any(isinstance(n, ast.Name) and n.id in ("print", "input", "getenv", "iter", "next", "map", "filter") for n in ast.walk(tree))
    return (LADDER[0] if plain else LADDER[1]), None, None


def classify(program: Column, *names: str) -> Column:
    """struct<engine, kind, detail> of each program; the parser is Python's own, hence Arrow."""
    known = frozenset(names)

    @F.arrow_udf("engine string, kind string, detail string")
    def run(texts: pa.Array) -> pa.Array:
        rows = [route(t, known) for t in texts.to_pylist()]
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, names=["engine", "kind", "detail"])

    return run(program)
