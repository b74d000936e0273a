"""What programs use: imported modules and built-in names, from their syntax trees. Nothing is run."""

from __future__ import annotations

import ast
import builtins
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.corpus import line_count, percentiles, top_counts

BUILTINS = frozenset(n for n in dir(builtins) if n[0] != "_")


def _stored(tree: ast.AST) -> Iterator[str]:
    """Names that a program binds itself."""
    for node in ast.walk(tree):
        match node:
            case ast.Name(ctx=ast.Store()) | ast.Name(ctx=ast.Del()):
                yield node.id
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                yield node.name
            case ast.ExceptHandler(name=str(name)):
                yield name
            case ast.arg():
                yield node.arg
            case ast.Global() | ast.Nonlocal():
                yield from node.names
            case ast.alias():
                yield (node.asname or node.name).partition(".")[0]


def _roots(tree: ast.AST) -> Iterator[str]:
    for node in ast.walk(tree):
        match node:
            case ast.Import():
                yield from (a.name.partition(".")[0] for a in node.names)
            case ast.ImportFrom(module=str(module), level=0):
                yield module.partition(".")[0]


def _loaded(tree: ast.AST) -> Iterator[str]:
    for node in ast.walk(tree):
        match node:
            case ast.Name(id=name, ctx=ast.Load()):
                yield name


def uses(program: str | None) -> tuple[list[str], list[str]] | None:
    """(module roots, built-in names loaded) with repeats, or None for what does not parse."""
    if program is None:
        return None
    with warnings.catch_warnings(action="ignore"):
        try:
            tree = ast.parse(program)
        except (MemoryError, RecursionError, SyntaxError, ValueError):
            return None
    own = set(_stored(tree))
    return list(_roots(tree)), [name for name in _loaded(tree) if name in BUILTINS - own]


def imports_and_builtins(program: Column) -> Column:
    """struct<modules, builtins>; null for what does not parse. Syntax trees need Python, hence Arrow."""

    @F.pandas_udf("modules array<string>, builtins array<string>, parsed boolean")
    def run(programs: pd.Series) -> pd.DataFrame:
        found = [uses(p) for p in programs]
        return pd.DataFrame({"modules": [f[0] if f else [] for f in found], "builtins": [f[1] if f else [] for f in found], "parsed": [f is not None for f in found]})

    out = run(program)
    return F.when(out["parsed"], F.struct(out["modules"].alias("modules"), out["builtins"].alias("builtins")))


def profile_uses(entries: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Frames of the most frequent modules and built-ins (entries that use them), of lines, and of entries unparsed."""
    used = entries.select("id", line_count(F.col("program")).alias("lines"), imports_and_builtins(F.col("program")).alias("u"))

    def ranked(field: str) -> DataFrame:
        names = used.select("id", F.explode(F.array_distinct(f"u.{field}")).alias("name"))
        return top_counts(names, "name", top)

    return {
        "modules": ranked("modules"),
        "builtins": ranked("builtins"),
        "lines": percentiles(used, "lines", {"median": 0.5, "p90": 0.9, "longest": 1.0}),
        "unparsed": used.agg(F.count_if(F.col("u").isNull()).alias("unparsed")),
    }


def registered_modules(source: Column) -> Column:
    """Names of the modules that a C source registers, sorted."""
    found = F.regexp_extract_all(source, F.lit(r"MP_REGISTER_(?:EXTENSIBLE_)?MODULE\s*\(\s*MP_QSTR_(\w+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, "^_+", ""))))
