"""Compile a Python program over columns: statements, functions and exceptions.

Tiers as for expressions. Straight-line programs, branches, loops over literal
lists or ranges, and functions and lambdas without recursion become one native
Column by symbolic execution: names stand for columns, a branch merges what both
sides assign, a loop is unrolled, a call is inlined, an assertion guards the
result. All else that is on the closed list runs on Arrow batches, with a bound
on steps; what is not on it is refused before anything runs.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructField, StructType

from lathe.plans import compiler
from lathe.plans.compiler import ARROW, NATIVE, Plan, Typed, Unsupported, _Native, _NotNative

#: Steps that a row's program may take: rounds of loops and calls of functions.
MAX_STEPS = 1_000_000
#: A native loop has at most so many rounds.
MAX_UNROLLED = 64
#: Calls within calls that are inlined.
MAX_INLINED = 16

_ERRORS = {
    e.__name__: e
    for e in (
        Exception, ArithmeticError, AssertionError, AttributeError, IndexError, KeyError, LookupError, NameError, NotImplementedError, OverflowError,
        RecursionError, RuntimeError, StopIteration, TypeError, UnicodeError, ValueError, ZeroDivisionError,
    )
}


class StatisticsError(ValueError):
    """What statistics of no data raise."""


class JSONDecodeError(ValueError):
    """A JSON text's fault, with its place."""


_BUILTINS = {**compiler._BUILTINS, **_ERRORS, "StatisticsError": StatisticsError, "JSONDecodeError": JSONDecodeError, "iter": iter, "next": next, "map": map,
             "filter": filter, "pow": pow, "format": format, "isinstance": isinstance, "bytes": bytes, "frozenset": frozenset, "print": print}
_METHODS = compiler._STR_METHODS | set(
    "append extend insert pop remove index count reverse sort clear copy get keys values items setdefault popitem update add discard union intersection "
    "difference symmetric_difference issubset issuperset partition rpartition encode decode hex expandtabs args is_integer bit_length".split()
)
_STATEMENTS = (
    ast.Module, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.If, ast.While, ast.For, ast.Break, ast.Continue, ast.Pass, ast.Expr, ast.FunctionDef, ast.Return, ast.Lambda,
    ast.arguments, ast.arg, ast.Try, ast.ExceptHandler, ast.Raise, ast.Assert, ast.Delete, ast.Del, ast.Global, ast.Nonlocal, ast.Starred, ast.NamedExpr,
)


class _TooManySteps(BaseException):
    """Not an Exception, so no handler of the program catches it."""


def _check(tree: ast.Module, columns: set[str], extra: set[str]) -> None:
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)}
    bound |= {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ExceptHandler)) and n.name}
    bound |= {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    known = columns | bound | set(_BUILTINS) | extra
    for node in ast.walk(tree):
        if not isinstance(node, (*compiler._ALLOWED, *_STATEMENTS)):
            raise Unsupported("syntax", type(node).__name__)
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id not in known:
            raise Unsupported("name", node.id)
        if isinstance(node, ast.Name) and node.id.startswith("__") or isinstance(node, ast.arg) and node.arg.startswith("__"):
            raise Unsupported("name", "names with two underscores")
        if isinstance(node, ast.Attribute) and node.attr not in _METHODS:
            raise Unsupported("method", node.attr)
        if isinstance(node, ast.FunctionDef) and node.decorator_list:
            raise Unsupported("syntax", "decorator")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.MatMult):
            raise Unsupported("operator", "@")


# the native tier


@dataclass
class _Function:
    args: list[str]
    defaults: dict[str, ast.expr]
    body: list[ast.stmt] | ast.expr
    scope: dict[str, object]


def _stored(nodes: list[ast.AST]) -> dict[str, int]:
    """How often names are bound, by assignments, loops, functions and deletions; within loops twice."""
    out: dict[str, int] = {}

    def walk(node: ast.AST, times: int) -> None:
        if isinstance(node, (ast.For, ast.While)):
            times = 2
        if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            out[node.id] = out.get(node.id, 0) + times
        if isinstance(node, ast.FunctionDef):
            out[node.name] = out.get(node.name, 0) + times
        for child in ast.iter_child_nodes(node):
            walk(child, times)

    for node in nodes:
        walk(node, 1)
    return out


@dataclass
class _State:
    """Names, whether the program is still running where this state holds, the value returned, and guards."""

    names: dict[str, object]
    #: Names that are bound more than once, or besides a column: functions see their last value, not the one at hand.
    moving: frozenset[str]
    path: Column | None = None
    returned: Typed | None = None
    live: bool = True
    guards: list[tuple[Column, str]] = field(default_factory=list)


class _Symbolic(_Native):
    """Expressions over names that may stand for functions, with calls inlined."""

    def __init__(self, state: _State, depth: int = 0) -> None:
        super().__init__({k: v for k, v in state.names.items() if isinstance(v, Typed)})
        self.state, self.depth = state, depth

    def _Call(self, node: ast.Call) -> Typed:
        f = node.func
        target = self.state.names.get(f.id) if isinstance(f, ast.Name) else self.function(f) if isinstance(f, ast.Lambda) else None
        if not isinstance(target, _Function):
            return super()._Call(node)
        if self.depth >= MAX_INLINED or any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords):
            raise _NotNative
        given = dict(zip(target.args, (self.visit(a) for a in node.args)))
        given |= {k.arg: self.visit(k.value) for k in node.keywords}
        if len(node.args) > len(target.args) or not set(given) <= set(target.args):
            raise _NotNative
        body = [target.body] if isinstance(target.body, ast.expr) else target.body
        own = _stored(body)
        # a name that the function binds is its own from the start
        inner = _State({k: v for k, v in target.scope.items() if k not in own}, self.state.moving, self.state.path)
        for name in target.args:
            if name not in given:
                if name not in target.defaults:
                    raise _NotNative
                given[name] = _Symbolic(_State(target.scope, self.state.moving)).visit(target.defaults[name])
        inner.names.update(given)
        if isinstance(target.body, ast.expr):
            return _Symbolic(inner, self.depth + 1).visit(target.body)
        _run(target.body, inner, self.depth + 1)
        self.state.guards += inner.guards
        if inner.returned is None or inner.live:
            raise _NotNative  # None is no value of a column's type
        return inner.returned

    def function(self, node: ast.FunctionDef | ast.Lambda) -> _Function:
        a = node.args
        if a.vararg or a.kwarg or a.kwonlyargs or a.posonlyargs:
            raise _NotNative
        names = [x.arg for x in a.args]
        body = [node.body] if isinstance(node.body, ast.expr) else node.body
        seen = {n.id for x in body for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
        if (seen - set(names) - set(_stored(body))) & self.state.moving:
            raise _NotNative
        return _Function(names, dict(zip(names[len(names) - len(a.defaults) :], a.defaults)), node.body, dict(self.state.names))


def _merge(test: Column, yes: object, no: object) -> object:
    if yes is no:
        return yes
    if not isinstance(yes, Typed) or not isinstance(no, Typed) or yes.type != no.type:
        raise _NotNative
    return Typed(F.when(test, yes.column).otherwise(no.column), yes.type)


def _literal_items(node: ast.expr) -> list[ast.expr]:
    """The items that a loop goes through, if they stand in the text."""
    if isinstance(node, (ast.List, ast.Tuple)):
        items = list(node.elts)
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "range" and not node.keywords:
        items = [ast.Constant(k) for k in range(*[compiler._literal(a, int) for a in node.args])]
    else:
        raise _NotNative
    if len(items) > MAX_UNROLLED or any(isinstance(x, ast.Starred) for x in items):
        raise _NotNative
    return items


def _run(body: list[ast.stmt], state: _State, depth: int = 0) -> None:
    """Execute statements; what follows a conditional return runs where none was made."""
    for k, node in enumerate(body):
        see = _Symbolic(state, depth)
        if isinstance(node, ast.Pass) or isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant):
            continue
        if isinstance(node, ast.FunctionDef):
            made = see.function(node)
            state.names[node.name] = made
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if len(targets) == 1 and isinstance(targets[0], ast.Name) and isinstance(node.value, ast.Lambda):
                state.names[targets[0].id] = see.function(node.value)
                continue
            if node.value is None:
                continue
            for target in targets:
                _assign(target, node.value, see)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            state.names[node.target.id] = see.visit(ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value))
        elif isinstance(node, ast.Assert):
            test = see._truth(see.visit(node.test))
            text = compiler._literal(node.msg, str) if node.msg is not None else ""
            ok = test if state.path is None else ~state.path | test
            state.guards.append((ok, f"AssertionError: {text}" if text else "AssertionError"))
        elif isinstance(node, ast.If):
            test = F.coalesce(see._truth(see.visit(node.test)), F.lit(False))
            sides = []
            for branch, here in ((node.body, test), (node.orelse, ~test)):
                side = _State(dict(state.names), state.moving, here if state.path is None else state.path & here)
                _run(branch, side, depth)
                sides.append(side)
                state.guards += side.guards
            yes, no = sides
            if yes.live and no.live:
                if yes.returned is not None or no.returned is not None:
                    raise _NotNative
                state.names = {n: _merge(test, yes.names[n], no.names[n]) for n in yes.names if n in no.names}
                continue
            # one side returns: the rest of the body runs for the other only
            if not yes.live and not no.live:
                state.returned, state.live = _merge(test, yes.returned, no.returned), False
                return
            going, gone = (yes, no) if yes.live else (no, yes)
            _run(body[k + 1 :], going, depth)
            state.guards += going.guards
            if going.live or going.returned is None:
                raise _NotNative
            pair = (going.returned, gone.returned) if yes.live else (gone.returned, going.returned)
            state.returned, state.live = _merge(test, *pair), False
            return
        elif isinstance(node, ast.For):
            if any(isinstance(x, (ast.Break, ast.Continue, ast.Return)) for s in node.body for x in ast.walk(s)):
                raise _NotNative
            for item in _literal_items(node.iter):
                _assign(node.target, item, _Symbolic(state, depth))
                _run(node.body, state, depth)
            _run(node.orelse, state, depth)
        elif isinstance(node, ast.Return) and depth and node.value is not None:
            state.returned, state.live = see.visit(node.value), False
            return
        elif isinstance(node, ast.Delete) and all(isinstance(t, ast.Name) for t in node.targets):
            for target in node.targets:
                if state.names.pop(target.id, None) is None:
                    raise _NotNative
        else:
            raise _NotNative


def _assign(target: ast.expr, value: ast.expr, see: _Symbolic) -> None:
    if isinstance(target, ast.Name):
        see.state.names[target.id] = see.visit(value)
        return
    if not isinstance(target, (ast.Tuple, ast.List)) or not isinstance(value, (ast.Tuple, ast.List)) or any(not isinstance(t, ast.Name) for t in target.elts):
        raise _NotNative
    if len(target.elts) != len(value.elts):
        raise _NotNative
    values = [see.visit(v) for v in value.elts]  # all before the first name changes
    for t, v in zip(target.elts, values):
        see.state.names[t.id] = v


# the Arrow tier


class _Counted(ast.NodeTransformer):
    """Counts a step in every round of a loop and every call of a function."""

    @staticmethod
    def _step() -> ast.stmt:
        return ast.Expr(ast.Call(ast.Name("__step__", ast.Load()), [], []))

    def _counted(self, node: ast.stmt) -> ast.stmt:
        self.generic_visit(node)
        node.body.insert(0, self._step())
        return node

    visit_For = visit_While = visit_FunctionDef = _counted

    def visit_comprehension(self, node: ast.comprehension) -> ast.comprehension:
        self.generic_visit(node)
        node.ifs.insert(0, ast.Call(ast.Name("__step__", ast.Load()), [], []))
        return node


def _outcome(code, names: dict[str, object], result: str, stdin: str | None, environment: Mapping[str, str]) -> tuple[object, str | None]:
    """(value, error) of one run; the error as Python shows it."""
    steps, printed = 0, []
    lines: Iterator[str] = iter((stdin or "").splitlines())

    def step() -> bool:
        nonlocal steps
        steps += 1
        if steps > MAX_STEPS:
            raise _TooManySteps
        return True

    def write(*values: object, sep: str = " ", end: str = "\n") -> None:
        printed.append(sep.join(map(str, values)) + end)

    def read(prompt: str = "") -> str:
        printed.append(prompt)
        line = next(lines, None)
        if line is None:
            raise EOFError("EOF when reading a line")
        return line

    scope = {"__builtins__": {**_BUILTINS, "__step__": step, "print": write, "input": read, "getenv": lambda name, default=None: environment.get(name, default)}, **names}
    try:
        exec(code, scope)
    except _TooManySteps:
        return None, f"steps: more than {MAX_STEPS}"
    except Exception as e:
        return None, f"{type(e).__name__}: {e}" if str(e) else type(e).__name__
    value = "".join(printed) if result == "stdout" else scope.get(result)
    return (sorted(value) if isinstance(value, (set, frozenset)) else value), None


def compile_program(
    text: str, df: DataFrame, returns: DataType | str | None = None, result: str = "result", errors: str = "raise", stdin: str | None = None, environment: Mapping[str, str] | None = None
) -> Plan:
    """Plan for a program over the frame's columns; its value is what the name ``result`` stands for at the end.

    ``result="stdout"`` gives the printed text. ``returns`` is the value's type
    where the program has no native form. An exception fails the job, or with
    ``errors="struct"`` the value is a struct<value, error>. ``stdin`` names a
    column that input() reads line by line; getenv() reads ``environment``.
    """
    try:
        tree = ast.parse(text)
        compile(text, "<program>", "exec")
    except (SyntaxError, ValueError, RecursionError) as e:
        raise Unsupported("syntax", str(e)) from e
    schema = {f.name: f.dataType for f in df.schema.fields}
    _check(tree, set(schema), {"input", "getenv"})
    if errors == "raise" and stdin is None and environment is None and result != "stdout":
        try:
            moving = frozenset(name for name, times in _stored(tree.body).items() if times > 1 or name in schema)
            state = _State({name: Typed(F.col(f"`{name}`"), kind) for name, kind in schema.items()}, moving)
            _run(tree.body, state)
            out = state.names.get(result)
            if isinstance(out, Typed):
                column = out.column
                for ok, message in reversed(state.guards):
                    column = F.when(ok, column).otherwise(F.raise_error(F.lit(message)).cast(out.type))
                return Plan(NATIVE, column, out.type)
        except _NotNative:
            pass
    if returns is None:
        raise Unsupported("type", "the result's type must be given for a program that is not native")
    kind = returns if isinstance(returns, DataType) else df.sparkSession.createDataFrame([], f"x {returns}").schema[0].dataType
    named = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} & set(schema)
    # as text, for code objects cannot be sent
    source = ast.unparse(ast.fix_missing_locations(_Counted().visit(tree)))
    used = sorted(named) or list(schema)[:1]
    reads = [*used, *([stdin] if stdin else [])]
    fields = StructType([StructField("value", kind), StructField("error", StringType())])
    as_arrow = to_arrow_type(fields)
    environment = dict(environment or {})

    @F.arrow_udf(fields)
    def run(*columns: pa.Array) -> pa.Array:
        compiled = compile(source, "<program>", "exec")
        out = []
        for row in zip(*[c.to_pylist() for c in columns]):
            value, error = _outcome(compiled, dict(zip(used, row)), result, row[-1] if stdin else None, environment)
            out.append({"value": value, "error": error})
        return pa.array(out, as_arrow)

    both = run(*[F.col(f"`{c}`") for c in reads])
    if errors == "struct":
        return Plan(ARROW, both, fields)
    failed = both["error"]
    return Plan(ARROW, F.when(failed.isNull(), both["value"]).otherwise(F.raise_error(failed).cast(kind)), kind)


def compile_function(text: str, df: DataFrame, *arguments: str, returns: DataType | str | None = None) -> Plan:
    """Plan for a function given as text, a ``def`` or a ``lambda``, called with these columns."""
    head = text.strip()
    if head.startswith("lambda"):
        return compile_program(f"f = {head}\nresult = f({', '.join(arguments)})", df, returns)
    try:
        made = ast.parse(head).body
    except SyntaxError as e:
        raise Unsupported("syntax", str(e)) from e
    if not made or not isinstance(made[-1], ast.FunctionDef):
        raise Unsupported("syntax", "a def or a lambda is wanted")
    return compile_program(f"{head}\nresult = {made[-1].name}({', '.join(arguments)})", df, returns)


def aggregate_function(text: str, df: DataFrame, value: str, *by: str, returns: str) -> DataFrame:
    """An aggregate given as text: a def or lambda from a group's list of values, in order, to one value.

    A group's values are gathered in one row, so this is for groups that fit a
    task; sums, counts and extremes have built-in forms that combine partially.
    """
    gathered = df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"))
    plan = compile_function(text, gathered, "values", returns=returns)
    return gathered.select(*by, plan.column.alias("value"))
