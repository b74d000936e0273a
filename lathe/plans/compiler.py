"""Compile one Python expression over columns to the cheapest tier that is exact.

Tiers: native Column; a Python function on Arrow batches; refusal. The choice is
made from the text and the schema before anything runs, and the expression comes
from a closed list of operations: no attribute, import or name beyond it.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegralType, LongType, StringType

from lathe.functions import collections as py_list
from lathe.functions import formatting, numbers, strings

NATIVE, ARROW = "native", "arrow"


class Unsupported(Exception):
    """The expression is refused; nothing has run."""

    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


class _NotNative(Exception):
    """This node has no exact native form."""


@dataclass
class Typed:
    column: Column
    type: DataType


@dataclass
class Plan:
    tier: str
    column: Column
    type: DataType


_BUILTINS = {"abs": abs, "all": all, "any": any, "bool": bool, "float": float, "int": int, "len": len, "max": max, "min": min, "repr": repr, "round": round,
             "sorted": sorted, "str": str, "sum": sum, "ord": ord, "chr": chr, "hex": hex, "oct": oct, "bin": bin, "list": list, "enumerate": enumerate, "zip": zip,
             "range": range, "reversed": reversed, "divmod": divmod, "set": set, "tuple": tuple, "dict": dict}
_STR_METHODS = set(
    "upper lower strip lstrip rstrip title swapcase casefold capitalize split rsplit splitlines join replace startswith endswith find rfind index count "
    "removeprefix removesuffix ljust rjust center zfill isalpha isdigit isalnum isspace islower isupper isnumeric".split()
)
_ALLOWED = (
    ast.Expression, ast.Constant, ast.Name, ast.Load, ast.Store, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.keyword, ast.Attribute,
    ast.Subscript, ast.Slice, ast.List, ast.Tuple, ast.Set, ast.Dict, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.comprehension, ast.JoinedStr,
    ast.FormattedValue, ast.operator, ast.unaryop, ast.boolop, ast.cmpop,
)


def _check(tree: ast.AST, columns: set[str]) -> None:
    bound = {node.id for node in ast.walk(tree) if isinstance(node, ast.Name) and type(node.ctx) is ast.Store}
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise Unsupported("syntax", type(node).__name__)
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id not in columns | bound | set(_BUILTINS):
            raise Unsupported("name", node.id)
        if isinstance(node, ast.Attribute) and node.attr not in _STR_METHODS:
            raise Unsupported("method", node.attr)
        if isinstance(node, ast.Call) and not isinstance(node.func, (ast.Name, ast.Attribute)):
            raise Unsupported("call", ast.unparse(node.func))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.MatMult):
            raise Unsupported("operator", "@")


def _is_int(t: DataType) -> bool:
    return isinstance(t, IntegralType)


def _is_number(t: DataType) -> bool:
    return _is_int(t) or isinstance(t, DoubleType)


def _literal(node: ast.AST, kind: type | tuple[type, ...] = object):
    """The value of a constant, possibly negated."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        value = -node.operand.value
    elif isinstance(node, ast.Constant):
        value = node.value
    else:
        raise _NotNative
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        raise _NotNative
    return value


class _Native:
    def __init__(self, scope: dict[str, Typed]) -> None:
        self.scope = scope

    def visit(self, node: ast.AST) -> Typed:
        method = getattr(self, f"_{type(node).__name__}", None)
        if method is None:
            raise _NotNative
        return method(node)

    def _Expression(self, node: ast.Expression) -> Typed:
        return self.visit(node.body)

    def _Constant(self, node: ast.Constant) -> Typed:
        kinds = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType()}
        kind = kinds.get(type(node.value))
        if kind is None or isinstance(node.value, int) and abs(node.value) >= 1 << 63:
            raise _NotNative
        return Typed(F.lit(node.value).cast(kind), kind)

    def _Name(self, node: ast.Name) -> Typed:
        if node.id not in self.scope:
            raise _NotNative
        return self.scope[node.id]

    def _BinOp(self, node: ast.BinOp) -> Typed:
        a, b = self.visit(node.left), self.visit(node.right)
        op = type(node.op)
        if _is_number(a.type) and _is_number(b.type):
            ints = _is_int(a.type) and _is_int(b.type)
            kind: DataType = LongType() if ints else DoubleType()
            x, y = a.column.cast(kind), b.column.cast(kind)
            table = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Mod: lambda: numbers.mod(x, y)}
            if op in table:
                return Typed(table[op](), kind)
            if op is ast.Div:
                return Typed(numbers.true_div(x, y), DoubleType())
            if op is ast.FloorDiv and ints:
                return Typed(numbers.floor_div(x, y), kind)
            if op is ast.Pow and ints and isinstance(node.right, ast.Constant) and node.right.value >= 0:
                return Typed(numbers.int_pow(x, y), kind)
            bits = {ast.BitAnd: x.bitwiseAND, ast.BitOr: x.bitwiseOR, ast.BitXor: x.bitwiseXOR}
            if ints and op in bits:
                return Typed(bits[op](y), kind)
            if ints and op is ast.LShift:
                return Typed(numbers.left_shift(x, y), kind)
            if ints and op is ast.RShift:
                return Typed(numbers.right_shift(x, y), kind)
        if op is ast.Add and type(a.type) is type(b.type) and isinstance(a.type, (StringType, ArrayType)):
            return Typed(F.concat(a.column, b.column), a.type)
        if op is ast.Mult and isinstance(a.type, StringType) and _is_int(b.type):
            return Typed(F.repeat(a.column, F.greatest(b.column, F.lit(0)).cast("int")), a.type)
        raise _NotNative

    def _UnaryOp(self, node: ast.UnaryOp) -> Typed:
        x = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~self._truth(x), BooleanType())
        if isinstance(node.op, ast.USub) and _is_number(x.type):
            return Typed(-x.column.cast("long") if _is_int(x.type) else -x.column, LongType() if _is_int(x.type) else x.type)
        if isinstance(node.op, ast.Invert) and _is_int(x.type):
            return Typed(F.bitwise_not(x.column.cast("long")), LongType())
        raise _NotNative

    def _truth(self, x: Typed) -> Column:
        return numbers.truthy(x.column, x.type.simpleString())

    def _BoolOp(self, node: ast.BoolOp) -> Typed:
        out = self.visit(node.values[-1])
        for value in reversed(node.values[:-1]):
            x = self.visit(value)
            if x.type != out.type:
                raise _NotNative
            first, second = (out.column, x.column) if isinstance(node.op, ast.And) else (x.column, out.column)
            out = Typed(F.when(self._truth(x), first).otherwise(second), x.type)
        return out

    def _Compare(self, node: ast.Compare) -> Typed:
        terms = [self.visit(x) for x in (node.left, *node.comparators)]
        out = None
        for a, op, b in zip(terms, node.ops, terms[1:]):
            part = self._one(a, op, b)
            out = part if out is None else out & part
        return Typed(out, BooleanType())

    def _one(self, a: Typed, op: ast.cmpop, b: Typed) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(b.type, StringType) and isinstance(a.type, StringType):
                found = F.contains(b.column, a.column)
            elif isinstance(b.type, ArrayType):
                found = py_list.contains(b.column, a.column)
            else:
                raise _NotNative
            return found if isinstance(op, ast.In) else ~found
        same = _is_number(a.type) and _is_number(b.type) or type(a.type) is type(b.type)
        if not same:
            raise _NotNative
        nan = [F.isnan(x.column) for x in (a, b) if isinstance(x.type, DoubleType)]
        sane = F.lit(True)
        for n in nan:
            sane = sane & ~F.coalesce(n, F.lit(False))
        x, y = a.column, b.column
        if isinstance(op, ast.Eq):
            return sane & x.eqNullSafe(y)
        if isinstance(op, ast.NotEq):
            return ~(sane & x.eqNullSafe(y))
        table = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}
        if type(op) not in table:
            raise _NotNative
        return sane & table[type(op)]

    def _IfExp(self, node: ast.IfExp) -> Typed:
        test, yes, no = self.visit(node.test), self.visit(node.body), self.visit(node.orelse)
        if yes.type != no.type:
            raise _NotNative
        return Typed(F.when(self._truth(test), yes.column).otherwise(no.column), yes.type)

    def _List(self, node: ast.List) -> Typed:
        items = [self.visit(x) for x in node.elts]
        if not items or any(x.type != items[0].type for x in items):
            raise _NotNative
        return Typed(F.array(*[x.column for x in items]), ArrayType(items[0].type))

    def _Subscript(self, node: ast.Subscript) -> Typed:
        x = self.visit(node.value)
        text = isinstance(x.type, StringType)
        if not text and not isinstance(x.type, ArrayType):
            raise _NotNative
        if isinstance(node.slice, ast.Slice):
            start, stop, step = (None if s is None else _literal(s, int) for s in (node.slice.lower, node.slice.upper, node.slice.step))
            return Typed((strings if text else py_list).slice_(x.column, start, stop, 1 if step is None else step), x.type)
        k = _literal(node.slice, int)
        value = strings.char_at(x.column, k) if text else py_list.item(x.column, k)
        size = F.length(x.column) if text else F.size(x.column)
        inside = size > k if k >= 0 else size >= -k
        kind = x.type if text else x.type.elementType
        return Typed(F.when(inside | x.column.isNull(), value).otherwise(F.raise_error(F.lit("index out of range")).cast(kind)), kind)

    def _JoinedStr(self, node: ast.JoinedStr) -> Typed:
        parts = []
        for part in node.values:
            if isinstance(part, ast.Constant):
                parts.append(F.lit(part.value))
                continue
            x = self.visit(part.value)
            spec = part.format_spec.values[0].value if part.format_spec and len(part.format_spec.values) == 1 else ""
            if part.conversion not in (-1, 115) or isinstance(x.type, ArrayType):
                raise _NotNative
            if spec == "":
                parts.append(formatting.py_str(x.column, x.type.simpleString()))
            elif isinstance(x.type, DoubleType) and spec[:1] == "." and spec[-1] == "f" and spec[1:-1].isdigit():
                parts.append(formatting.fixed(x.column, int(spec[1:-1])))
            else:
                raise _NotNative
        return Typed(F.concat(*parts) if parts else F.lit(""), StringType())

    def _ListComp(self, node: ast.ListComp) -> Typed:
        if len(node.generators) != 1 or node.generators[0].is_async or not isinstance(node.generators[0].target, ast.Name):
            raise _NotNative
        loop = node.generators[0]
        source = self.visit(loop.iter)
        if not isinstance(source.type, ArrayType):
            raise _NotNative
        kinds: list[DataType] = []

        def inner(x: Column) -> "_Native":
            return _Native({**self.scope, loop.target.id: Typed(x, source.type.elementType)})

        def element(x: Column) -> Column:
            out = inner(x).visit(node.elt)
            kinds.append(out.type)
            return out.column

        def passes(test: ast.expr):
            return lambda x: inner(x)._truth(inner(x).visit(test))

        kept = source.column
        for test in loop.ifs:
            kept = F.filter(kept, passes(test))
        column = F.transform(kept, element)
        return Typed(column, ArrayType(kinds[0]))

    def _Call(self, node: ast.Call) -> Typed:
        if isinstance(node.func, ast.Attribute):
            return self._method(node)
        name, args = node.func.id, node.args
        if name == "sorted" and len(args) == 1 and all(k.arg == "reverse" and isinstance(k.value, ast.Constant) for k in node.keywords):
            x = self.visit(args[0])
            if not isinstance(x.type, ArrayType):
                raise _NotNative
            return Typed(py_list.sort(x.column, reverse=bool(node.keywords and node.keywords[0].value.value)), x.type)
        if node.keywords or not args:
            raise _NotNative
        x = self.visit(args[0])
        kind = x.type.simpleString()
        if name == "len" and (isinstance(x.type, (StringType, ArrayType))):
            return Typed((F.length(x.column) if kind == "string" else F.size(x.column)).cast("long"), LongType())
        if name == "str" and len(args) == 1 and not isinstance(x.type, ArrayType):
            return Typed(formatting.py_str(x.column, kind), StringType())
        if name == "bool" and len(args) == 1:
            return Typed(self._truth(x), BooleanType())
        if name == "abs" and _is_number(x.type):
            return Typed(F.abs(x.column), x.type)
        if name == "float" and _is_number(x.type):
            return Typed(x.column.cast("double"), DoubleType())
        if name == "int" and _is_int(x.type):
            return Typed(x.column.cast("long"), LongType())
        if name == "round" and isinstance(x.type, DoubleType) and len(args) == 2:
            return Typed(numbers.round_(x.column, _literal(args[1], int)), DoubleType())
        if name == "sum" and isinstance(x.type, ArrayType) and _is_int(x.type.elementType) and len(args) == 1:
            return Typed(py_list.sum_(F.transform(x.column, lambda v: v.cast("long")), F.lit(0).cast("long")), LongType())
        if name in ("min", "max") and len(args) > 1:
            rest = [self.visit(a) for a in args[1:]]
            if any(r.type != x.type for r in rest) or isinstance(x.type, DoubleType):
                raise _NotNative
            return Typed((F.least if name == "min" else F.greatest)(x.column, *[r.column for r in rest]), x.type)
        if name in ("hex", "oct", "bin") and _is_int(x.type):
            return Typed(numbers.to_base(x.column, {"hex": 16, "oct": 8, "bin": 2}[name]), StringType())
        raise _NotNative

    def _method(self, node: ast.Call) -> Typed:
        name = node.func.attr
        if node.keywords:
            raise _NotNative
        if name == "join" and isinstance(node.func.value, ast.Constant):
            items = self.visit(node.args[0])
            if not isinstance(items.type, ArrayType) or not isinstance(items.type.elementType, StringType):
                raise _NotNative
            return Typed(strings.join(_literal(node.func.value, str), items.column), StringType())
        x = self.visit(node.func.value)
        if not isinstance(x.type, StringType):
            raise _NotNative
        args = [_literal(a, (str, int)) for a in node.args]
        texts, counts, tests = StringType(), LongType(), BooleanType()
        kinds = {
            **dict.fromkeys("upper lower strip lstrip rstrip capitalize replace removeprefix removesuffix ljust rjust zfill title swapcase casefold".split(), texts),
            **dict.fromkeys("find rfind count index".split(), counts),
            **dict.fromkeys("startswith endswith isalpha isspace islower isupper isdigit isalnum isnumeric".split(), tests),
            **dict.fromkeys("split rsplit splitlines".split(), ArrayType(texts)),
        }
        if name not in kinds or name == "rsplit" and not args:
            raise _NotNative
        column = getattr(strings, name)(x.column, *args)
        return Typed(column.cast("long") if kinds[name] == counts else column, kinds[name])


def compile_expression(text: str, df: DataFrame, returns: DataType | str | None = None) -> Plan:
    """Plan for a Python expression over the frame's columns.

    ``returns`` is the result's type where the expression has no native form.
    """
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError, RecursionError) as e:
        raise Unsupported("syntax", str(e)) from e
    schema = {f.name: f.dataType for f in df.schema.fields}
    _check(tree, set(schema))
    try:
        out = _Native({name: Typed(F.col(f"`{name}`"), kind) for name, kind in schema.items()}).visit(tree)
        return Plan(NATIVE, out.column, out.type)
    except _NotNative:
        pass
    if returns is None:
        raise Unsupported("type", "the result's type must be given for an expression that is not native")
    used = sorted({getattr(node, "id", None) for node in ast.walk(tree)} & set(schema))
    if not used:
        raise Unsupported("constant", "no column is named")

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        code = compile(text, "<expression>", "eval")
        rows = zip(*[c.map(formatting._plain) for c in columns])
        return pd.Series([eval(code, {"__builtins__": _BUILTINS, **dict(zip(used, r))}) for r in rows])

    return Plan(ARROW, run(*[F.col(f"`{u}`") for u in used]), run.returnType)
