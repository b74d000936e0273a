"""Differential fuzzing: seeded programs, judgement of answers, collapsing and shrinking of findings."""

from __future__ import annotations

import ast
import random
import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.grading import REFUSED_EXIT, refused

_WORDS = ["", "a", "ab c", "Zz9", "x-y", "  pad ", "a,b,,c", "ÄÖ"]
KINDS = ("int", "str", "bool", "list", "float", "dict", "set", "tuple", "bytes")

# templates by kind: {kind} is a smaller expression of that kind, {digit} and {word} are literals
_RULES = {
    "int": """({int} + {int}) ({int} - {int}) ({int} * {digit}) ({int} // {digit}) ({int} % {digit}) (-{int}) (~{int}) ({int} & {int}) ({int} | {int}) ({int} ^ {int}) ({int} << {digit})
        ({int} >> {digit}) ({digit} ** {digit}) len({str}) len({list}) len({dict}) len({set}) sum({list}) abs({int}) min({int},{int}) max({int},{int}) int({bool}) round({float})
        ({int} if {bool} else {int}) {str}.count({word}) {str}.find({word}) {str}.rfind({word}) {list}.count({digit}) {dict}.get({word},{int}) divmod({int},{digit})[1] int({word},36)""",
    "str": """({str} + {str}) ({str} * {digit}) {str}.upper() {str}.lower() {str}.strip() {str}.lstrip() {str}.rstrip() {str}.title() {str}.swapcase() {str}.capitalize() {str}.casefold()
        {str}.replace({word},{word}) {str}.removeprefix({word}) {str}.removesuffix({word}) {str}.ljust({digit}) {str}.rjust({digit}) {str}.center({digit}) {str}.zfill({digit}) {str}[{digit}:]
        {str}[::-1] {str}.partition('a')[2] '-'.join({str}.split()) '-'.join({str}.split(',')) str({int}) repr({str}) hex({int}) oct({int}) bin({int}) f'{{{int}:>5}}' ('%d' % {int})
        chr(97 + {digit}) {bytes}.hex() ({str} if {bool} else {str}) repr({float})""",
    "bool": """({int} < {int}) ({int} <= {int}) ({int} == {int}) ({str} != {str}) ({digit} in {list}) ({word} in {str}) ({word} in {dict}) (not {bool}) ({bool} and {bool}) ({bool} or {bool})
        ({digit} < {int} <= 50) {str}.isdigit() {str}.isalpha() {str}.isspace() {str}.islower() {str}.startswith({word}) {str}.endswith({word}) any({list}) all({list}) bool({list})
        {set}.issubset({set}) isinstance({int},int) ({float} < {float})""",
    "list": """({list} + {list}) ({list} * 2) sorted({list}) sorted({list},reverse={bool}) {list}[::-1] {list}[{digit}:] [v*2 for v in {list} if v%2==0] [len(w) for w in {str}.split()]
        list(range({digit})) list(map(abs,{list})) [a for a,b in zip({list},{list})] [k for k,v in enumerate({list})] list({dict}.values()) sorted({set}) list(reversed({list})) list({tuple})""",
    "float": "({float} + {float}) ({float} * {digit}) ({int} / {digit}) ({float} // {digit}) ({float} % {digit}) float({int}) round({float},{digit}) abs({float}) (-{float})",
    "dict": "{{{word}:{int}}} {{**{dict},{word}:{int}}} ({dict} | {dict}) dict(zip({str}.split(),{list})) {{v:v*v for v in {list}}} {{k:v for k,v in {dict}.items()}}",
    "set": "({set} | {set}) ({set} & {set}) ({set} - {set}) ({set} ^ {set}) set({list}) {{v%3 for v in {list}}}",
    "tuple": "({tuple} + {tuple}) ({int},{int}) tuple({list}) divmod({int},{digit}) {tuple}[::-1]",
    "bytes": "{str}.encode() ({bytes} + {bytes}) {bytes}.upper() {bytes}.replace(b'a',b'b') {bytes}.strip() bytes([{digit},{digit}])",
}
def _apart(text: str) -> list[str]:
    """The templates of a text: what blanks outside all brackets separate."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c.isspace() and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [t for t in out if t]


_RULES = {kind: _apart(text) for kind, text in _RULES.items()}


def _expression(rng: random.Random, kind: str, depth: int) -> str:
    if kind == "digit":
        return str(rng.randint(1, 9))
    if kind == "word":
        return repr(rng.choice(_WORDS))
    if depth <= 0:
        digits = ", ".join(str(rng.randint(0, 9)) for _ in range(rng.randint(1, 4)))
        leaves = {
            "int": lambda: str(rng.randint(0, 99)), "str": lambda: repr(rng.choice(_WORDS)), "bool": lambda: rng.choice(["True", "False"]), "float": lambda: repr(rng.randint(0, 999) / 8),
            "list": lambda: f"[{digits}]", "set": lambda: f"{{{digits}}}", "tuple": lambda: f"({digits},)", "dict": lambda: f"{{{rng.choice(_WORDS)!r}: {rng.randint(0, 9)}}}",
            "bytes": lambda: rng.choice(["b''", "b'ab'", "b' x '"]),
        }
        return leaves[kind]()
    rule = rng.choice(_RULES[kind])
    parts = string.Formatter().parse(rule)
    return "".join(head + (_expression(rng, field, depth - 1) if field else "") for head, field, _, _ in parts)


def generate(seed: int, depth: int = 3) -> str:
    """A program that prints one typed expression; the same for the same seed."""
    rng = random.Random(seed)
    return f"print({_expression(rng, rng.choice(KINDS), depth)})"


def judge(engine: Column, reference: Column) -> Column:
    """agreed, refused, or a kind of finding, for structs of rc, stdout, stderr, timed_out; a null reference never ran."""
    contract = (engine["rc"] == REFUSED_EXIT) & (~refused(engine["rc"], engine["stderr"]) | (engine["stdout"] != ""))
    return (
        F.when(engine["timed_out"] | F.coalesce(reference["timed_out"], F.lit(False)), "harness")
        .when((engine["rc"] == 127) & (engine["stdout"] == ""), "harness")
        .when(contract, "contract")
        .when(engine["rc"] == REFUSED_EXIT, "refused")
        .when(reference.isNull() | (reference["rc"] != 0), "harness")
        .when(engine["rc"] != 0, "crash")
        .when(engine["stdout"] != reference["stdout"], "output")
        .otherwise("agreed")
    )


def collapse(findings: DataFrame) -> DataFrame:
    """Equal findings as one with their count, the most frequent first, then by kind and length."""
    keys = ["kind", "program", "engine_out", "reference_out"]
    grouped = findings.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("seed").alias("seed"))
    return grouped.orderBy(F.desc("count"), "kind", F.length("program"), "program")


def candidates(program: str) -> Iterator[str]:
    """Smaller programs, shortest first: half of a block's statements, all but one of them, or one sub-expression in place of the one around it."""
    tree = ast.parse(program)
    found = set()
    for outer in ast.walk(tree):
        for field in ("body", "orelse", "finalbody"):
            block = getattr(outer, field, None)
            if not isinstance(block, list) or len(block) < 2:
                continue
            middle = len(block) // 2
            for kept in (block[:middle], block[middle:], *(block[:k] + block[k + 1 :] for k in range(len(block)))):
                setattr(outer, field, kept)
                found.add(ast.unparse(tree))
            setattr(outer, field, block)
    for outer in ast.walk(tree):
        for field, value in ast.iter_fields(outer):
            slots = value if isinstance(value, list) else [value]
            for k, inner in enumerate(slots):
                if not isinstance(inner, ast.expr):
                    continue
                for part in ast.iter_child_nodes(inner):
                    if not isinstance(part, ast.expr):
                        continue
                    if isinstance(value, list):
                        value[k] = part
                    else:
                        setattr(outer, field, part)
                    found.add(ast.unparse(tree))
                    if isinstance(value, list):
                        value[k] = inner
                    else:
                        setattr(outer, field, inner)
    yield from sorted((p for p in found if len(p) < len(program)), key=lambda p: (len(p), p))


def shrink(program: str, fails: Callable[[str], bool], trials: int = 200) -> str:
    """The smallest program that still fails, by greedy steps, within a number of trials."""
    smaller = True
    while smaller:
        smaller = False
        for candidate in candidates(program):
            if trials <= 0:
                return program
            trials -= 1
            try:
                compile(candidate, "<candidate>", "exec")
            except SyntaxError:
                continue
            if fails(candidate):
                program, smaller = candidate, True
                break
    return program


def tally(judged: DataFrame, judgement: str = "judgement") -> DataFrame:
    """Programs by judgement, the most frequent first."""
    return judged.groupBy(judgement).agg(F.count("*").alias("count")).orderBy(F.desc("count"), judgement)
