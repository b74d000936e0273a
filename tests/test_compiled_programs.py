"""Compiled programs against the running interpreter, row by row."""

import pytest

from lathe.plans.compiler import ARROW, NATIVE, Unsupported
from lathe.plans.programs import aggregate_function, compile_function, compile_program

ROWS = [(3, "lace ring", 1.5), (0, "", -2.0), (-7, "aéb", 0.0), (12, "x y z", 1e9)]

# (program, type, tier)
PROGRAMS = [
    ("result = n + 1", "long", NATIVE),
    ("a = b = n\na -= 2\nresult = a * b", "long", NATIVE),
    ("a, b = n, n + 1\na, b = b, a\nresult = a - 2 * b", "long", NATIVE),
    ("if n > 2:\n    result = 'big'\nelif n == 0:\n    result = 'none'\nelse:\n    result = s", "string", NATIVE),
    ("r = 0\nfor k in range(4):\n    if k != n:\n        r += k\nresult = r", "long", NATIVE),
    ("r = ''\nfor w in ['a', 'b']:\n    r = r + w + s\nelse:\n    r += '!'\nresult = r", "string", NATIVE),
    ("def f(x, y=2):\n    if x < 0:\n        return -x\n    z = x * y\n    return z\nresult = f(n) + f(n, y=5)", "long", NATIVE),
    ("def f(x):\n    def g(y):\n        return y + x\n    return g(x) * 2\nresult = f(n)", "long", NATIVE),
    ("f = lambda a, b=3: a * b\nresult = f(n) - f(n, 1)", "long", NATIVE),
    ("x = 1\ndel x\nresult = n", "long", NATIVE),
    ("assert n < 100, 'too large'\nresult = n", "long", NATIVE),
    # names that move are looked up when the function runs
    ("x = 1\ndef f():\n    return x\nx = 2\nresult = f()", "long", ARROW),
    ("fs = 0\nfor k in range(3):\n    f = lambda: k\n    fs += f()\nresult = fs", "long", ARROW),
    ("def f(x):\n    return 1 if x <= 1 else x * f(x - 1)\nresult = f(abs(n))", "long", ARROW),
    ("k, result = abs(n), 0\nwhile k:\n    k -= 1\n    if k == 5:\n        continue\n    if k == 1:\n        break\n    result += k\nelse:\n    result = -1", "long", ARROW),
    ("first, *rest = [n, 1, 2]\n*head, last = rest\nresult = [first, last, len(head)]", "array<long>", ARROW),
    ("try:\n    result = 10 // n\nexcept (ZeroDivisionError, KeyError) as e:\n    result = len(str(e))\nelse:\n    result += 1\nfinally:\n    done = 1", "long", ARROW),
    ("try:\n    {}[s]\nexcept LookupError as e:\n    result = repr(e)", "string", ARROW),
    ("total = 0\ndef add(k):\n    global total\n    total += k\nadd(n)\nadd(2)\nresult = total", "long", ARROW),
    ("def glue(*parts, sep='-'):\n    return sep.join(parts)\nresult = glue(s, 'x', *['y', 'z'])", "string", ARROW),
    ("it = iter(s)\nresult = [next(it, '?'), next(it, '?')] + list(map(lambda c: c + c, it))", "array<string>", ARROW),
    ("d = {}\nfor w in s.split(' '):\n    d[w] = d.get(w, 0) + 1\nd.setdefault('q', n)\nresult = sorted(d.items(), key=lambda p: (p[1], p[0]))[0][0]", "string", ARROW),
    ("x = [3, 1, 2]\nx.sort(reverse=True)\nx.append(n)\nx.insert(0, 9)\nx.remove(1)\nresult = x[::-1]", "array<long>", ARROW),
    ("result = sum(k * k for k in range(abs(n)) if k % 2)", "long", ARROW),
    ("if (m := n * 2) > 4:\n    result = m\nelse:\n    result = 0", "long", ARROW),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "n long, s string, v double")


@pytest.mark.parametrize("k", range(len(PROGRAMS)))
def test_programs_against_the_interpreter(df, k):
    text, kind, tier = PROGRAMS[k]
    plan = compile_program(text, df, kind)
    assert plan.tier == tier
    want = []
    for n, s, v in ROWS:
        scope = {"n": n, "s": s, "v": v}
        exec(text, scope)
        want.append(scope["result"])
    assert [r[0] for r in df.select(plan.column).collect()] == want


@pytest.mark.parametrize(
    "text, kind",
    [
        ("import os\nresult = 1", "syntax"), ("class A:\n    pass", "syntax"), ("async def f():\n    pass", "syntax"), ("def f():\n    yield 1", "syntax"), ("with n:\n    pass", "syntax"),
        ("@f\ndef f():\n    pass", "syntax"), ("result = n.__class__", "method"), ("result = __builtins__", "name"), ("result = open(s)", "name"), ("result = eval(s)", "name"),
        ("result = '{0.a}'.format(n)", "method"), ("def f(:\n  pass", "syntax"), ("x = n @ n", "operator"), ("result = [n] * n", "type"),
    ],
)
def test_refusals(df, text, kind):
    with pytest.raises(Unsupported) as e:
        compile_program(text, df)
    assert e.value.kind == kind


def test_errors_and_limits(df, monkeypatch):
    got = df.select(compile_program("result = 10 // n\nassert n != 3, 'three'", df, "long", errors="struct").column.alias("o")).select("o.*").collect()
    try:
        10 // ROWS[1][0]
    except ZeroDivisionError as e:
        zero = f"ZeroDivisionError: {e}"
    assert [tuple(r) for r in got] == [(None, "AssertionError: three"), (None, zero), (-2, None), (0, None)]
    endless = df.select(compile_program("try:\n    while True:\n        pass\nexcept Exception:\n    result = 1", df, "long", errors="struct").column["error"]).first()[0]
    assert endless.startswith("steps:")
    for native in ("assert n > 0, 'low'\nresult = n", "x = [n]\nassert x[0] > 0, 'low'\nx.append(1)\nresult = n"):
        with pytest.raises(Exception, match="AssertionError: low"):
            df.select(compile_program(native, df, "long").column).collect()
    guarded = compile_program("result = 0\nif n > 5:\n    assert n > 10, 'no'\n    result = n", df)
    assert guarded.tier == NATIVE and [r[0] for r in df.select(guarded.column).collect()] == [0, 0, 0, 12]


def test_input_output_environment(df):
    plan = compile_program("print(input(), n)\nprint(getenv('A'), getenv('B', 'none'), sep='|', end='')", df, "string", result="stdout", stdin="s", environment={"A": "1"})
    got = [r[0] for r in df.where("s <> ''").select(plan.column).collect()]
    assert got == [f"{s} {n}\n1|none" for n, s, _ in ROWS if s]
    empty = compile_program("result = input()", df, "string", errors="struct", stdin="s")
    assert df.where("s = ''").select(empty.column["error"]).first()[0] == "EOFError: EOF when reading a line"


def test_functions_and_aggregates(df):
    assert [r[0] for r in df.select(compile_function("lambda a: a * 2", df, "n").column).collect()] == [2 * n for n, _, _ in ROWS]
    assert [r[0] for r in df.select(compile_function("def f(a, b):\n    return a + len(b)", df, "n", "s").column).collect()] == [n + len(s) for n, s, _ in ROWS]
    got = aggregate_function("def spread(values):\n    return max(values) - min(values)", df.selectExpr("n", "n % 2 = 0 as even"), "n", "even", returns="long").collect()
    assert {r.even: r.value for r in got} == {True: 12, False: 10}


@pytest.mark.parametrize(
    "text, engine, kind",
    [
        ("class A: pass", "refused", "class"), ("import os", "refused", "import"), ("async def f(): pass", "refused", "async"), ("def f():\n yield 1", "refused", "generator"),
        ("@d\ndef f(): pass", "refused", "decorator"), ("x = ...", "refused", "ellipsis"), ("def f(:", "refused", "syntax"), ("q.foo()", "refused", "method"), ("x = unknown", "refused", "name"),
        ("try:\n  pass\nexcept* ValueError:\n  pass", "refused", "exception group"), ("match n:\n  case 1: pass", "refused", "match"), ("x = [v async for v in n]", "refused", "syntax"),
        ("result = n + 1", "column", None), ("print(n)", "batch", None), ("while n: n -= 1", "batch", None), ("", "column", None), (None, "column", None),
    ],
)
def test_routes(text, engine, kind):
    from lathe.plans.routes import route

    assert route(text, frozenset({"n"}))[:2] == (engine, kind)


def test_generated_programs_in_the_compiled_tier(df):
    """Every generated program means the same compiled as run by the interpreter, errors included."""
    import contextlib
    import io

    from lathe.operators import fuzz
    from lathe.plans.routes import route

    programs, want = [], []
    for seed in range(60):
        text = fuzz.generate(seed)
        assert route(text)[0] == "batch"
        out = io.StringIO()
        try:
            with contextlib.redirect_stdout(out):
                exec(text, {})
            want.append((out.getvalue(), None))
        except Exception as e:
            want.append((None, type(e).__name__))
        programs.append(compile_program(text, df, "string", result="stdout", errors="struct").column)
    got = df.limit(1).select(*[p.alias(f"p{k}") for k, p in enumerate(programs)]).first()
    assert [(r.value, r.error and r.error.split(":")[0]) for r in got] == want


def test_shrinking_drops_statements():
    from lathe.operators import fuzz

    def fails(text):
        try:
            exec(text, {"print": lambda *a: None})
        except ZeroDivisionError:
            return True
        except Exception:
            return False
        return False

    assert fuzz.shrink("a = 1\nb = 2\nprint(len('abc') + 5 // (b - 2))\nd = 4\ne = 5", fails) == "b = 2\n5 // (b - 2)"
