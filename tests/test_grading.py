import json
import random

import pytest
from pyspark.sql import functions as F

from lathe import queries
from lathe.operators import fuzz, gate, grading, relational, timing
from lathe.plans.compiler import ARROW, NATIVE, Unsupported, compile_expression


def test_verdict_of_every_rule(spark):
    cases = {
        "match": (dict(), "MATCH", ""),
        "timeout": (dict(timed_out=True), "MISMATCH", "timeout"),
        "unbuilt": (dict(binary=""), "MISMATCH", "unbuilt"),
        "refused": (dict(returncode=90, stdout="", stderr="core: unsupported: builtin: eval"), "UNSUPPORTED", "builtin"),
        "late refusal": (dict(returncode=90, stdout="x", stderr="core: unsupported: builtin: eval"), "MISMATCH", "contract"),
        "silent 90": (dict(returncode=90, stdout=""), "MISMATCH", "contract"),
        "foreign refusal": (dict(returncode=90, stdout="", stderr="other: unsupported: builtin: eval"), "MISMATCH", "contract"),
        "output": (dict(stdout="b\n"), "MISMATCH", "stdout"),
        "exit": (dict(returncode=1), "MISMATCH", "exit"),
        "set order": (dict(stdout="{2, 1}"), "MATCH", ""),
        "dict order": (dict(stdout="{2: 1, 1: 1}"), "MISMATCH", "stdout"),
        "silent error": (dict(), "MISMATCH", "stderr"),
        "skipped": (dict(stdout="anything"), "MATCH", ""),
        "own 90": (dict(returncode=90), "MATCH", ""),
    }
    refs = {"set order": dict(stdout="{1, 2}"), "dict order": dict(stdout="{1: 1, 2: 1}"), "silent error": dict(stderr="boom"), "skipped": dict(skip_stdout=True), "own 90": dict(returncode=90)}
    base = dict(returncode=0, stdout="a\n", stderr="")
    ref_rows = [(k, *{**base, "skip_stdout": False, **refs.get(k, {})}.values()) for k in cases]
    got_rows = [("core", k, *{"binary": "b", **base, "wall_ns": 1, "timed_out": False, **v[0]}.values()) for k, v in cases.items()]
    reference = spark.createDataFrame(ref_rows, "entry_id string, returncode int, stdout string, stderr string, skip_stdout boolean")
    results = spark.createDataFrame(got_rows, "engine string, entry_id string, binary string, returncode int, stdout string, stderr string, wall_ns long, timed_out boolean")
    got = {r.entry_id: (r.verdict, r.kind) for r in grading.classify(reference, results).collect()}
    assert got == {k: (v[1], v[2]) for k, v in cases.items()}


def test_first_diff_and_paths(spark):
    rows = [("a\nb", "a\nc"), ("a", "a\nb"), ("x" * 95, "y"), ("same", "same")]
    got = [r.d for r in spark.createDataFrame(rows, "a string, b string").select(grading.first_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == ["line 2: want 'b', got 'c'", "line 2: want <no line>, got 'b'", "line 1: want '" + "x" * 90 + "…', got 'y'", "trailing whitespace only"]
    texts = [("open('/etc/passwd'); x = a/b/c; '/api/chat/'; '/tmp/x/y' '/tmp/x/y' http://h/usr/x",)]
    paths = spark.createDataFrame(texts, "t string").select(grading.absolute_paths(F.col("t")).alias("p")).first().p
    assert paths == ["/etc/passwd", "/tmp/x/y"]


def test_nondeterminism_classes(spark):
    rows = [("print(datetime.now())", [], True), ("import random; random.random()", None, True), ("print(1)", ["seeded"], True), ("len(zlib.compress(x))", [], True), ("print(sys.argv)", [], False), ("grid(2)", [], False), ("id(x)", [], True)]
    frame = spark.createDataFrame([r[:2] for r in rows], "p string, tags array<string>").select(grading.is_nondeterministic(F.col("p"), F.col("tags")).alias("n"))
    assert [r.n for r in frame.collect()] == [r[2] for r in rows]


def test_route_grades(spark):
    ladder = ["core", "mid", "ref"]
    table = {
        "ideal": ("core", {"core": "MATCH", "mid": "MATCH"}, "IDEAL"),
        "wasted": ("core", {"core": "UNSUPPORTED", "mid": "MATCH"}, "WASTED"),
        "late": ("mid", {"core": "MATCH", "mid": "MATCH"}, "LATE"),
        "unsafe": ("core", {"core": "MISMATCH", "mid": "MATCH"}, "UNSAFE"),
        "to the top": ("ref", {"core": "UNSUPPORTED", "mid": "UNSUPPORTED"}, "IDEAL"),
        "unknown": ("nosuch", {"core": "MATCH"}, "UNSAFE"),
        "unmeasured": ("mid", {"core": "MATCH"}, None),
    }
    routes = spark.createDataFrame([(k, v[0]) for k, v in table.items()], "entry_id string, predicted string")
    verdicts = spark.createDataFrame([(k, e, x, "", "") for k, v in table.items() for e, x in v[1].items()], "entry_id string, engine string, verdict string, kind string, detail string")
    graded = grading.grade_routes(routes, verdicts, ladder)
    assert {r.entry_id: r.grade for r in graded.collect()} == {k: v[2] for k, v in table.items() if v[2]}
    summary = grading.grade_summary(graded).first()
    assert summary.graded == 6 and summary.unsafe == 2 and summary.first_try_pct == 50.0
    assert {r.entry_id for r in grading.routing_errors(routes, verdicts, ladder[:2]).collect()} == {"unsafe"}


def test_coverage_and_plan(spark):
    rows = [("core", f"e{k}", v, "builtin", d) for k, (v, d) in enumerate([("MATCH", ""), ("UNSUPPORTED", "f"), ("UNSUPPORTED", "f"), ("UNSUPPORTED", "g"), ("MISMATCH", "")])]
    verdicts = spark.createDataFrame(rows, "engine string, entry_id string, verdict string, kind string, detail string")
    assert tuple(grading.coverage(verdicts).first()) == ("core", 1, 3, 1, 5, 20.0)
    assert [tuple(r) for r in grading.plan(verdicts).collect()] == [("builtin: f", 2, ["e1", "e2"]), ("builtin: g", 1, ["e3"])]


def test_timing(spark):
    samples = spark.createDataFrame(
        [("a", "1", 0, 5.0, "ran", 0), ("a", "1", 1, 3.0, "ran", 1), ("a", "2", 0, 1.0, "refused", 90), ("b", "1", 0, 9.0, "ran", 0), ("b", "2", 0, 2.0, "ran", 0)],
        "arm string, entry_id string, repeat int, ms double, outcome string, rc int",
    )
    best = timing.keep_best(samples)
    assert {(r.arm, r.entry_id): (r.ms, r.rc) for r in best.collect()}[("a", "1")] == (3.0, 1)
    assert [r.entry_id for r in timing.shared_subset(best).collect()] == ["1"]
    totals = {r.arm: r for r in timing.corpus_time(samples).collect()}
    assert (totals["a"].ran, totals["a"].refused, totals["a"].total_ms, totals["b"].shared_ms) == (1, 1, 3.0, 9.0)
    record = timing.timing_record(best.where("arm = 'b'"))
    loaded = timing.load_record(record, "record")
    assert {(r.entry_id, r.ms) for r in loaded.collect()} == {("1", 9.0), ("2", 2.0)}
    assert timing.load_record(spark.createDataFrame([('{"schema": "other", "entries": {}}',)], "record string"), "record").count() == 0
    change = timing.diff(loaded, best.where("arm = 'a'").drop("arm"))
    summary = timing.diff_summary(change).first()
    assert (summary.shared, summary.added, summary.dropped, summary.flips) == (2, 0, 0, 2)
    assert [r.entry_id for r in timing.movers(change, 1).collect()] == ["1"]
    ratios = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, 0.0)], "a double, b double").select(timing.ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in ratios.collect()] == ["0.50x", "—", "—"]
    reasons = spark.createDataFrame([("x = 1", []), ("open('/etc/hosts/x')", []), ("x", ["/tmp/a/b"]), ("a\0", [])], "p string, argv array<string>").select(timing.skip_reason(F.col("p"), F.col("argv")).alias("r"))
    assert [r.r[:8] for r in reasons.collect()] == ["", "absolute", "absolute", "NUL byte"]


def test_timing_record_in_parts(spark, monkeypatch):
    monkeypatch.setattr(timing, "RECORD_ENTRIES", 2, raising=False)
    rows = [(arm, f"e{k}", float(k), "ran", 0) for arm, n in (("a", 5), ("b", 2), (None, 1)) for k in range(n)]
    best = spark.createDataFrame(rows, "arm string, entry_id string, ms double, outcome string, rc int").repartition(3)
    records = timing.timing_record(best)
    texts = {}
    for r in records.orderBy("arm", "part").collect():
        texts.setdefault(r.arm, []).append(json.loads(r.record))
    assert {arm: [list(t["entries"]) for t in all_] for arm, all_ in texts.items()} == {"a": [["e0", "e1"], ["e2", "e3"], ["e4"]], "b": [["e0", "e1"]], None: [["e0"]]}
    assert {arm: {t["total_ms"] for t in all_} for arm, all_ in texts.items()} == {"a": {10.0}, "b": {1.0}, None: {0.0}}
    assert sorted(map(tuple, timing.load_record(records, "record").collect())) == sorted(r[1:] for r in rows)


def test_judge_and_collapse(spark):
    run = "struct<rc:int,stdout:string,stderr:string,timed_out:boolean>"
    ok, line = (0, "1", "", False), "core: unsupported: x: y"
    cases = [((0, "1", "", False), ok, "agreed"), ((90, "", line, False), None, "refused"), ((90, "a", line, False), None, "contract"), ((90, "", "", False), None, "contract"), ((0, "2", "", False), ok, "output"),
             ((1, "", "", False), ok, "crash"), ((0, "1", "", True), ok, "harness"), ((0, "1", "", False), (1, "", "", False), "harness"), ((127, "", "", False), ok, "harness")]
    frame = spark.createDataFrame([c[:2] for c in cases], f"e {run}, r {run}").select(fuzz.judge(F.col("e"), F.col("r")).alias("j"))
    assert [r.j for r in frame.collect()] == [c[2] for c in cases]


def test_generator_and_shrinker():
    assert fuzz.generate(5) == fuzz.generate(5) and len({fuzz.generate(k) for k in range(50)}) > 40
    for k in range(60):
        compile(fuzz.generate(k), "<generated>", "exec")
    small = fuzz.shrink("print((1 + 2) * len('abc'.upper().strip()))", lambda p: "upper" in p)
    assert "upper" in small and len(small) < 30


def test_gate(spark):
    row = gate.gate(spark.createDataFrame([(700_001, 3, None)], "bytes long, opens int, shared_objects int")).first()
    assert (row.bytes_check, row.opens_check, row.shared_objects_check, row.ok, row.blocks) == ("failed", "passed", "unmeasured", False, 6)
    log = spark.createDataFrame([('openat(AT_FDCWD, "/a", O_RDONLY) = 3',), ('openat(AT_FDCWD, "/a", O_RDONLY) = 4',), ('open("/b") = -1 ENOENT (No)',), ('stat("/c", {}) = 0',), ("read(3)",)], "value string")
    assert tuple(gate.parse_trace(log).first()) == (1, 1, 1)
    cold = spark.range(1).select(gate.project_cold_ms(F.lit(131073), F.lit(3), F.lit(1310720), F.lit(10), F.lit(1000)).alias("ms")).first().ms
    assert cold == 300


def test_relational_edges(spark):
    frame = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 3, 2), ("b", 2, 3), ("a", 3, 4)], "g string, k int, pos int")
    assert [(r.g, r.pos) for r in relational.first_by(frame, ["g"], "k", "pos").orderBy("g").collect()] == [("a", 0), ("b", 3)]
    assert [(r.g, r.pos) for r in relational.first_by(frame, ["g"], "k", "pos", largest=True).orderBy("g").collect()] == [("a", 2), ("b", 3)]
    assert [r.pos for r in relational.sort_rows(frame, "k", "pos", reverse=True).collect()] == [2, 4, 3, 0, 1]
    assert [r.pos for r in relational.enumerate_rows(frame.drop("pos"), "k", start=7).orderBy("pos").collect()] == [7, 8, 9, 10, 11]
    assert relational.enumerate_rows(frame.where("false"), "k", name="n").count() == 0
    counts = relational.counter(frame, "g", "pos")
    assert [tuple(r) for r in relational.most_common(counts, 1).collect()] == [("a", 4, 0)]
    assert relational.elements(counts, "g").count() == 5
    assert relational.mode(frame, "k", "pos", "g").where("g = 'a'").first().mode == 1
    assert relational.median_high(frame, "k", "g").where("g = 'a'").first().median_high == 3
    none = frame.select("g").where("false")
    assert relational.symmetric_difference(frame.select("g"), none).count() == 2 and relational.is_subset(none, frame.select("g")).first().is_subset


ROWS = [(7, -2.5, "Ab c", ["x", "yy", ""], [3, 1, 2]), (-7, 0.5, "", [], []), (0, 2.675, "héllo-wörld", ["a"], [5])]
EXPRESSIONS = {
    "n // 2 + n % 3": NATIVE, "-n * (n + 1)": NATIVE, "n / 4": NATIVE, "n ** 2": NATIVE, "n & 5 | 2": NATIVE, "f * 2 - 1": NATIVE, "f % 2.0": NATIVE,
    "s.upper() + '!' if s else 'none'": NATIVE, "s[1:3]": NATIVE, "s[::-1]": NATIVE, "len(s) + len(w)": NATIVE, "'b' in s": NATIVE, "s.split()": NATIVE, "s.title()": NATIVE, "'-'.join(w)": NATIVE,
    "-3 <= n < 5 and f > 0": NATIVE, "not s": NATIVE, "s or 'empty'": NATIVE, "[v * 2 for v in a if v > 1]": NATIVE, "sorted(a, reverse=True)": NATIVE, "sum(a)": NATIVE, "max(n, 3)": NATIVE,
    "f'{n}:{s}:{f:.1f}'": NATIVE, "round(f, 1)": NATIVE, "hex(n)": NATIVE, "str(f)": NATIVE, "abs(n)": NATIVE, "n == f": NATIVE, "s.count('l') > 1": NATIVE,
}
ARROW_ONLY = {"{v: len(v) for v in w}": "map<string,int>", "[x + y for x in w for y in w]": "array<string>", "repr(w)": "string", "f'{n:>8,d}|{s!r}'": "string", "sum(len(v) for v in w)": "int", "s.rjust(n if n > 0 else 1)": "string"}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "n long, f double, s string, w array<string>, a array<long>")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_nested_loops_by_order(spark, monkeypatch, block):
    monkeypatch.setattr(relational, "BLOCK_ROWS", block)
    rng = random.Random(5)
    values = [None, float("nan"), float("inf"), 0.0, -0.0, 3.0, 3.0, 3.0]
    xs, ys = ([(k, rng.choice([*values, rng.uniform(-9, 9)])) for k in range(n)] for n in (23, 40))
    left, right = spark.createDataFrame(xs, "i int, x double").repartition(3), spark.createDataFrame(ys, "j int, y double").repartition(2)
    below = (F.col("x"), F.col("y") - 1)
    want = sorted(map(tuple, left.join(right, below[0] < below[1]).select("i", "j").collect()))
    got = relational.nested_loops(left, right, less=below)
    assert got.columns == ["i", "x", "j", "y"] and len(want) > 100
    assert sorted(map(tuple, got.select("i", "j").collect())) == want
    odd = relational.nested_loops(left, right, (F.col("i") + F.col("j")) % 2 == 1, below)
    assert sorted(map(tuple, odd.select("i", "j").collect())) == [p for p in want if sum(p) % 2]
    assert relational.nested_loops(left, right.where("y is null"), less=below).count() == 0
    with pytest.raises(ValueError):
        relational.nested_loops(left, right, less=(F.col("x").cast("string"), F.col("y")))


def test_theta_join_compares_bounds_of_blocks(spark, tiny):
    plan = queries.theta_join(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    loops = [line for line in plan.splitlines() if "NestedLoop" in line or "CartesianProduct" in line]
    assert all("__low" in line for line in loops)


def evaluate(text, row):
    return eval(text, {}, dict(zip("nfswa", row)))


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_native_expressions(frame, text):
    plan = compile_expression(text, frame)
    assert plan.tier == EXPRESSIONS[text]
    got = frame.select("n", plan.column.alias("y")).collect()
    for row in ROWS:
        value = next(r.y for r in got if r.n == row[0])
        assert value == evaluate(text, row) and isinstance(value, type(evaluate(text, row))), (text, row)


@pytest.mark.parametrize("text", ARROW_ONLY)
def test_arrow_expressions(frame, text):
    plan = compile_expression(text, frame, ARROW_ONLY[text])
    assert plan.tier == ARROW
    got = frame.select("n", plan.column.alias("y")).collect()
    assert all(next(r.y for r in got if r.n == row[0]) == evaluate(text, row) for row in ROWS)


@pytest.mark.parametrize("text", ["__import__('os')", "n.__class__", "lambda: 1", "open('x')", "missing + 1", "(yield)", "n @ n", "1 +", "s.format(n)", "[w for w in w for w in w].sort()", "repr(w)"])
def test_refusals_come_before_anything_runs(frame, text):
    with pytest.raises(Unsupported):
        compile_expression(text, frame)


def test_index_errors_raise(frame):
    with pytest.raises(Exception):
        frame.select(compile_expression("a[9]", frame).column).collect()
