import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from lathe.functions import numbers, text, web
from lathe.operators import grading, harvest, programs

from test_harvest import sighting


def uses(text):
    found = programs.uses(text)
    return found and tuple(map(sorted, found))


def test_uses():
    assert uses("import os.path, json as j\nfrom a.b import c\nfrom . import d\nprint(len([x for x in range(3)]))") == (["a", "json", "os"], ["len", "print", "range"])
    assert uses("list = open('f').read()\nprint(list)\ndef max(a): return a\nmax(min)") == ([], ["min", "open", "print"])
    assert uses("'\\.'") == ([], []) and uses("x = (") is None and uses(None) is None
    assert uses("try:\n  pass\nexcept E as id:\n  print(id)\nwith open('x') as (a, *hash): sum(hash)")[1] == ["open", "print", "sum"]


def test_profile(spark):
    entries = spark.createDataFrame([("a", "import os\nprint(1)"), ("b", "import os, json"), ("c", "bad(")], "id string, program string")
    out = programs.profile_uses(entries)
    assert [tuple(r) for r in out["modules"].collect()] == [("os", 2), ("json", 1)]
    assert [tuple(r) for r in out["builtins"].collect()] == [("print", 1)] and out["unparsed"].first().unparsed == 1
    assert tuple(out["lines"].first()) == (1, 2, 2)


def test_transcripts(spark):
    block = {"type": "tool_use", "name": "Bash", "id": "t1", "input": {"command": "python -c 'a'; python -c b"}}
    events = [{"timestamp": "2024", "message": {"content": [block, {**block, "name": "Read"}, {"type": "text"}]}}, {"message": {"content": "text"}}, {"message": 3}, []]
    lines = [("/x/s1.jsonl", json.dumps(e)) for e in events] + [("/x/s1.jsonl", "{half")]
    frame = spark.createDataFrame(lines + lines, "file string, value string")
    got = harvest.aggregate(harvest.transcript_occurrences(frame)).collect()
    assert sorted((r.program, r["count"], r.session, r.source) for r in got) == [("a", 1, "s1", "transcript"), ("b", 1, "s1", "transcript")]


def test_export_twice_publishes_once(spark):
    rows = sighting(spark, [("k", "print(1)", [], "shim", "s", "2024-01-01", 2, None), ("k", "pass", [], "shim", "s", "", 1, None), ("k", "print(2)", [], "hook", None, "", 1, None)])
    known = spark.createDataFrame([], "id string")
    first, dropped = harvest.export(rows, known, None)
    assert {(r.reason, r.rows) for r in dropped.collect()} == {("trivial", 1)}
    published = spark.createDataFrame(first.collect(), first.schema)
    assert {r.session for r in published.collect()} == {"s", "unknown"}
    assert harvest.export(rows, known, published)[0].count() == 0
    more = rows.unionByName(sighting(spark, [("k", "print(3)", [], "hook", "s", "", 1, None)]))
    again = harvest.export(more, known, published)[0].collect()
    assert {r.session for r in again} == {"s"} and len(again) == 2
    assert harvest.collect(rows.where("program = 'print(1)'"), rows.where("program = 'print(1)'")).count() == 1


def test_math_and_types(spark):
    frame = spark.createDataFrame([(2.25,), (100.0,)], "x double").select(numbers.sqrt(F.col("x")).alias("s"), numbers.log10(F.col("x")).alias("l"), numbers.floor(F.col("x")).alias("f"), numbers.ceil(F.col("x")).alias("c"))
    assert [tuple(r) for r in frame.collect()] == [(math.sqrt(x), math.log10(x), math.floor(x), math.ceil(x)) for x in (2.25, 100.0)]
    for bad in (numbers.sqrt(F.lit(-1.0)), numbers.log10(F.lit(0.0))):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()
    assert numbers.type_name("array<int>") == "list" and numbers.isinstance_("boolean", "int") and not numbers.isinstance_("string", "int")
    with pytest.raises(ValueError):
        numbers.type_name("decimal(3,1)")


def test_struct_and_bytes(spark):
    frame = spark.createDataFrame([(1, 65000)], "a int, b int").select(text.struct_pack("<HI", F.col("a"), F.col("b")).alias("p"), text.bytes_of(F.array(F.lit(65), F.lit(255))).alias("y"))
    row = frame.first()
    assert bytes(row.p) == struct.pack("<HI", 1, 65000) and bytes(row.y) == b"A\xff"
    assert frame.select(text.struct_unpack("<HI", F.col("p")).alias("u")).first().u == [1, 65000]
    with pytest.raises(struct.error):
        text.struct_pack("nonsense!", F.lit(1))


def test_registered_modules_and_bytes_of_urls(spark):
    source = "MP_REGISTER_MODULE(MP_QSTR_math, x);\nMP_REGISTER_EXTENSIBLE_MODULE( MP_QSTR__io, y); MP_REGISTER_MODULE(MP_QSTR_math, z)"
    row = spark.createDataFrame([(source, "a%FF%41+b")], "s string, u string").select(programs.registered_modules(F.col("s")).alias("m"), web.unquote_to_bytes(F.col("u")).alias("b")).first()
    assert row.m == ["io", "math"] and bytes(row.b) == b"a\xffA+b"


def test_dispatch_moves_on_only_for_refusals(spark):
    routes = spark.createDataFrame([("a", "core"), ("b", "mid"), ("c", "core"), ("d", "elsewhere")], "entry_id string, predicted string")
    line = "core: unsupported: x: y"
    rows = [("a", "core", 90, line), ("a", "mid", 0, ""), ("b", "core", 0, ""), ("b", "mid", 1, ""), ("c", "core", 90, line), ("c", "mid", 90, line), ("d", "core", 90, ""), ("d", "mid", 0, "")]
    results = spark.createDataFrame(rows, "entry_id string, engine string, returncode int, stderr string")
    got = {r.entry_id: (r.answered, r.tries) for r in grading.dispatch(routes, results, ["core", "mid"]).collect()}
    assert got == {"a": ("mid", 2), "b": ("mid", 1), "c": (None, 2), "d": ("core", 1)}
