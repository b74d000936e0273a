import json
import random

import pytest
from pyspark.sql import functions as F

from lathe.operators import corpus
from lathe.sources import files, jsonl

SCHEMA = corpus.ENTRY


def entries(spark, rows):
    """Rows (id, program, argv_tail, source, first_seen, count, stdin_sample, extra as JSON)."""
    frame = spark.createDataFrame(rows, SCHEMA.replace("extra variant", "extra string"))
    return frame.withColumn("extra", F.parse_json("extra"))


def plain(frame):
    return [tuple(r) for r in frame.withColumn("extra", F.to_json("extra")).collect()]


ROWS = [
    ("a", "p1", ["x"], "s1", "2024-01-02", 2, None, None),
    ("a", "p1", ["x"], "s1", "2024-01-02", 2, None, '{"k":1}'),
    ("a", "p1", [], "s2", "2024-01-01", 3, "in", None),
    ("b", "p2", [], "s1", "", 1, None, None),
    ("b", "p2b", [], "s1", "2023-05-05", 1, None, None),
    ("c", "p3", [], "", "", 5, None, '{"tags":["t"]}'),
]


def test_normalise_and_keys(spark):
    def rule(text):
        import itertools
        import re

        trimmed = [x.rstrip(" \t") for x in re.split("\r\n|\r|\n", text)]
        blank = lambda x: x.strip() == ""
        for _ in range(2):
            trimmed = list(itertools.dropwhile(blank, trimmed))[::-1]
        return "\n".join(trimmed)

    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\r\nabé\x0b") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", "\n\n  x  \n\n", "  indented\n\tx \r", "\x0b \n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.normalise(F.col("t")).alias("n"), corpus.fingerprint(F.col("t")).alias("k"), corpus.line_count(F.col("t")).alias("lines"))
    import hashlib

    for r in frame.collect():
        assert r.n == rule(r.t), repr(r.t)
        assert r.k == "py-" + hashlib.sha256(rule(r.t).encode()).hexdigest()[:12]
        assert r.lines == len(r.t.splitlines())


def test_merge(spark):
    merged = corpus.merge(entries(spark, ROWS))
    got = {r[0]: r for r in plain(merged)}
    assert [r[0] for r in plain(merged)] == ["a", "b", "c"]
    assert got["a"][1:6] == ("p1", [], "s2", "2024-01-01", 5) and got["b"][1:6] == ("p2b", [], "s1", "2023-05-05", 2)
    assert json.loads(got["c"][7]) == {"tags": ["t"]}


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_commutative_and_idempotent(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice("pq"), [], rng.choice("xy"), rng.choice(["", "2024-01-01", "2023-01-01"]), rng.randint(1, 3), None, None) for _ in range(12)]
    one, two = entries(spark, rows[:6]), entries(spark, rows[6:])
    merged = plain(corpus.merge(one, two))
    assert merged == plain(corpus.merge(two, one))
    assert plain(corpus.merge(corpus.merge(one, two))) == merged
    assert plain(corpus.merge(one, one, two)) == merged


def test_percentiles_follow_the_index_rule(spark):
    values = [1, 2, 3, 4]
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    row = corpus.percentiles(frame, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    assert tuple(row) == tuple(values[min(int(q * 4), 3)] for q in (0.0, 0.5, 0.9, 1.0))
    arrays = spark.createDataFrame([([],), ([1, 2, 3, 4],)], "v array<int>").select(corpus.nth_value(F.col("v"), 0.5).alias("x")).collect()
    assert [r.x for r in arrays] == [None, 3]


def test_jsonl_round_trip_and_corruption(spark, tmp_path):
    lines = [
        json.dumps({"id": "k1", "count": 3, "argv_tail": ["a"], "program": "print(1)", "first_seen": "2024-01-01", "tags": ["x", 1], "nested": {"é": 1.5}}),
        json.dumps({"key": "k2", "program": "print('日本')", "stdin": "data", "count": "many"}),
        json.dumps({"program": "no id"}),
        "",
        "[1, 2]",
        '{"id": "half',
        json.dumps({"id": "no program"}),
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    good, bad = jsonl.load(spark, str(path))
    rows = {r[1]: r for r in plain(good)}
    assert bad.count() == 3 and len(rows) == 3
    assert rows["print(1)"][:6] == ("k1", "print(1)", ["a"], "", "2024-01-01", 3) and json.loads(rows["print(1)"][7]) == {"tags": ["x", 1], "nested": {"é": 1.5}}
    assert rows["print('日本')"][0] == "k2" and rows["print('日本')"][5:7] == (1, "data")
    assert rows["no id"][0].startswith("py-")
    jsonl.write(good, str(tmp_path / "out"))
    again, none = jsonl.load(spark, str(tmp_path / "out"))
    assert sorted(plain(again), key=str) == sorted(plain(good), key=str) and none.count() == 0
    assert jsonl.load(spark, str(tmp_path / "missing.jsonl"))[0].count() == 0
    assert "日本" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))


def test_numbered_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("\n".join(f"{name} {k}" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5003 and all(r.value.split()[1] == str(r.line) for r in rows)


def test_files(spark, tmp_path):
    fs = files.FileSystem(spark)
    base = str(tmp_path / "d")
    fs.makedirs(base)
    (tmp_path / "d" / "x.csv").write_text('a,b\n1,"two\nlines"\n2,"q""uote"\n')
    (tmp_path / "d" / "y.json").write_text('{"a": 1}')
    assert fs.isdir(base) and fs.isfile(f"{base}/x.csv") and not fs.exists(f"{base}/z") and fs.listdir(base) == ["x.csv", "y.json"]
    assert [tuple(r) for r in files.read_csv(spark, f"{base}/x.csv").collect()] == [("1", "two\nlines"), ("2", 'q"uote')]
    assert files.read_json(spark, f"{base}/y.json", "a int").first().a == 1
    assert {r.name: r.size for r in files.listing(spark, base).collect()} == {n: fs.getsize(f"{base}/{n}") for n in ("x.csv", "y.json")}
    assert [r.name for r in files.listing(spark, base, glob="*.csv").collect()] == ["x.csv"]
    before = spark.createDataFrame(files.fingerprints(spark, base).collect())
    (tmp_path / "d" / "y.json").write_text('{"a": 2}')
    fs.copy(f"{base}/x.csv", f"{base}/w.csv")
    changes = {(r.path.rsplit("/", 1)[1], r.change) for r in files.collateral(before, files.fingerprints(spark, base)).collect()}
    assert changes == {("y.json", "changed"), ("w.csv", "created")}
    fs.rename(f"{base}/w.csv", f"{base}/v.csv")
    fs.remove(f"{base}/v.csv")
    with pytest.raises(FileNotFoundError):
        fs.remove(f"{base}/v.csv")
    with pytest.raises(OSError):
        fs.rmdir(base)
    fs.rmtree(base)
    assert not fs.exists(base)


@pytest.mark.parametrize("piece", ["\n" * 100_000, " " * 100_000, "a" + " " * 50_000 + "b" + "\n \t" * 30_000 + "c"])
def test_normalise_is_linear(spark, piece):
    import time

    text = f"x{piece}y  \n\n \t\n"
    df = spark.createDataFrame([(text,)], "t string")
    df.select(corpus.normalise(F.lit("a"))).first()
    began = time.time()
    got = df.select(corpus.normalise(F.col("t")).alias("t")).first().t
    assert time.time() - began < 3
    lines = [x.rstrip(" \t") for x in text.split("\n")]
    while lines and not lines[-1].strip():
        lines.pop()
    assert got == "\n".join(lines)


def test_line_numbers_do_not_depend_on_how_a_file_is_split(spark, tmp_path):
    from lathe.sources import jsonl

    for name, n in (("a.txt", 5000), ("b.txt", 7), ("c.txt", 1)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1kb", "10kb", "1gb"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = jsonl.numbered_lines(spark, str(tmp_path)).collect()
            assert len(rows) == 5008 and all(r.value == f"{r.file.rsplit('/', 1)[1]} {r.line}" for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
