import json

from pyspark.sql import functions as F

from lathe.operators import corpus, harvest
from lathe.operators.extraction import extract, programs, shell_words, split_heredocs
from lathe.operators.redaction import UNSAFE, has_residue, redact_arguments, redact_text, secret_values
from lathe.sources import jsonl
from lathe.streaming import capture

LONG = "a1b2c3d4e5f6a7b8c9d0e1f2"


def test_redaction_labels_and_markers():
    cases = {
        'password = "hunter2"': ('password = "[REDACTED password 7 chars]"', ["password"]),
        "TOKEN=abc123": ("TOKEN=[REDACTED-token-6-chars]", ["token"]),
        "run --api-key xyz now": ("run --api-key [REDACTED-api_key-3-chars] now", ["api_key"]),
        "Authorization: Bearer abcd.efgh": ("Authorization: Bearer [REDACTED-bearer-9-chars]", ["bearer"]),
        "AKIA" + "A" * 16: ("[REDACTED-AKIA-20-chars]", ["AKIA"]),
        "ghp_" + "a" * 20: ("[REDACTED-ghp_-24-chars]", ["ghp_"]),
        "nothing to see": ("nothing to see", []),
        "": ("", []),
    }
    for text, want in cases.items():
        got = redact_text(text)
        assert got == want, text
        assert redact_text(got[0])[0] == got[0]


def test_environment_values_and_residue():
    env = {"API_TOKEN": "s3cr3t-value-long", "PATH_KEY": "/etc/key/file.pem", "TOKEN_URL": "https://x.y/zzzzzz", "AUTH_EMAIL": "someone@example.com", "N_TOKEN": "123456789012345", "SHORT_KEY": "abc", "PLAIN": "s3cr3t-value-long2"}
    assert secret_values(env) == [("API_TOKEN", "s3cr3t-value-long")]
    assert redact_text("x s3cr3t-value-long y", secret_values(env))[0] == "x [REDACTED env API_TOKEN 17 chars] y"
    assert has_residue(f"token is {LONG}") and not has_residue("token is SOME_LONG_VARIABLE_NAME_HERE_X") and not has_residue(LONG)
    assert redact_text(f"token is {LONG}")[1] == [UNSAFE]
    assert redact_arguments(["--password", "hunter2", "x"]) == (["--password", "[REDACTED-argv-value-7-chars]", "x"], ["argv value"])


def test_shell_words_and_heredocs():
    assert shell_words("""a 'b c' "d \\"e\\" $f" g\\ h; i && j|k""") == ["a", "b c", 'd "e" $f', "g h", ";", "i", "&&", "j", "|", "k"]
    body = "cat <<EOF | x\nline 1\n  EOF\npython3 - <<-'PY'\n\tprint(1)\n\tPY\ntail"
    plain, found = split_heredocs(body)
    assert [(n, b) for n, b, _ in found] == [("EOF", "line 1"), ("PY", "print(1)")] and plain.endswith("tail") and "<<<" not in plain
    assert split_heredocs("cat <<<word")[1] == []


def test_programs():
    cases = {
        "python3 -c 'print(1)' a b | sort": [("print(1)", ["a", "b"])],
        'uv run python -u -c "x" ; /usr/bin/python3.12 -c y': [("x", []), ("y", [])],
        "python -m json.tool": [],
        "python script.py -c no": [],
        "echo python -c": [],
        "python3 <<'EOF'\nprint(2)\nEOF": [("print(2)", [])],
        "cat <<PY\nz\nPY": [("z", [])],
        "cat <<EOF\nnot python\nEOF": [],
        "": [],
    }
    for command, want in cases.items():
        assert list(programs(command)) == want, command


def log_lines():
    return [
        dict(kind="python_invocation", session="s1", ts="2024-01-02", program="print(1)  ", argv_tail=["a"]),
        {"ts": "2024-01-01", "kind": "bash_command", "session": "s1", "command": "python -c 'print(1)' && python -c 'print(2)'"},
        dict(kind="python_invocation", program="  "),
        {"kind": "exit", "session": "s1"},
        dict(kind="python_invocation", program="print(3)", argv_tail="bad"),
    ]


def test_log_to_sightings_whatever_the_order(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join([*map(json.dumps, log_lines()), "", '{"half": '], ))
    rows = jsonl.numbered_lines(spark, str(tmp_path / "log"))
    found = harvest.occurrences(rows)
    assert {r.occ_key for r in found.collect()} == {"shim:s1#1", "hook:s1#2#0", "hook:s1#2#1", "shim:invocations#5"}
    once = sorted(map(str, harvest.aggregate(found).collect()))
    twice = sorted(map(str, harvest.aggregate(found.unionByName(found).repartition(3)).collect()))
    assert once == twice
    by = {r.program.strip(): r for r in harvest.aggregate(found).collect()}
    assert by["print(1)"]["count"] == 2 and by["print(1)"].source == "shim" and by["print(1)"].first_seen == "2024-01-01" and by["print(1)"].argv_tail == ["a"]


def sighting(spark, rows):
    return spark.createDataFrame(rows, "key string, program string, argv_tail array<string>, source string, session string, first_seen string, count long, stdin_sample string")


def test_combine_is_idempotent_and_keeps_everything(spark):
    old = sighting(spark, [("a", "old", [], "hook", None, "2024-02-01", 3, None), ("b", "only old", [], "shim", "s", "", 1, None)])
    new = sighting(spark, [("a", "new", ["x"], "shim", "t", "2024-01-01", 2, "in"), ("c", "only new", [], "hook", None, "", 1, None)])
    got = {r.key: r for r in harvest.combine(old, new).collect()}
    assert tuple(got["a"])[1:] == ("old", ["x"], "shim", "t", "2024-01-01", 3, "in") and set(got) == {"a", "b", "c"}
    again = harvest.combine(harvest.combine(old, new), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_clean_names_a_reason(spark):
    rows = [
        ("k", "print(1)", [], "shim", None, "", 1, None), ("k", "pass\n\n", [], "shim", None, "", 1, None), ("k", " \n", [], "shim", None, "", 1, None), ("k", "known()", [], "shim", None, "", 1, None),
        ("k", f"token is {LONG}", [], "shim", None, "", 1, None), ("k", "x" * 70_000, [], "shim", None, "", 1, None), ("k", "argv()", ["--token", "v"], "shim", None, "", 1, None),
    ]
    known = spark.createDataFrame([("known()",)], "p string").select(corpus.fingerprint(F.col("p")).alias("id"))
    out = harvest.clean(sighting(spark, rows), known).collect()
    assert sorted((r.program[:8], r.reason) for r in out) == sorted(
        [("print(1)", ""), ("pass\n\n", "trivial"), (" \n", "empty"), ("known()", "known"), ("token is", "unredactable"), ("x" * 8, "oversized"), ("argv()", "")]
    )
    tail = next(r for r in out if r.program == "argv()")
    assert tail.argv_tail == ["--token", "[REDACTED-argv-value-1-chars]"] and tail.hits == ["argv value"]


def test_fold_into_corpus_never_deletes(spark):
    base = spark.createDataFrame([("a", "p", [], "s", "2024-05-01", 2, None)], "id string, program string, argv_tail array<string>, source string, first_seen string, count long, stdin_sample string").withColumn("extra", F.lit(None).cast("variant"))
    new = sighting(spark, [("a", "other", [], "shim", None, "2024-04-01", 9, None), ("n", "q", [], "shim", None, "", 1, None)])
    got = {r.id: r for r in harvest.fold_into_corpus(base, new).drop("extra").collect()}
    assert got["a"].program == "p" and got["a"]["count"] == 9 and got["a"].first_seen == "2024-04-01" and got["n"].program == "q"


def test_lateral_extraction_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "python -c 'a' x; python -c b"), (2, "ls"), (3, None)], "id int, cmd string")
    assert sorted((r.id, r.idx, r.program, r.argv_tail) for r in extract(rows, "cmd").collect()) == [(1, 0, "a", ["x"]), (1, 1, "b", [])]


def test_session_filename(spark):
    frame = spark.createDataFrame([("a/b c",), (None,), ("",), ("x" * 100,)], "s string").select(harvest.session_filename(F.col("s")).alias("f"))
    assert [r.f for r in frame.collect()] == ["a_b_c.jsonl", "unknown.jsonl", "unknown.jsonl", "x" * 80 + ".jsonl"]


def test_capture_stream_is_replay_safe(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    event = lambda command, **k: json.dumps({"tool_name": "Bash", "session_id": "s", "ts": "2024-01-01", "tool_input": {"command": command}, **k})
    (tmp_path / "in" / "1.txt").write_text("\n".join([event("python -c 'print(1)'"), event("ls"), event("python x", tool_name="Read"), "not json", "[1]"]))
    capture.ingest(spark, source, target, mark)
    (tmp_path / "in" / "2.txt").write_text(event("python3 -c 'print(2)'"))
    capture.ingest(spark, source, target, mark)
    capture.ingest(spark, source, target, mark)
    assert spark.read.parquet(f"{target}/records").count() == 2 and spark.read.parquet(f"{target}/quarantine").count() == 2
    assert {r.program for r in capture.sightings(spark, target).collect()} == {"print(1)", "print(2)"}


def test_running_counts_of_a_stream(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    want = {(r.start, r.event_type, r["count"]) for r in capture.running_counts(events, "ts", "event_type").collect()}
    schema = events.schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(tiny)
    q = capture.running_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("lathe_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.event_type, r["count"]) for r in spark.table("lathe_counts").collect()} == want
