"""From capture logs to published sightings: occurrences, aggregation, cleaning, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.corpus import content_key, fingerprint, normalise
from lathe.operators.extraction import extract, looks_pythonish
from lathe.operators.redaction import is_safe, redact, redact_argv

MAX_PROGRAM_BYTES = 64 * 1024
#: Sources by how directly they saw a program.
SOURCES = dict(transcript=1, hook=2, shim=3)
LOG = "kind string, ts string, session string, command string, program string, argv_tail array<string>"
OCCURRENCE = ["occ_key", "program", "argv_tail", "source", "session", "ts"]


def source_rank(source: Column) -> Column:
    out = F.lit(0)
    for name, value in SOURCES.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def session_filename(session: Column) -> Column:
    name = F.left(F.regexp_replace(F.coalesce(session, F.lit("unknown")), "[^-._A-Za-z0-9]", "_"), F.lit(80))
    return F.concat(F.when(name == "", "unknown").otherwise(name), F.lit(".jsonl"))


def occurrences(log: DataFrame) -> DataFrame:
    """Occurrences (occ_key, program, argv_tail, source, session, ts) in log lines (line, value).

    A line that is no JSON object is lost, not an error. The key names feed,
    session and line, so that reading a log twice counts nothing twice.
    """
    records = log.select("line", F.from_json("value", LOG).alias("r")).select("line", "r.*")
    session = F.when(F.col("session") != "", F.col("session"))
    place = F.concat(F.coalesce(session, F.lit("invocations")), F.lit("#"), F.col("line").cast("string"))
    records = records.select(
        "*", session.alias("s"), F.coalesce("ts", F.lit("")).alias("t"), place.alias("place"), F.coalesce("argv_tail", F.array().cast("array<string>")).alias("tail")
    )
    direct = records.where("kind = 'python_invocation' and trim(program) <> ''").select(
        F.concat(F.lit("shim:"), "place").alias("occ_key"), "program", F.col("tail").alias("argv_tail"), F.lit("shim").alias("source"), F.col("s").alias("session"), F.col("t").alias("ts")
    )
    shell = records.where("kind = 'bash_command' and command is not null").select("place", "command", F.col("s").alias("session"), F.col("t").alias("ts"))
    embedded = extract(shell, "command").select(
        F.concat(F.lit("hook:"), "place", F.lit("#"), F.col("idx").cast("string")).alias("occ_key"), "program", "argv_tail", F.lit("hook").alias("source"), "session", "ts"
    )
    return direct.unionByName(embedded)


def aggregate(found: DataFrame) -> DataFrame:
    """One sighting per program key: distinct occurrences, the first occurrence's text and session."""
    once = found.groupBy("occ_key").agg(F.min(F.struct("program", "argv_tail", "source", "session", "ts")).alias("o")).select("occ_key", "o.*")
    tail = F.min_by(F.when(F.size("argv_tail") > 0, F.col("argv_tail")), F.when(F.size("argv_tail") > 0, F.col("occ_key")))
    first = F.min_by(F.struct("program", "session"), F.col("occ_key"))
    grouped = once.groupBy(fingerprint(F.col("program")).alias("key")).agg(
        first.alias("f"),
        F.coalesce(tail, F.array().cast("array<string>")).alias("argv_tail"),
        F.max_by("source", F.struct(source_rank(F.col("source")), "source")).alias("source"),
        F.coalesce(F.min(F.when(F.col("ts") != "", F.col("ts"))), F.lit("")).alias("first_seen"),
        F.count("*").alias("count"),
    )
    return grouped.select("key", "f.program", "argv_tail", "source", "f.session", "first_seen", "count", F.lit(None).cast("string").alias("stdin_sample"))


def known_keys(corpus: DataFrame) -> DataFrame:
    """(id) of every entry: as stored, and recomputed from its text."""
    return corpus.select("id").unionByName(corpus.select(fingerprint(F.col("program")).alias("id"))).where("id is not null").distinct()


def _empty_or_trivial(program: Column) -> Column:
    """empty, trivial (nothing but pass), or an empty string."""
    text = normalise(F.coalesce(program, F.lit("")))
    trivial = text.rlike(r"(?U)\A\s*pass\s*(?:\n\s*pass\s*)*\z")
    return F.when(text == "", "empty").when(trivial, "trivial").otherwise("")


def reject_reason(program: Column, known: Column) -> Column:
    """Why a program is not worth publishing: empty, trivial, known; else an empty string."""
    plain = _empty_or_trivial(program)
    return F.when(plain != "", plain).when(known, "known").otherwise("")


def with_reason(rows: DataFrame, program: str, known: DataFrame) -> DataFrame:
    """The rows with ``reason``; known keys are looked up by a join, whose side Spark chooses by size.

    What depends on the text alone is computed in one projection before the
    join, where the normalised text is shared.
    """
    keyed = rows.withColumns({"__key": fingerprint(F.col(program)), "__plain": _empty_or_trivial(F.col(program))})
    marked = keyed.join(known.select(F.col("id").alias("__known")).distinct(), F.col("__key") == F.col("__known"), "left")
    reason = F.when(F.col("__plain") != "", F.col("__plain")).when(F.col("__known").isNotNull(), "known").otherwise("")
    return marked.withColumn("reason", reason).drop("__key", "__known", "__plain")


def interesting(rows: DataFrame, program: str, known: DataFrame) -> DataFrame:
    return with_reason(rows, program, known).where("reason = ''").drop("reason")


def clean(sightings: DataFrame, known: DataFrame, secrets: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Sightings redacted and keyed anew, with ``hits`` and the ``reason`` why one must not be published."""
    red = sightings.withColumn("p", redact(F.col("program"), secrets)).withColumn("a", redact_argv(F.col("argv_tail"), secrets))
    red = red.withColumns({"program": F.col("p.text"), "argv_tail": F.col("a.argv")})
    checked = with_reason(red, "program", known)
    reason = (
        F.when(~is_safe(F.col("p.hits")), "unredactable")
        .when(F.octet_length("program") > MAX_PROGRAM_BYTES, "oversized")
        .when(F.col("reason") != "", F.col("reason"))
        .when(~is_safe(F.col("a.hits")), "unredactable")
        .otherwise("")
    )
    return checked.withColumns({"reason": reason, "hits": F.concat("p.hits", "a.hits"), "key": fingerprint(F.col("program"))}).drop("p", "a")


def combine(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Keyed upsert: nothing is deleted; counts take the larger, dates the earlier, the stored text wins.

    Idempotent: counts on both sides come from the same occurrences.
    """
    fields = "program argv_tail source session first_seen count stdin_sample".split()

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.struct(*fields).alias(name))

    both = side(old, "o").join(side(new, "n"), key, "full")
    o, n = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"n.{f}"))
    dates = [F.when(c != "", c) for c in (o("first_seen"), n("first_seen"))]
    some = lambda c: F.when(F.size(c) > 0, c)
    return both.select(
        key,
        F.when(F.col("o").isNotNull(), o("program")).otherwise(n("program")).alias("program"),
        F.coalesce(some(o("argv_tail")), some(n("argv_tail")), F.array().cast("array<string>")).alias("argv_tail"),
        F.when(F.col("n").isNull() | (F.col("o").isNotNull() & (source_rank(o("source")) >= source_rank(n("source")))), o("source")).otherwise(n("source")).alias("source"),
        F.coalesce(F.when(o("session") != "", o("session")), n("session")).alias("session"),
        F.coalesce(F.least(*dates), F.lit("")).alias("first_seen"),
        F.greatest(o("count"), n("count")).alias("count"),
        F.coalesce(o("stdin_sample"), n("stdin_sample")).alias("stdin_sample"),
    )


def fold_into_corpus(corpus: DataFrame, sightings: DataFrame) -> DataFrame:
    """MERGE of sightings into a corpus: new ids are inserted, counts and dates of old ones updated."""
    incoming = sightings.select(
        F.coalesce("key", content_key(F.col("program"))).alias("id"), *[F.col(c).alias(f"n_{c}") for c in "program argv_tail source first_seen count stdin_sample".split()]
    )
    both = corpus.join(incoming, "id", "full")
    dates = [F.when(F.col(c) != "", F.col(c)) for c in ("first_seen", "n_first_seen")]
    return both.select(
        "id",
        F.coalesce("program", "n_program").alias("program"),
        F.coalesce("argv_tail", "n_argv_tail").alias("argv_tail"),
        F.coalesce("source", "n_source").alias("source"),
        F.coalesce(F.least(*dates), F.lit("")).alias("first_seen"),
        F.greatest("count", "n_count").alias("count"),
        F.coalesce("stdin_sample", "n_stdin_sample").alias("stdin_sample"),
        "extra",
    )


TRANSCRIPT = "timestamp string, message struct<content: array<struct<type: string, name: string, id: string, input: struct<command: string>>>>"


def transcript_occurrences(lines: DataFrame) -> DataFrame:
    """Occurrences in transcript lines (file, value): shell commands that a message's content asked for.

    The key holds the request's own id, so a file read twice counts once. Lines
    of another shape give nothing.
    """
    events = lines.select(F.substring_index("file", "/", -1).alias("file"), F.from_json("value", TRANSCRIPT).alias("e"))
    blocks = events.select("file", F.coalesce("e.timestamp", F.lit("")).alias("ts"), F.explode("e.message.content").alias("b"))
    wanted = blocks.where((F.col("b.type") == "tool_use") & (F.col("b.name") == "Bash") & looks_pythonish(F.col("b.input.command")))
    place = F.concat_ws("#", F.concat(F.lit("transcript:"), "file"), F.coalesce("b.id", F.lit("noid")))
    commands = wanted.select(place.alias("place"), F.col("b.input.command").alias("command"), "ts", F.regexp_replace("file", r"\.jsonl$", "").alias("session"))
    found = extract(commands, "command")
    return found.select(F.concat_ws("#", "place", F.col("idx").cast("string")).alias("occ_key"), "program", "argv_tail", F.lit("transcript").alias("source"), "session", "ts")


def collect(*sightings: DataFrame) -> DataFrame:
    """Sightings of several feeds by key, combined from left to right."""
    return reduce(combine, sightings)


def export(sightings: DataFrame, known: DataFrame, published: DataFrame | None, secrets: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, counts of dropped rows by reason): clean sightings upserted into the published ones.

    Only rows of sessions in which something changed are returned, for a
    dynamic partition overwrite by session; a second run returns none.
    """
    checked = clean(sightings, known, secrets).withColumn("session", F.coalesce(F.when(F.col("session") != "", F.col("session")), F.lit("unknown")))
    dropped = checked.where("reason <> ''").groupBy("reason").agg(F.count("*").alias("rows"))
    kept = checked.where("reason = ''").drop("reason", "hits").withColumn("key", F.struct("session", "key"))
    if published is None:
        return kept.withColumn("key", F.col("key.key")), dropped
    before = published.withColumn("key", F.struct("session", "key")).select(*kept.columns)
    after = combine(before, kept)
    changed = after.exceptAll(before).select(F.col("key.session").alias("session")).distinct()
    return after.withColumn("key", F.col("key.key")).join(changed, "session", "left_semi").select(*published.columns), dropped
