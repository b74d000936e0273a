"""The library's queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions import collections as py_list
from lathe.functions import dates, formatting, numbers, paths, regex, strings, text, web
from lathe.operators import corpus, fuzz, gate, grading, harvest, programs, redaction, relational, timing
from lathe.operators.extraction import extract, looks_pythonish
from lathe.plans.compiler import compile_expression
from lathe.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# DuckDB has no function for the normalisation rule; as macros are not at hand, it is a text to paste
NORMALISED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^(\\s*\\n)+', ''), '(\\n\\s*)+$', '')"
)
KEY = "'py-' || substring(sha256(" + NORMALISED + "), 1, 12)"

# corpus


@query(f"SELECT {KEY.format('text')} AS id, count(*) AS count, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_by_key(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dedupe_by_key(table(spark, d, "documents"), corpus.fingerprint(F.col("text")), "doc_id")


@query("SELECT text, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    copies = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return copies.where("copies > 1")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        corpus.content_key(F.col("text")).alias("id"), F.col("text").alias("program"), F.array("lang").alias("argv_tail"), "source",
        F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1).alias("first_seen"), F.lit(1).cast("long").alias("count"),
        F.lit(None).cast("string").alias("stdin_sample"), F.lit(None).cast("variant").alias("extra"),
    )


_ENTRIES = "SELECT 'py-' || substring(sha256(text), 1, 12) AS id, text AS program, lang, source, printf('2024-01-%02d', doc_id % 28 + 1) AS first_seen FROM documents"


@query(
    f"""WITH e AS (SELECT DISTINCT * FROM ({_ENTRIES})),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_seen, source, lang, program) AS k FROM e)
    SELECT id, max(CASE WHEN k = 1 THEN program END) AS program, max(CASE WHEN k = 1 THEN source END) AS source, min(first_seen) AS first_seen, CAST(count(*) AS BIGINT) AS count
    FROM r GROUP BY id"""
)
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return corpus.merge(entries.where("source < 'src5'"), entries.where("source >= 'src5'")).select("id", "program", "source", "first_seen", "count")


@query("SELECT count(*) AS entries, CAST(sum(1) AS BIGINT) AS occurrences, count(*) FILTER (len(regexp_extract_all(text, chr(10))) + (CASE WHEN text = '' OR text[-1] = chr(10) THEN 0 ELSE 1 END) <= 1) AS oneliners, count(*) AS with_argv, CAST(0 AS BIGINT) AS with_stdin, CAST(max(length(text)) AS INTEGER) AS longest FROM documents")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return corpus.profile(_entries(spark, d))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def profile_histograms(spark: SparkSession, d: str) -> DataFrame:
    return corpus.histograms(table(spark, d, "documents"), "lang", "source")


@query("SELECT lang, count(*) AS count, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def profile_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("count"), F.sum("n_chars").alias("chars"))


@query("SELECT source, count(*) AS count, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY source")
def profile_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("count"), F.max("n_chars").alias("longest"))


@query(
    """WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)
    SELECT lang, v[least(CAST(floor(0.5 * len(v)) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(0.9 * len(v)) AS BIGINT), len(v) - 1) + 1] AS p90,
    v[least(CAST(floor(0.99 * len(v)) AS BIGINT), len(v) - 1) + 1] AS p99 FROM s"""
)
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.percentiles(table(spark, d, "documents"), "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "lang")


@query("SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY count DESC, word LIMIT 50")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return corpus.top_counts(words, "word", 50)


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, chr(10))) + (CASE WHEN text = '' OR text[-1] = chr(10) THEN 0 ELSE 1 END) AS BIGINT) AS lines, contains(text, chr(10)) = false AS oneliner FROM documents")
def oneliner_split(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", corpus.line_count(x).alias("lines"), corpus.is_oneliner(x).alias("oneliner"))


@query("SELECT lang, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", F.round(corpus.share(F.col("n")), 6).alias("share"))


# numbers

_SIGNED = "(l_orderkey % 19 - 9)"


def _ints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 19 - 9).alias("a"), F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("long").alias("b"))


_B = "(CASE WHEN l_linenumber % 2 = 0 THEN -l_linenumber ELSE l_linenumber END)"


@query(f"SELECT l_orderkey, l_linenumber, CAST(floor({_SIGNED} / CAST({_B} AS DOUBLE)) AS BIGINT) AS quotient FROM lineitem")
def floor_div(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("l_orderkey", "l_linenumber", numbers.floor_div(F.col("a"), F.col("b")).alias("quotient"))


@query(f"SELECT l_orderkey, l_linenumber, CAST({_SIGNED} - {_B} * floor({_SIGNED} / CAST({_B} AS DOUBLE)) AS BIGINT) AS remainder FROM lineitem")
def py_mod(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("l_orderkey", "l_linenumber", numbers.mod(F.col("a"), F.col("b")).alias("remainder"))


@query(f"SELECT l_orderkey, l_linenumber, {_SIGNED} / CAST({_B} AS DOUBLE) AS quotient FROM lineitem")
def true_div(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("l_orderkey", "l_linenumber", numbers.true_div(F.col("a"), F.col("b")).alias("quotient"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(CAST(pow({_SIGNED}, l_linenumber) AS HUGEINT) AS BIGINT) AS power FROM lineitem")
def int_pow(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("l_orderkey", "l_linenumber", numbers.int_pow(F.col("a"), F.col("l_linenumber")).alias("power"))


@query("SELECT o_orderkey, round_even(o_totalprice, 0) AS rounded FROM orders")
def round_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.round_(F.col("o_totalprice"), 0).alias("rounded"))


@query(f"SELECT l_orderkey, l_linenumber, {_SIGNED} & l_linenumber AS band, {_SIGNED} | l_linenumber AS bor, xor({_SIGNED}, l_linenumber) AS bxor, (l_orderkey << l_linenumber) AS shl, ({_SIGNED} >> l_linenumber) AS shr FROM lineitem")
def bit_operations(spark: SparkSession, d: str) -> DataFrame:
    a, n = F.col("a"), F.col("l_linenumber").cast("long")
    return _ints(spark, d).select(
        "l_orderkey", "l_linenumber", a.bitwiseAND(n).alias("band"), a.bitwiseOR(n).alias("bor"), a.bitwiseXOR(n).alias("bxor"),
        numbers.left_shift(F.col("l_orderkey"), n).alias("shl"), numbers.right_shift(a, n).alias("shr"),
    )


@query("SELECT l_orderkey, l_linenumber, 5 <= l_quantity AND l_quantity < 25 AS inside FROM lineitem")
def chained_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.between_chain(5, F.col("l_quantity"), 25).alias("inside"))


@query("SELECT p_partkey, CASE WHEN p_size <> 0 THEN CAST(p_size AS BIGINT) ELSE p_partkey END AS either, CASE WHEN p_size % 2 <> 0 THEN p_partkey ELSE CAST(p_size % 2 AS BIGINT) END AS both FROM part")
def boolean_operands(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", numbers.or_(size, key, "bigint").alias("either"), numbers.and_(size % 2, key, "bigint").alias("both"))


@query("SELECT p_partkey, CAST(substring(p_type, 1, 1) || CAST(p_size AS VARCHAR) AS VARCHAR) AS label, CAST(p_size AS BIGINT) AS parsed, '0x' || lower(hex(p_partkey)) AS hexed, CAST(ord(p_type) AS INTEGER) AS code FROM part")
def parse_and_base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.concat(F.left("p_type", F.lit(1)), F.col("p_size").cast("string")).alias("label"), numbers.parse_int(F.concat(F.lit("  +"), F.col("p_size").cast("string"), F.lit("\n"))).alias("parsed"),
        numbers.to_base(F.col("p_partkey"), 16).alias("hexed"), numbers.ord_(F.left("p_type", F.lit(1))).alias("code"),
    )


@query("SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed FROM orders")
def format_fixed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", formatting.fixed(F.col("o_totalprice"), 2).alias("fixed"))


@query("SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS shown FROM orders")
def float_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", formatting.float_repr(F.col("o_totalprice")).alias("shown"))


# strings


@query("SELECT doc_id, len(w) AS words, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda v: v <> '') AS w FROM documents)")
def str_split_ws(spark: SparkSession, d: str) -> DataFrame:
    w = strings.split(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("words"), F.try_element_at("w", F.lit(1)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word")
    )


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS head, CASE WHEN contains(p_type, ' ') THEN ' ' ELSE '' END AS sep, CASE WHEN contains(p_type, ' ') THEN substring(p_type, instr(p_type, ' ') + 1) ELSE '' END AS tail FROM part")
def str_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", strings.partition(F.col("p_type"), " ").alias("p")).select("p_partkey", "p.*")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS INTEGER) AS n, CAST(instr(text, 'the') - 1 AS INTEGER) AS at FROM documents".replace("AS at", 'AS "at"'))
def str_count_find(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", strings.count(x, "th").alias("n"), strings.find(x, "the").alias("at"))


@query("SELECT p_partkey, CASE WHEN length(p_name) < 24 THEN rpad(p_name, 24, '.') ELSE p_name END AS l, CASE WHEN length(p_name) < 24 THEN lpad(p_name, 24, '.') ELSE p_name END AS r, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS z FROM part")
def str_pad(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", strings.ljust(x, 24, ".").alias("l"), strings.rjust(x, 24, ".").alias("r"), strings.zfill(F.col("p_partkey").cast("string"), 8).alias("z"))


@query("SELECT doc_id, upper(substring(lang, 1, 1)) || lower(substring(lang, 2)) AS cap, lang = lower(lang) AS low, regexp_full_match(lang, '\\p{L}+') AS alpha, starts_with(text, 'The') OR starts_with(text, 'Is') AS opens, CASE WHEN starts_with(source, 'src') THEN substring(source, 4) ELSE source END AS cut FROM documents")
def str_predicates(spark: SparkSession, d: str) -> DataFrame:
    lang, x, s = F.col("lang"), F.col("text"), F.col("source")
    return table(spark, d, "documents").select(
        "doc_id", strings.capitalize(lang).alias("cap"), strings.islower(lang).alias("low"), strings.isalpha(lang).alias("alpha"), strings.startswith(x, "The", "Is").alias("opens"), strings.removeprefix(s, "src").alias("cut")
    )


@query("SELECT p_partkey, reverse(p_name) AS backwards, p_name[2:4] AS piece, p_name[-3:] AS ending FROM part")
def slice_step(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", strings.slice_(x, None, None, -1).alias("backwards"), strings.slice_(x, 1, 4).alias("piece"), strings.slice_(x, -3).alias("ending"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, trim(split_part(text, chr(10), 1), ' .') AS first_line, replace(left(text, 200), 'th', 'TH') AS shouted FROM documents")
def str_lines_strip_replace(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    lines = strings.split(x, "\n")
    return table(spark, d, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("lines"), strings.strip(F.try_element_at(lines, F.lit(1)), " .").alias("first_line"), strings.replace(F.left(x, F.lit(200)), "th", "TH").alias("shouted")
    )


# arrays, dicts, sets


@query("SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda v: v > 0), lambda v: CAST(v AS DOUBLE) * 2)), 6) AS total, len(list_filter(embedding, lambda v: v > 0)) AS kept FROM embeddings")
def comprehension_filter_map(spark: SparkSession, d: str) -> DataFrame:
    kept = py_list.comprehension(F.col("embedding"), lambda v: v.cast("double") * 2, lambda v: v > 0)
    return table(spark, d, "embeddings").select("vec_id", F.round(py_list.sum_(kept, F.lit(0.0)), 6).alias("total"), F.size(kept).cast("long").alias("kept"))


@query("SELECT n_nationkey, r_name, n_name FROM nation, region WHERE n_regionkey = r_regionkey AND length(n_name) > length(r_name)")
def comprehension_join(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    wanted = (F.col("n_regionkey") == F.col("r_regionkey")) & (F.length("n_name") > F.length("r_name"))
    return relational.nested_loops(nation, region, wanted).select("n_nationkey", "r_name", "n_name")


@query("SELECT s_suppkey, p_partkey FROM supplier, part WHERE s_suppkey * 3 < p_size")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    supplier, part = table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select("p_partkey", "p_size")
    return relational.nested_loops(supplier, part, less=(F.col("s_suppkey") * 3, F.col("p_size"))).select("s_suppkey", "p_partkey")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS pos FROM customer")
def enumerate_rows(spark: SparkSession, d: str) -> DataFrame:
    return relational.enumerate_rows(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), "c_custkey", start=1).select("c_custkey", "pos")


@query("SELECT a.s_suppkey, b.c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos FROM customer) b ON a.pos = b.pos")
def zip_rows(spark: SparkSession, d: str) -> DataFrame:
    a = relational.enumerate_rows(table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "pos")
    b = relational.enumerate_rows(table(spark, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "pos")
    return relational.zip_rows(a, b).select("s_suppkey", "c_custkey")


@query(
    """SELECT c_mktsegment, arg_min(c_custkey, struct_pack(a := c_nationkey, b := c_custkey)) AS first_min, arg_max(c_custkey, struct_pack(a := c_nationkey, b := -c_custkey)) AS first_max
    FROM customer GROUP BY c_mktsegment"""
)
def min_max_key_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", F.col("c_custkey").alias("k"))
    low = relational.first_by(rows, ["c_mktsegment"], "c_nationkey", "k").select("c_mktsegment", F.col("k").alias("first_min"))
    high = relational.first_by(rows, ["c_mktsegment"], "c_nationkey", "k", largest=True).select("c_mktsegment", F.col("k").alias("first_max"))
    return low.join(high, "c_mktsegment")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS BIGINT) AS pos FROM part QUALIFY pos <= 100")
def sorted_reverse_ties(spark: SparkSession, d: str) -> DataFrame:
    top = relational.sort_rows(table(spark, d, "part"), "p_size", "p_partkey", reverse=True).limit(100)
    return relational.enumerate_rows(top.select("p_partkey", "p_size"), F.desc("p_size"), "p_partkey", start=1).select("p_partkey", "pos")


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).where("k < 18"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).where("k > 4")


_A, _S = "SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 18", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 4"


@query(f"{_A} UNION {_S}")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_set(*_keys(spark, d))


@query(f"{_A} INTERSECT {_S}")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return relational.intersection(*_keys(spark, d))


@query(f"{_A} EXCEPT {_S}")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return relational.difference(*_keys(spark, d))


@query(f"({_A} EXCEPT {_S}) UNION ({_S} EXCEPT {_A})")
def set_symdiff(spark: SparkSession, d: str) -> DataFrame:
    return relational.symmetric_difference(*_keys(spark, d))


@query(f"SELECT (SELECT count(*) FROM ({_A} EXCEPT SELECT n_nationkey FROM nation)) = 0 AS is_subset")
def subset_test(spark: SparkSession, d: str) -> DataFrame:
    return relational.is_subset(_keys(spark, d)[0], table(spark, d, "nation").select(F.col("n_nationkey").alias("k")))


@query(
    """SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v
    FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey <= 60) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) b ON a.k = b.k"""
)
def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_custkey <= 60").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return relational.merge_dicts(a, b, "k")


@query("SELECT user_id, count(*) AS count, min(event_id) AS first FROM events GROUP BY user_id ORDER BY count DESC, first LIMIT 20")
def counter_most_common(spark: SparkSession, d: str) -> DataFrame:
    return relational.most_common(relational.counter(table(spark, d, "events"), "user_id", "event_id"), 20)


@query(
    """SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) - coalesce(b.n, 0) AS count
    FROM (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1) b ON a.event_type = b.event_type"""
)
def counter_subtract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    even, odd = (relational.counter(e.where(F.col("user_id") % 2 == k), "event_type", "event_id") for k in (0, 1))
    return relational.subtract_counts(even, odd, "event_type")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.5) AS low, round(var_pop(value), 6) AS pvariance, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type")
def stats_by_group(spark: SparkSession, d: str) -> DataFrame:
    s = relational.statistics(table(spark, d, "events"), "value", "event_type")
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "median", "pvariance", "variance", "stdev")]
    return s.select("event_type", "n", F.col("median_low").alias("low"), *rounded)


@query(
    """SELECT c_mktsegment, arg_max(c_nationkey, struct_pack(a := n, b := -f)) AS mode
    FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) GROUP BY c_mktsegment"""
)
def stats_mode(spark: SparkSession, d: str) -> DataFrame:
    return relational.mode(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_mktsegment")


@query("SELECT vec_id, round(list_min(embedding), 6) AS low, round(list_max(embedding), 6) AS high, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at_high, list_bool_or(list_transform(embedding, lambda v: v > 0.5)) AS some, list_bool_and(list_transform(embedding, lambda v: v > -10)) AS every FROM embeddings")
def array_any_all_index(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(F.array_min(e), 6).alias("low"), F.round(F.array_max(e), 6).alias("high"), py_list.index(e, F.array_max(e)).alias("at_high"),
        py_list.any_(e, lambda v: v > 0.5).alias("some"), py_list.all_(e, lambda v: v > -10).alias("every"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(formatting.json_loads(F.col("props")), "$.k", "bigint").alias("k"))


@query("SELECT event_id, '{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS dumped FROM events")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", formatting.json_rewrite(F.col("props")).alias("dumped"))


@query(
    """WITH u AS (SELECT page_id, url, split_part(url, '#', 1) AS nofrag FROM pages)
    SELECT page_id, split_part(url, ':', 1) AS scheme, regexp_extract(nofrag, '^[a-z]+://([^/?]*)', 1) AS netloc, regexp_extract(nofrag, '^[a-z]+://[^/?]*([^?]*)', 1) AS path,
    regexp_extract(nofrag, '[?](.*)$', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM u"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.urlparse(F.col("url")).alias("u")).select("page_id", "u.*")


@query(
    """SELECT page_id, split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v
    FROM (SELECT page_id, unnest(string_split(regexp_extract(split_part(url, '#', 1), '[?](.*)$', 1), '&')) AS kv FROM pages) WHERE kv LIKE '%=_%'"""
)
def query_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = web.parse_qsl(web.urlparse(F.col("url"))["query"])
    return table(spark, d, "pages").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.*")


@query("SELECT page_id, parse_filename(p, false, '/') AS name, regexp_replace(p, '/+[^/]*$', '') AS folder FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages) WHERE p LIKE '/%/%'")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", web.urlparse(F.col("url"))["path"].alias("p")).where("p like '/%/%'")
    return p.select("page_id", paths.basename(F.col("p")).alias("name"), paths.dirname(F.col("p")).alias("folder"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, base64(encode(left(text, 20))) AS b64 FROM documents")
def hash_digests(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[web.digest(x, n).alias(n) for n in ("md5", "sha1", "sha256")], web.b64encode(F.encode(F.left(x, F.lit(20)), "utf-8")).alias("b64"))


@query(
    """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(datediff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS ordinal,
    strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS shown, epoch(o_orderdate) AS stamp FROM orders"""
)
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_orderdate")
    day = x.cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.weekday(day).alias("weekday"), dates.toordinal(day).alias("ordinal"), dates.strftime(x, "%d/%m/%Y %H:%M:%S").alias("shown"), dates.timestamp(x).alias("stamp")
    )


@query("SELECT doc_id, len(m) AS n, array_to_string(m, ' ') AS found FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS m FROM documents)")
def regex_findall(spark: SparkSession, d: str) -> DataFrame:
    found = regex.findall(F.col("text"), "[A-Z][a-z]+")
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("found"))


@query("SELECT doc_id, regexp_replace(left(text, 300), '([a-z]+)ing', '<\\1>', 'g') AS rewritten, regexp_matches(text, '\\d{4}') AS digits FROM documents")
def regex_sub(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", regex.sub(F.left(x, F.lit(300)), "([a-z]+)ing", r"<\1>").alias("rewritten"), regex.search(x, r"\d{4}").alias("digits"))


@query("SELECT doc_id, regexp_replace(left(text, 80), '(^|\\n)([^\\n]*\\S)', '\\1> \\2', 'g') AS quoted FROM documents")
def text_indent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.indent(F.left("text", F.lit(80)), "> ").alias("quoted"))


@query()
def text_wrap_fold(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    wrapped = text.wrap(x, 60)
    return table(spark, d, "documents").select("doc_id", F.size(wrapped).alias("lines"), F.try_element_at(wrapped, F.lit(1)).alias("first"), text.shorten(x, 40).alias("short"), text.normalize(F.left(x, F.lit(50)), "NFD").alias("nfd"))


# harvest


@query()
def redact_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?i)token|secret|passw|api[_-]?key|bearer|AKIA|sk-|gh[prsou]_"))
    red = docs.select("doc_id", redaction.redact(F.col("text")).alias("r"))
    return red.select("doc_id", F.array_join("r.hits", ",").alias("hits"), F.sha2("r.text", 256).alias("digest"), redaction.is_safe(F.col("r.hits")).alias("safe"))


@query(
    f"""WITH k AS (SELECT DISTINCT {KEY.format('text')} AS id FROM benchmark)
    SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN id IN (SELECT id FROM k) THEN 'known' ELSE '' END AS reason
    FROM (SELECT doc_id, {NORMALISED.format('text')} AS n, {KEY.format('text')} AS id FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark))"""
)
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark")
    known = bench.select(corpus.fingerprint(F.col("text")).alias("id"))
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(bench.select((-F.col("item_id") - 1).alias("doc_id"), "text"))
    return harvest.with_reason(rows, "text", known).select("doc_id", "reason")


@query(f"SELECT doc_id FROM documents WHERE {KEY.format('text')} NOT IN (SELECT {KEY.format('text')} FROM documents WHERE doc_id % 3 = 0)")
def anti_known(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    known = docs.where(F.col("doc_id") % 3 == 0).select(corpus.fingerprint(F.col("text")).alias("id")).distinct()
    return docs.withColumn("id", corpus.fingerprint(F.col("text"))).join(known, "id", "left_anti").select("doc_id")


def _sightings(df: DataFrame, source: str, count: str) -> DataFrame:
    return df.select(
        F.col("k").alias("key"), F.col("name").alias("program"), F.array().cast("array<string>").alias("argv_tail"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("session"),
        F.format_string("2024-02-%02d", F.col("k").cast("long") % 28 + 1).alias("first_seen"), F.expr(count).cast("long").alias("count"), F.lit(None).cast("string").alias("stdin_sample"),
    )


@query(
    """SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, b.v) AS program, CASE WHEN b.k IS NOT NULL THEN 'shim' ELSE 'hook' END AS source, printf('2024-02-%02d', coalesce(a.k, b.k) % 28 + 1) AS first_seen,
    greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS count
    FROM (SELECT c_custkey AS k, c_name AS v, c_custkey % 7 AS n FROM customer WHERE c_custkey <= 70) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v, s_suppkey % 5 AS n FROM supplier) b ON a.k = b.k"""
)
def upsert_full_outer(spark: SparkSession, d: str) -> DataFrame:
    old = _sightings(table(spark, d, "customer").where("c_custkey <= 70").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "hook", "k % 7")
    new = _sightings(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "shim", "k % 5")
    return harvest.combine(old, new).select("key", "program", "source", "first_seen", "count")


@query(
    """SELECT conv_id, turn, 'print(' || conv_id || ')' AS program, role || ' ' || turn AS arguments FROM conversations"""
)
def extract_rows(spark: SparkSession, d: str) -> DataFrame:
    command = F.concat(F.lit("cd /srv && python3 -u -c 'print("), F.col("conv_id").cast("string"), F.lit(")' "), "role", F.lit(' "'), F.col("turn").cast("string"), F.lit('" | sort'))
    rows = table(spark, d, "conversations").select("conv_id", "turn", command.alias("command"))
    return extract(rows, "command").select("conv_id", "turn", "program", F.array_join("argv_tail", " ").alias("arguments"))


@query()
def aggregate_occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.concat(F.lit("shim:"), F.col("user_id").cast("string"), F.lit("#"), F.col("event_id").cast("string")).alias("occ_key"), F.concat(F.lit("print('"), "event_type", F.lit("')  \n")).alias("program"),
        F.array(F.col("user_id").cast("string")).alias("argv_tail"), F.lit("shim").alias("source"), F.col("user_id").cast("string").alias("session"), F.date_format("ts", "yyyy-MM-dd").alias("ts"),
    )
    return harvest.aggregate(rows.unionByName(rows)).select("key", "program", "session", "first_seen", "count")


@query("SELECT conv_id, turn, regexp_matches(text, '\\b(python|pypy|micropython)[0-9.]*\\b|\\b(hatch|pdm|pipx|poetry|rye|uv)\\s+run\\b|\\bpip[0-9.]*\\s+install\\b|\\bpytest\\b') AS pythonish FROM conversations")
def pythonish(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", looks_pythonish(F.col("text")).alias("pythonish"))


@query(
    """SELECT name, count(*) AS count FROM (SELECT unnest(CASE WHEN user_id % 3 = 0 THEN ['json', 'os'] WHEN user_id % 3 = 1 THEN ['json'] ELSE [] END) AS name FROM (SELECT DISTINCT user_id, event_type FROM events)) GROUP BY name"""
)
def program_imports(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("user_id") % 3 == 0, "import json, os.path\nfrom . import x\n").when(F.col("user_id") % 3 == 1, "from json import loads as os\n").otherwise("broken(\n")
    entries = table(spark, d, "events").select("user_id", "event_type").distinct()
    programs_of = entries.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), F.concat(head, F.lit("print(len('"), "event_type", F.lit("'))\n")).alias("program"))
    return programs.profile_uses(programs_of)["modules"]


@query(
    """SELECT conv_id, turn, 'x' AS program FROM conversations WHERE role = 'assistant'"""
)
def transcript_programs(spark: SparkSession, d: str) -> DataFrame:
    block = F.struct(F.lit("tool_use").alias("type"), F.when(F.col("role") == "assistant", "Bash").otherwise("Read").alias("name"), F.col("turn").cast("string").alias("id"), F.struct(F.lit("python -c x").alias("command")).alias("input"))
    event = F.to_json(F.struct(F.lit("2024-01-01").alias("timestamp"), F.struct(F.array(block).alias("content")).alias("message")))
    lines = table(spark, d, "conversations").select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), event.alias("value"))
    found = harvest.transcript_occurrences(lines)
    return found.select(F.col("session").cast("long").alias("conv_id"), F.split("occ_key", "#")[1].cast("long").alias("turn"), "program")


# grading

LADDER = ["core", "mid", "reference"]


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Run results that a rule derives from orders: two engines, each kind of outcome."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("out"))
    reference = o.select("entry_id", F.lit(0).alias("returncode"), F.col("out").alias("stdout"), F.lit("").alias("stderr"), F.lit(False).alias("skip_stdout"))
    runs = o.select("*", F.explode(F.array(F.lit("core"), F.lit("mid"))).alias("engine")).withColumn("z", (F.col("k") + F.when(F.col("engine") == "core", 0).otherwise(3)) % 11)
    z = F.col("z")
    results = runs.select(
        "engine", "entry_id", F.when(z == 9, "").otherwise("/bin/engine").alias("binary"), F.when(z.isin(1, 2), 90).when(z == 3, 1).otherwise(0).alias("returncode"),
        F.when(z == 1, "").when(z == 4, F.concat("out", F.lit("x"))).when(z == 2, "").otherwise(F.col("out")).alias("stdout"),
        F.when(z == 1, F.concat("engine", F.lit(": unsupported: builtin: f"), (F.col("k") % 5).cast("string"))).otherwise("").alias("stderr"),
        F.lit(1000).cast("long").alias("wall_ns"), (z == 10).alias("timed_out"),
    )
    return reference, results


_VERDICTS = """SELECT engine, entry_id, k, CASE z WHEN 10 THEN 'MISMATCH' WHEN 9 THEN 'MISMATCH' WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'MISMATCH' WHEN 4 THEN 'MISMATCH' WHEN 3 THEN 'MISMATCH' ELSE 'MATCH' END AS verdict,
    CASE z WHEN 10 THEN 'timeout' WHEN 9 THEN 'unbuilt' WHEN 1 THEN 'builtin' WHEN 2 THEN 'contract' WHEN 4 THEN 'stdout' WHEN 3 THEN 'exit' ELSE '' END AS kind, CASE z WHEN 1 THEN 'f' || (k % 5) END AS feature
    FROM (SELECT engine, CAST(o_orderkey AS VARCHAR) AS entry_id, o_orderkey AS k, (o_orderkey + CASE engine WHEN 'core' THEN 0 ELSE 3 END) % 11 AS z FROM orders, (VALUES ('core'), ('mid')) e(engine))"""


@query(f"SELECT engine, entry_id, verdict, kind FROM ({_VERDICTS})")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return grading.classify(*_runs(spark, d)).select("engine", "entry_id", "verdict", "kind")


@query(f"SELECT engine, count(*) FILTER (verdict = 'MATCH') AS match, count(*) FILTER (verdict = 'UNSUPPORTED') AS unsupported, count(*) FILTER (verdict = 'MISMATCH') AS mismatch, count(*) AS total, round(100.0 * count(*) FILTER (verdict = 'MATCH') / count(*), 6) AS coverage FROM ({_VERDICTS}) GROUP BY engine")
def coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = grading.coverage(grading.classify(*_runs(spark, d)))
    return out.withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT 'builtin: ' || feature AS feature, count(*) AS blocks, array_to_string(list_sort(list(DISTINCT entry_id))[1:4], ' ') AS examples FROM ({_VERDICTS}) WHERE verdict = 'UNSUPPORTED' GROUP BY 1")
def plan_rank(spark: SparkSession, d: str) -> DataFrame:
    return grading.plan(grading.classify(*_runs(spark, d))).withColumn("examples", F.array_join("examples", " "))


_ROUTED = f"""WITH v AS ({_VERDICTS}), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, ['core', 'mid', 'reference'][o_orderkey % 3 + 1] AS predicted FROM orders),
    w AS (SELECT r.entry_id, predicted, c.verdict AS vc, m.verdict AS vm FROM r JOIN v c ON c.entry_id = r.entry_id AND c.engine = 'core' JOIN v m ON m.entry_id = r.entry_id AND m.engine = 'mid'),
    g AS (SELECT entry_id, predicted, CASE WHEN vc = 'MATCH' THEN 'core' WHEN vm = 'MATCH' THEN 'mid' ELSE 'reference' END AS ideal, CASE predicted WHEN 'core' THEN vc WHEN 'mid' THEN vm ELSE 'MATCH' END AS got FROM w),
    s AS (SELECT entry_id, predicted, ideal, CASE WHEN got = 'MISMATCH' THEN 'UNSAFE' WHEN predicted = ideal THEN 'IDEAL' WHEN got = 'UNSUPPORTED' THEN 'WASTED' ELSE 'LATE' END AS grade FROM g)"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, LADDER))
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.get(names, (F.col("o_orderkey") % 3).cast("int")).alias("predicted"))


@query(f"{_ROUTED} SELECT entry_id, predicted, ideal, grade FROM s")
def route_grades(spark: SparkSession, d: str) -> DataFrame:
    return grading.grade_routes(_routes(spark, d), grading.classify(*_runs(spark, d)), LADDER)


@query(f"{_ROUTED} SELECT count(*) AS graded, count(*) FILTER (grade = 'IDEAL') AS ideal, count(*) FILTER (grade = 'WASTED') AS wasted, count(*) FILTER (grade = 'LATE') AS late, count(*) FILTER (grade = 'UNSAFE') AS unsafe, CAST(0 AS BIGINT) AS no_engine, round(100.0 * count(*) FILTER (grade = 'IDEAL') / count(*), 6) AS ideal_pct, round(100.0 * count(*) FILTER (grade IN ('IDEAL', 'LATE')) / count(*), 6) AS first_try_pct FROM s")
def route_summary(spark: SparkSession, d: str) -> DataFrame:
    out = grading.grade_summary(grading.grade_routes(_routes(spark, d), grading.classify(*_runs(spark, d)), LADDER))
    return out.withColumns({c: F.round(c, 6) for c in ("ideal_pct", "first_try_pct")})


@query(f"{_ROUTED} SELECT s.entry_id, s.predicted, CASE WHEN w.vc = 'MATCH' THEN 'core' ELSE 'mid' END AS ideal FROM s JOIN w USING (entry_id) WHERE grade = 'UNSAFE' AND (w.vc = 'MATCH' OR w.vm = 'MATCH')")
def routing_errors(spark: SparkSession, d: str) -> DataFrame:
    return grading.routing_errors(_routes(spark, d), grading.classify(*_runs(spark, d)), LADDER[:2]).select("entry_id", "predicted", "ideal")


# timing


def _samples(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber <= 6")
    arm = F.when(F.col("l_linenumber") % 2 == 0, "core").otherwise("mid")
    outcome = F.when((F.col("l_orderkey") + F.col("l_linenumber") % 2) % 13 == 0, "refused").when(F.col("l_orderkey") % 17 == 0, "error").otherwise("ran")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("ms")).select(
        arm.alias("arm"), F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_linenumber").alias("repeat"), "ms", outcome.alias("outcome"), F.lit(0).alias("rc")
    )


_SAMPLES = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'core' ELSE 'mid' END AS arm, CAST(l_orderkey AS VARCHAR) AS entry_id, l_linenumber AS repeat, min(l_quantity) AS ms,
    CASE WHEN (l_orderkey + l_linenumber % 2) % 13 = 0 THEN 'refused' WHEN l_orderkey % 17 = 0 THEN 'error' ELSE 'ran' END AS outcome FROM lineitem WHERE l_linenumber <= 6 GROUP BY l_orderkey, l_linenumber"""
_BEST = f"SELECT arm, entry_id, ms, outcome FROM (SELECT *, row_number() OVER (PARTITION BY arm, entry_id ORDER BY ms, repeat) AS k FROM ({_SAMPLES})) WHERE k = 1"


@query(_BEST)
def keep_best(spark: SparkSession, d: str) -> DataFrame:
    return timing.keep_best(_samples(spark, d)).select("arm", "entry_id", "ms", "outcome")


@query(f"SELECT entry_id FROM ({_BEST}) WHERE outcome = 'ran' GROUP BY entry_id HAVING count(*) = 2")
def shared_subset(spark: SparkSession, d: str) -> DataFrame:
    return timing.shared_subset(timing.keep_best(_samples(spark, d)))


@query(
    f"""WITH b AS ({_BEST}), s AS (SELECT entry_id FROM b WHERE outcome = 'ran' GROUP BY entry_id HAVING count(*) = 2)
    SELECT arm, count(*) FILTER (outcome = 'ran') AS ran, count(*) FILTER (outcome = 'refused') AS refused, count(*) FILTER (outcome = 'error') AS errors, sum(ms) FILTER (outcome = 'ran') AS total_ms,
    count(*) FILTER (entry_id IN (SELECT entry_id FROM s)) AS shared, sum(ms) FILTER (entry_id IN (SELECT entry_id FROM s)) AS shared_ms, median(ms) FILTER (entry_id IN (SELECT entry_id FROM s)) AS shared_median_ms
    FROM b GROUP BY arm"""
)
def timing_totals(spark: SparkSession, d: str) -> DataFrame:
    return timing.corpus_time(_samples(spark, d))


@query(f"SELECT arm, min(ms) AS startup_ms FROM ({_SAMPLES}) WHERE outcome = 'ran' GROUP BY arm")
def startup_minimum(spark: SparkSession, d: str) -> DataFrame:
    return timing.startup(_samples(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    best = timing.keep_best(_samples(spark, d))
    return best.where("arm = 'core' and entry_id like '%1'").drop("arm"), best.where("arm = 'mid' and entry_id not like '3%'").drop("arm")


_DIFF = f"""WITH b AS ({_BEST}), x AS (SELECT * FROM b WHERE arm = 'core' AND entry_id LIKE '%1'), y AS (SELECT * FROM b WHERE arm = 'mid' AND entry_id NOT LIKE '3%'),
    f AS (SELECT coalesce(x.entry_id, y.entry_id) AS entry_id, x.ms AS before_ms, y.ms AS after_ms, CASE WHEN x.entry_id IS NULL THEN 'added' WHEN y.entry_id IS NULL THEN 'dropped' ELSE 'shared' END AS change,
    x.entry_id IS NOT NULL AND y.entry_id IS NOT NULL AND x.outcome <> y.outcome AS flip FROM x FULL JOIN y ON x.entry_id = y.entry_id)"""


@query(f"{_DIFF} SELECT count(*) FILTER (change = 'shared') AS shared, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'dropped') AS dropped, sum(before_ms) FILTER (change = 'shared') AS before_ms, sum(after_ms) FILTER (change = 'shared') AS after_ms, count(*) FILTER (flip) AS flips FROM f")
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    return timing.diff_summary(timing.diff(*_sides(spark, d)))


@query(f"{_DIFF} SELECT entry_id, before_ms, after_ms, after_ms - before_ms AS delta_ms FROM f WHERE change = 'shared' ORDER BY abs(delta_ms) DESC, entry_id LIMIT 12")
def baseline_movers(spark: SparkSession, d: str) -> DataFrame:
    return timing.movers(timing.diff(*_sides(spark, d))).select("entry_id", "before_ms", "after_ms", "delta_ms")


@query(f"SELECT entry_id, ms, outcome FROM ({_BEST}) WHERE arm = 'core'")
def timing_record_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    record = timing.timing_record(timing.keep_best(_samples(spark, d)).where("arm = 'core'"))
    return timing.load_record(record, "record").select("entry_id", "ms", "outcome")


@query("SELECT p_partkey, CAST(ceil(p_partkey * 1000 / 131072) AS BIGINT) AS blocks, CASE WHEN p_partkey * 1000 <= 700000 THEN 'passed' ELSE 'failed' END AS bytes_check, CASE WHEN p_size % 5 = 0 THEN 'unmeasured' WHEN p_size % 5 <= 3 THEN 'passed' ELSE 'failed' END AS opens_check FROM part")
def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    measured = table(spark, d, "part").select(
        "p_partkey", (F.col("p_partkey") * 1000).alias("bytes"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5).alias("opens"), F.lit(0).alias("shared_objects")
    )
    return gate.gate(measured).select("p_partkey", "blocks", "bytes_check", "opens_check")


@query(
    """SELECT event_type AS kind, 'p' || (user_id % 7) AS program, count(*) AS count, min(event_id) AS seed FROM events GROUP BY 1, 2"""
)
def fuzz_collapse(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").select(
        F.col("event_type").alias("kind"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("program"), F.lit("").alias("engine_out"), F.lit("").alias("reference_out"), F.lit(1).alias("count"), F.col("event_id").alias("seed")
    )
    return fuzz.collapse(found).select("kind", "program", "count", "seed")


# the relational checklist on the star schema


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), revenue.alias("revenue"), F.count("*").alias("n"))


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def customers_without_large_orders(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS nth FROM events")
def previous_element(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id", 1, -1).over(w).alias("previous"), F.row_number().over(w).alias("nth"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(dates.strftime(F.col("ts"), "%Y-%m-%d").alias("start"), "event_type").agg(F.count("*").alias("count"))


# compiled expressions


@query("SELECT p_partkey, (CASE WHEN p_size > 25 THEN upper(p_brand) || '!' ELSE lower(p_brand) END) AS label, CAST(floor((p_size - 30) / 7.0) AS BIGINT) AS q, 10 <= p_size AND p_size < 20 AS mid, CAST(list_sum(list_transform(list_filter(range(1, 4), lambda v: v <> 2), lambda v: v * p_size)) AS BIGINT) AS s FROM part")
def compiled_native(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    texts = {"label": "p_brand.upper() + '!' if p_size > 25 else p_brand.lower()", "q": "(p_size - 30) // 7", "mid": "10 <= p_size < 20", "s": "sum([v * p_size for v in [1, 2, 3] if v != 2])"}
    return p.select("p_partkey", *[compile_expression(t, p).column.alias(name) for name, t in texts.items()])


@query("SELECT p_partkey, array_to_string(list_reverse_sort(list_distinct(string_split(p_type, ' '))), '/') AS words FROM part")
def compiled_arrow(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    plan = compile_expression("'/'.join(sorted(set(p_type.split(' ')), reverse=True))", p, "string")
    return p.select("p_partkey", plan.column.alias("words"))


# the rest of the inventory


@query("SELECT c_custkey, c_name || ':' || c_mktsegment AS joined, list_reverse(string_split(c_name, '#'))[1] AS tail, CAST(length(c_mktsegment) * 2 AS INTEGER) AS n FROM customer")
def str_join_rsplit_repeat(spark: SparkSession, d: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    parts = strings.rsplit(name, "#", 1)
    return table(spark, d, "customer").select("c_custkey", strings.join(":", F.array(name, segment)).alias("joined"), F.element_at(parts, -1).alias("tail"), F.length(F.repeat(segment, F.lit(2))).alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_name) < 30 THEN rpad(p_name, 30, '-') ELSE p_name END AS padded, instr(p_name, 'a') - 1 AS found, length(p_name) - instr(reverse(p_name), 'a') AS last FROM part WHERE contains(p_name, 'a')")
def str_find_rfind(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_name")
    rows = table(spark, d, "part").where(x.contains("a"))
    return rows.select("p_partkey", strings.ljust(x, 30, "-").alias("padded"), strings.index(x, "a").cast("long").alias("found"), strings.rindex(x, "a").cast("long").alias("last"))


@query("SELECT doc_id, regexp_full_match(lang, '[a-z]+') AS low, regexp_full_match(upper(lang), '[A-Z]+') AS up, regexp_full_match(source, '.*[0-9]') AS tail FROM documents")
def str_cased(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    return table(spark, d, "documents").select("doc_id", strings.islower(lang).alias("low"), strings.isupper(F.upper(lang)).alias("up"), strings.isdecimal(F.right("source", F.lit(1))).alias("tail"))


@query("SELECT vec_id, len(embedding) + 1 AS appended, round(embedding[2], 6) AS second, round(list_reverse(embedding)[1], 6) AS last, round(list_sort(embedding)[1], 6) AS least, len(embedding[3:6]) AS cut FROM embeddings")
def list_methods(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(py_list.append(e, F.lit(0.0).cast("float"))).cast("long").alias("appended"), F.round(py_list.item(e, 1), 6).alias("second"), F.round(py_list.pop(e)["value"], 6).alias("last"),
        F.round(py_list.item(py_list.sort(e), 0), 6).alias("least"), F.size(py_list.slice_(e, 2, 6)).cast("long").alias("cut"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'zero' WHEN o_orderkey % 3 = 1 THEN 'one' ELSE 'none' END AS got, CAST(CASE WHEN o_orderkey % 3 < 2 THEN 2 ELSE 3 END AS INTEGER) AS size FROM orders")
def dict_get_setdefault(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit(0).cast("long"), F.lit("zero"), F.lit(1).cast("long"), F.lit("one"))
    key = F.col("o_orderkey") % 3
    return table(spark, d, "orders").select("o_orderkey", py_list.get(m, key, F.lit("none")).alias("got"), F.size(py_list.setdefault(m, key, F.lit("new"))).alias("size"))


@query("SELECT doc_id, len(list_distinct(w)) AS distinct_words, len(list_filter(list_distinct(w), lambda x: x IN ('the', 'of', 'le'))) AS common FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)")
def set_methods(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    known = F.array(F.lit("the"), F.lit("of"), F.lit("le"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select(
        "doc_id", F.size(py_list.set_of(F.col("w"))).cast("long").alias("distinct_words"), F.size(py_list.intersection(F.col("w"), known)).cast("long").alias("common")
    )


@query("SELECT event_id, split_part(line, ',', 1) AS kind, split_part(line, ',', 3) AS tail FROM (SELECT event_id, event_type || ',' || user_id || ',end' AS line FROM events)")
def csv_fields(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string"), F.lit("end"))
    fields = text.csv_row(line)
    return table(spark, d, "events").select("event_id", fields.alias("f")).select("event_id", F.col("f")[0].alias("kind"), F.col("f")[2].alias("tail"))


@query("SELECT event_id, '\"' || event_type || '\"\"x\",' || user_id || chr(13) || chr(10) AS line FROM events")
def csv_written(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(F.concat("event_type", F.lit('"x')), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", text.csv_write(fields).alias("line"))


@query("SELECT event_id, '{\"kind\": \"' || event_type || '\", \"user\": ' || user_id || '}' AS dumped FROM events")
def json_dumps(spark: SparkSession, d: str) -> DataFrame:
    # a struct's fields arrive as a dict, in order
    record = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return table(spark, d, "events").select("event_id", formatting.json_rewrite(record).alias("dumped"))


@query("SELECT o_orderkey, printf('%08d|%s', o_orderkey, o_orderstatus) AS old, o_orderstatus || '-' || format('{:,}', o_orderkey) AS new FROM orders")
def percent_and_template(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", formatting.percent_format("%08d|%s", k, s).alias("old"), formatting.template("{0}-{n:,}", s, n=k).alias("new"))


@query("SELECT p_partkey, '''' || p_name || '''' AS shown, format('{:,}', p_partkey * 1000) AS grouped FROM part")
def repr_and_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", formatting.repr_(F.col("p_name")).alias("shown"), formatting.format_(F.col("p_partkey") * 1000, ",d").alias("grouped"))


@query("SELECT n_nationkey, 'True ' || n_name || ' None' || chr(10) AS printed FROM nation")
def print_row(spark: SparkSession, d: str) -> DataFrame:
    printed = formatting.print_(F.lit(True), F.col("n_name"), F.lit(None).cast("string"), kinds=["boolean", "string", "string"])
    return table(spark, d, "nation").select("n_nationkey", printed.alias("printed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T' || strftime(o_orderdate, '%H:%M:%S') AS iso, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) * 86400 AS seconds, CAST(make_date(2000, month(o_orderdate), 1) AS VARCHAR) AS replaced, CAST(isodow(o_orderdate) AS INTEGER) AS iso_weekday FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def date_iso_delta(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_orderdate")
    rows = table(spark, d, "orders").where(x == F.date_trunc("day", x).cast("timestamp_ntz"))
    day = x.cast("date")
    return rows.select(
        "o_orderkey", dates.isoformat(x).alias("iso"), dates.total_seconds(x, F.lit("1992-01-01").cast("timestamp_ntz")).alias("seconds"), dates.replace(day, year=2000, day=1).cast("string").alias("replaced"), dates.isoweekday(day).alias("iso_weekday")
    )


@query("SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%H:%M:%S on %d.%m.%Y') AS later, floor(epoch(ts)) AS stamp FROM events")
def date_add(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("ts")
    return table(spark, d, "events").select("event_id", dates.strftime(dates.add_seconds(x, F.lit(90.0)), "%H:%M:%S on %d.%m.%Y").alias("later"), F.floor(dates.timestamp(x)).cast("double").alias("stamp"))


@query("SELECT page_id, url_encode(url) AS quoted, url AS back FROM pages")
def url_quote(spark: SparkSession, d: str) -> DataFrame:
    quoted = web.quote(F.col("url"), safe="")
    return table(spark, d, "pages").select("page_id", quoted.alias("quoted"), web.unquote(quoted).alias("back"))


@query("SELECT page_id, url AS rebuilt FROM pages")
def url_unparse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.urlunparse(web.urlparse(F.col("url"))).alias("rebuilt"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/x/y' AS rooted, regexp_extract(url, '^([a-z]+):', 1) || '://h/z' AS hosted FROM pages")
def url_join(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", web.urljoin(u, F.lit("/x/y")).alias("rooted"), web.urljoin(u, F.lit("//h/z")).alias("hosted"))


@query("SELECT p_partkey, 'data/' || p_brand || '/' || p_partkey AS normal, '/data/' || p_partkey || '.txt' AS absolute, CAST(p_partkey AS VARCHAR) AS stem, '.txt' AS ext FROM part")
def path_join_normal(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    messy = paths.join(F.lit("data/./x/.."), F.col("p_brand"), key)
    file = paths.join(F.lit("ignored"), F.lit("/data"), F.concat(key, F.lit(".txt")))
    return table(spark, d, "part").select("p_partkey", paths.normpath(messy).alias("normal"), file.alias("absolute"), paths.stem(file).alias("stem"), paths.suffix(file).alias("ext"))


@query("SELECT doc_id, replace(replace(base64(encode(left(text, 30))), '+', '-'), '/', '_') AS safe, left(text, 30) AS back, md5(lang) AS named FROM documents")
def base64_forms(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode(F.left("text", F.lit(30)), "utf-8")
    safe = web.urlsafe_b64encode(raw)
    return table(spark, d, "documents").select("doc_id", safe.alias("safe"), F.decode(web.urlsafe_b64decode(safe), "utf-8").alias("back"), web.digest(F.col("lang"), "md5").alias("named"))


@query("SELECT doc_id, text FROM documents WHERE length(text) < 3000")
def zlib_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") < 3000)
    return docs.select("doc_id", F.decode(web.decompress(web.compress(F.encode("text", "utf-8"))), "utf-8").alias("text"))


@query("SELECT p_partkey, lower(hex(encode(p_brand))) AS hexed, upper(p_brand) AS loud, instr(p_brand, '#') - 1 AS hash_at FROM part")
def bytes_methods(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode("p_brand", "utf-8")
    return table(spark, d, "part").select("p_partkey", text.bytes_hex(raw).alias("hexed"), F.decode(text.bytes_upper(raw), "utf-8").alias("loud"), text.bytes_find(raw, b"#").cast("long").alias("hash_at"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(left(text, 500), 'th')) AS INTEGER) AS n, replace(left(text, 500), 'th', '') AS cut, instr(left(text, 500), 'th') - 1 AS \"start\" FROM documents WHERE contains(left(text, 500), 'th')")
def regex_subn_iter(spark: SparkSession, d: str) -> DataFrame:
    x = F.left("text", F.lit(500))
    rows = table(spark, d, "documents").where(x.contains("th"))
    sub = regex.subn(x, "th", "")
    return rows.select("doc_id", sub["n"].alias("n"), sub["text"].alias("cut"), regex.finditer(x, "th")[0]["start"].cast("long").alias("start"))


@query("SELECT doc_id, regexp_extract(text, '([A-Z])([a-z]+)', 2) AS tail, len(string_split_regex(left(text, 300), '[.,]')) AS parts FROM documents WHERE regexp_matches(text, '([A-Z])([a-z]+)')")
def regex_group_split(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    rows = table(spark, d, "documents").where(regex.search(x, "([A-Z])([a-z]+)"))
    return rows.select("doc_id", regex.group(x, "(?P<head>[A-Z])(?P<tail>[a-z]+)", "tail").alias("tail"), F.size(regex.split(F.left(x, F.lit(300)), "[.,]")).cast("long").alias("parts"))


@query("SELECT event_type, v[len(v) // 2 + 1] AS median_high FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def stats_median_high(spark: SparkSession, d: str) -> DataFrame:
    return relational.median_high(table(spark, d, "events"), "value", "event_type")


@query("SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY c_mktsegment")
def counter_elements_total(spark: SparkSession, d: str) -> DataFrame:
    counts = relational.counter(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    spread = relational.elements(counts, "c_mktsegment").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return spread.crossJoin(F.broadcast(relational.total(counts)))


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN ['--password', '[REDACTED-argv-value-' || length(s_name) || '-chars]', s_name] ELSE ['--name', s_name, s_name] END[2] AS second FROM supplier")
def redact_arguments(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("s_nationkey") < 5, "--password").otherwise("--name")
    red = redaction.redact_argv(F.array(flag, F.col("s_name"), F.col("s_name")))
    return table(spark, d, "supplier").select("s_suppkey", red["argv"][1].alias("second"))


@query("SELECT 'user_' || user_id || '.jsonl' AS file, count(*) AS n FROM events GROUP BY user_id")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    name = harvest.session_filename(F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    return table(spark, d, "events").groupBy(name.alias("file")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id FROM (SELECT 'doc-' || doc_id AS id FROM documents UNION ALL SELECT 'py-' || substring(sha256(lang), 1, 12) FROM documents)")
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("program"))
    return harvest.known_keys(docs)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true ELSE false END AS only_order FROM orders")
def set_order_only(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    want = F.concat(F.lit("{"), k, F.lit(", 'b'} x"))
    got = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("{'b', "), k, F.lit("} x"))).when(F.col("o_orderkey") % 4 == 1, want).otherwise(F.concat(F.lit("{'c', "), k, F.lit("} x")))
    return table(spark, d, "orders").select("o_orderkey", grading.only_set_order_differs(want, got).alias("only_order"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'line 2: want ''b'', got ''' || o_orderstatus || '''' ELSE 'line 3: want <no line>, got ''c''' END AS diff FROM orders")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    got = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a\n"), "o_orderstatus")).otherwise("a\nb\nc")
    return table(spark, d, "orders").select("o_orderkey", grading.first_diff(F.lit("a\nb"), got).alias("diff"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'absolute path outside the sandbox: /tmp/' || s_suppkey || '/x' ELSE '' END AS reason FROM supplier")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    program = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("open('/tmp/"), k, F.lit("/x')"))).otherwise(F.concat(F.lit("get('/api/"), k, F.lit("/x') / 2")))
    return table(spark, d, "supplier").select("s_suppkey", timing.skip_reason(program, F.array(F.lit("a"))).alias("reason"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS unstable FROM customer")
def nondeterminism(spark: SparkSession, d: str) -> DataFrame:
    program = F.when(F.col("c_custkey") % 4 == 0, "import time; print(time.time())").otherwise("print(sys.argv)")
    tags = F.when(F.col("c_custkey") % 4 == 1, F.array(F.lit("seeded"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", grading.is_nondeterministic(program, tags).alias("unstable"))


@query(
    f"""WITH v AS ({_VERDICTS}), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, ['core', 'mid', 'reference'][o_orderkey % 3 + 1] AS predicted FROM orders)
    SELECT r.entry_id, predicted, CASE WHEN predicted = 'core' AND c.verdict <> 'UNSUPPORTED' THEN 'core' WHEN m.verdict <> 'UNSUPPORTED' THEN 'mid' END AS answered,
    CAST(CASE WHEN predicted = 'core' AND c.verdict = 'UNSUPPORTED' THEN 2 ELSE 1 END AS BIGINT) AS tries
    FROM r JOIN v c ON c.entry_id = r.entry_id AND c.engine = 'core' JOIN v m ON m.entry_id = r.entry_id AND m.engine = 'mid' WHERE predicted <> 'reference'"""
)
def dispatch_chain(spark: SparkSession, d: str) -> DataFrame:
    return grading.dispatch(_routes(spark, d).where("predicted <> 'reference'"), _runs(spark, d)[1], LADDER[:2])


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'refused' WHEN event_id % 5 = 1 THEN 'output' WHEN event_id % 5 = 2 THEN 'crash' ELSE 'agreed' END AS judgement, count(*) AS count FROM events GROUP BY 1")
def fuzz_judged(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("event_id") % 5
    engine = F.struct(
        F.when(z == 0, 90).when(z == 2, 1).otherwise(0).alias("rc"), F.when(z == 0, "").when(z == 1, "x").otherwise("y").alias("stdout"), F.when(z == 0, "core: unsupported: a: b").otherwise("").alias("stderr"), F.lit(False).alias("timed_out")
    )
    reference = F.struct(F.lit(0).alias("rc"), F.lit("y").alias("stdout"), F.lit("").alias("stderr"), F.lit(False).alias("timed_out"))
    return fuzz.tally(table(spark, d, "events").select(fuzz.judge(engine, reference).alias("judgement")))


@query("SELECT count(DISTINCT p_brand) AS opens, count(*) FILTER (p_size > 25) AS failed_opens, (SELECT count(*) FROM nation) AS stat_calls FROM part")
def trace_counts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    opened = part.select(F.concat(F.lit('openat(AT_FDCWD, "/'), "p_brand", F.lit('", O_RDONLY) = 3')).alias("value"))
    failed = part.where("p_size > 25").select(F.lit('open("/none") = -1 ENOENT (No such file)').alias("value"))
    stats = table(spark, d, "nation").select(F.lit('stat("/x", {}) = 0').alias("value"))
    return gate.parse_trace(opened.unionByName(failed).unionByName(stats))


@query("SELECT entry_id, gap, gap / sum(gap) OVER () AS share FROM (SELECT o_orderkey AS entry_id, CAST(o_orderkey % 8 AS DOUBLE) AS gap FROM orders WHERE o_orderkey % 64 = 3)")
def gap_share(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "orders").where("o_orderkey % 64 = 3").select(F.col("o_orderkey").alias("entry_id"), (F.col("o_orderkey") % 8).cast("double").alias("gap"))
    return timing.concentration(gaps, "gap")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE printf('%.2fx', o_orderkey / CAST(o_orderkey % 5 AS DOUBLE)) END AS ratio FROM orders")
def time_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", timing.ratio(F.col("o_orderkey").cast("double"), (F.col("o_orderkey") % 5).cast("double")).alias("ratio"))


@query("SELECT o_orderkey, sqrt(o_totalprice) AS root, CAST(floor(o_totalprice) AS BIGINT) AS low, CAST(ceil(o_totalprice) AS BIGINT) AS high, CAST(abs(o_orderkey - 5000) AS BIGINT) AS dist FROM orders WHERE o_totalprice >= 0")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders").where("o_totalprice >= 0").select("o_orderkey", numbers.sqrt(x).alias("root"), numbers.floor(x).alias("low"), numbers.ceil(x).alias("high"), numbers.abs_(F.col("o_orderkey") - 5000).alias("dist"))


@query("SELECT e.event_id, n.n_name FROM (SELECT event_id, user_id % 25 AS k FROM events) e LEFT JOIN nation n ON n.n_nationkey = e.k")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("n_nationkey"))
    return keyed.join(table(spark, d, "nation"), "n_nationkey", "left").select("event_id", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
