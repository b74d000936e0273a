"""Queries for single methods of texts, lists, dicts, sets, bytes, dates, paths and files, over whole tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import collections as py_list
from lathe.functions import dates, formatting, numbers, paths, regex, strings, text, web
from lathe.operators import gate, harvest, programs, redaction
from lathe.plans import routes
from lathe.plans.compiler import NATIVE
from lathe.plans.programs import aggregate_function, compile_function, compile_program
from lathe.queries import QUERIES, SQL, Query, query
from lathe.session import shared_dir, table
from lathe.sources import files, jsonl
from lathe.streaming import capture

# numbers and comparisons


@query(
    """SELECT l_orderkey, l_linenumber, floor((l_quantity - 25) / 3.5) AS quotient, floor(l_extendedprice) AS whole, CAST(floor((l_linenumber - 4) / 3.0) AS BIGINT) AS q,
    CAST((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3.0) AS BIGINT) AS r FROM lineitem"""
)
def float_floor_div_and_divmod(spark: SparkSession, d: str) -> DataFrame:
    pair = numbers.divmod_(F.col("l_linenumber") - 4, F.lit(3))
    quotient, remainder = (pair.getField(k) for k in ("quotient", "remainder"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.float_floor_div(F.col("l_quantity") - 25, F.lit(3.5)).alias("quotient"),
        numbers.float_floor_div(F.col("l_extendedprice"), F.lit(1.0)).alias("whole"), quotient.alias("q"), remainder.alias("r"),
    )


_NAN = "CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END"


@query(
    f"""SELECT event_id, v = 5.0 AND NOT isnan(v) AND v IS NOT NULL AS eq, v IS NOT NULL AND NOT isnan(v) AND v < 5.0 AS lt,
    v IS NOT DISTINCT FROM u AND NOT (v IS NOT NULL AND isnan(v)) AS same
    FROM (SELECT event_id, {_NAN} AS v, CASE WHEN event_id % 2 = 0 THEN {_NAN} ELSE 1.0 END AS u FROM events)"""
)
def comparisons_with_nan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    v = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_id", v.alias("v")).withColumn("u", F.when(k % 2 == 0, F.col("v")).otherwise(1.0))
    v = F.col("v")
    return rows.select("event_id", numbers.float_equal(v, F.lit(5.0)).alias("eq"), F.coalesce(numbers.less(v, F.lit(5.0)), F.lit(False)).alias("lt"), numbers.float_equal(v, F.col("u")).alias("same"))


@query("SELECT event_id, try_cast(trim(t) AS DOUBLE) AS number FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN event_type WHEN 2 THEN value || 'e2' ELSE '-' || value END AS t FROM events)")
def parse_floats(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id") % 4, F.col("value").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(k == 1, F.col("event_type")).when(k == 2, F.concat(v, F.lit("e2"))).otherwise(F.concat(F.lit("-"), v))
    return table(spark, d, "events").select("event_id", numbers.parse_float(raw).alias("number"))


@query("SELECT p_partkey, chr(CAST(97 + p_partkey % 20000 AS INTEGER)) AS letter, 'int' AS kind_of_key, 'str' AS kind_of_name, true AS is_number, false AS is_text FROM part WHERE p_partkey % 20000 < 10000")
def characters_and_types(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey % 20000 < 10000")
    kinds = dict(p.dtypes)
    return p.select(
        "p_partkey", numbers.chr_(97 + F.col("p_partkey") % 20000).alias("letter"), F.lit(numbers.type_name(kinds["p_partkey"])).alias("kind_of_key"),
        F.lit(numbers.type_name(kinds["p_name"])).alias("kind_of_name"), F.lit(numbers.isinstance_(kinds["p_size"], "int", "float")).alias("is_number"),
        F.lit(numbers.isinstance_(kinds["p_size"], "str")).alias("is_text"),
    )


# texts


@query(
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, lower(p_type) AS folded, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(upper(p_name)) END AS swapped,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled,
    regexp_replace(p_type, 'Y$', '') AS cut, hex(encode(p_name)) AS raw FROM part"""
)
def text_cases(spark: SparkSession, d: str) -> DataFrame:
    name, even = F.col("p_name"), F.col("p_partkey") % 2 == 0
    mixed = F.when(even, name).otherwise(F.upper(name))
    return table(spark, d, "part").select(
        "p_partkey", strings.upper(name).alias("up"), strings.lower(F.col("p_brand")).alias("low"), strings.casefold(F.col("p_type")).alias("folded"),
        strings.swapcase(mixed).alias("swapped"), strings.title(name).alias("titled"), strings.removesuffix(F.col("p_type"), "Y").alias("cut"), F.hex(strings.encode(name)).alias("raw"),
    )


@query("SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS lines, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS breaks FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AND NOT contains(text, chr(10) || chr(10)) AND NOT starts_with(text, chr(10))")
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    rows = table(spark, d, "documents").where((x != "") & ~x.rlike("[\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]") & ~x.contains("\n\n") & ~x.startswith("\n"))
    return rows.select("doc_id", strings.splitlines(x).alias("lines"), strings.count(x, "\n").cast("int").alias("breaks"))


@query("SELECT page_id, contains(url, '?page=2&ref=x') AS found, list_filter([url], lambda u: contains(u, '.example.com/')) AS hosts FROM pages")
def regex_escape(spark: SparkSession, d: str) -> DataFrame:
    """Literals with special characters, searched as patterns."""
    url = F.col("url")
    here = F.filter(F.array(url), lambda u: regex.search(u, regex.escape(".example.com/")))
    return table(spark, d, "pages").select("page_id", regex.search(url, regex.escape("?page=2&ref=x")).alias("found"), here.alias("hosts"))


# lists


_WORDS = "string_split(p_name, ' ')"


@query(
    f"""SELECT p_partkey, w || ['x', 'y'] AS extended, [w[1], 'new'] || w[2:] AS inserted, w[:-2] || ['new'] || w[-1:] AS before_last, w || w || w AS thrice,
    CAST(len(list_filter(w, lambda x: x = w[1])) AS INTEGER) AS copies, w[2:] AS without_first, list_reverse(w) AS backwards, w || ['x'] AS appended FROM (SELECT p_partkey, {_WORDS} AS w FROM part)"""
)
def list_changes(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    more = F.array(F.lit("x"), F.lit("y"))
    return table(spark, d, "part").select(
        "p_partkey", py_list.extend(w, more).alias("extended"), py_list.insert(w, 1, F.lit("new")).alias("inserted"), py_list.insert(w, -1, F.lit("new")).alias("before_last"),
        py_list.repeat(w, F.lit(3)).alias("thrice"), py_list.count(w, F.get(w, F.lit(0))).alias("copies"), py_list.remove(w, F.get(w, F.lit(0))).alias("without_first"),
        py_list.reverse(w).alias("backwards"), py_list.append(w, F.lit("x")).alias("appended"),
    )


@query(
    """SELECT p_partkey, range(0, p_size) AS up, range(p_size, 0, -3) AS down, list_transform(range(0, p_size), lambda x: x * x) AS squares,
    list_filter(range(0, p_size), lambda x: x % 3 = 1) AS thirds, list_min(list_transform(string_split(p_name, ' '), lambda w: {'n': length(w), 'k': 0})).n AS shortest,
    list_max(list_transform(string_split(p_name, ' '), lambda w: length(w))) AS longest FROM part"""
)
def ranges_map_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    up, w = py_list.range_(F.lit(0).cast("long"), n), F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", up.alias("up"), py_list.range_(n, F.lit(0).cast("long"), -3).alias("down"), py_list.map_(lambda x: x * x, up).alias("squares"),
        py_list.filter_(lambda x: x % 3 == 1, up).alias("thirds"), F.length(py_list.min_by(w, F.length)).cast("long").alias("shortest"),
        F.length(py_list.max_by(w, F.length)).cast("long").alias("longest"),
    )


@query(
    """SELECT p_partkey, list_transform(range(0, len(w)), lambda k: w[k + 1] || '=' || k) AS pairs FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"""
)
def list_zip(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    longer = py_list.range_(F.lit(0).cast("long"), F.size(w).cast("long"))
    pairs = py_list.zip_(w, F.concat(longer, F.array(F.lit(7).cast("long"))))
    return table(spark, d, "part").select("p_partkey", F.transform(pairs, lambda p: F.concat(p["_0"], F.lit("="), p["_1"].cast("string"))).alias("pairs"))


# dicts: maps shown as sorted lists of "key=value"


@query(
    """SELECT p_partkey, list_sort(['brand=' || p_brand, 'size=9', 'type=' || p_type]) AS updated, p_brand AS popped, ['type=' || p_type] AS rest, 'type=' || p_type AS last,
    list_sort(['brand=' || p_brand, 'type=' || p_type]) AS made, ['brand', 'type'] AS keys, p_type AS looked_up FROM part"""
)
def dict_changes(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))

    def shown(x):
        return F.array_sort(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit("="), e["value"])))

    one, last = py_list.dict_pop(m, F.lit("brand")), py_list.popitem(m)
    pairs = F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v")))
    return table(spark, d, "part").select(
        "p_partkey", shown(py_list.update(m, F.create_map(F.lit("size"), F.lit("9"), F.lit("brand"), F.col("p_brand")))).alias("updated"),
        one["value"].alias("popped"), shown(one["rest"]).alias("rest"), F.concat(last["key"], F.lit("="), last["value"]).alias("last"),
        shown(py_list.dict_of(pairs)).alias("made"), F.array_sort(F.map_keys(m)).alias("keys"), py_list.lookup(m, F.lit("type")).alias("looked_up"),
    )


# sets


@query(
    """SELECT p_partkey, list_sort(list_distinct(w || ['zz'])) AS added, list_sort(list_filter(w, lambda x: x <> w[1])) AS discarded, list_sort(list_filter(w, lambda x: x <> w[1])) AS removed,
    list_sort(list_distinct(w || ['aa', 'bb'])) AS updated, true AS below, len(w) = 1 AS above FROM (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part)"""
)
def set_changes(spark: SparkSession, d: str) -> DataFrame:
    s = py_list.set_of(F.split("p_name", " "))
    first = F.get(s, F.lit(0))
    return table(spark, d, "part").select(
        "p_partkey", py_list.add(s, F.lit("zz")).alias("added"), py_list.discard(s, first).alias("discarded"), py_list.set_remove(s, first).alias("removed"),
        py_list.union(s, F.array(F.lit("aa"), F.lit("bb"))).alias("updated"), py_list.issubset(F.array(first), s).alias("below"), py_list.issuperset(F.array(first), s).alias("above"),
    )


# bytes: shown in hexadecimal


@query(
    """SELECT p_partkey, hex(encode(lower(p_brand))) AS low, hex(encode(upper(p_name))) AS up, hex(encode(trim(p_name, 'sg'))) AS stripped, hex(encode(replace(p_name, 'ring', 'R'))) AS replaced,
    list_transform(string_split(p_name, ' '), lambda w: hex(encode(w))) AS parts, hex(encode(replace(p_name, ' ', '--'))) AS joined, p_name AS decoded, hex(chr(65 + p_size % 26)::BLOB) AS made FROM part"""
)
def bytes_changes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_name").cast("binary")
    parts = text.bytes_split(b, b" ")
    return table(spark, d, "part").select(
        "p_partkey", F.hex(text.bytes_lower(F.col("p_brand").cast("binary"))).alias("low"), F.hex(text.bytes_upper(b)).alias("up"), F.hex(text.bytes_strip(b, b"sg")).alias("stripped"),
        F.hex(text.bytes_replace(b, b"ring", b"R")).alias("replaced"), F.transform(parts, F.hex).alias("parts"), F.hex(text.bytes_join(b"--", parts)).alias("joined"),
        text.bytes_decode(b).alias("decoded"), F.hex(text.bytes_of(F.array(65 + F.col("p_size") % 26))).alias("made"),
    )


# dates


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, date_part('epoch', o_orderdate) AS seconds, strftime(o_orderdate + INTERVAL 5400 SECOND, '%Y-%m-%d %H:%M:%S') AS combined,
    strftime(to_timestamp(86400 * (o_orderkey % 9000)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS from_seconds, CAST(floor(o_totalprice / 86400) AS BIGINT) AS days FROM orders WHERE o_totalprice >= 0"""
)
def dates_parsed_and_combined(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    whole = dates.datetime_fromisoformat(F.concat(day, F.lit("T00:00:00")))
    combined = dates.combine(dates.date_fromisoformat(day), F.lit(1), F.lit(30), F.lit(0))
    return table(spark, d, "orders").where("o_totalprice >= 0").select(
        "o_orderkey", dates.date_fromisoformat(day).cast("string").alias("parsed"), dates.timestamp(whole).cast("double").alias("seconds"), dates.strftime(combined, "%Y-%m-%d %H:%M:%S").alias("combined"),
        dates.strftime(dates.fromtimestamp(86400 * (F.col("o_orderkey") % 9000)), "%Y-%m-%d").alias("from_seconds"), dates.timedelta_parts(F.col("o_totalprice"))["days"].cast("long").alias("days"),
    )


# addresses, checksums, text layout


@query("SELECT page_id, 'u=' || url_encode(split_part(url, '/', 3)) || '&n=' || page_id AS encoded FROM pages")
def form_encoding(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("u").alias("k"), F.get(F.split("url", "/"), F.lit(2)).alias("v")), F.struct(F.lit("n").alias("k"), F.col("page_id").cast("string").alias("v")))
    return table(spark, d, "pages").select("page_id", web.urlencode(pairs).alias("encoded"))


@query("SELECT doc_id, text AS dedented, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS lines FROM documents WHERE text <> '' AND NOT regexp_matches(text, '(?m)^[ \\t]')")
def text_dedent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where((F.col("text") != "") & ~F.col("text").rlike("(?m)^[ \\t]"))
    moved = F.regexp_replace("text", "(?m)^(?=.)", "    ")
    return rows.select("doc_id", text.dedent(moved).alias("dedented"), F.split(text.dedent(moved), "\n").alias("lines"))


_N = "(p_size % 9 + 1)"


@query(
    f"""SELECT p_partkey, list_transform(range(0, ({_N} + 1) // 2), lambda k: CASE WHEN 2 * k + 1 < {_N} THEN 'abcd abcd' ELSE 'abcd' END) AS wrapped,
    array_to_string(list_transform(range(0, ({_N} + 1) // 2), lambda k: CASE WHEN 2 * k + 1 < {_N} THEN 'abcd abcd' ELSE 'abcd' END), chr(10)) AS filled,
    CASE WHEN {_N} <= 4 THEN trim(repeat('abcd ', {_N})) ELSE 'abcd abcd [...]' END AS shortened, p_name || 'é' AS composed, {_N} = 1 AS is_composed FROM part"""
)
def text_wrapped(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 9 + 1
    words = F.repeat(F.lit("abcd "), n)
    accent = F.concat("p_name", F.lit("e\u0301"))
    return table(spark, d, "part").select(
        "p_partkey", text.wrap(words, 10).alias("wrapped"), text.fill(words, 10).alias("filled"), text.shorten(words, 19).alias("shortened"), text.normalize(accent, "NFC").alias("composed"),
        text.is_normalized(F.when(n == 1, "é").otherwise("e\u0301"), "NFC").alias("is_composed"),
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'token="[REDACTED token ' || length(event_type) || ' chars]"' WHEN 1 THEN 'curl --password [REDACTED-password-' || length(event_type) || '-chars]'
    WHEN 2 THEN 'id [REDACTED-AKIA-20-chars] end' ELSE 'x = ' || value END AS text, CASE event_id % 4 WHEN 0 THEN ['token'] WHEN 1 THEN ['password'] WHEN 2 THEN ['AKIA'] ELSE [] END AS hits, true AS safe FROM events"""
)
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Assignments, flags and issued keys; redacting twice changes nothing."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    raw = (
        F.when(k == 0, F.concat(F.lit('token="'), kind, F.lit('"')))
        .when(k == 1, F.concat(F.lit("curl --password "), kind))
        .when(k == 2, F.concat(F.lit("id AKIA"), F.upper(F.substring(F.sha2(kind, 256), 1, 16)), F.lit(" end")))
        .otherwise(F.concat(F.lit("x = "), F.col("value").cast("string")))
    )
    once = table(spark, d, "events").select("event_id", redaction.redact(raw).alias("r"))
    twice = once.select("event_id", "r.hits", redaction.redact(F.col("r.text")).alias("r"))
    return twice.select("event_id", "r.text", "hits", redaction.is_safe(F.col("hits")).alias("safe"))


# paths


@query(
    """SELECT page_id, split_part(url, '://', 2) AS path, regexp_extract(split_part(url, '://', 2), '^(.*)/[^/]*$', 1) AS head, regexp_extract(url, '([^/]*)$', 1) AS tail,
    string_split(split_part(url, '://', 2), '/') AS parts, '/home/u/' || split_part(url, '://', 2) AS expanded, false AS absolute, true AS rooted, starts_with(split_part(url, '://', 2), 'th') AS matched
    FROM pages WHERE NOT contains(split_part(url, '://', 2), '//') AND NOT ends_with(url, '/') AND NOT contains(split_part(url, '://', 2), '/.') AND contains(split_part(url, '://', 2), '/')"""
)
def path_pieces(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, d, "pages").withColumn("path", F.get(F.split("url", "://"), F.lit(1))).where(~p.contains("//") & ~p.endswith("/") & ~p.contains("/.") & p.contains("/"))
    two = paths.split(p)
    return rows.select(
        "page_id", "path", two["head"].alias("head"), two["tail"].alias("tail"), paths.parts(p).alias("parts"),
        paths.expanduser(F.concat(F.lit("~/"), p), "/home/u").alias("expanded"), paths.isabs(p).alias("absolute"), paths.isabs(F.concat(F.lit("/"), p)).alias("rooted"), paths.fnmatch(p, "th*").alias("matched"),
    )


@query("SELECT p_partkey, p_type || '/y.txt' AS named, 'a/' || p_type || '.md' AS suffixed, contains(p_name, '*') AS magic FROM part")
def path_with_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", paths.with_name(F.concat(F.col("p_type"), F.lit("/x.csv")), "y.txt").alias("named"),
        paths.with_suffix(F.concat(F.lit("a/"), F.col("p_type"), F.lit(".csv")), ".md").alias("suffixed"), F.lit(paths.has_magic("plain/name")).alias("magic"),
    )


# files: written to the shared folder and read back


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lathe-{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '[\\r\\n]') AND text <> ''")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines written and read with their numbers."""
    path = _folder(spark, "text")
    one = table(spark, d, "documents").where(~F.col("text").rlike("[\r\n]") & (F.col("text") != ""))
    files.write_text(one.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("value")), path)
    parts = F.split("value", "\t", 2)
    return jsonl.numbered_lines(spark, path).where("line > 0").select(F.get(parts, F.lit(0)).cast("long").alias("doc_id"), F.get(parts, F.lit(1)).alias("text"))


@query("SELECT c_custkey, c_name, c_mktsegment || ', \"' || c_nationkey || '\"' AS note FROM customer")
def csv_files(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    note = F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", note.alias("note")), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, note string")


@query("SELECT n_nationkey, n_name FROM nation")
def json_files(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "json")
    rows = table(spark, d, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("r"))
    files.write_text(rows.select(formatting.json_dumps(F.col("r"), indent=1).alias("value")), path)
    return files.read_json(spark, f"{path}/*.txt", "n_nationkey int, n_name string")


@query("SELECT n_nationkey, '{\"n_name\": \"' || n_name || '\", \"n_regionkey\": ' || n_regionkey || '}' AS object, '[\"' || n_name || '\", \"é\"]' AS list, '\"\\u00e9' || n_name || '\"' AS text FROM nation")
def json_dumped(spark: SparkSession, d: str) -> DataFrame:
    """json.dumps of structs, lists and texts, with and without ASCII escapes."""
    return table(spark, d, "nation").select(
        "n_nationkey", formatting.json_dumps(F.struct("n_name", "n_regionkey")).alias("object"),
        formatting.json_dumps(F.array("n_name", F.lit("é")), ensure_ascii=False).alias("list"), formatting.json_dumps(F.concat(F.lit("é"), "n_name")).alias("text"),
    )


@query("SELECT 1 AS exists, 1 AS folder, 0 AS file, sum(octet_length(encode(n_name)) + 1)::BIGINT AS bytes, count(*) AS lines FROM nation")
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "list")
    files.write_text(table(spark, d, "nation").select(F.col("n_name").alias("value")), path)
    fs = files.FileSystem(spark)
    found = files.listing(spark, path, "*.txt")
    lines = files.read_text(spark, f"{path}/*.txt").agg(F.sum(F.size(strings.splitlines(F.col("text")))).alias("lines"))
    return found.agg(F.sum("size").alias("bytes")).crossJoin(lines).select(
        F.lit(int(fs.exists(path))).alias("exists"), F.lit(int(fs.isdir(path))).alias("folder"), F.lit(int(fs.isfile(path))).alias("file"), "bytes", "lines"
    )


@query("SELECT * FROM (VALUES ('a', 'changed'), ('b', 'removed'), ('d', 'created')) t(name, change)")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """A tree's digests before and after: one file changed, one removed, one made, one left alone."""
    path, fs = _folder(spark, "tree"), files.FileSystem(spark)
    nation = table(spark, d, "nation").select(F.col("n_name").alias("value"))
    for name, k in (("a", 1), ("b", 2), ("c", 3)):
        files.write_text(nation.limit(k).coalesce(1), f"{path}/{name}")

    def snapshot() -> DataFrame:
        seen = files.fingerprints(spark, path).where("path like '%.txt'").select(F.regexp_extract("path", "/([a-d])/[^/]*$", 1).alias("path"), "digest")
        return spark.createDataFrame(seen.collect(), "path string, digest string")

    before = snapshot()
    fs.rmtree(f"{path}/a")
    fs.rmtree(f"{path}/b")
    for name, k in (("a", 5), ("d", 4)):
        files.write_text(nation.limit(k).coalesce(1), f"{path}/{name}")
    return files.collateral(before, snapshot()).select(F.col("path").alias("name"), "change")


# entries as JSON lines


_ENTRY = "'py-' || substring(sha256(text), 1, 12)"


@query(f"SELECT {_ENTRY} AS id, any_value(text) AS program, min(source) AS source, count(*) AS count, max(lang) AS note FROM (SELECT * FROM documents WHERE text <> '') GROUP BY {_ENTRY}")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries with an extra field, written as JSON lines and loaded again; then merged."""
    path = _folder(spark, "entries")
    docs = table(spark, d, "documents").where("text <> ''").groupBy("text").agg(F.min("source").alias("source"), F.count("*").alias("count"), F.max("lang").alias("note"))
    line = F.to_json(F.struct(F.col("text").alias("program"), "source", "count", "note"))
    files.write_text(docs.select(line.alias("value")), path)
    entries, _ = jsonl.load(spark, path)
    jsonl.write(entries, f"{path}-again")
    merged = jsonl.load_default(spark, f"{path}-again", f"{path}-missing")
    return merged.select("id", "program", "source", "count", F.variant_get("extra", "$.note", "string").alias("note"))


@query("SELECT count(*) FILTER (WHERE k % 3 = 0) AS entries, count(*) FILTER (WHERE k % 3 <> 0) AS problems FROM (SELECT n_nationkey AS k FROM nation)")
def jsonl_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no JSON object or have no program are problems, not entries."""
    k = F.col("n_nationkey") % 3
    line = F.when(k == 0, F.to_json(F.struct(F.col("n_name").alias("program")))).when(k == 1, F.to_json(F.struct(F.col("n_name").alias("name")))).otherwise("{not json")
    entries, problems = jsonl.parse_entries(table(spark, d, "nation").select(line.alias("value")))
    return entries.agg(F.count("*").alias("entries")).crossJoin(problems.agg(F.count("*").alias("problems")))


# harvest


_LOG = """SELECT turn, conv_id, 'print(' || conv_id || ')' AS program FROM conversations WHERE conv_id % 3 <> 2"""


@query(
    f"""SELECT program, CASE WHEN count(*) FILTER (WHERE conv_id % 3 = 0) > 0 THEN 'shim' ELSE 'hook' END AS source, count(*) AS count, min(printf('2024-01-%02d', turn % 28 + 1)) AS first_seen
    FROM ({_LOG}) GROUP BY program"""
)
def log_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of two feeds, one direct and one in shell commands, as sightings per program."""
    rows = table(spark, d, "conversations").where("conv_id % 3 <> 2")
    program = F.concat(F.lit("print("), F.col("conv_id").cast("string"), F.lit(")"))
    direct = F.col("conv_id") % 3 == 0
    ts = F.format_string("2024-01-%02d", F.col("turn") % 28 + 1)
    record = F.struct(
        F.when(direct, "python_invocation").otherwise("bash_command").alias("kind"), ts.alias("ts"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("session"),
        F.when(direct, program).alias("program"), F.when(~direct, F.concat(F.lit('python3 -c "'), program, F.lit('"'))).alias("command"),
    )
    log = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.to_json(record).alias("value"))
    seen = harvest.aggregate(harvest.occurrences(log.unionByName(log)))  # read twice, counted once
    return seen.select("program", "source", "count", "first_seen")


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("k"), F.count("*").alias("count"))
    return docs.select(
        F.concat(F.lit("key-"), F.sha2("text", 256)).alias("key"), F.col("text").alias("program"), F.array().cast("array<string>").alias("argv_tail"), F.lit("hook").alias("source"),
        F.concat(F.lit("s"), (F.col("k") % 7).cast("string")).alias("session"), F.format_string("2024-02-%02d", F.col("k") % 28 + 1).alias("first_seen"), "count", F.lit(None).cast("string").alias("stdin_sample"),
    )


_SEEN = "SELECT 'key-' || sha256(text) AS key, text AS program, min(doc_id) AS k, count(*) AS n FROM documents WHERE text <> '' GROUP BY text"


@query(f"SELECT key, program, 's' || (k % 7) AS session, greatest(n, n + 1) AS count, printf('2024-02-%02d', k % 28 + 1) AS first_seen FROM ({_SEEN})")
def collected_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Three feeds of one set of sightings: the largest count wins, nothing is doubled."""
    seen = _sightings(spark, d)
    more = seen.withColumn("count", F.col("count") + 1)
    return harvest.collect(seen, more, seen).select("key", "program", "session", "count", "first_seen")


@query(f"SELECT key AS id, program, CASE WHEN k % 2 = 0 THEN n + 5 ELSE n END AS count, printf('2024-02-%02d', k % 28 + 1) AS first_seen FROM ({_SEEN})")
def folded_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Sightings merged into a corpus that has half of them: old ids are updated, new ones inserted."""
    seen = _sightings(spark, d)
    ids = table(spark, d, "documents").where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("k")).where("k % 2 = 0").select(F.concat(F.lit("key-"), F.sha2("text", 256)).alias("key"))
    corpus = seen.join(ids, "key", "left_semi").select(F.col("key").alias("id"), "program", "argv_tail", "source", F.lit("2024-12-31").alias("first_seen"), (F.col("count") + 5).alias("count"), "stdin_sample", F.lit(None).cast("variant").alias("extra"))
    return harvest.fold_into_corpus(corpus, seen).select("id", "program", "count", "first_seen")


_PLANTED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'password=\"hunter22\" ' || doc_id WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN 'pass' ELSE 'x = ' || doc_id END AS program FROM documents"


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'password="[REDACTED password 8 chars]" ' || doc_id ELSE program END AS program,
    CASE WHEN doc_id % 5 = 1 THEN 'empty' WHEN doc_id % 5 = 2 THEN 'trivial' WHEN doc_id % 5 = 3 THEN 'known' ELSE '' END AS reason FROM ({_PLANTED})"""
)
def cleaned_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Redacted, keyed anew, and held against what is known."""
    k = F.col("doc_id") % 5
    number = F.col("doc_id").cast("string")
    program = F.when(k == 0, F.concat(F.lit('password="hunter22" '), number)).when(k == 1, "").when(k == 2, "pass").otherwise(F.concat(F.lit("x = "), number))
    rows = table(spark, d, "documents").select("doc_id", program.alias("program"), F.array().cast("array<string>").alias("argv_tail"))
    known = harvest.known_keys(rows.where("doc_id % 5 = 3").select(F.lit(None).cast("string").alias("id"), "program"))
    return harvest.clean(rows, known).select("doc_id", "program", "reason")


@query(f"SELECT 's' || (k % 7) AS session, count(*) AS rows FROM ({_SEEN}) WHERE length(program) <= 3000 GROUP BY 1")
def exported_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What is published: clean sightings by session, and nothing the second time."""
    seen = _sightings(spark, d).where(F.length("program") <= 3000).withColumn("program", F.concat(F.lit("x = "), F.sha2("program", 256)))
    nothing = seen.where("false").select(F.col("key").alias("id"))
    first, _ = harvest.export(seen, nothing, None)
    again, _ = harvest.export(seen, nothing, first)
    return first.unionByName(again).groupBy("session").agg(F.count("*").alias("rows"))


@query("SELECT conv_id, turn, 'python3 -c ''print(' || turn || ')''' AS command, 's' || conv_id AS session FROM conversations WHERE turn % 2 = 0")
def captured_commands(spark: SparkSession, d: str) -> DataFrame:
    """Command events as a stream: written to a folder, read as they arrive, published batch by batch."""
    path = _folder(spark, "stream")
    rows = table(spark, d, "conversations")
    run = F.concat(F.lit("python3 -c 'print("), F.col("turn").cast("string"), F.lit(")'"))
    command = F.when(F.col("turn") % 2 == 0, run).otherwise("ls -l")
    event = F.struct(
        F.lit("Bash").alias("tool_name"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.struct(command.alias("command"), F.concat_ws("/", "conv_id", "turn").alias("description")).alias("tool_input")
    )
    files.write_text(rows.select(F.to_json(event).alias("value")), f"{path}/in")
    capture.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint")
    place = F.split("description", "/")
    found = spark.read.parquet(f"{path}/out/records")
    return found.select(F.get(place, F.lit(0)).cast("long").alias("conv_id"), F.get(place, F.lit(1)).cast("long").alias("turn"), "command", "session")


# sources and gates


@query("SELECT n_nationkey, list_sort([lower(n_name), 'sys']) AS modules FROM nation")
def registered_modules(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("MP_REGISTER_MODULE(MP_QSTR_"), F.lower("n_name"), F.lit(", a);\nMP_REGISTER_EXTENSIBLE_MODULE( MP_QSTR__sys, b);"))
    return table(spark, d, "nation").select("n_nationkey", programs.registered_modules(source).alias("modules"))


@query(
    """SELECT p_partkey, CAST(round_even(100.0 * greatest(ceil(CAST(floor(p_retailprice * 1000) AS BIGINT) / 131072.0) / 4.0, p_size / 20.0), 0) AS BIGINT) AS ms FROM part"""
)
def projected_cold_time(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("p_retailprice") * 1000).cast("long")
    return table(spark, d, "part").select("p_partkey", gate.project_cold_ms(size, F.col("p_size"), F.lit(400_000), F.lit(20), F.lit(100.0)).alias("ms"))


@query("SELECT p_brand, count(*) FILTER (WHERE side = 'ours') AS ours, count(*) FILTER (WHERE side = 'baseline') AS baseline FROM (SELECT p_brand, 'ours' AS side FROM part UNION ALL SELECT p_brand, 'baseline' FROM part WHERE p_size > 25) GROUP BY p_brand")
def compared_with_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    both = gate.compare(p.select("p_brand", "p_size"), p.where("p_size > 25").select("p_brand"))
    return both.groupBy("p_brand").agg(F.count_if(F.col("side") == "ours").alias("ours"), F.count_if(F.col("side") == "baseline").alias("baseline"))


@query("SELECT name FROM (VALUES ('API_KEY'), ('DB_SECRET')) t(name)")
def environment_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Names of variables that hold one opaque credential."""
    env = {"API_KEY": "abcdef0123456789", "HOME_TOKEN": "/home/user/token", "DB_SECRET": "s3cr3tvalue99", "PATH": "abcdef0123456789", "MY_KEY": "placeholder", "PIN_KEY": "123456789012"}
    return spark.createDataFrame([(name,) for name, _ in redaction.secret_values(env)], "name string")


# programs: statements, functions, exceptions


def _native(plan):
    assert plan.tier == NATIVE
    return plan.column


@query(
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 2 * p_size + 1 WHEN p_size > 10 THEN p_size - 3 ELSE 0 END AS branched, 6 * p_size + 10 AS looped,
    p_size * p_size + 7 AS called, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE upper(p_name) END AS early, p_size AS swapped FROM part"""
)
def program_native(spark: SparkSession, d: str) -> DataFrame:
    """Assignments, branches, unrolled loops, functions and lambdas as one expression each."""
    p = table(spark, d, "part")
    texts = {
        "branched": "if p_size > 25:\n    result = p_size\n    result *= 2\n    result += 1\nelif p_size > 10:\n    result = p_size - 3\nelse:\n    result = 0",
        "looped": "total = 0\nfor k in [1, 2, 3]:\n    total += k * p_size\nfor k in range(5):\n    total += k\nresult = total",
        "called": "def square(x, more=7):\n    y = x * x\n    return y + more\nresult = square(p_size)",
        "early": "def pick(n):\n    if n % 2 == 0:\n        return p_brand\n    up = p_name.upper()\n    return up\nresult = pick(p_size)",
        "swapped": "f = lambda v: v + 1\na, b = f(p_size), p_size\na, b = b, a\nassert b == a + 1, 'swapped'\nresult = a",
    }
    return p.select("p_partkey", *[_native(compile_program(t, p)).alias(name) for name, t in texts.items()])


@query(
    """SELECT p_partkey, list_sum(list_filter(range(1, p_size + 1), lambda k: k % 3 <> 0))::BIGINT AS summed, list_reverse_sort(list_distinct(string_split(p_name, ' ')))[1] AS last,
    CAST(CASE WHEN p_size % 5 = 0 THEN -1 ELSE 100 // (p_size % 5) END AS BIGINT) AS guarded, string_split(p_name, ' ')[2:] AS rest FROM part WHERE p_size >= 1"""
)
def program_arrow(spark: SparkSession, d: str) -> DataFrame:
    """while with continue and break, closures with key=, try with else and finally, unpacking with a star."""
    p = table(spark, d, "part").where("p_size >= 1")
    texts = {
        "summed": ("k, result = 0, 0\nwhile True:\n    k += 1\n    if k > p_size:\n        break\n    if k % 3 == 0:\n        continue\n    result += k", "long"),
        "last": ("def order(sign):\n    def key(w):\n        return w\n    return key\nresult = sorted(set(p_name.split(' ')), key=order(1), reverse=True)[0]", "string"),
        "guarded": ("try:\n    result = 100 // (p_size % 5)\nexcept ZeroDivisionError as e:\n    result = -1\nelse:\n    result += 0\nfinally:\n    done = True", "long"),
        "rest": ("first, *result = p_name.split(' ')", "array<string>"),
    }
    return p.select("p_partkey", *[compile_program(t, p, kind).column.alias(name) for name, (t, kind) in texts.items()])


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'ValueError: small ' || p_size WHEN p_size % 4 = 1 THEN 'KeyError: ''x''' WHEN p_size % 4 = 2 THEN 'AssertionError: odd' ELSE 'none' END AS error,
    CAST(CASE WHEN p_size % 4 = 3 THEN p_size ELSE -1 END AS BIGINT) AS value, 'p' || p_size || chr(10) AS printed FROM part"""
)
def program_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a program raises, by the name and text that Python shows; and what it prints."""
    p = table(spark, d, "part")
    text_ = "k = p_size % 4\nif k == 0:\n    raise ValueError('small ' + str(p_size))\nif k == 1:\n    {}['x']\nassert k != 2, 'odd'\nresult = p_size"
    outcome = compile_program(text_, p, "long", errors="struct").column
    printed = compile_program("print('p', p_size, sep='')", p, "string", result="stdout").column
    rows = p.select("p_partkey", outcome.alias("o"), printed.alias("printed"))
    return rows.select("p_partkey", F.coalesce("o.error", F.lit("none")).alias("error"), F.coalesce("o.value", F.lit(-1)).cast("long").alias("value"), "printed")


@query("SELECT p_partkey, p_size * 3 + 1 AS lambda_value, p_brand || '/' || p_type AS joined, upper(p_name) || '!' AS read FROM part")
def user_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions given as text, *args among them, and a program that reads a column as its input."""
    p = table(spark, d, "part")
    joined = compile_function("def glue(*parts, sep='/'):\n    return sep.join(parts)", p, "p_brand", "p_type", returns="string")
    read = compile_program("result = input().upper() + getenv('MARK', '?')", p, "string", stdin="p_name", environment={"MARK": "!"})
    return p.select("p_partkey", _native(compile_function("lambda n: n * 3 + 1", p, "p_size")).alias("lambda_value"), joined.column.alias("joined"), read.column.alias("read"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS BIGINT) AS value FROM part GROUP BY p_brand")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_function("lambda values: values[-1] - values[0]", table(spark, d, "part"), "p_size", "p_brand", returns="long")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'column' WHEN 2 THEN 'batch' WHEN 3 THEN 'refused' ELSE 'refused' END AS engine,
    CASE event_id % 5 WHEN 0 THEN 'class' WHEN 3 THEN 'import' WHEN 4 THEN 'decorator' END AS kind, CASE event_id % 5 WHEN 0 THEN 'C' || user_id WHEN 3 THEN 'm' || user_id WHEN 4 THEN 'd' || user_id END AS detail FROM events"""
)
def program_routes(spark: SparkSession, d: str) -> DataFrame:
    """The tier each program text goes to, and what a refused one needs."""
    k, n = F.col("event_id") % 5, F.col("user_id").cast("string")
    program = (
        F.when(k == 0, F.concat(F.lit("class C"), n, F.lit(": pass")))
        .when(k == 1, F.concat(F.lit("x = value + "), n))
        .when(k == 2, F.concat(F.lit("while x < "), n, F.lit(":\n    x = value")))
        .when(k == 3, F.concat(F.lit("from m"), n, F.lit(" import y")))
        .otherwise(F.concat(F.lit("@d"), n, F.lit("\ndef f(): pass")))
    )
    return table(spark, d, "events").select("event_id", routes.classify(program, "value").alias("r")).select("event_id", "r.*")


# lists are shown as texts, as clients of the two engines give them in different forms

LISTS = {
    "split_lines": "lines", "regex_escape": "hosts", "list_changes": "extended inserted before_last thrice without_first backwards appended", "ranges_map_filter": "up down squares thirds",
    "list_zip": "pairs", "dict_changes": "updated rest made keys", "set_changes": "added discarded removed updated", "bytes_changes": "parts", "text_dedent": "lines", "text_wrapped": "wrapped",
    "path_pieces": "parts", "registered_modules": "modules", "program_arrow": "rest", "redacted_texts": "hits",
}


def _joined(build: Query, columns: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return build(spark, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in columns})

    return run


for _name, _columns in LISTS.items():
    QUERIES[_name] = _joined(QUERIES[_name], _columns.split())
    _texts = ", ".join(f"coalesce(array_to_string({c}, '|'), '') AS {c}" for c in _columns.split())
    SQL[_name] = f"SELECT * REPLACE ({_texts}) FROM ({SQL[_name]})"
