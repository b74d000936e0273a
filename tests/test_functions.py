"""Column functions against CPython over edge values."""

import base64
import csv
import datetime
import hashlib
import io
import json
import math
import posixpath
import re
import textwrap
import unicodedata
import urllib.parse
import zlib
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from lathe import queries
from lathe.functions import collections as L
from lathe.functions import dates, formatting, numbers, paths, regex, strings, text, web

INTS = [0, 1, -1, 2, -2, 7, -7, 9, 100, -99, 2**31, -(2**62), 2**62 - 1]
FLOATS = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, 2.675, 1e16, 123456789012345.67, 1e-5, 0.0001, 1e22, -3.75, 1 / 3, 1e300, 5e-324, float("inf"), float("-inf"), float("nan")]
TEXTS = ["", " ", "a", "abc", "  pad ded  ", "A-b c-D", "x\r\ny\rz\n", "日本 語", "straße", "½", "emoji😀tail", "a,b,,c", "aXbXc", "tab\tsep", " wide ", "Ünï Çödé", "it's", "'\"", "1_000", "-42", "a.b.c", "..", "THE END"]


def same(a, b):
    if isinstance(a, bytearray):
        a = bytes(a)
    if isinstance(a, float) and isinstance(b, float):
        return a == b and math.copysign(1, a) == math.copysign(1, b) or a != a and b != b
    return a == b and type(a) is type(b) or isinstance(a, (list, tuple)) and list(a) == list(b)


def check(spark, kind, values, column, oracle):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    got = {r.k: r.y for r in frame.select("k", column(F.col("x")).alias("y")).collect()}
    for k, v in enumerate(values):
        want = oracle(v)
        assert same(got[k], want), (v, got[k], want)


def check2(spark, kind, pairs, column, oracle):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a {kind}, b {kind}")
    got = {r.k: r.y for r in frame.select("k", column(F.col("a"), F.col("b")).alias("y")).collect()}
    for k, (a, b) in enumerate(pairs):
        assert same(got[k], oracle(a, b)), (a, b, got[k], oracle(a, b))


PAIRS = [(a, b) for a in INTS for b in INTS if b]


def test_integer_division_and_remainder(spark):
    check2(spark, "long", PAIRS, numbers.floor_div, lambda a, b: a // b)
    check2(spark, "long", PAIRS, numbers.mod, lambda a, b: a % b)
    check2(spark, "long", PAIRS, numbers.true_div, lambda a, b: float(a) / float(b))
    pairs = [(a, b) for a in FLOATS if math.isfinite(a) for b in (1.0, -2.0, 0.3, -7.5)]
    check2(spark, "double", pairs, numbers.mod, lambda a, b: a % b)
    check2(spark, "double", [(a, b) for a, b in pairs if abs(a) < 1e15], numbers.float_floor_div, lambda a, b: a // b)


def test_powers_shifts_and_errors(spark):
    pairs = [(a, b) for a in (0, 1, -1, 2, -3, 10) for b in (0, 1, 2, 3, 15)]
    check2(spark, "long", pairs, numbers.int_pow, lambda a, b: a**b)
    check2(spark, "long", [(1, 62), (-5, 3), (0, 99), (7, 0)], numbers.left_shift, lambda a, b: a << b)
    check2(spark, "long", [(1 << 40, 3), (-5, 1), (-5, 99), (7, 0)], numbers.right_shift, lambda a, b: a >> b)
    for column in (numbers.left_shift(F.lit(1), F.lit(64)), numbers.left_shift(F.lit(1), F.lit(-1)), numbers.int_pow(F.lit(10), F.lit(19)), numbers.floor_div(F.lit(1), F.lit(0))):
        with pytest.raises(Exception):
            spark.range(1).select(column).collect()


def test_rounding(spark):
    values = [v for v in FLOATS if abs(v) < 1e15 or not math.isfinite(v)] + [k / 8 for k in range(-40, 40)] + [0.125, 1.005, 2.675, 1234.565, 0.285]
    for digits in (0, 1, 2):
        check(spark, "double", values, lambda x, d=digits: numbers.round_(x, d), lambda v, d=digits: round(v, d) if math.isfinite(v) else v)
    check(spark, "double", [15.0, 25.0, -35.0, 1449.9], lambda x: numbers.round_(x, -1), lambda v: round(v, -1))


def test_comparison_and_truth(spark):
    nan = float("nan")
    pairs = [(a, b) for a in (1.0, nan, -0.0) for b in (0.0, nan, 1.0)]
    check2(spark, "double", pairs, numbers.less, lambda a, b: a < b)
    check2(spark, "double", pairs, numbers.float_equal, lambda a, b: a == b)
    check(spark, "string", ["", "a", None], lambda x: numbers.truthy(x, "string"), bool)
    check(spark, "long", [0, 3, None], lambda x: numbers.truthy(x, "bigint"), bool)
    check2(spark, "long", [(0, 5), (3, 5), (None, 2)], lambda a, b: numbers.and_(a, b, "bigint"), lambda a, b: a and b)
    check2(spark, "long", [(0, 5), (3, 5), (None, 2)], lambda a, b: numbers.or_(a, b, "bigint"), lambda a, b: a or b)


def attempt(f):
    def run(v):
        try:
            return f(v)
        except ValueError:
            return None

    return run


def test_parsing_and_bases(spark):
    texts = ["7", " -7\n", "+0", "1_000", "1__0", "_1", "", "x", "0x10", "7.0", "9223372036854775807", "12"]
    check(spark, "string", texts, numbers.parse_int, attempt(int))
    check(spark, "string", ["ff", "0xFF", "-0x_1f", "zz", "1g"], lambda x: numbers.parse_int(x, 16), attempt(lambda v: int(v, 16)))
    check(spark, "string", ["101", "0b11", "2"], lambda x: numbers.parse_int(x, 2), attempt(lambda v: int(v, 2)))
    check(spark, "string", ["1.5", " inf", "-Infinity", "nan", "1_0.5", "1e5", ".5", "5.", ".", "1__0", "e5", "0x1"], numbers.parse_float, attempt(float))
    for base, f in ((16, hex), (8, oct), (2, bin)):
        check(spark, "long", [*INTS, -(2**63)], lambda x, b=base: numbers.to_base(x, b), f)
    check(spark, "string", ["a", "é", "日", "😀"], numbers.ord_, ord)
    check(spark, "int", [97, 233, 0x65E5, 0x1F600], numbers.chr_, chr)


@pytest.mark.parametrize(
    "name, args",
    [
        ("upper", ()), ("casefold", ()), ("swapcase", ()), ("title", ()), ("capitalize", ()), ("strip", ()), ("lstrip", ()), ("rstrip", ()), ("strip", (" a-c",)), ("split", ()), ("split", (",",)),
        ("split", ("X", 1)), ("rsplit", (",", 1)), ("rsplit", (".", 5)), ("splitlines", ()), ("splitlines", (True,)), ("replace", ("a", "bb")), ("replace", ("a", "bb", 1)), ("replace", ("", "-")),
        ("find", ("b",)), ("rfind", ("c",)), ("count", ("X",)), ("count", ("X", 2)), ("removeprefix", ("a",)), ("removesuffix", ("c",)), ("ljust", (5, "*")), ("rjust", (5,)), ("center", (8,)), ("zfill", (6,)),
        ("isalpha", ()), ("isdigit", ()), ("isdecimal", ()), ("isnumeric", ()), ("isalnum", ()), ("isspace", ()), ("islower", ()), ("isupper", ()), ("isascii", ()),
    ],
)
def test_string_methods(spark, name, args):
    check(spark, "string", TEXTS, lambda x: getattr(strings, name)(x, *args), lambda v: getattr(v, name)(*args))


def test_string_pieces(spark):
    for sep in ("-", "X", "b c"):
        check(spark, "string", TEXTS, lambda x, s=sep: strings.partition(x, s), lambda v, s=sep: v.partition(s))
        check(spark, "string", TEXTS, lambda x, s=sep: strings.rpartition(x, s), lambda v, s=sep: v.rpartition(s))
    check(spark, "string", TEXTS, lambda x: strings.startswith(x, "a", " "), lambda v: v.startswith(("a", " ")))
    for s in [(None, None, -1), (1, 3, 1), (-3, None, 1), (None, -1, 2), (5, 1, -2), (10, 20, 1), (-1, -4, -1)]:
        check(spark, "string", TEXTS, lambda x, s=s: strings.slice_(x, *s), lambda v, s=s: v[slice(*s)])
        check(spark, "array<int>", [[], [1], [1, 2, 3, 4, 5]], lambda x, s=s: L.slice_(x, *s), lambda v, s=s: v[slice(*s)])
    check(spark, "string", ["abc", ""], lambda x: strings.char_at(x, -1), lambda v: v[-1] if v else None)
    check(spark, "array<string>", [["a", "b"], [], ["x"]], lambda x: strings.join("-", x), "-".join)
    with pytest.raises(Exception):
        spark.createDataFrame([(["a", None],)], "x array<string>").select(strings.join("", F.col("x"))).collect()


LISTS = [[], [3], [3, 1, 2, 3, 1], [5, 5, 5], list(range(10))]


def test_lists(spark):
    kind = "array<long>"
    for reverse in (False, True):
        check(spark, kind, LISTS, lambda x, r=reverse: L.sort(x, key=lambda v: v % 3, reverse=r), lambda v, r=reverse: sorted(v, key=lambda e: e % 3, reverse=r))
    check(spark, kind, LISTS, lambda x: L.min_by(x, lambda v: v % 3), lambda v: min(v, key=lambda e: e % 3, default=None))
    check(spark, kind, LISTS, lambda x: L.max_by(x, lambda v: v % 3), lambda v: max(v, key=lambda e: e % 3, default=None))
    check(spark, kind, LISTS, lambda x: L.sum_(x, F.lit(0).cast("long")), sum)
    check(spark, kind, LISTS, lambda x: L.count(x, F.lit(3)), lambda v: v.count(3))
    check(spark, kind, LISTS, lambda x: L.enumerate_(x, 5), lambda v: list(enumerate(v, 5)))
    check(spark, kind, LISTS, lambda x: L.zip_(x, F.slice(x, 1, 2)), lambda v: list(zip(v, v[:2])))
    check(spark, kind, LISTS, lambda x: L.insert(x, -1, F.lit(9).cast("long")), lambda v: (lambda w: (w.insert(-1, 9), w)[1])(list(v)))
    check(spark, kind, LISTS, lambda x: L.insert(x, 2, F.lit(9).cast("long")), lambda v: (lambda w: (w.insert(2, 9), w)[1])(list(v)))
    check(spark, kind, [x for x in LISTS if 3 in x], lambda x: L.remove(x, F.lit(3).cast("long")), lambda v: (lambda w: (w.remove(3), w)[1])(list(v)))
    check(spark, kind, LISTS, lambda x: L.pop(x)["rest"], lambda v: v[:-1] if v else None)
    check(spark, kind, LISTS, lambda x: L.comprehension(x, lambda v: v * 2, lambda v: v > 1), lambda v: [e * 2 for e in v if e > 1])
    check(spark, kind, LISTS, lambda x: L.nested(x, lambda v: F.array(v, v + 1), lambda a, b: a * b), lambda v: [a * b for a in v for b in (a, a + 1)])
    check(spark, kind, LISTS, lambda x: L.any_(x, lambda v: v > 4), lambda v: any(e > 4 for e in v))
    check(spark, kind, LISTS, lambda x: L.all_(x, lambda v: v > 0), lambda v: all(e > 0 for e in v))
    check(spark, kind, LISTS, lambda x: L.repeat(x, F.lit(2)), lambda v: v * 2)
    check2(spark, "long", [(0, 0), (0, 3), (5, 2), (-2, 2)], L.range_, lambda a, b: list(range(a, b)))
    check2(spark, "long", [(0, 0), (0, 3), (5, 2)], lambda a, b: L.range_(a, b, -2), lambda a, b: list(range(a, b, -2)))
    check(spark, kind, LISTS, lambda x: L.most_common(x, 2), lambda v: __import__("collections").Counter(v).most_common(2))


def test_dicts_and_sets(spark):
    frame = spark.createDataFrame([({"a": 1, "b": None},)], "m map<string,int>")
    m = F.col("m")
    row = frame.select(
        L.get(m, F.lit("b"), F.lit(7)).alias("stored_none"), L.get(m, F.lit("z"), F.lit(7)).alias("missing"), L.update(m, F.create_map(F.lit("a"), F.lit(5), F.lit("c"), F.lit(6))).alias("updated"),
        L.setdefault(m, F.lit("a"), F.lit(9)).alias("kept"), L.popitem(m).alias("last"), L.dict_pop(m, F.lit("a")).alias("popped"),
    ).first()
    assert (row.stored_none, row.missing, row.updated, row.kept, tuple(row["last"]), row.popped.value, row.popped.rest) == (None, 7, {"a": 5, "b": None, "c": 6}, {"a": 1, "b": None}, ("b", None), 1, {"b": None})
    with pytest.raises(Exception):
        frame.select(L.lookup(m, F.lit("z"))).collect()
    pairs = [([1, 2, 2], [2, 3]), ([], [1]), ([4], [])]
    for mine, op in ((L.union, set.union), (L.intersection, set.intersection), (L.difference, set.difference), (L.symmetric_difference, set.symmetric_difference)):
        check2(spark, "array<long>", pairs, mine, lambda a, b, op=op: sorted(op(set(a), set(b))))
    check2(spark, "array<long>", pairs, L.issubset, lambda a, b: set(a) <= set(b))


def test_display(spark):
    check(spark, "double", FLOATS, formatting.float_repr, repr)
    check(spark, "double", [v for v in FLOATS if math.isfinite(v) and abs(v) < 1e18], lambda x: formatting.fixed(x, 2), lambda v: f"{v:.2f}")
    check(spark, "boolean", [True, False, None], lambda x: formatting.py_str(x, "boolean"), str)
    check(spark, "string", TEXTS, formatting.repr_, repr)
    check(spark, "array<string>", [["a", None], []], formatting.repr_, repr)
    check(spark, "long", INTS, lambda x: formatting.format_(x, "+,d"), lambda v: format(v, "+,d"))
    check(spark, "double", [1.5, 1e10], lambda x: formatting.percent_format("%08.3f|%g", x, x), lambda v: "%08.3f|%g" % (v, v))
    check(spark, "string", TEXTS, lambda x: formatting.template("{0!r:>10}{n}", x, n=x), lambda v: "{0!r:>10}{n}".format(v, n=v))
    check(spark, "string", TEXTS, formatting.json_dumps, json.dumps)
    check(spark, "string", ['{"b": 1, "a": [1.0, NaN]}', "[1,", '{"a":1,"a":2}'], lambda x: formatting.json_rewrite(x, sort_keys=True), attempt(lambda v: json.dumps(json.loads(v), sort_keys=True)))
    with pytest.raises(ValueError):
        formatting.format_(F.lit(1), "n")
    with pytest.raises(ValueError):
        formatting.template("{0.__class__}", F.lit(1))


PATTERNS = [r"\w+", r"[a-c]+", r"(\w)(\w)", r"X|-", r"^\S+$", r"\d+", r"(?P<first>\w)\S*"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_regex(spark, pattern):
    compiled = re.compile(pattern)
    check(spark, "string", TEXTS, lambda x: regex.search(x, pattern), lambda v: compiled.search(v) is not None)
    check(spark, "string", TEXTS, lambda x: regex.match(x, pattern), lambda v: compiled.match(v) is not None)
    check(spark, "string", TEXTS, lambda x: regex.fullmatch(x, pattern), lambda v: compiled.fullmatch(v) is not None)
    check(spark, "string", TEXTS, lambda x: F.transform(regex.findall(x, pattern), lambda e: e.cast("string") if compiled.groups < 2 else F.concat(e["_0"], e["_1"])), lambda v: ["".join(m) for m in compiled.findall(v)])
    check(spark, "string", TEXTS, lambda x: regex.sub(x, pattern, "<$>"), lambda v: compiled.sub("<$>", v))
    check(spark, "string", TEXTS, lambda x: regex.sub(x, pattern, "_", count=1), lambda v: compiled.sub("_", v, 1))
    check(spark, "string", TEXTS, lambda x: regex.split(x, pattern), compiled.split)
    check(spark, "string", TEXTS, lambda x: regex.subn(x, pattern, "")["n"], lambda v: compiled.subn("", v)[1])


DATES = [datetime.date(1, 1, 1), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29), datetime.date(9999, 12, 31)]
TIMES = [datetime.datetime(2024, 2, 29, 13, 5, 9), datetime.datetime(1999, 12, 31, 0, 0, 0, 120), datetime.datetime(2024, 1, 1, 23, 59, 59, 999999)]


def test_dates(spark):
    check(spark, "date", DATES, dates.toordinal, lambda v: v.toordinal())
    check(spark, "date", DATES, dates.weekday, lambda v: v.weekday())
    check(spark, "date", DATES, dates.isoweekday, lambda v: v.isoweekday())
    check(spark, "int", [1, 719163, 738945], dates.fromordinal, datetime.date.fromordinal)
    check(spark, "timestamp_ntz", TIMES, dates.isoformat, lambda v: v.isoformat())
    for spec in ("%Y-%m-%d", "%d/%m/%y %H:%M:%S.%f", "%I %p on day %j, 100%%", "%A %a %B %b"):
        check(spark, "timestamp_ntz", TIMES, lambda x, s=spec: dates.strftime(x, s), lambda v, s=spec: v.strftime(s))
    check(spark, "timestamp_ntz", TIMES, dates.timestamp, lambda v: v.replace(tzinfo=datetime.timezone.utc).timestamp())
    check(spark, "string", ["2024-02-29", "2023-02-29", "x", "2024-2-9"], dates.date_fromisoformat, attempt(lambda v: datetime.datetime.strptime(v, "%Y-%m-%d").date() if len(v) == 10 else None))
    check(spark, "date", [datetime.date(2024, 5, 9)], lambda x: dates.replace(x, year=2020, day=1), lambda v: v.replace(year=2020, day=1))
    parts = lambda v: (lambda t: (t.days, t.seconds, t.microseconds))(datetime.timedelta(seconds=v))
    check(spark, "double", [0.0, -1.0, 90061.5, -0.25], dates.timedelta_parts, parts)
    with pytest.raises(ValueError):
        dates.java_format("%Q")


URLS = ["http://a.com/b/c?x=1&y=2#f", "https://u@h:80", "//host/p", "/rel/path?q", "name", "mailto:x@y", "?a=b", "#frag", "HTTP://X/"]


def test_web(spark):
    texts = TEXTS
    check(spark, "string", texts, web.quote, urllib.parse.quote)
    check(spark, "string", texts, web.quote_plus, urllib.parse.quote_plus)
    check(spark, "string", [*map(urllib.parse.quote, texts), "100%", "a+b", "%zz"], web.unquote, urllib.parse.unquote)
    check(spark, "string", [*map(urllib.parse.quote_plus, texts)], web.unquote_plus, urllib.parse.unquote_plus)

    def parse(u):
        p = urllib.parse.urlsplit(u)
        return (p.scheme, p.netloc, p.path, p.query, p.fragment)

    check(spark, "string", URLS, web.urlparse, parse)
    check(spark, "string", URLS[:5], lambda x: web.urlunparse(web.urlparse(x)), lambda v: urllib.parse.urlunsplit(urllib.parse.urlsplit(v)))
    check(spark, "string", ["a=1&b=2&a=3", "a=&b=x", "", "k=%20+v"], lambda x: F.transform(web.parse_qsl(x), lambda p: F.concat(p["k"], F.lit("|"), p["v"])), lambda v: ["|".join(p) for p in urllib.parse.parse_qsl(v)])
    check(spark, "string", ["a=1&b=2&a=3"], web.parse_qs, urllib.parse.parse_qs)
    base = "http://a.com/b/c?q=1"
    check(spark, "string", ["d", "../d", "/x", "//h/y", "?z=2", "#f", "", "http://o/", "./e/../f", "../.."], lambda x: web.urljoin(F.lit(base), x), lambda v: urllib.parse.urljoin(base, v))
    blobs = [b"", b"abc", bytes(range(256))]
    check(spark, "binary", blobs, web.b64encode, lambda v: base64.b64encode(v).decode())
    check(spark, "binary", blobs, web.urlsafe_b64encode, lambda v: base64.urlsafe_b64encode(v).decode())
    check(spark, "binary", blobs, lambda x: web.decompress(web.compress(x)), lambda v: v)
    for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        check(spark, "binary", blobs, lambda x, n=name: web.digest(x, n), lambda v, n=name: hashlib.new(n, v).hexdigest())
    check(spark, "binary", blobs, web.crc32, zlib.crc32)
    with pytest.raises(ValueError):
        web.digest(F.lit("x"), "whirl")


PATHS = ["a/b/c.txt", "/a/b/", "", "/", "a.tar.gz", ".profile", "x/..", "..//y/./z", "/../q", "name.", "a//b", "~", "~/x", "dir/.hidden.d"]


def test_paths(spark):
    for mine, theirs in ((paths.basename, posixpath.basename), (paths.dirname, posixpath.dirname), (paths.normpath, posixpath.normpath), (paths.splitext, posixpath.splitext), (paths.isabs, posixpath.isabs)):
        check(spark, "string", PATHS, mine, theirs)
    check2(spark, "string", [(a, b) for a in PATHS[:5] for b in PATHS[:5]], paths.join, posixpath.join)
    check2(spark, "string", [("a/b/c", "a"), ("a", "a/b"), ("a", "a"), ("x/y", "a/b")], lambda p, s: paths.relpath(p, s), lambda p, s: posixpath.relpath(p, s))
    pure = [p for p in PATHS if p not in ("", "name.", "x/..", "..//y/./z")]
    check(spark, "string", pure, paths.name, lambda v: PurePosixPath(v).name)
    check(spark, "string", pure, paths.suffix, lambda v: PurePosixPath(v).suffix)
    check(spark, "string", pure, paths.stem, lambda v: PurePosixPath(v).stem)
    check(spark, "string", pure, paths.parts, lambda v: list(PurePosixPath(v).parts))
    check(spark, "string", ["a.py", "b.txt", "dir/a.py"], lambda x: paths.fnmatch(x, "*.p[xy]"), lambda v: __import__("fnmatch").fnmatchcase(v, "*.p[xy]"))
    check(spark, "string", PATHS, lambda x: paths.expanduser(x, "/home/u"), lambda v: "/home/u" + v[1:] if v == "~" or v.startswith("~/") else v)


def test_text(spark):
    blocks = ["  a\n    b\n\n  c", "one two three four five six seven", "", "\tx\n\ty"]
    check(spark, "string", blocks, text.dedent, textwrap.dedent)
    check(spark, "string", blocks, lambda x: text.wrap(x, 10), lambda v: textwrap.wrap(v, 10))
    check(spark, "string", blocks, lambda x: text.indent(x, "> $"), lambda v: textwrap.indent(v, "> $"))
    check(spark, "string", blocks, lambda x: text.shorten(x, 12), lambda v: textwrap.shorten(v, 12))
    check(spark, "string", TEXTS, lambda x: text.normalize(x, "NFKD"), lambda v: unicodedata.normalize("NFKD", v))
    lines = ['a,"b,c",d', 'x,"say ""hi""",', "", '"multi\nline",2']
    check(spark, "string", lines, text.csv_row, lambda v: next(csv.reader(io.StringIO(v)), []))
    check(spark, "array<string>", [["a", 'q"', "c,d"], [""], ["x\ny"]], text.csv_write, lambda v: (lambda o: (csv.writer(o).writerow(v), o.getvalue())[1])(io.StringIO()))
    check(spark, "string", ["1,2", "1,2,3,4"], lambda x: text.csv_dict(x, ["a", "b", "c"], restval="-"), lambda v: {"1,2": {"a": "1", "b": "2", "c": "-"}, "1,2,3,4": {"a": "1", "b": "2", "c": "3", "rest": "4"}}[v])
    blobs = [b"", b" Ab c ", b"x,y,,z", bytes([255, 0, 65])]
    for mine, theirs in ((text.bytes_hex, bytes.hex), (text.bytes_lower, bytes.lower), (text.bytes_strip, bytes.strip), (lambda x: text.bytes_find(x, b","), lambda v: v.find(b","))):
        check(spark, "binary", blobs, mine, theirs)
    check(spark, "binary", blobs, lambda x: F.size(text.bytes_split(x, b",")), lambda v: len(v.split(b",")))
    check(spark, "binary", blobs, text.bytes_decode, attempt(lambda v: v.decode()))


def test_wrap_query_of_blank_texts(spark, tmp_path):
    blank = [(0, ""), (1, " \n\t"), (2, None), (3, "one  two")]
    spark.createDataFrame(blank, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.text_wrap_fold(spark, str(tmp_path)).collect()}
    assert got == {0: (0, None, "", ""), 1: (0, None, "", " \n\t"), 2: (None,) * 4, 3: (1, "one  two", "one two", "one  two")}


def test_display_of_structs_and_anchored_globs(spark):
    row = spark.range(1).select(
        formatting.json_dumps(F.struct(F.lit(1).alias("a"), F.array(F.lit("é")).alias("b"), F.lit(None).cast("double").alias("c"))).alias("j"),
        formatting.repr_(F.lit(None).cast("double")).alias("n"), formatting.repr_(F.lit(float("nan"))).alias("nan"),
        *[paths.fnmatch(F.lit(x), "th*").alias(k) for k, x in (("yes", "there"), ("no", "blog.there"))],
    ).first()
    assert tuple(row) == ('{"a": 1, "b": ["\\u00e9"], "c": null}', "None", "nan", True, False)
