"""Lexical path functions."""

from __future__ import annotations

import fnmatch as _fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    head = F.regexp_replace(p, "[^/]*$", "")
    return F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def split(p: Column) -> Column:
    return F.struct(dirname(p).alias("head"), basename(p).alias("tail"))


def splitext(p: Column) -> Column:
    """struct<root, ext>; leading dots of a name are no extension."""
    name = basename(p)
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    ext = F.when(ext != "", ext).otherwise(F.regexp_extract(name, r"^\.*[^.]+(\.[^.]*)$", 1))
    return F.struct(F.left(p, F.length(p) - F.length(ext)).alias("root"), ext.alias("ext"))


def join(first: Column, *rest: Column) -> Column:
    """An absolute part starts anew."""
    out = first
    for part in rest:
        glue = F.when((out == "") | out.endswith("/"), "").otherwise("/")
        out = F.when(part.startswith("/"), part).otherwise(F.concat(out, glue, part))
    return out


def normpath(p: Column) -> Column:
    root = F.regexp_extract(p, "^(//(?!/)|/)", 1)
    absolute = root != ""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when(F.size(acc) > 0, F.when(last == "..", F.array_append(acc, s)).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1)))
        return F.when(s.isin("", "."), acc).when(s == "..", up.otherwise(F.when(absolute, acc).otherwise(F.array(s)))).otherwise(F.array_append(acc, s))

    body = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    out = F.concat(root, body)
    return F.when(out == "", ".").otherwise(out)


def abspath(p: Column, cwd: str) -> Column:
    return normpath(join(F.lit(cwd), p))


def relpath(p: Column, start: Column) -> Column:
    a, b = F.split(normpath(start), "/"), F.split(normpath(p), "/")
    a, b = F.filter(a, lambda s: ~s.isin("", ".")), F.filter(b, lambda s: ~s.isin("", "."))
    pairs = F.arrays_zip(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))).alias("x"), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))).alias("y"))
    same = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, q: F.struct(
        (acc["n"] + F.when(acc["on"] & (q["x"] == q["y"]), 1).otherwise(0)).alias("n"), (acc["on"] & (q["x"] == q["y"])).alias("on")
    ))["n"]
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def expanduser(p: Column, home: str) -> Column:
    return F.when(p.rlike("^~(/|$)"), F.concat(F.lit(home.rstrip("/")), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)


def isabs(p: Column) -> Column:
    return p.startswith("/")


def name(p: Column) -> Column:
    return basename(F.regexp_replace(p, "/+$", ""))


def suffix(p: Column) -> Column:
    """pathlib's suffix: a lone dot at the end is none."""
    ext = splitext(name(p))["ext"]
    return F.when(ext == ".", "").otherwise(ext)


def stem(p: Column) -> Column:
    return F.left(name(p), F.length(name(p)) - F.length(suffix(p)))


def parent(p: Column) -> Column:
    up = dirname(F.regexp_replace(p, "(?<=.)/+$", ""))
    return F.when(up == "", ".").otherwise(up)


def parts(p: Column) -> Column:
    body = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    return F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), body)).otherwise(body)


def with_suffix(p: Column, ext: str) -> Column:
    return F.concat(F.left(p, F.length(p) - F.length(suffix(p))), F.lit(ext))


def with_name(p: Column, new: str) -> Column:
    return F.concat(F.left(p, F.length(p) - F.length(name(p))), F.lit(new))


def fnmatch(x: Column, pattern: str) -> Column:
    return x.rlike("\\A" + _fnmatch.translate(pattern).replace("\\Z", "\\z"))


def has_magic(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def escape(path: str) -> str:
    return "".join(f"[{c}]" if c in "*?[" else c for c in path)
