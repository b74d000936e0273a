"""Python regular expressions on Java's engine where both agree, on Arrow where not."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FLAGS = {re.I: "i", re.M: "m", re.S: "s", re.X: "x"}


def java_pattern(pattern: str, flags: int = 0) -> str:
    """The pattern in Java's dialect. Python's \\w, \\d and \\s are Unicode's, and \\Z is Java's \\z."""
    if flags & ~(re.I | re.M | re.S | re.X | re.A | re.U):
        raise ValueError("only the flags A, I, M, S, U and X are served")
    re.compile(pattern, flags)  # Python's syntax errors, before anything runs
    out, k = [], 0
    word = "\\p{L}\\p{N}_"  # Java's own word class has marks and lacks fractions
    inside = False
    while k < len(pattern):
        if not flags & re.A and pattern[k : k + 2] in ("\\w", "\\W"):
            negated = pattern[k + 1] == "W"
            out.append(f"[^{word}]" if negated else word if inside else f"[{word}]")
            k += 2
        elif pattern[k] == "[" and not inside:
            inside = True
            # a bracket or caret right after the opening is not the end
            start = re.match(r"\[\^?\]?", pattern[k:])[0]
            out.append(start.replace("]", "\\]"))
            k += len(start)
        elif inside and pattern[k] in "[&":
            out.append("\\" + pattern[k])
            k += 1
        elif inside and pattern[k] == "]":
            inside = False
            out.append("]")
            k += 1
        elif pattern.startswith("(?P<", k) and not inside:
            end = pattern.index(">", k)
            name = pattern[k + 4 : end].replace("_", "0U")
            out.append(f"(?<{name}>")
            k = end + 1
        elif pattern.startswith("(?P=", k):
            end = pattern.index(")", k)
            out.append("\\k<" + pattern[k + 4 : end].replace("_", "0U") + ">")
            k = end + 1
        elif pattern[k] == "\\" and k + 1 < len(pattern):
            out.append("\\z" if pattern[k + 1] == "Z" else pattern[k : k + 2])
            k += 2
        elif pattern[k] == "$" and not flags & re.M and not inside:
            out.append("(?=\\n?\\z)")
            k += 1
        else:
            out.append(pattern[k])
            k += 1
    letters = "".join(letter for flag, letter in _FLAGS.items() if flags & flag) + ("" if flags & re.A else "U")
    # only a line feed ends a line in Python
    return f"(?{letters}d)" + "".join(out) if letters else "(?d)" + "".join(out)


def java_replacement(text: str) -> str:
    out = re.sub(r"\$", r"\\$", text)
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def search(x: Column, pattern: str, flags: int = 0) -> Column:
    return x.rlike(java_pattern(pattern, flags))


def match(x: Column, pattern: str, flags: int = 0) -> Column:
    return x.rlike(f"\\A(?:{java_pattern(pattern, flags)})")


def fullmatch(x: Column, pattern: str, flags: int = 0) -> Column:
    return x.rlike(f"\\A(?:{java_pattern(pattern, flags)})\\z")


def group(x: Column, pattern: str, index: int | str = 0, flags: int = 0) -> Column:
    """A group of the first match; null without one."""
    number = re.compile(pattern, flags).groupindex[index] if isinstance(index, str) else index
    return F.when(search(x, pattern, flags), F.regexp_extract(x, java_pattern(pattern, flags), number))


def findall(x: Column, pattern: str, flags: int = 0) -> Column:
    groups = re.compile(pattern, flags).groups
    if groups > 1:
        parts = [F.regexp_extract_all(x, F.lit(java_pattern(pattern, flags)), k + 1).alias(f"_{k}") for k in range(groups)]
        return F.arrays_zip(*parts)
    return F.regexp_extract_all(x, F.lit(java_pattern(pattern, flags)), groups)


def finditer(x: Column, pattern: str, flags: int = 0) -> Column:
    """array<struct<start, stop, text>>; offsets need the matcher, hence Arrow."""
    compiled = re.compile(pattern, flags)

    @F.pandas_udf("array<struct<start:int,stop:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "stop": m.end(), "text": m[0]} for m in compiled.finditer(t)])

    return run(x)


def split(x: Column, pattern: str, maxsplit: int = 0, flags: int = 0) -> Column:
    compiled = re.compile(pattern, flags)
    if compiled.groups == 0 and compiled.match("") is None:
        return F.split(x, java_pattern(pattern, flags), maxsplit + 1 if maxsplit else -1)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compiled.split(t, maxsplit))

    return run(x)


def sub(x: Column, pattern: str, replacement: str | Callable[[re.Match[str]], str], count: int = 0, flags: int = 0) -> Column:
    """Texts replace in the JVM; a limited count or a callable goes through Arrow."""
    if isinstance(replacement, str) and not count and not re.search(r"\\g<[^\d]|\\[^\dg]", replacement):
        return F.regexp_replace(x, java_pattern(pattern, flags), java_replacement(replacement))
    compiled = re.compile(pattern, flags)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compiled.sub(replacement, t, count))

    return run(x)


def subn(x: Column, pattern: str, replacement: str, flags: int = 0) -> Column:
    return F.struct(sub(x, pattern, replacement, flags=flags).alias("text"), F.regexp_count(x, F.lit(java_pattern(pattern, flags))).alias("n"))


def escape(literal: str) -> str:
    return re.escape(literal)
