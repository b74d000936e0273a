"""URLs, base64, digests and checksums."""

from __future__ import annotations

import urllib.parse
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(x: Column, safe: str = "/") -> Column:
    """Percent-encoding; url_encode is the form encoding, so its differences are mapped back."""
    out = F.url_encode(x)
    for was, now in [("+", "%20"), ("*", "%2A"), ("%7E", "~")] + [(f"%{b:02X}", chr(b)) for b in safe.encode("ascii")]:
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def quote_plus(x: Column) -> Column:
    return F.replace(quote(x, safe=""), F.lit("%20"), F.lit("+"))


def unquote(x: Column) -> Column:
    """Percent-decoding that leaves plus signs and stray per cent signs alone."""
    tame = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(tame), x)


def unquote_plus(x: Column) -> Column:
    return unquote(F.replace(x, F.lit("+"), F.lit(" ")))


def urlencode(pairs: Column) -> Column:
    """Query string of an array<struct<k, v>>."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")


def urlparse(url: Column) -> Column:
    """struct<scheme, netloc, path, query, fragment>; relative references too."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    fragment = F.regexp_extract(rest, r"#(.*)$", 1)
    rest = F.regexp_replace(rest, r"#.*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    rest = F.regexp_replace(rest, r"\?.*$", "")
    netloc = F.regexp_extract(rest, r"^//([^/]*)", 1)
    path = F.regexp_replace(rest, r"^//[^/]*", "")
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path"), query.alias("query"), fragment.alias("fragment"))


def urlunparse(parts: Column) -> Column:
    part = lambda name, before, after="": F.when(parts[name] != "", F.concat(F.lit(before), parts[name], F.lit(after))).otherwise("")
    slash = F.when((parts["netloc"] != "") & (parts["path"] != "") & ~parts["path"].startswith("/"), "/").otherwise("")
    return F.concat(part("scheme", "", ":"), part("netloc", "//"), slash, parts["path"], part("query", "?"), part("fragment", "#"))


def parse_qsl(query: Column) -> Column:
    """array<struct<k, v>> of the pairs that have a value, in order."""
    fields = F.filter(F.split(query, "[&;]"), lambda f: f.rlike("=.+"))
    return F.transform(fields, lambda f: F.struct(unquote_plus(F.substring_index(f, "=", 1)).alias("k"), unquote_plus(F.regexp_replace(f, "^[^=]*=", "")).alias("v")))


def parse_qs(query: Column) -> Column:
    """map of key to all its values; keys in order of first occurrence."""
    pairs = parse_qsl(query)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def urljoin(base: Column, url: Column) -> Column:
    """A reference resolved against a base, by the simple rules: absolute, //host, /path, ?query, #fragment, relative."""
    b = urlparse(base)
    root = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), url)
    path = F.substring_index(F.substring_index(joined, "#", 1), "?", 1)
    tail = F.substring(joined, F.length(path) + 1, F.length(joined))
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, s)),
    )
    folderish = path.rlike("/\\.{1,2}$")
    clean = F.concat(F.array_join(steps, "/"), F.when(folderish, "/").otherwise(""))
    return (
        F.when(url == "", base)
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(b["scheme"], F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(root, b["path"], url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(root, clean, tail))
    )


def b64encode(x: Column) -> Column:
    return F.regexp_replace(F.base64(x), "\r?\n", "")


def b64decode(x: Column) -> Column:
    return F.unbase64(x)


def urlsafe_b64encode(x: Column) -> Column:
    return F.translate(b64encode(x), "+/", "-_")


def urlsafe_b64decode(x: Column) -> Column:
    return F.unbase64(F.translate(x, "-_", "+/"))


def digest(x: Column, name: str) -> Column:
    """Hex digest by name; a name that is not served is refused before anything runs."""
    sizes = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if name in sizes:
        return F.sha2(x, sizes[name])
    if name in ("md5", "sha1"):
        return F.md5(x) if name == "md5" else F.sha1(x)
    raise ValueError(f"unsupported hash type {name}")


def crc32(x: Column) -> Column:
    return F.crc32(x)


def _bytes(f):
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def compress(x: Column, level: int = -1) -> Column:
    """DEFLATE; the bytes are not specified, only that decompress restores the input."""
    return _bytes(lambda v: zlib.compress(v, level))(x)


def decompress(x: Column) -> Column:
    return _bytes(zlib.decompress)(x)


def unquote_to_bytes(x: Column) -> Column:
    """Percent-decoding to bytes, valid UTF-8 or not."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: None if v is None else urllib.parse.unquote_to_bytes(v))

    return run(x)
