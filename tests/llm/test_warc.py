import hashlib

from lathe.llm import warc
from lathe.llm.common import table


def damaged(page_id, html):
    kind = page_id % warc.DAMAGE if page_id is not None else -1
    return "X" + html[1:] if kind == 0 else html[: len(html) // 2] if kind == 1 else None if kind == 2 else html


def record(page_id, url, html):
    body = (html or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def brute(pages):
    """Every record compared with its replica, byte by byte."""
    out, files = set(), {}
    for r in sorted(pages, key=lambda r: (r.page_id is None, r.page_id or 0)):
        file = -1 if r.page_id is None else r.page_id // warc.RECORDS_PER_FILE
        offset = files.get(file, 0)
        files[file] = offset + len(record(r.page_id, r.url, r.html))
        other = damaged(r.page_id, r.html or "")
        if other is None:
            out.add((file, offset, r.page_id, "missing"))
        elif other != (r.html or ""):
            out.add((file, offset, r.page_id, "corrupt"))
    return out


def test_matches_brute_force(spark, small):
    pages = table(spark, small, "pages")
    got = {tuple(r) for r in warc.audited(pages).select("file", "offset", "page_id", "status").collect()}
    assert got == brute(pages.collect()) and {r[3] for r in got} == {"corrupt", "missing"}


def frame(spark, rows):
    return spark.createDataFrame([(f, o, i, hashlib.sha256(d.encode()).hexdigest()) for f, o, i, d in rows], "file long, offset long, page_id long, digest string")


def test_descends_to_single_records_and_reports_extras(spark):
    rows = [(f, o << 14, f * 1000 + o, f"{f}-{o}") for f in range(3) for o in range(200)]
    changed = [(f, o, i, d + "!" if i in (1007, 2100) else d) for f, o, i, d in rows if i != 55] + [(2, 900 << 14, 9, "new")]
    got = {(r.file, r.page_id, r.status) for r in warc.audit(frame(spark, rows), frame(spark, changed)).collect()}
    assert got == {(1, 1007, "corrupt"), (2, 2100, "corrupt"), (0, 55, "missing"), (2, 9, "extra")}
    assert warc.audit(frame(spark, rows), frame(spark, rows[::-1])).count() == 0
    assert warc.audit(frame(spark, rows), frame(spark, rows).where("false")).count() == len(rows)


def test_root_depends_on_order_and_bytes(spark):
    a = [(0, 0, 1, "x"), (0, 100, 2, "y")]
    roots = [warc.tree(frame(spark, x))[-1].first().digest for x in (a, a[::-1], [(0, 0, 1, "y"), (0, 100, 2, "x")])]
    assert roots[0] == roots[1] != roots[2]


def test_odd_pages(spark):
    rows = [(0, None, None), (0, None, None), (None, None, "x"), (None, "u", None), (None, "u", None), (211, "http://a/", "é" * 100_000), (1, "", ""), (2, "", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as file", "2 as offset", "'y' as HTML")
    got = {(r.page_id, r.status) for r in warc.audited(pages).collect()}
    assert got == {(211, "corrupt"), (2, "missing")}
    assert warc.audited(pages.where("false")).count() == 0
