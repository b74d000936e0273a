from lathe.llm import quality
from lathe.llm.common import table

ENDINGS = ".!?:;…"


def passes(line):
    words = line.split(" ")
    body = line.rstrip("\"')]”’»")
    if body[-1:] not in ENDINGS and len(words) < quality.CUT_FROM or not body and len(words) < quality.CUT_FROM:
        return False
    if len(words) >= quality.REPEAT_FROM and len(set(words)) * 5 < len(words):
        return False
    if sum(c in "#$%&*|<>{}[]\\^~_=+@" for c in line) * 10 > len(line):
        return False
    upper, lower = sum(c.isupper() for c in line), sum(c.islower() for c in line)
    if len(line) >= quality.SHOUT_FROM and upper > lower:
        return False
    marks = [k for k, w in enumerate(words) if w in "| » › > · •".split()]
    # the rule's first mark may be glued to what precedes it only at a blank
    return not (len(marks) >= 2 and marks[0] != marks[-1])


def boilerplate(line):
    low = " " + line.lower() + " "

    def bordered(p):
        at = low.find(p)
        while at >= 0:
            if not low[at - 1].isalnum() and not low[at + len(p)].isalnum():
                return True
            at = low.find(p, at + 1)
        return False

    starts = any(low[1:].startswith(p) and not low[1 + len(p)].isalnum() for p in quality.BOILERPLATE_STARTS)
    return len(line.split(" ")) <= quality.BOILERPLATE_WORDS and (starts or any(map(bordered, quality.BOILERPLATE)))


def brute(text):
    lines = [x for x in (y.replace("\t", " ").replace("\r", " ").strip(" ") for y in (text or "").split("\n")) if x]
    good = [x for x in lines if passes(x) and not boilerplate(x)]
    if good and sum(map(len, good)) >= quality.LEAST_KEPT * sum(map(len, lines)):
        return "\n".join(good), len(lines) - len(good)
    return None


def test_matches_brute_force(spark, small):
    docs = table(spark, small, "documents")
    got = {r.doc_id: (r.text, r.removed_lines) for r in quality.cleaned(docs).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert got == {i: w for i, w in want.items() if w}


def test_labelled_documents(spark, small):
    kept = quality.cleaned(table(spark, small, "documents")).select("doc_id")
    ids = {r.doc_id for r in kept.collect()}
    rows = table(spark, small, "labels").collect()
    good = [r.doc_id in ids for r in rows if r.quality == 1]
    junk = [r.doc_id in ids for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.05 * len(junk)


def test_rules(spark):
    lines = {
        "A sentence that ends properly.": True,
        "Menu": False,
        "Home | Products | About us | Contact": False,
        "THIS IS SHOUTED FROM THE ROOF TOPS!!": False,
        "They design inclusive tools and share only what holds.": True,
        "She left a cookie and a glass of milk on the table.": True,
        "Mentions légales": False,
        "To sign in is easy, says the long report, which goes on to list every door and every key of the house, " * 2 + "at length.": True,
        "We use cookies to improve your visit to this site.": False,
        "SKU 4471-0092-3381 QTY 12 PRICE 19.99": False,
        "### $$$ %%% &&& some words *** @@@ ###.": False,
        "spam " * 30 + "end.": False,
        "An honest line that was cut before its": True,
    }
    for line, good in lines.items():
        text = "A first good sentence carries this document well enough. It goes on for a while so that nothing else matters.\n" * 8 + line
        row = quality.cleaned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert (row.removed_lines == 0) == good, line


def test_boilerplate_counts_as_lost(spark):
    notice = "We use cookies to improve your visit to this site.\n"
    rows = [(1, "One good sentence stands at the top.\n" + notice * 100), (2, "One good sentence stands at the top.\n" * 3 + notice)]
    got = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.removed_lines) for r in got] == [(2, 1)]


def test_odd_rows(odd_documents, no_documents):
    got = quality.cleaned(odd_documents).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(1) == 2 and {2, None, 6} <= set(ids) and not {3, 4, 5, 7} & set(ids)
    assert quality.cleaned(no_documents).count() == 0
