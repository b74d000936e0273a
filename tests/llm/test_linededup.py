import re

import pyarrow as pa
import pytest

from lathe.llm import linededup
from lathe.llm.common import table

BLANK = " \t\n\x0b\x0c\r"
WORD = f"[^{BLANK}]+"


def rank(word):
    x = sum((b + 1) * pow(0x7F4A7C15, k, 1 << 32) for k, b in enumerate(word.encode())) % (1 << 32)
    x = (x ^ (x >> 15)) * 0x2C1B3C6D % (1 << 32)
    return max(x ^ (x >> 13), 1)


def whole_lines(text):
    return [x for x in re.split("(?<=\n)|(?<=[.!?] )", text) if x]


def cut(text):
    """(line, number of the whole line it is part of), cut by looking at every span of words."""
    out = []
    for n, line in enumerate(whole_lines(text)):
        words = list(re.finditer(WORD, line))[:-1]
        span = linededup.SPAN
        ends = {min(range(k, k + span), key=lambda j: (rank(words[j].group()), -j)) for k in range(len(words) - span + 1)}
        at = [0, *(words[j].end() + 1 for j in sorted(ends)), len(line)]
        out += [(line[a:b], n) for a, b in zip(at, at[1:])]
    return out


def brute(rows):
    """(text, removed) of rows (id, text) in the order given, which is the corpus order."""
    seen, out = {}, []
    for n, (_, text) in enumerate(rows):
        lines = cut(text or "")
        full = [k for k, (x, _) in enumerate(lines) if x.strip(BLANK)]
        covered = set()
        for p in range(len(full) - 2):
            body = tuple(lines[k][0].strip(BLANK) for k in full[p : p + 3])
            first = seen.setdefault(body, (n, p))
            if first != (n, p):
                covered |= {p, p + 1, p + 2} - ({first[1], first[1] + 1, first[1] + 2} if first[0] == n else set())
        gone, run = set(), []
        for p in [*range(len(full)), -1]:
            if p in covered:
                run.append(p)
                continue
            words = sum(len(re.findall(WORD, lines[full[q]][0])) for q in run)
            inside = {lines[full[q]][1] for q in run}
            entire = [w for w in inside if all(q in run for q, k in enumerate(full) if lines[k][1] == w)]
            if words >= linededup.RUN_WORDS or len(entire) >= linededup.WHOLE_LINES:
                gone |= {full[q] for q in run}
            run = []
        out.append((text if not gone else "".join(x for k, (x, _) in enumerate(lines) if k not in gone).rstrip(BLANK), len(gone)))
    return out


def test_matches_brute_force(spark, small):
    docs = table(spark, small, "documents").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.deduplicated(docs).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
    assert any(n for _, n in got.values())


def test_passage_in_the_middle_of_a_paragraph(spark):
    passage = " ".join(f"Clause {k} of the shared passage says exactly this much." for k in range(8))
    rows = [(1, f"Opening words here. {passage} Closing words."), (2, f"Other start.\nMore of it. {passage}\nOther end."), (3, "A clean text.\nWith its own lines.\nNothing repeated at all.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other start.\nMore of it. Other end."
    assert [(got[i].text, got[i].removed_lines) for i in (1, 2, 3)] == brute(rows)


@pytest.mark.parametrize("stops", ["", ",", "。"])
def test_passages_of_fifty_words_without_sentences(spark, stops):
    """Whatever surrounds them, and without one line break or full stop, all but their ends go."""
    import random

    rng = random.Random(stops)
    passages = [[f"{rng.choice('bdfgklmnprst')}{rng.randint(0, 9999)}{stops}" for _ in range(51)] for _ in range(40)]

    def around():
        return [f"own{rng.randint(0, 1 << 40)}" for _ in range(rng.randint(0, 30))]

    rows = [(2 * k + late, " ".join([*around(), *p, *around()])) for k, p in enumerate(passages) for late in (0, 1)]
    got = {r.doc_id: r.text.split() for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1].split()
        left = [w for w in got[2 * k + 1] if w in p]
        head = next((j for j, (a, b) in enumerate(zip(left, p)) if a != b), len(left))
        assert len(left) <= 29 and head <= 15 and left[head:] == p[len(p) - len(left) + head :]
        assert [w for w in got[2 * k + 1] if w not in p] == [w for w in rows[2 * k + 1][1].split() if w not in p]


def test_a_phrase_alone_is_no_passage(spark):
    phrase = "on the other side of the old stone bridge near the mill stream"
    rows = [(k, f"Text {k} starts on its own and says that {phrase} there is number {k} of all things {k * 7919}.") for k in range(20)]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.removed_lines == 0 for r in got)


def test_repeats_within_one_text(spark):
    line = "The same line again and again.\n"
    df = spark.createDataFrame([(1, line * 6), (2, "x.\n" * 9), (3, "Home\nNews\nHelp\nOne text."), (4, "Home\nNews\nHelp\nOther text.")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert got[1].text == (line * 3).rstrip() and got[1].removed_lines == 3
    assert got[2].text == "x.\nx.\nx."  # short lines are lines
    assert got[3].removed_lines == 0 and got[4].text == "Other text."


def test_odd_rows(odd_documents, no_documents):
    got = linededup.deduplicated(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    # within one text, too, the second and third of three equal sentences go
    assert sorted(by[1]) == ["", "The quick brown foxes jumped over seventeen lazy dogs beside a quiet river."]
    assert by[2] == [""] and None in by[3] and by[4] == [""] and sorted(by[None], key=str) == ["", None]
    assert by[10] == ["\x1f\x00 odd bytes \x0b here. And here. Too."]
    kept = linededup.without_repeated_lines(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == len(got) - 3
    assert linededup.deduplicated(no_documents).count() == 0
    assert linededup.without_repeated_lines(no_documents).count() == 0


@pytest.mark.parametrize("texts", [["a. b. c", "", None, "é. ü! ñ?\n\nx", " ".join(map(str, range(99))) + "  \n" + "at " * 40, "x " * 20 + " "], ["\n", "  ", ". . ."], []])
def test_lines_cover_the_text(texts):
    lines = linededup.Lines(pa.array(texts, pa.string()))
    data = lines.data.tobytes()
    for k, t in enumerate(texts):
        parts = [data[lines.bounds[i] : lines.bounds[i + 1]].decode() for i in range(lines.first[k], lines.first[k + 1])]
        assert "".join(parts) == (t or "") and parts == [x for x, _ in cut(t or "")]


@pytest.mark.parametrize("before", ["It ends here.", "It ends here", "", None])
def test_leading_blanks_do_not_depend_on_the_text_before(before):
    texts = [before, " D. E. F.", "  G! H", "\nI. J", " "]
    lines = linededup.Lines(pa.array(texts, pa.string()))
    data = lines.data.tobytes()
    for k, t in enumerate(texts):
        assert [data[lines.bounds[i] : lines.bounds[i + 1]].decode() for i in range(lines.first[k], lines.first[k + 1])] == [x for x, _ in cut(t or "")]


def test_texts_that_begin_with_a_space(spark):
    passage = "Delta says one thing. Echo says another thing. Foxtrot ends it."
    rows = [(1, passage), (2, "Nothing of this is repeated."), (3, f" {passage} An innocent line."), (4, "Neither is this one."), (5, f" {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.deduplicated(df).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
