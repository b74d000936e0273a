"""Line deduplication over overlapping windows of three lines.

A line ends at a line break, and after a full stop, exclamation or question mark
that a space follows. What lies between is cut further at places that its words
choose: the word with the least hash of any SPAN consecutive ones ends a line, so
no line is longer than SPAN words and equal passages are cut alike wherever they
stand. Each run of three consecutive non-blank lines is hashed; a window that
occurs anywhere earlier in the corpus is a repetition. The lines that repeated
windows cover are merged into runs, and a run goes if it has RUN_WORDS words or
three whole lines as the text itself breaks them.

So every repeated passage of 49 words loses its later occurrences, up to 14 words
at either end, whatever surrounds it and however it is punctuated: all but its
first and last 7 words are cut alike, which leaves four cuts and 20 words between.

Shape at scale: windows are hashed in the scan, so what is shuffled to find
repetitions is 32 bytes a window and no text. One sort by (hash, place) finds all
later occurrences without a join, however often a window repeats. Texts are
shuffled once, to meet their covered lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lathe.llm.common import numbered, pick, position, sortable_id
from lathe.llm.kernels import _C1, _POWERS, mix, text_slices, utf8

#: Of any so many consecutive words one ends a line; a power of two.
SPAN = 8
#: Covered lines that touch go when they have so many words; fewer may coincide
#: by chance, unless they are three whole lines.
RUN_WORDS = 20
WHOLE_LINES = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLANKS = " \t\n\x0b\x0c\r"
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_SALT = np.uint64(0xA0761D6478BD642F)


def _opens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of runs and bytes after them; a text's edge ends a run even where two texts touch."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


class Lines:
    """The lines of a slice of texts.

    ``bounds`` are byte offsets: line k is data[bounds[k]:bounds[k + 1]] with its
    break; ``first`` has n + 1 offsets into the lines, one range per text;
    ``start`` and ``stop`` leave out surrounding blanks; ``whole`` is the number
    of the line, as the text breaks it, that line k is part of.
    """

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = data, offsets = utf8(column)
        cut = data == 10
        cut[1:] |= (data[1:] == 32) & _END[data[:-1]]
        # a space at a text's start does not end a line of the text before it
        head = offsets[:-1][offsets[:-1] < len(data)]
        cut[head] = data[head] == 10
        breaks = np.unique(np.concatenate([offsets, np.flatnonzero(cut) + 1]))
        with np.errstate(over="ignore"):
            up, self._down = _POWERS.upto(len(data) + 1)
            self._total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._total[1:])
        word, after = _opens(~_SPACE[data], offsets)
        chosen = self._chosen(word, after, np.searchsorted(breaks, word, side="right"))
        self.bounds = np.unique(np.concatenate([breaks, after[chosen] + 1]))
        starts = self.bounds[:-1]
        self.whole = np.searchsorted(breaks, starts, side="right")
        self.first = np.searchsorted(starts, offsets)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        at = np.searchsorted(word, self.bounds)
        self.words = np.diff(at)
        self.blank = self.words == 0
        self.start, self.stop = starts.copy(), starts.copy()
        full = ~self.blank
        self.start[full] = word[at[:-1][full]]
        self.stop[full] = after[at[1:][full] - 1]

    def _raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._total[stop] - self._total[start]) * self._down[start]

    def _chosen(self, word: np.ndarray, after: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Words after which a line is cut: the last of the least in any SPAN words of a line, its last word left out."""
        if len(word) < SPAN:
            return np.zeros(0, np.int64)
        rank = _rank(self._raw(word, after).astype(np.uint32)).astype(np.uint64)
        last = np.ones(len(word), bool)
        last[:-1] = line[1:] != line[:-1]
        # the last word of a line beats all others, so no span across lines chooses within one
        rank[last] = 0
        low = np.uint64(0xFFFFFFFF)
        least = (rank << np.uint64(32)) | (low - np.arange(len(word), dtype=np.uint64))
        width = 1
        while width < SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        found = np.zeros(len(word), bool)
        found[(low - (least & low)).astype(np.int64)] = True
        return np.flatnonzero(found & ~last)

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self._raw(self.start, self.stop) + (self.stop - self.start).astype(np.uint64) * _C1)

    def full(self) -> np.ndarray:
        """The lines that are not blank."""
        return np.flatnonzero(~self.blank)

    def windows(self) -> np.ndarray:
        """Places in ``full()`` at which three lines of one text begin."""
        row = self.row[self.full()]
        return np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)

    def runs(self, covered: np.ndarray) -> np.ndarray:
        """Of the covered places in ``full()`` of one text those in runs that go."""
        full = self.full()
        words, whole = self.words[full], self.whole[full]
        keep = np.zeros(len(full), bool)
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if words[a:b].sum() < RUN_WORDS:
                lines = set(whole[a:b].tolist())
                # a line that goes on outside the run is not whole
                cut = {whole[a]} if a and whole[a - 1] == whole[a] else set()
                cut |= {whole[b - 1]} if b < len(full) and whole[b] == whole[b - 1] else set()
                if len(lines - cut) < WHOLE_LINES:
                    continue
            keep[a:b] = True
        return full[keep]


def _rank(x: np.ndarray) -> np.ndarray:
    """A hash of 32 bits, never zero."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.maximum(x ^ (x >> np.uint32(13)), np.uint32(1))


def text_tag(text: Column) -> Column:
    """A hash of 32 bits that tells texts of one id apart. A null text differs from an empty one."""
    return F.hash(F.coalesce(text, F.lit("\0null")))


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, ht, sid, p): 64 bits of a window's hash, 32 more with the text's tag below, and the place of its first line."""
    for batch in batches:
        tags = batch.column("tag").to_numpy().view(np.uint32).astype(np.uint64)
        for start, stop in text_slices(batch.column("text")):
            lines = Lines(batch.column("text").slice(start, stop - start))
            at, full = lines.windows(), lines.full()
            h = lines.hashes()[full]
            with np.errstate(over="ignore"):
                h1, h2 = h[at], mix(h[at] + _SALT)
                for k in (1, 2):
                    h1 = mix(h1 * _C1 + h[at + k])
                    h2 = mix(h2 * _SALT + h[at + k])
            row = lines.row[full[at]]
            # places count the non-blank lines of the text
            first = np.searchsorted(full, lines.first)[row]
            ht = (h2 & np.uint64(0xFFFFFFFF00000000)) | tags[row + start]
            yield pa.record_batch(
                [pa.array(h1.view(np.int64)), pa.array(ht.view(np.int64)), batch.column("sid").take(pa.array(row + start)), pa.array((at - first).astype(np.int32))],
                names=["h", "ht", "sid", "p"],
            )


def covered_lines(rows: DataFrame) -> DataFrame:
    """(sid, tag, places): for each later occurrence of a window 4 times its place, plus how many of its lines stay.

    Occurrences are ordered by id (nulls last), text hash and place. Where a
    window overlaps its own first occurrence, the lines of the first stay.
    """
    windows = rows.mapInArrow(_hash_windows, "h long, ht long, sid long, p int").repartition("h")
    low = F.lit(0xFFFFFFFF)
    same = Window.partitionBy("h", F.shiftright("ht", 32)).orderBy("sid", F.col("ht").bitwiseAND(low), "p")
    firsts = windows.withColumn("f", F.first(F.struct("ht", "sid", "p")).over(same))
    own = (F.col("sid") == F.col("f.sid")) & (F.col("ht") == F.col("f.ht"))
    stay = F.when(own, F.greatest(F.lit(0), F.col("f.p") + 3 - F.col("p"))).otherwise(0)
    later = firsts.withColumn("stay", stay).where("stay < 3")
    return later.groupBy("sid", F.col("ht").bitwiseAND(low).alias("tag")).agg(F.collect_list(F.col("p").cast("long") * 4 + F.col("stay")).alias("places"))


def _rewriter(text_at: int, chars_at: int | None, drop_emptied: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts covered lines; the last two columns are the covered places and the row's number among equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            places, nth = columns[-2], columns[-1].to_numpy()
            texts = columns[text_at].to_pylist()
            removed = np.zeros(len(texts), np.int32)
            hit = np.flatnonzero((nth > 1) | places.is_valid().to_numpy(zero_copy_only=False))
            for k in hit.tolist():
                if not texts[k]:
                    continue
                lines = Lines(pa.array([texts[k]]))
                covered = np.zeros(len(lines.full()), bool)
                if nth[k] > 1:
                    covered[:] = len(covered) >= 3
                else:
                    code = places[k].values.to_numpy()
                    for j in range(3):
                        covered[(code >> 2)[(code & 3) <= j] + j] = True
                gone = lines.runs(covered)
                if not len(gone):
                    continue
                keep = np.ones(len(lines.bounds) - 1, bool)
                keep[gone] = False
                removed[k] = len(gone)
                data = lines.data.tobytes()
                b = lines.bounds
                texts[k] = b"".join(data[b[i] : b[i + 1]] for i in np.flatnonzero(keep)).decode("utf-8").rstrip(BLANKS)
            out = list(columns[:-2])
            text = pa.array(texts, columns[text_at].type)
            out[text_at] = text
            if chars_at is not None:
                chars = pa.compute.utf8_length(text).cast(out[chars_at].type)
                out[chars_at] = pa.compute.if_else(pa.array(removed > 0), chars, out[chars_at])
            result = pa.record_batch([*out, pa.array(removed)], names=[*batch.schema.names[:-2], "__removed"])
            if drop_emptied:
                empty = pa.compute.equal(pa.compute.fill_null(pa.compute.utf8_trim_whitespace(text), ""), "")
                result = result.filter(pa.compute.invert(pa.compute.and_(empty, pa.array(removed > 0))))
            yield result

    return run


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> tuple[DataFrame, list[str]]:
    """The documents as columns __c0.. and __removed, and their names."""
    renamed, names = numbered(docs)
    id_at, text_at = position(names, "doc_id"), position(names, "text")
    lower = [c.lower() for c in names]
    chars_at = position(names, "n_chars") if "n_chars" in lower else None
    if chars_at is not None and renamed.dtypes[chars_at][1] not in ("int", "bigint"):
        chars_at = None
    rows = pick(docs, "doc_id", "text").select(sortable_id(F.col("doc_id").cast("long")).alias("sid"), text_tag(F.col("text")).alias("tag"), "text")
    covered = covered_lines(rows).select(F.col("sid").alias("__sid"), F.col("tag").alias("__tag"), F.col("places").alias("__places"))
    keys = {"__sid": sortable_id(F.col(f"__c{id_at}").cast("long")), "__tag": text_tag(F.col(f"__c{text_at}")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))}
    same = Window.partitionBy("__sid", "__tag").orderBy(F.lit(1))
    joined = (
        renamed.withColumns(keys)
        .join(covered, ["__sid", "__tag"], "left")
        .withColumn("__nth", F.row_number().over(same))
        .select(*renamed.columns, "__places", "__nth")
    )
    schema = StructType([*renamed.schema.fields, StructField("__removed", IntegerType())])
    return joined.mapInArrow(_rewriter(text_at, chars_at, drop_emptied), schema), names


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_lines) for every document: its text without repeated lines.

    Null and empty texts are as they were; so is every text that loses nothing.
    A null doc_id sorts last. Of repeated rows the first is treated as one
    document, the others lose every line that a window covers. Lines of texts
    with fewer than three lines are never removed. A text that loses all lines
    is empty. Blanks at the end of a shortened text go. Equal windows count in
    the order of id, text hash and place, so ties fall alike in every run.
    ``removed_lines`` counts the lines as they were cut. Extra columns are
    ignored. An empty table gives no rows.
    """
    rows, _ = dedup_lines(pick(docs, "doc_id", "text"))
    return rows.select(F.col("__c0").cast("long").alias("doc_id"), F.col("__c1").alias("text"), F.col("__removed").alias("removed_lines"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated lines cut, n_chars (where there is one)
    brought up to date; documents of which nothing is left are dropped.

    Documents with null, empty or blank texts lose nothing and stay. Of repeated
    rows all but the first lose their covered lines, so they are dropped unless
    they are too short to repeat anything. An empty table gives no rows.
    """
    rows, names = dedup_lines(docs, drop_emptied=True)
    return rows.drop("__removed").toDF(*names)


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH d AS (
  SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS sid FROM documents
), n AS (
  SELECT sid, unnest(s) AS line, generate_subscripts(s, 1) AS w
  FROM (SELECT sid, string_split(regexp_replace(coalesce(text, ''), '(\\n|[.!?] )', '\\1' || chr(31), 'g'), chr(31)) AS s FROM d)
), t AS (
  SELECT sid, w, unnest(s) AS piece, generate_subscripts(s, 1) AS k
  FROM (SELECT sid, w, regexp_extract_all(line, '[ \\t\\n\\x0b\\f\\r]*[^ \\t\\n\\x0b\\f\\r]+[ \\t\\n\\x0b\\f\\r]?|[ \\t\\n\\x0b\\f\\r]+') AS s FROM n WHERE line <> '')
), b AS (
  SELECT *, trim(piece, {_WS}) AS word FROM t
), v AS (
  SELECT word, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(strlen(word), 0, -1),
         lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) + 1)), lambda x, y: (x * 2135587861 + y) % 4294967296) AS x
  FROM (SELECT DISTINCT word FROM b)
), r AS (
  SELECT word, CAST(greatest(1, xor(y, y >> 13)) AS UBIGINT) AS rank FROM (SELECT word, xor(x, x >> 15) * 739982445 % 4294967296 AS y FROM v)
), o AS (
  SELECT b.sid, b.w, b.k, b.word, rank * 4294967296 + CAST(4294967295 - b.k AS UBIGINT) AS rank, max(b.k) FILTER (WHERE b.word <> '') OVER (PARTITION BY b.sid, b.w) AS last
  FROM b JOIN r ON b.word = r.word
), m AS (
  SELECT DISTINCT sid, w, 4294967295 - least % 4294967296 AS k FROM (
    SELECT sid, w, k, last, min(rank) OVER (PARTITION BY sid, w ORDER BY k ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS least FROM o WHERE k < last
  ) WHERE k + {SPAN - 1} < last
), l AS (
  SELECT sid, w, string_agg(piece, '' ORDER BY k) AS line, count(*) FILTER (WHERE word <> '') AS words, min(k) AS k
  FROM (SELECT b.*, coalesce(sum(CASE WHEN m.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.sid, b.w ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
        FROM b LEFT JOIN m ON b.sid = m.sid AND b.w = m.w AND b.k = m.k)
  GROUP BY sid, w, part
), f AS (
  SELECT sid, w, k, words, trim(line, {_WS}) AS t, row_number() OVER (PARTITION BY sid ORDER BY w, k) AS p FROM l WHERE words > 0
), g AS (
  SELECT a.sid, a.p, a.t || chr(31) || b.t || chr(31) || c.t AS body
  FROM f a JOIN f b ON a.sid = b.sid AND b.p = a.p + 1 JOIN f c ON a.sid = c.sid AND c.p = a.p + 2
), e AS (
  SELECT *, first_value(sid) OVER x AS fs, first_value(p) OVER x AS fp FROM g WINDOW x AS (PARTITION BY body ORDER BY sid, p)
), c AS (
  SELECT DISTINCT sid, p FROM (SELECT sid, fs, fp, unnest([p, p + 1, p + 2]) AS p FROM e WHERE sid <> fs OR p <> fp) WHERE sid <> fs OR p > fp + 2
), i AS (
  SELECT c.sid, c.p, f.w, f.k, f.words, c.p - row_number() OVER (PARTITION BY c.sid ORDER BY c.p) AS run FROM c JOIN f ON c.sid = f.sid AND c.p = f.p
), h AS (
  SELECT i.sid, i.run, i.w, sum(i.words) AS words, count(*) = any_value(z.n) AS entire
  FROM i JOIN (SELECT sid, w, count(*) AS n FROM f GROUP BY sid, w) z ON i.sid = z.sid AND i.w = z.w GROUP BY i.sid, i.run, i.w
), q AS (
  SELECT sid, run FROM h GROUP BY sid, run HAVING sum(words) >= {RUN_WORDS} OR count(*) FILTER (WHERE entire) >= {WHOLE_LINES}
), x AS (
  SELECT i.sid, i.w, i.k FROM i JOIN q ON i.sid = q.sid AND i.run = q.run
), y AS (
  SELECT l.sid, string_agg(CASE WHEN x.k IS NULL THEN l.line ELSE '' END, '' ORDER BY l.w, l.k) AS text, count(x.k) AS n
  FROM l LEFT JOIN x ON l.sid = x.sid AND l.w = x.w AND l.k = x.k GROUP BY l.sid
)
SELECT d.doc_id, CASE WHEN y.n > 0 THEN rtrim(y.text, {_WS}) ELSE d.text END AS text, CAST(coalesce(y.n, 0) AS INTEGER) AS removed_lines
FROM d LEFT JOIN y ON d.sid = y.sid
"""
