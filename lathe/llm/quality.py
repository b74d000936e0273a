"""Line-first quality rules: judge every line, then the document by what is left.

A line fails when it is short and does not end like a sentence, is a run of
navigation links, is boilerplate, shouts, repeats few words, or is thick with
symbols. Failing lines go; a document that loses too much of its text goes as a
whole.

Shape at scale: one map over the documents in the JVM, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import pick

#: Share of the characters of its lines that a document must keep; blanks
#: around lines are not counted.
LEAST_KEPT = 0.5
#: Lines of this many characters or more may not have more capitals than small letters.
SHOUT_FROM = 20
#: Lines of fewer words must end like a sentence.
CUT_FROM = 5
#: Of so many words or more, one in five must be distinct.
REPEAT_FROM = 20

# the same in Java's and RE2's dialect
ENDS = "[.!?:;…][\"')\\]”’»]*$"
NAVIGATION = "(^| )(\\||»|›|>|·|•)( .*)? (\\||»|›|>|·|•)( |$)"
#: Phrases that make a line of at most BOILERPLATE_WORDS words boilerplate, in
#: lower case; as words of their own, not as parts of words. A longer line is
#: prose that mentions them.
BOILERPLATE = (
    "all rights reserved", "©", "is licensed under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "use cookies", "accept cookies", "cookie settings", "enable javascript", "subscribe to", "sign in", "sign up", "log in to", "login to",
    "click here", "read more", "share this", "share on", "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen",
    "cookies akzeptieren", "hier klicken", "weiterlesen", "tous droits réservés", "politique de confidentialité", "mentions légales",
    "accepter les cookies", "cliquez ici", "lire la suite", "todos los derechos reservados", "política de privacidad", "términos de uso",
    "aceptar cookies", "haga clic aquí", "leer más",
)
BOILERPLATE_STARTS = ("copyright", "licensed under", "released under")
BOILERPLATE_WORDS = 30
# a plain search comes first, as an alternation of this size costs several times all the other rules
_EDGE = "[^\\p{L}\\p{N}]"
BORDERED = f"(^|{_EDGE})({'|'.join(BOILERPLATE)})($|{_EDGE})|^({'|'.join(BOILERPLATE_STARTS)})($|{_EDGE})"
PLAIN = "[^#$%&*|<>{}\\[\\]\\\\^~_=+@]+"
NOT_LOWER = "[^\\p{Ll}]+"
NOT_UPPER = "[^\\p{Lu}]+"


def _with(value: Column, test: Callable[[Column], Column]) -> Column:
    """test(value) with the value computed once: lambdas are interpreted and share no subexpressions."""
    return F.exists(F.array(value), test)


def is_boilerplate(line: Column) -> Column:
    def test(low: Column) -> Column:
        found = F.lit(False)
        for phrase in (*BOILERPLATE, *BOILERPLATE_STARTS):
            found = found | low.contains(phrase)
        return found & low.rlike(BORDERED) & (F.size(F.split(low, " ")) <= BOILERPLATE_WORDS)

    return _with(F.lower(line), test)


def line_passes(line: Column) -> Column:
    """Whether a trimmed, non-empty line passes every rule but that on boilerplate."""
    size = F.length(line)
    symbols = F.length(F.regexp_replace(line, PLAIN, ""))
    calm = F.length(F.regexp_replace(line, NOT_UPPER, "")) <= F.length(F.regexp_replace(line, NOT_LOWER, ""))
    worded = _with(
        F.split(line, " "),
        lambda w: (line.rlike(ENDS) | (F.size(w) >= CUT_FROM)) & ((F.size(w) < REPEAT_FROM) | (F.size(F.array_distinct(w)) * 5 >= F.size(w))),
    )
    return worded & (symbols * 10 <= size) & ((size < SHOUT_FROM) | calm) & ~line.rlike(NAVIGATION)


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_lines) of every document that keeps enough: its text without failing lines.

    Lines are trimmed; blank lines go without counting as removed. What any rule
    removes, boilerplate too, counts as lost. Null, empty
    and blank texts have nothing to keep and are rejected. A null doc_id stays
    null; repeated rows are judged alike; texts are read whole. Extra columns
    are ignored. An empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\r]", " "))), lambda x: x != "")

    def once(df: DataFrame, **columns: Column) -> DataFrame:
        """Add columns that are computed once per row, whatever uses them: nothing is pulled through a generator."""
        packed = F.struct(*[c.alias(name) for name, c in columns.items()])
        return df.withColumn("__one", F.explode(F.array(packed))).select(*df.columns, "__one.*")

    split = once(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lines=lines).drop("text")
    judged = once(split, good=F.filter("lines", lambda x: line_passes(x) & ~is_boilerplate(x)))

    def chars(name: str) -> Column:
        return F.aggregate(name, F.lit(0), lambda a, x: a + F.length(x))

    enough = (F.size("good") > 0) & (chars("good") >= LEAST_KEPT * chars("lines"))
    return judged.where(enough).select("doc_id", F.array_join("good", "\n").alias("text"), (F.size("lines") - F.size("good")).alias("removed_lines"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BOILERPLATE_SQL = f"regexp_matches(lower(x), {_q(BORDERED)}) AND len(string_split(x, ' ')) <= {BOILERPLATE_WORDS}"

SQL = f"""
WITH l AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM documents
), j AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: (regexp_matches(x, {_q(ENDS)}) OR len(string_split(x, ' ')) >= {CUT_FROM})
    AND (len(string_split(x, ' ')) < {REPEAT_FROM} OR len(list_distinct(string_split(x, ' '))) * 5 >= len(string_split(x, ' ')))
    AND length(regexp_replace(x, {_q(PLAIN)}, '', 'g')) * 10 <= length(x)
    AND (length(x) < {SHOUT_FROM} OR length(regexp_replace(x, {_q(NOT_UPPER)}, '', 'g')) <= length(regexp_replace(x, {_q(NOT_LOWER)}, '', 'g')))
    AND NOT regexp_matches(x, {_q(NAVIGATION)}) AND NOT ({_BOILERPLATE_SQL})) AS good
  FROM l
)
SELECT doc_id, array_to_string(good, chr(10)) AS text, CAST(len(lines) - len(good) AS INTEGER) AS removed_lines
FROM j WHERE len(good) > 0 AND list_sum(list_transform(good, lambda x: length(x))) >= {LEAST_KEPT} * list_sum(list_transform(lines, lambda x: length(x)))
"""
