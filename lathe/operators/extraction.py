"""Programs embedded in shell commands: here-documents, quote-aware words, and a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_OPEN = re.compile(r"""(?<!<)<<(?!<)(?P<dash>-?)\s*(?:'(?P<a>\w+)'|"(?P<b>\w+)"|(?P<c>[A-Za-z_]\w*))""", re.A)
_PYTHON = re.compile(r"(?:\S*/)?(?:python|pypy|micropython)[0-9.]*")
_MENTIONS = re.compile(r"\b(?:python|pypy|micropython)[0-9.]*\b")
_BODY_NAME = re.compile("py|python|pyeof|eofpy", re.I)
_OPERATORS = {";", "&", "&&", "|", "||", "(", ")", "\n"}
_RUNNERS = set("hatch pdm pipx poetry rye uv".split())
PYTHONISH = r"\b(?:python|pypy|micropython)[0-9.]*\b|\b(?:hatch|pdm|pipx|poetry|rye|uv)\s+run\b|\bpip[0-9.]*\s+install\b|\bpytest\b"


def split_heredocs(command: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The command without here-documents, and (delimiter, body, opening line) of each."""
    lines, kept, found = iter(command.split("\n")), [], []
    for line in lines:
        m = _OPEN.search(line)
        name = next((m[g] for g in "abc" if m[g]), "") if m else ""
        if m is None or name[:1].isdigit():
            kept.append(line)
            continue
        body = []
        for inner in lines:
            inner = inner.lstrip("\t") if m["dash"] else inner
            if inner.strip() == name:
                break
            body.append(inner)
        found.append((name, "\n".join(body), line))
        kept.append(line[: m.start()])
    return "\n".join(kept), found


def shell_words(text: str) -> list[str]:
    """Words and operators; quotes are resolved, nothing is expanded."""
    words: list[str] = []
    word: list[str] | None = None
    k = 0

    def end() -> None:
        nonlocal word
        if word is not None:
            words.append("".join(word))
            word = None

    while k < len(text):
        c = text[k]
        if c in " \t":
            end()
        elif c in ";&|()\n":
            end()
            double = c in "&|" and text[k + 1 : k + 2] == c
            words.append(c * 2 if double else c)
            k += double
        else:
            if c == "\\" and text[k + 1 : k + 2] == "\n":
                k += 2
                continue
            word = [] if word is None else word
            if c == "'":
                stop = text.find("'", k + 1)
                stop = len(text) if stop < 0 else stop
                word.append(text[k + 1 : stop])
                k = stop
            elif c == '"':
                k += 1
                while k < len(text) and text[k] != '"':
                    if text[k] == "\\" and k + 1 < len(text) and text[k + 1] in '\\"$`\n':
                        k += 1
                        word.append("" if text[k] == "\n" else text[k])
                    else:
                        word.append(text[k])
                    k += 1
            elif c == "\\" and k + 1 < len(text):
                k += 1
                word.append(text[k])
            else:
                word.append(c)
        k += 1
    end()
    return words


def programs(command: str | None) -> Iterator[tuple[str, list[str]]]:
    """(program, arguments) of every ``python -c`` in a command, then of here-documents fed to Python."""
    if not command:
        return
    plain, documents = split_heredocs(command)
    words = shell_words(plain)
    k = 0
    while k < len(words):
        runner = words[k] in _RUNNERS and words[k + 1 : k + 2] == ["run"]
        if not runner and not _PYTHON.fullmatch(words[k]):
            k += 1
            continue
        k += 1 + runner
        if runner and k < len(words) and _PYTHON.fullmatch(words[k]):
            k += 1
        while k < len(words) and words[k] not in _OPERATORS:
            if words[k] == "-c":
                stop = next((i for i in range(k + 1, len(words)) if words[i] in _OPERATORS), len(words))
                if stop > k + 1 and words[k + 1].strip():
                    yield words[k + 1], words[k + 2 : stop]
                k = stop
                break
            if words[k] == "-m" or words[k][:1] != "-":
                break
            k += 1
    for name, body, opened in documents:
        if body.strip() and (_MENTIONS.search(opened) or _BODY_NAME.fullmatch(name)):
            yield body, []


@udtf(returnType="idx int, program string, argv_tail array<string>")
class ExtractPrograms:
    """Table function: one row per program of a command."""

    def eval(self, command: str):
        for idx, (program, tail) in enumerate(programs(command)):
            yield idx, program, tail


def extract(commands: DataFrame, command: str) -> DataFrame:
    """The rows joined laterally with the programs of their command."""
    return commands.lateralJoin(ExtractPrograms(F.col(command).outer())).select("*")


def looks_pythonish(command: Column) -> Column:
    return F.coalesce(command.rlike(PYTHONISH), F.lit(False))
