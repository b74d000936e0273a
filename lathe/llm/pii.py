"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Broad patterns propose spans, and inside each every strict pattern proposes its
own matches, overlapping ones too. Labelers of three sorts vote on each: strict
regular expressions and checksums, gazetteers, and context words. The votes of
all spans are counted by pattern; expectation maximisation over the counts
estimates each labeler's reliability and each kind's prior. The posteriors then
train a logistic span classifier on votes and shape, and it accepts spans; of
accepted spans that overlap the longest of strict form stays.

Shape at scale: one scan proposes spans into a small stored table; EM and
training see only counts of distinct patterns, whose number is bounded by the
features and not by the data; a second map over the spans scores them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import pick, stored
from lathe.llm.kernels import text_slices, utf8

KINDS = ("email", "phone", "ip", "card", "ssn", "secret")
LABELERS = ("strict", "structure", "gazetteer", "context", "decoy", "border")
#: Labelers whose votes against are failed checks.
CHECKS = ("strict", "structure", "gazetteer", "decoy")
#: Characters on either side of a span in which context words count.
CONTEXT = 48
#: Probability from which the span classifier accepts.
THRESHOLD = 0.5
EM_ROUNDS = 100
RIDGE = 1e-4
#: Spans' worth of belief, before any is seen, in what a vote means (see
#: ``estimate``): a share of all spans, and no fewer than LEAST_BELIEF.
BELIEF, LEAST_BELIEF = 0.05, 200.0

_EMAIL = r"[^\s@<>\"'(),;:\[\]]{1,128}@[^\s@<>\"'(),;:\[\]]{1,255}"
_IP = r"(?<![\w.])\d{1,4}(?:\.\d{1,4}){3}(?![\w])"
_NUMBER = r"(?<![\w.])(?:\+|\((?=\d{2,4}\)))?\d(?:[ .()/-]{0,2}\d){6,}(?![\w])"
_SECRET = r"(?<![\w/+])[A-Za-z0-9_+/-]{16,}={0,2}(?![\w])"
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_CANDIDATE = re.compile(f"(?P<email>{_EMAIL})|(?P<ip>{_IP})|(?P<number>{_NUMBER})|(?P<secret>{_SECRET})")

_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "phone": re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "secret": re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{18,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/-]{20,}={0,2}"),
}
# inside a broad match: overlapping matches, one from each place where one may begin
_INNER = {
    "email": {"email": re.compile(rf"(?<![A-Za-z0-9._%+-])(?=({_STRICT['email'].pattern})(?![A-Za-z0-9]))")},
    "number": {
        "card": re.compile(r"(?<!\d)(?=((?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?!\d)))"),
        "phone": re.compile(rf"(?<![\d+])(?=({_STRICT['phone'].pattern})(?!\d))"),
        "ssn": re.compile(r"(?<![\d-])(?=(\d{3}-\d{2}-\d{4})(?![\d-]))"),
        "ip": re.compile(rf"(?<![\w.])(?=({_STRICT['ip'].pattern})(?![\w.]*\d))"),
    },
}
TOP_DOMAINS = set("com org net edu gov mil int info biz io dev app example test de fr es it uk nl eu ch at be se no dk pl pt ru cn jp in br us ca au".split())
CREDENTIAL_WORDS = set("token password passwd pwd secret key apikey api_key access_key bearer auth authorization credential credentials".split())
CARD_PREFIXES = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|36|38")
CONTEXT_WORDS = {
    "email": set("email e-mail mail contact write reply address courriel correo".split()),
    "phone": set("phone tel telephone call mobile cell fax contact telefon téléphone teléfono whatsapp".split()),
    "ip": set("ip host server address login connected from client dns".split()),
    "card": set("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "ssn": set("ssn social security taxpayer tin".split()),
    "secret": CREDENTIAL_WORDS,
}
DECOY_WORDS = set("version release v isbn issn doi page chapter section figure table license licence commit sha md5 checksum serial total price sum id".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (start, end, kind) that look like personal data or secrets in the widest sense; spans overlap only within a group."""
    for m in _CANDIDATE.finditer(text):
        broad, start, end = m.lastgroup, m.start(), m.end()
        kind, value = broad, m.group()
        group: dict[tuple[int, int, str], None] = {}
        if broad == "email":
            # punctuation and decoration around an address are none of it
            while end > start and not text[end - 1].isalnum():
                end -= 1
            while start < end and not text[start].isalnum():
                start += 1
            if "@" not in text[start:end]:
                continue
        elif broad == "number":
            digits = sum(c.isdigit() for c in value)
            kind = "ssn" if _SSN.fullmatch(value) else "card" if 13 <= digits <= 19 else "phone"
        elif broad == "secret" and not value.startswith("AKIA") and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        group[start, end, kind] = None
        for inner, pattern in _INNER.get(broad, {}).items():
            for i in pattern.finditer(text, m.start(), m.end()):
                group[i.start(1), i.end(1), inner] = None
        yield list(group)


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing."""
    value = text[start:end]
    left = text[max(0, start - CONTEXT) : start]
    right = text[end : end + CONTEXT]
    digits = re.sub(r"\D", "", value)
    before = [w.lower() for w in _WORD.findall(left)]
    words = set(before) | {w.lower() for w in _WORD.findall(right)}

    strict = 1 if _STRICT[kind].fullmatch(value) else -1
    if kind == "email":
        domain = value.rpartition("@")[2]
        structure = 1 if "." in domain and ".." not in value and value.count("@") == 1 else -1
        gazetteer = 1 if domain.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif kind == "phone":
        structure = 1 if 10 <= len(digits) <= 13 and len(set(digits)) > 2 else -1
        gazetteer = 1 if value.startswith("+") else 0
    elif kind == "ip":
        parts = [int(x) for x in value.split(".")]
        structure = 1 if max(parts) <= 255 and parts[0] > 0 else -1
        gazetteer = -1 if parts[0] in (0, 127, 255) or max(parts) < 10 else 0
    elif kind == "card":
        structure = 1 if _luhn(digits) else -1
        gazetteer = 1 if CARD_PREFIXES.match(digits) else -1
    elif kind == "ssn":
        issued = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        structure = 1 if issued and len(set(digits)) > 2 else -1
        gazetteer = 1 if words & {"ssn", "social"} else 0
    else:
        structure = 1 if _entropy(value) >= 3.0 else -1
        gazetteer = 1 if (before and before[-1] in CREDENTIAL_WORDS) or value.startswith("AKIA") else 0
    context = 1 if words & CONTEXT_WORDS[kind] else 0
    decoy = -1 if before and before[-1] in DECOY_WORDS else 0
    border = 1 if (not left or not left[-1].isalnum()) and (not right or not right[0].isalnum()) else -1
    return [strict, structure, gazetteer, context, decoy, border]


def shape(value: str) -> tuple[int, int, int]:
    """Bucketed length, share of digits, and letter case of a span."""
    n = len(value)
    digits = sum(c.isdigit() for c in value) / n
    return (
        0 if n < 12 else 1 if n < 20 else 2 if n < 32 else 3,
        0 if digits < 0.2 else 1 if digits < 0.7 else 2,
        (1 if value != value.lower() else 0) + (2 if value != value.upper() else 0),
    )


FEATURES = [*LABELERS, "size", "digits", "letters"]


SPAN = pa.struct([(name, pa.int32()) for name in ("start", "end", "kind", *FEATURES)])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of overlapping spans."""
    # a document without a digit or an at sign has no candidate
    mark = np.zeros(256, np.int64)
    mark[48:58] = mark[64] = 1
    for batch in batches:
        column = batch.column("text")
        out: list[list] = [[] for _ in range(3 + len(FEATURES))]
        rows, ends = [], [0]
        for s, e in text_slices(column):
            part = column.slice(s, e - s)
            data, offsets = utf8(part)
            seen = np.concatenate([[0], np.cumsum(mark[data])])
            for k in np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]).tolist():
                text = part[k].as_py()
                for group in candidates(text):
                    for start, end, kind in group:
                        span = [start, end, KINDS.index(kind), *votes(text, start, end, kind), *shape(text[start:end])]
                        for cell, value in zip(out, span):
                            cell.append(value)
                    rows.append(s + k)
                    ends.append(len(out[0]))
        values = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], fields=list(SPAN))
        spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), spans], names=["doc_id", "spans"])


@dataclass
class Reliability:
    """Per labeler the probability of a vote for and against given the truth and that it votes, and per kind the prior."""

    prior: np.ndarray
    table: np.ndarray  # truth, labeler, vote + 1; the middle ones are 1, as saying nothing tells nothing

    def posterior(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        logs = np.stack([np.log(1 - self.prior[kind]), np.log(self.prior[kind])])
        for labeler in range(vote.shape[1]):
            logs += np.log(self.table[:, labeler, vote[:, labeler] + 1])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def estimate(kind: np.ndarray, vote: np.ndarray, count: np.ndarray) -> Reliability:
    """EM for the naive Bayes model of votes.

    It starts from the belief that votes are right in four cases of five, and a
    failed check (of form, checksum or list, or a decoy's word before the span) in
    nearly all. That belief stays on as a Dirichlet prior that weighs as much as
    BELIEF of the spans: the most probable reliabilities under it are what is
    estimated, and spans that outnumber it by far may say otherwise.
    """
    labelers = vote.shape[1]
    table = np.repeat(np.array([[0.8, 1.0, 0.2], [0.2, 1.0, 0.8]])[:, None, :], labelers, axis=1)
    for labeler in CHECKS:
        table[1, LABELERS.index(labeler)] = [0.01, 1.0, 0.99]
    model = Reliability(np.full(len(KINDS), 0.5), table)
    belief = max(LEAST_BELIEF, BELIEF * count.sum()) * model.table
    for _ in range(EM_ROUNDS):
        p = model.posterior(kind, vote)
        weights = np.stack([count * (1 - p), count * p])
        table = belief.copy()
        for labeler in range(labelers):
            for truth in (0, 1):
                table[truth, labeler] += np.bincount(vote[:, labeler] + 1, weights=weights[truth], minlength=3)
        table[:, :, 1] = 0
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, 1] = 1
        prior = (1 + np.bincount(kind, weights=weights[1], minlength=len(KINDS))) / (2 + np.bincount(kind, weights=count, minlength=len(KINDS)))
        done = np.abs(table - model.table).max() < 1e-6
        model = Reliability(prior, table)
        if done:
            break
    return model


def encode(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One column per kind, votes as they are, one column per bucket of the shape, and the bias."""
    parts = [np.eye(len(KINDS))[kind], features[:, : len(LABELERS)]]
    for k, width in ((6, 4), (7, 3), (8, 4)):
        parts.append(np.eye(width)[features[:, k]])
    return np.concatenate([*parts, np.ones((len(kind), 1))], axis=1)


def train_classifier(x: np.ndarray, target: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    weight = count / count.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - target)) + RIDGE * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_apart(start: np.ndarray, end: np.ndarray, strict: np.ndarray, score: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the spans that stay: in each group those of strict form first, then the longest, more probable, earlier; others only beside them."""
    kept: list[int] = []
    order = np.lexsort((start, -score, start - end, -strict, group))
    taken: list[tuple[int, int]] = []
    last = -1
    for k in order.tolist():
        if group[k] != last:
            last, taken = group[k], []
        if all(end[k] <= a or start[k] >= b for a, b in taken):
            taken.append((start[k], end[k]))
            kept.append(k)
    return np.array(sorted(kept), np.int64)


def _scorer(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for batch in batches:
            spans = batch.column("spans")
            group = np.repeat(np.arange(len(batch)), spans.value_lengths().to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            start, end, kind, *features = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
            score = 1 / (1 + np.exp(-np.clip(encode(kind, np.stack(features, axis=1)) @ w, -35, 35)))
            good = np.flatnonzero(score >= THRESHOLD)
            keep = good[best_apart(start[good], end[good], features[0][good], score[good], group[good])]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(group[keep])), pa.array(start[keep]), pa.array(end[keep]), names.take(pa.array(kind[keep])), pa.array(score[keep])],
                names=["doc_id", "start", "end", "kind", "score"],
            )

    return run


def learned(patterns: pd.DataFrame) -> np.ndarray:
    """Weights of the span classifier from the counted patterns (kind, features, count)."""
    kind, features, count = patterns["kind"].to_numpy(), patterns[FEATURES].to_numpy(), patterns["count"].to_numpy(float)
    vote = features[:, : len(LABELERS)]
    return train_classifier(encode(kind, features), estimate(kind, vote, count).posterior(kind, vote), count)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, score): spans of personal data and secrets; offsets count characters.

    Spans of one document do not overlap: of accepted ones that would, those of
    strict form go first, then the longest, the more probable, the earlier.

    Null and empty texts have none. A null doc_id stays null; repeated rows give
    repeated results; texts are read whole, and numbers and secrets may be of any
    length. With few spans in all, the belief in the labelers decides. Extra
    columns are ignored. An empty table, or one without a candidate, gives no
    rows.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    fields = ", ".join(f"{f}: int" for f in ("start", "end", "kind", *FEATURES))
    proposed = stored(rows.mapInArrow(_propose, f"doc_id long, spans array<struct<{fields}>>"), "spans")
    # one row per distinct pattern of kind, votes and shape: bounded whatever the corpus
    each = proposed.select(F.explode("spans").alias("s")).select("s.*")
    patterns = each.groupBy("kind", *FEATURES).count().orderBy("kind", *FEATURES).toPandas()
    if patterns.empty:
        weights = np.zeros(encode(np.zeros(1, int), np.zeros((1, len(FEATURES)), int)).shape[1])
    else:
        weights = learned(patterns)
    return proposed.mapInArrow(_scorer(weights), "doc_id long, start int, end int, kind string, score double")
