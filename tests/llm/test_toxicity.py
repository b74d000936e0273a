import random

import numpy as np
import pyarrow as pa

from lathe.llm import toxicity
from lathe.llm.common import table


def made(n, seed):
    rng = random.Random(seed)
    clean = [f"{a}{b}" for a in ("th", "an", "re", "on", "er") for b in ("ing", "ed", "le", "st", "ou")]
    bad = ["scumbag", "worthless", "disgusting"]
    rows = []
    for k in range(n):
        words = rng.choices(clean, k=rng.randint(20, 200))
        toxic = k % 4 == 0
        if toxic:
            for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
                words[at] = rng.choice(bad)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy():
    rows = made(800, 1)
    model = toxicity.fit([t for _, t, _ in rows[:400]], [y for _, _, y in rows[:400]])
    score = model.score(pa.array([t for _, t, _ in rows[400:]]))
    assert np.mean((score >= toxicity.THRESHOLD) == np.array([y for _, _, y in rows[400:]])) >= 0.97


def values(text):
    """{feature: value} of a text, n-gram by n-gram."""
    out = {}
    low = text.lower()
    for n in toxicity.SIZES:
        for k in range(len(low) - n + 1):
            code = np.frombuffer(low[k : k + n].encode("utf-32-le"), np.uint32)
            feature = int(next(i[0] for size, i in toxicity.grams(code) if size == n))
            out[feature] = out.get(feature, 0) + 1000 / len(low)
    return out


def test_score_is_the_sum_over_ngrams():
    """Against a plain loop over every n-gram of every text."""
    rows = made(120, 2)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [rows[0][1], rows[1][1], "Äh, WORTHLESS scum — 日本!", "ab", "abc"]
    for text, got in zip(texts, model.score(pa.array(texts))):
        z = model.bias + sum(model.coefficient[f] * v for f, v in values(text).items())
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_fit_is_the_regression_on_scaled_counts(monkeypatch):
    """Ratios and loss computed from plain counts: the fitted weights leave no slope."""
    monkeypatch.setattr(toxicity, "ROUNDS", 500)
    monkeypatch.setattr(toxicity, "FLAT", 1e-6)
    rows = made(40, 3)
    y = np.array([t for _, _, t in rows], float)
    model = toxicity.fit([t for _, t, _ in rows], y.tolist())
    tables = [values(t) for _, t, _ in rows]
    names = sorted({f for x in tables for f in x})
    x = np.array([[t.get(f, 0.0) for f in names] for t in tables])
    unseen = (1 << toxicity.HASH_BITS) - len(names)
    share = [(toxicity.SMOOTHING + x[y == c].sum(axis=0)) / (x[y == c].sum() + toxicity.SMOOTHING * (len(names) + unseen)) for c in (0, 1)]
    ratio = np.log(share[1] / share[0])
    w = model.coefficient[names] / ratio
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    slope = weight * (1 / (1 + np.exp(-(x @ model.coefficient[names] + model.bias))) - y)
    assert np.abs(ratio * (x.T @ slope) + toxicity.L2 * w).max() < 1e-4 and abs(slope.sum()) < 1e-4
    others = np.delete(model.coefficient, names)
    assert np.abs(others).max() < 1e-6


def test_on_labelled_documents(spark):
    """Fitted on one half of the labels, measured on the other; some labels are noise."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.scores(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("toxic", "flag").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.flag.mean() >= 0.9 and clean.flag.mean() <= 0.02


def test_every_document_is_scored(spark, small):
    docs = table(spark, small, "documents")
    assert toxicity.scores(docs, table(spark, small, "labels")).count() == docs.count()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (9, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, toxic int, TOXIC int")
    got = toxicity.scores(odd_documents, labels).collect()
    assert len(got) == odd_documents.count()
    assert all(r.score == 0 and not r.toxic for r in got if r.doc_id in (3, 4))
    kept = toxicity.drop_toxic(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    none = labels.where("false")
    assert {r.score for r in toxicity.scores(odd_documents, none).collect()} == {0.0}
    assert toxicity.drop_toxic(odd_documents, none).count() == odd_documents.count()
    assert toxicity.scores(no_documents, labels).count() == 0
    assert toxicity.drop_toxic(no_documents, labels).count() == 0
