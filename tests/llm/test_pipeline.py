import pytest

import corpus_pipeline
from lathe.llm import decontam, packing, toxicity
from lathe.llm.common import pick, table

from test_linededup import brute as brute_lines
from test_packing import spans
from test_simhash import brute_groups


def test_stages_against_brute_force(spark, tiny):
    """Each stage on its own input, against an independent version of its rule."""
    docs = table(spark, tiny, "documents").cache()
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

    first = corpus_pipeline.toxicity(spark, docs, tiny).cache()
    flagged = {r.doc_id for r in toxicity.scores(docs, table(spark, tiny, "labels")).where("toxic").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert first.columns == names and {tuple(r) for r in first.collect()} == {tuple(r) for i, r in rows.items() if i not in flagged}

    second = corpus_pipeline.line_dedup(spark, first, tiny).cache()
    before = sorted(first.collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: (t, len(t) if n else r.n_chars) for r, (t, n) in zip(before, brute_lines([(r.doc_id, r.text) for r in before])) if t.strip() or not n}
    assert second.columns == names and {r.doc_id: (r.text, r.n_chars) for r in second.collect()} == want

    third = corpus_pipeline.near_dedup(spark, second, tiny).cache()
    before = sorted(second.collect(), key=lambda r: r.doc_id)
    root = brute_groups([r.text for r in before])
    keep = {r.doc_id for k, (r, g) in enumerate(zip(before, root)) if g in (-1, k)}
    got = {r.doc_id for r in third.collect()}
    assert third.columns == names and keep <= got and len(got - keep) <= 0.1 * max(10, len(before) - len(keep))

    fourth = corpus_pipeline.decontamination(spark, third, tiny).cache()
    leaked = {r.doc_id for r in decontam.contaminated(third, table(spark, tiny, "benchmark")).collect()}
    assert fourth.columns == names and {r.doc_id for r in fourth.collect()} == got - leaked

    last = corpus_pipeline.packing(spark, fourth, tiny).collect()
    sizes = {r.doc_id: len(r.text.encode()) for r in fourth.collect() if r.text}
    ends = dict.fromkeys(sizes, 0)
    for _, i, start, n in spans(last):
        assert ends[i] == start
        ends[i] += n
    assert ends == sizes and all(r.used <= packing.CAPACITY for r in last)


def test_run_is_the_stages_in_order(spark, tiny):
    docs = table(spark, tiny, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("frame", ["odd_documents", "no_documents"])
def test_stages_on_odd_tables(spark, tiny, request, frame):
    docs = request.getfixturevalue(frame)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        if k < 4:
            assert out.columns == docs.columns
        assert out.count() <= max(docs.count(), 10_000)


def test_run_on_a_table_of_odd_rows(spark, tmp_path, odd_documents, tiny):
    """Nulls, long texts and repeated rows through the whole pipeline, with an unknown extra column."""
    pick(odd_documents, "doc_id", "text", "lang", "source", "n_chars", "rank").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, tiny, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i for r in rows for i in r.doc_ids}
    assert 6 in ids and 3 not in ids and 4 not in ids
