import pytest

import corpus_pipeline
from labelgrid.llm.shared import saved


def test_stages_on_awkward_rows(spark, awkward, sf):
    docs = saved(awkward, "awkward")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf), name)
        assert docs.columns == awkward.columns, name
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 5, 6, 7, 8, 9, 10, None], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_stages_on_an_empty_table(spark, nothing, sf):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), name)
        assert docs.count() == 0, name


@pytest.fixture(scope="module")
def ran(spark, sf):
    return corpus_pipeline.run(spark, sf).toPandas()


def test_run_equals_its_stages_by_hand(spark, sf, ran):
    """The kept documents: not toxic, first of their component among those, without a benchmark item; their token counts with personal data masked."""
    from labelgrid.llm import decontam, minhash, pii, toxicity
    from labelgrid.llm.encode import encoder, vocabulary

    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    low = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score < toxicity.LIMIT}
    rest = docs.where(docs["doc_id"].isin(list(low)))
    first = {r.doc_id for r in minhash.near_duplicates(rest).collect() if r.kept}
    leaks = {r.doc_id for r in decontam.matches(docs, items).collect()}
    texts = {r.doc_id: pii.mask(r.text or "") for r in docs.collect() if r.doc_id in first - leaks}
    assert set(ran["doc_id"]) == set(texts)
    tok = encoder(vocabulary("word_bpe_49k.json"), 2).tokenizer
    assert ran.groupby("doc_id")["length"].sum().to_dict() == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert leaks


def test_leaks_equal_a_plain_search(spark, sf):
    """Every document with a whole benchmark item in it is reported, and no other."""
    from labelgrid.llm import decontam

    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    squeeze = lambda t: " " + " ".join(t.split()) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if d.text and squeeze(i.text) in squeeze(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()} == want and want
