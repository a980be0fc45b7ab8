import re

import pytest

from bandweave.llm import ngram_join, pii, quality, toxicity
from bandweave.llm.common import table, written

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    stage = dict(pipeline.STAGES)
    one = written(stage["quality rules"](spark, docs, sf), "s")
    rows = quality.features(docs)
    kept = quality.judged(rows, quality.host_verdicts(rows)).where("kept")
    assert one.columns == COLUMNS and {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
    two = written(stage["toxicity"](spark, one, sf), "s")
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(one, toxicity.fit(one, table(spark, sf, "labels"))).collect()}
    assert two.columns == COLUMNS and {r["doc_id"] for r in two.collect()} == {i for i, p in scored.items() if not p}
    three = written(stage["n-gram Jaccard join"](spark, two, sf), "s")
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(two).collect()}
    assert three.columns == COLUMNS and sorted(r["doc_id"] for r in three.collect()) == sorted(set(joined.values()))
    four = written(stage["PII"](spark, three, sf), "s")
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert r["text"] == pii.redacted(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) and not re.search(r"[a-z]@[a-z]+\.", r["text"])
    five = stage["packing"](spark, four, sf)
    assert four.columns == COLUMNS and {r["doc_id"] for r in five.select("doc_id").collect()} == set(texts)
    assert pipeline.run(spark, sf).count() == five.count()


def test_further_columns_keep_their_values(spark, sf):
    names = ["n_words", "Score", "predicted", "kept", "_cls", "_words", "_salt", "cls", "keeper", "pii"]
    docs = table(spark, sf, "documents").limit(60).selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    stage = dict(pipeline.STAGES)
    for name, _ in pipeline.STAGES[:-1]:
        docs = written(stage[name](spark, docs, sf), "s")
        assert docs.columns == [*COLUMNS, *names]
        assert all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names)
    assert docs.count() and stage["packing"](spark, docs, sf).count()


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "s")
    assert docs.isEmpty()
