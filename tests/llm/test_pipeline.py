"""The pipeline against the brute-force forms of its stages."""

import corpus_pipeline
from tessera.llm import minhash
from tessera.llm.common import table, written
from tests.llm.test_dedup_and_placement import brute_classes
from tests.llm.test_texts import brute_contamination


def test_stages_on_the_small_table(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs := written(stage(spark, docs, sf), "stage"))
        if name != "bpe encoding":
            assert docs.columns == columns
    rows = lambda name: [(r.doc_id, r.text) for r in seen[name].orderBy("doc_id").collect()]
    good, exact, near, clean = (rows(n) for n in list(seen)[:4])
    last = {t: d for d, t in good}
    assert exact == [(d, t) for d, t in good if last[t] == d]
    classes = brute_classes(exact)
    assert near == [(d, t) for d, t in exact if classes[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hits = brute_contamination([t for _, t in near], items)
    assert clean == [row for row, h in zip(near, hits) if not h[1]]
    assert sorted(r.doc_id for r in seen["bpe encoding"].collect()) == [d for d, _ in clean]
    assert len(good) > len(exact) > 0 and minhash.SIMILARITY == 0.8


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "token_ids", "n_tokens"] and out.count() > 0
