"""Stages of the pipeline on the small tables, each against its predecessor's rows."""

import corpus_pipeline
from tests.llm import brute


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.save(stage(spark, docs, sf), name)
        assert docs.columns == given
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = kept["quality_classifier"]
    assert sum(labels[i] == 1 and i not in after for i, _ in before if i in labels) <= 3
    assert sum(labels[i] == 0 and i in after for i, _ in before if i in labels) <= 3
    before, after = kept["line_dedup"]
    assert after == {i: t for i, t, _, _ in brute.line_drops(before)}
    before, after = kept["jaccard_join"]
    assert set(after) == {i for i, (_, c) in brute.groups(before, 5, 80).items() if i == c}
    before, after = kept["benchmark_decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(after) == {i for i, _, hit, _ in brute.contamination(before, bench) if not hit}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == set(after)


def test_the_whole_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
