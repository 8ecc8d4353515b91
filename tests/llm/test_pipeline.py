"""The pipeline stage by stage against what its operators must leave."""

from collections import Counter

import corpus_pipeline
from test_operators import check_packing, expected_components, expected_leaks

from wordfold.llm import io, langid


def test_stages(spark, sf):
    docs = io.documents(spark, sf)
    columns = docs.columns
    left = {r.doc_id: r for r in docs.collect()}
    contents = langid.fit(langid.training_rows(docs))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = io.written(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            check_packing(docs.collect(), [(d, r.text) for d, r in left.items()])
            continue
        assert docs.columns == columns
        rows = [(d, r.text) for d, r in sorted(left.items())]
        if name == "language":
            classifier = langid.Classifier(contents)
            stay = {d for d, t in rows if classifier.predict(t)[3]}
            assert len(stay) > 0.95 * len(rows)
        elif name == "exact":
            stay = set({t: d for d, t in rows}.values())  # the largest id of each text
        elif name == "near":
            stay = {d for d, _, c in expected_components(rows, 5, 80) if d == c}
        else:
            stay = {d for d, _ in rows} - {d for d, *_ in expected_leaks(rows, items)}
        found = docs.collect()
        assert Counter(r.doc_id for r in found) == Counter(stay)
        assert all(tuple(r) == tuple(left[r.doc_id]) for r in found)
        left = {r.doc_id: r for r in found}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(left)


def test_stages_on_nothing(spark, sf):
    docs = io.documents(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = io.written(stage(spark, docs, sf), f"none-{name}")
        assert docs.count() == 0
