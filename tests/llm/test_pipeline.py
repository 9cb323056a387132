"""The pipeline, stage by stage, on a given table and on edge cases."""

import corpus_pipeline
from stackscan.llm.common import stored
from stackscan.llm.substring_dedup import _without
from tests.llm.tables import SF, documents, edge_docs, empty_docs
from tests.llm.test_native import lower, measures
from tests.llm.test_near import extended, near_of, shingles


def test_stages(spark):
    docs = documents(spark)
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "test-stage"))
    assert all(t.columns == columns for t in tables[:-1])
    raw, good, unique, apart, clean, packed = [[r for r in t.collect()] for t in tables]
    assert not [r for r in good if measures(r["text"])[-1]]
    largest = {}
    for r in good:
        largest[lower(r["text"])] = max(r["doc_id"], largest.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in unique) == sorted(largest.values())
    named = near_of([(r["doc_id"], r["text"]) for r in unique])
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, n, c in named if i == c)
    assert all(shingles(r["text"]) for r in apart)
    want = {i: _without(text, removed) for (i, text), removed in extended([(r["doc_id"], r["text"]) for r in apart]).items()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean} == {i: (t, len(t)) for i, t in want.items()}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed))


def test_stages_on_edges(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            assert found.count() >= 0
            assert name == "packing" or found.columns == docs.columns
