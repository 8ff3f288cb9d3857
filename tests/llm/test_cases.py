"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pytest

from lectern.llm import chunks, fingerprint, forest, jaccard, licenses, maxent, mixing, packing, quality, toxicity
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=None):
    rows = [(i, i % 2, int(i in (13,))) for i in range(1, 15)] + [(None, 1, 0), (3, None, None), (99, 1, 1)] if rows is None else rows
    return spark.createDataFrame(rows, LABELS)


OPERATORS = {
    "quality": lambda s, d: quality.classify(d, quality.fit(d, labels(s))),
    "toxicity": lambda s, d: toxicity.classify(d, toxicity.fit(d, labels(s))),
    "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "fingerprints": lambda s, d: fingerprint.edited_fingerprints(d),
    "groups": lambda s, d: fingerprint.duplicate_groups(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "repeats": lambda s, d: chunks.repeats(d),
    "maxent": lambda s, d: maxent.score_documents(d),
    "licenses": lambda s, d: licenses.scan(d),
    "mixing": lambda s, d: mixing.balance(d),
}
STAGES = {
    "keep_good": lambda s, d: quality.keep_good(d, quality.fit(d, labels(s))),
    "keep_one": lambda s, d: jaccard.keep_one(d),
    "deduplicate": lambda s, d: chunks.deduplicate(d),
    "mix": lambda s, d: mixing.mix(d),
}
PER_ROW = {"quality", "toxicity", "jaccard", "fingerprints", "groups", "maxent", "mixing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_documents(spark, name):
    docs = cases.docs(spark)
    got = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, cases.docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = cases.docs(spark)
    got = STAGES[name](spark, docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    got.collect()
    assert STAGES[name](spark, cases.docs(spark, [])).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (9, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in forest.neighbours(vectors).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 50), (50, 1, 9), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert forest.neighbours(vectors.limit(0)).collect() == []
