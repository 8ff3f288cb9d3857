"""Groups of equal canonical texts against a plain grouping."""

from __future__ import annotations

import random

import pyarrow as pa

from lectern.llm import fingerprint
from tests.llm import cases


def plain(pairs):
    least = {}
    for i, t in pairs:
        form = fingerprint.canonical(t)
        least[form] = min((x for x in (least.get(form), i) if x is not None), default=None)
    return sorted(((i, least[fingerprint.canonical(t)]) for i, t in pairs), key=str)


def test_groups_against_plain_grouping(spark):
    rng = random.Random(6)
    texts = ["Same text", "SAME  text", "same\tText ", "ﬁne", "fine", "", " \n", None, "Straße", "STRASSE", *[cases.prose(i, 30) for i in range(20)]]
    pairs = [(rng.choice([i, i, i, 7, None]), rng.choice(texts)) for i in range(400)]
    for got in (fingerprint.edited_fingerprints(cases.made(spark, pairs)), fingerprint.duplicate_groups(cases.made(spark, pairs))):
        assert sorted(((r["doc_id"], r["group_id"]) for r in got.collect()), key=str) == plain(pairs)


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    pairs = [(i, "one " * (1 + i % 2)) for i in range(200, 300)] + [(None, "one")] * 3
    got = fingerprint.duplicate_groups(cases.made(spark, pairs).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["group_id"]) for r in got), key=str) == plain(pairs)


def test_a_collision_is_told_apart():
    """Rows of one digest with unequal bytes have forms of their own."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text_key": [1, 2, 3], "fingerprint": ["f"] * 3, "part": [0] * 3, "text": ["a", "b", "A "]})
    forms = pa.Table.from_batches(list(fingerprint._compared([batch])))["form"].to_pylist()
    assert forms[0] == forms[2] != forms[1]
