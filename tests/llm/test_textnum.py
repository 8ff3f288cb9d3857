"""Words and shingles of batches against the regular expression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chunks
from lectern.llm import textnum as tn

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZé ß\n\t\x0b\x1f\xa0 .,!😀"), max_size=40)), max_size=12)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words(texts):
    got = tn.words_of(pa.array(texts, pa.string()))
    assert got.counts.tolist() == [len(words(t)) for t in texts]
    seen = {}
    for h, w in zip(got.hash.tolist(), [w for t in texts for w in words(t)], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(TEXTS, st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_shingles(texts, k):
    h, first = tn.shingles(tn.words_of(pa.array(texts, pa.string())), k)
    want = []
    for t in texts:
        w = words(t)
        want.append([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))
    assert np.diff(first).tolist() == [len(x) for x in want]
    flat = [s for x in want for s in x]
    table = {}
    for a, b in zip(h.tolist(), flat, strict=True):
        assert table.setdefault(b, a) == a
    assert len(set(table.values())) == len(table)


@given(st.lists(st.text(max_size=300), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_boundaries_are_of_characters_and_of_one_document(texts):
    data, offsets = tn.utf8_buffers(pa.array(texts, pa.string()))
    ends, first = chunks.boundaries(data, offsets)
    raw = data.tobytes()
    for e in ends.tolist():
        raw[:e].decode()
    for i, t in enumerate(texts):
        alone, _ = chunks.boundaries(*tn.utf8_buffers(pa.array([t], pa.string())))
        assert (ends[first[i] : first[i + 1]] - offsets[i]).tolist() == alone.tolist()


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 30) for i in range(49)] + ["y" * 500])], ["doc_id", "text"])
    rows = [r for p in tn.pieces([batch, batch], 64) for r in p.to_pylist()]
    assert rows == batch.to_pylist() * 2


def test_periodic_text_is_cut():
    ends = []
    for prefix in (b"one start ", b"quite another beginning of it "):
        text = prefix + b"spam " * 80 + b"end"
        ends.append({text[a:b] for a, b in zip(*(lambda e: (e[:-1], e[1:]))(chunks.boundaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]), strict=True)})
    assert any(len(x) > 20 for x in ends[0] & ends[1])
