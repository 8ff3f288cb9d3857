"""Ids of every piece against the tokenizer; limits on segments and loss."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lectern.llm import packing
from tests.llm import cases


def reference():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_random_strings_tokenise_like_the_tokenizer():
    rng, plain = random.Random(8), reference()
    letters = "aZé9İıßΣſŉǰÅİͅ.,;:!?'-_ \t\n$%日‘’́µ×÷ÿĀžǅɏ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(6000)] + [c + m for c in "İÇŞĞÖÜıß" for m in (",", ".", "?", "!", ":", ";", ".,!")]
    ids, first = packing.tokenizer_of("word_bpe_49k.json").encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1], repr(t)


def check(rows, texts, limits, doc="doc_id"):
    plain, pieces, filled = reference(), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[doc]].append(r)
        filled[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in filled.values():
        assert len(own) <= limits.segments
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)
    return filled


def test_every_piece_of_every_document(spark):
    texts = {r[0]: r[1] for r in cases.rows() if r[0] not in (None, 9)}
    check(packing.pack_documents(cases.made(spark, list(texts.items()))).collect(), texts, packing.Limits())


def test_short_documents_are_filled_up(spark):
    """Thousands of short documents before long ones make few short sequences."""
    texts = {i: f"tiny {i}" for i in range(3000)} | {5000 + i: cases.prose(i, 3000) for i in range(12)}
    rows = packing.pack_documents(cases.made(spark, sorted(texts.items())).coalesce(1)).collect()
    filled = check(rows, texts, packing.Limits())
    sizes = Counter(sum(r["length"] for r in own) for own in filled.values())
    assert sum(sizes.values()) - sizes[2048] <= 50  # what ends the partition; by the segment limit alone it were 46 sequences and more


def test_loss_is_limited(spark):
    limits, share = packing.Limits(loss=700), {i: (i % 5) / 4 for i in range(60)}
    texts = {i: cases.prose(i, 30 + 5 * i) for i in share}
    docs = spark.createDataFrame([(i, texts[i], share[i]) for i in texts], "doc_id long, text string, share double")
    filled = check(packing.pack_documents(docs, limits=limits, loss="share").collect(), texts, limits)
    for own in filled.values():
        assert sum(r["length"] * share[r["doc_id"]] for r in own) <= 700 + len(own)
    without = check(packing.pack_documents(docs).collect(), texts, packing.Limits())
    assert any(sum(r["length"] * share[r["doc_id"]] for r in own) > 700 + len(own) for own in without.values())


def test_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said, own = defaultdict(list), defaultdict(Counter)
    for r in table.orderBy("conv_id", "turn").collect():
        said[r["conv_id"]].append(r["text"] or "")
        own[r["conv_id"]][r["role"]] += len(r["text"] or "")
    limits = packing.Limits(loss=1024)
    filled = check(packing.pack_conversations(table).collect(), {i: "\n".join(t) for i, t in said.items()}, limits)
    share = {i: c["assistant"] / max(1, sum(c.values())) for i, c in own.items()}
    assert all(sum(r["length"] * share[r["doc_id"]] for r in x) <= 1024 + len(x) for x in filled.values())
