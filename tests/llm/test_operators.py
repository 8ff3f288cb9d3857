"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import chunks, common, fingerprint, forest, jaccard, licenses, maxent, mixing, packing, quality, registry, textnum, toxicity
from lectern.llm.components import components
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(pairs):
    sets = {i: shingle_set(t) for i, t in pairs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed=5):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(cases.WORDS) + str(rng.randrange(60)) for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    pairs = [(i, edited(rng, rng.choice(base), rng.randrange(0, 8))) for i in range(1, 260)]
    passage = " ".join(f"common{i}" for i in range(60))
    return pairs + [(300 + i, passage + " " + " ".join(f"own{i}w{j}" for j in range(rng.randrange(1, 40)))) for i in range(80)]


def test_jaccard_against_brute_force(spark):
    pairs = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(cases.made(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def test_jaccard_large_groups(spark, monkeypatch):
    """Groups beyond a block go through stars and pairs of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    pairs = near_copies(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(cases.made(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def test_keep_one(spark):
    kept = jaccard.keep_one(cases.docs(spark)).select("doc_id").collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[9] == 1 and ids[None] == 2 and ids[5] == 1


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    got = jaccard.overlaps(sets[:8], sets[8:], columns=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 100, 300: 100}


def test_fingerprints(spark):
    pairs = [(5, "Straße  in\tÖl"), (1, "STRASSE in Öl"), (9, "abcdefgh"), (7, ""), (3, "ﬁne text here"), (4, "fine TEXT here")]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(cases.made(spark, pairs)).collect()}
    order = sorted(i for i, _ in pairs)
    texts = dict(pairs)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        t, k = texts[here], len(texts[here]) // 4
        e = t[: len(t) - k] + texts[after][:k]
        r = got[here]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.fingerprint(t) and r["edited_fingerprint"] == fingerprint.fingerprint(e)
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"]) and r["near_next"] == float(r["fingerprint"] == got[after]["fingerprint"])
    assert got[1]["fingerprint"] == got[5]["fingerprint"] and got[3]["fingerprint"] == got[4]["fingerprint"]
    groups = dict(fingerprint.duplicate_groups(cases.made(spark, pairs)).select("doc_id", "group_id").collect())
    assert groups == {1: 1, 5: 1, 9: 9, 7: 7, 3: 3, 4: 3}


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    docs = cases.made(spark, [(1, "same"), (2, "SAME "), (3, "other"), (4, "other"), (5, "alone")])
    groups = dict(fingerprint.duplicate_groups(docs).select("doc_id", "group_id").collect())
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    monkeypatch.setattr(fingerprint, "digest", lambda form: "one")
    assert fingerprint.likeness("a", "b") == 0.0 and fingerprint.likeness("a", "a") == 1.0


def test_fingerprints_many_ranges(spark):
    pairs = [(i * 3, f"{i} " * (i % 50)) for i in range(400)]
    random.Random(2).shuffle(pairs)
    docs = cases.made(spark, pairs).repartition(7)
    texts, order = dict(pairs), sorted(i for i, _ in pairs)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_fingerprints(docs).collect()}
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        t, k = texts[here], len(texts[here]) // 4
        assert got[here] == hashlib.sha256((t[: len(t) - k] + texts[after][:k]).encode()).hexdigest()


def test_packing_round_trip(spark):
    docs = cases.docs(spark)
    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[(r["doc_id"], len(ids))] += len(ids)
    got = Counter()
    for r in rows:
        got[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert got == want
    ids = tokenizer.encode(next(r["text"] for r in docs.collect() if r["doc_id"] == 10), add_special_tokens=False).ids + [1]
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 10)
    at = 0
    for start, length, crc in pieces:
        assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        at += length
    assert at == len(ids)
    filled = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


@pytest.mark.parametrize("text", ["don't I'LL 12,3 $5.00!?", "İ Σ ΣΑΣ. é é.", "<|endoftext|> a<|ENDOFTEXT|> b", "ab…. cd×. ef÷, x.,;:!?y", " a b", "日本語。 text."])
def test_words_tokenise_like_texts(text):
    own = packing.tokenizer_of("word_bpe_49k.json")
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, first = own.encode(pa.array([text, None, text]))
    assert ids[first[0] : first[1]].tolist() == [*reference.encode(text, add_special_tokens=False).ids, 1]
    assert ids[first[1] : first[2]].tolist() == [1]


def test_vector_limits():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 900, 300)
    loss = (tokens * rng.random(300)).astype(int)
    demand = np.stack([tokens, np.ones(300), loss], axis=1)
    limits = packing.Limits(tokens=1000, segments=4, loss=500)
    sequences, left = packing.fill(demand, packing.Limits(tokens=1000, segments=4, loss=900), cut=False)
    assert not left and sorted(i for s in sequences for i, _, _ in s) == list(range(300))
    for s in sequences:
        assert sum(n for _, _, n in s) <= 1000 and len(s) <= 4 and sum(loss[i] for i, _, _ in s) <= 900
    cut, left = packing.fill(demand, limits)
    taken = Counter()
    for s in cut:
        assert sum(n for _, _, n in s) <= 1000 and len(s) <= 4 and sum(loss[i] * n / tokens[i] for i, _, n in s) <= 500 + 4
        for i, start, n in s:
            assert start == taken[i]
            taken[i] += n
    assert not left and all(taken[i] == tokens[i] for i in range(300))


def test_repeated_passages(spark):
    passage = cases.prose(50, 70)
    pairs = [(i, cases.prose(60 + i, 150) + (" " + passage + " " if i % 3 == 0 else " ") + cases.prose(100 + i, 150)) for i in range(1, 31)]
    docs = cases.made(spark, pairs)
    spans = chunks.repeats(docs).collect()
    assert {r["doc_id"] for r in spans} == {i for i, _ in pairs if i % 3 == 0} - {3}
    texts, found = dict(pairs), Counter()
    for r in spans:  # a few words more may be those of another holder than the passage's
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode() in texts[r["kept_in"]]
        found[r["doc_id"]] += (r["end"] - r["start"]) * (r["kept_in"] == 3)
    assert all(n > 0.8 * len(passage) for n in found.values()) and len(found) == 9
    after = {r["doc_id"]: r for r in chunks.deduplicate(docs).collect()}
    for i, t in pairs:
        assert (after[i]["text"] == t) == (i % 3 != 0 or i == 3)
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_boundaries_follow_content():
    text = cases.prose(8, 400).encode()
    shifted = b"inserted words here " + text
    ends = [chunks.boundaries(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (text, shifted)]
    assert len(set((ends[0] + 20).tolist()) & set(ends[1].tolist())) >= len(ends[0]) - 3


def test_maxent_counts_and_normalisation(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    pairs = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 30]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    got = {r["doc_id"]: r for r in maxent.score_documents(cases.made(spark, pairs)).collect()}
    train = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in pairs}
    for i, t in pairs:
        if not held[i]:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in pairs:
        tokens = [*words(t), None]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-8 * max(1, abs(base))


def test_maxent_beats_counts(spark, sf_dir):
    r = maxent.score_documents(common.documents(spark, sf_dir)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_licenses_against_full_alignment(spark):
    notice = licenses.TEMPLATES["mit-grant"].split()
    changed = " ".join(notice[:20] + ["NEW"] + notice[21:50] + notice[52:])
    pairs = [(1, cases.prose(1, 30) + " Released under the MIT License. " + cases.prose(2, 20)), (2, changed), (3, cases.prose(3, 90)), (4, "all rights RESERVED"), (5, "Licensed under the Apache License, Version 2.0. x " * 2)]
    got = licenses.scan(cases.made(spark, pairs)).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == Counter({(1, "mit-line"): 1, (2, "mit-grant"): 1, (4, "all-rights-reserved"): 1, (5, "apache-2.0-line"): 2})
    one = next(r for r in got if r["doc_id"] == 1)
    assert pairs[0][1][one["start"] : one["end"]] == "Released under the MIT License"
    assert next(r for r in got if r["doc_id"] == 2)["matched_words"] == len(notice) - 3
    index = licenses.Index(licenses.TEMPLATES)
    for t, template in enumerate(index.words):  # every start is tried, without an index
        for _, text in pairs:
            h = textnum.words_of(pa.array([text])).bare()
            best = max(licenses.align(template, h, s)[0] for s in range(-8, len(h) + 1))
            hits = [m for k, m, _, _ in licenses.scan_words(h, licenses.Index({index.names[t]: licenses.TEMPLATES[index.names[t]]})) if k == 0]
            assert (best >= licenses.COVERAGE * len(template)) == bool(hits)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 50, 40).astype(np.uint64)
        picked = set(licenses.winnow(h).tolist())
        assert all(picked & set(range(i, i + licenses.WINDOW)) for i in range(len(h) - licenses.WINDOW + 1))


def test_forest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    got = {}
    for r in forest.neighbours(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        score[i] = -9
        best = np.lexsort((ids, -score))[:5]
        hit += len({v for _, v, _ in got[ids[i]]} & set(ids[best].tolist()))
        total += 5
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got[ids[i]])
    assert hit >= 0.9 * total


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i % 40), "en", None if i % 7 == 0 else f"s{i % 4}", 0, 0.0, 0, "", 0) for i in range(2000)] + [(9000, "z " * 3, "en", "tiny", 0, 0.0, 0, "", 0)]
    got = mixing.balance(cases.docs(spark, rows)).collect()
    by = {}
    sources = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(sources[r["doc_id"]], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for s in names:
        assert all(abs(r["target"] - target[s]) < 1e-6 * target[s] and r["source_size"] == sizes[s] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 41
    again = mixing.balance(cases.docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_quality_rules(spark, sf_dir):
    table = common.labels(spark, sf_dir)
    got = registry.QUERIES["op1_quality"](spark, sf_dir).join(table, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)


def test_toxicity_accuracy(spark):
    table = common.labels(spark, "/root/testdata/sf0.1")
    got = registry.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(table, "doc_id").filter("held_out").collect()
    hits, found, true = sum(r["predicted"] and r["toxic"] for r in got), sum(r["predicted"] for r in got), sum(r["toxic"] for r in got)
    assert hits >= 0.8 * true and hits >= 0.95 * found


def test_rules_compile_to_the_same_score(spark):
    model = quality.RuleModel(0.3, [([("upper", ">", 0.5)], -2.0), ([("upper", "<=", 0.5), ("log_words", ">", 1.0)], 1.0)])
    got = [r[0] for r in spark.createDataFrame([(0.9, 2.0), (0.1, 2.0), (0.1, 0.0)], "upper double, log_words double").select(model.score()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([-1.7, 1.3, 0.3]))))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = common.documents(spark, sf_dir)
    kept = corpus_pipeline.quality_classifier(spark, docs, sf_dir).cache()
    good = {r["doc_id"] for r in kept.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in registry.QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert good == {i for i, p in scores.items() if p}
    one = corpus_pipeline.ngram_jaccard_join(spark, kept, sf_dir).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in want.items() if i == c}
    cut = corpus_pipeline.substring_dedup(spark, one, sf_dir).cache()
    assert cut.count() == one.count()
    mixed = corpus_pipeline.source_mixing(spark, cut, sf_dir).cache()
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.balance(cut).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})
    packed = corpus_pipeline.sequence_packing(spark, mixed, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, sf_dir, name):
    import duckdb

    df = registry.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as con:
        con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
        found = con.sql(registry.ORACLE_SQL[name])
        assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())
