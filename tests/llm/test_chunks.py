"""Repeated passages against brute force; rows that share an id or have none."""

from __future__ import annotations

import random

from lectern.llm import chunks
from tests.llm import cases


def shares(a: str, b: str, n: int) -> bool:
    """Whether n words in a row of a stand in b."""
    x, y = a.split(), " " + " ".join(b.split()) + " "
    return any(" " + " ".join(x[i : i + n]) + " " in y for i in range(len(x) - n + 1))


def made_of(rng, n):
    return " ".join(rng.choice(cases.WORDS) + rng.choice(cases.WORDS)[:3] + str(rng.randrange(100)) for _ in range(n))


def test_spans_against_brute_force(spark):
    """Passages of 60 words and more are found, of 30 and fewer are not, and
    every span stands in its holder."""
    rng = random.Random(4)
    passages = [made_of(rng, n) for n in (20, 30, 60, 60, 75, 120)]
    pairs = [(i, " ".join([made_of(rng, rng.randrange(0, 60)), rng.choice(passages), made_of(rng, rng.randrange(0, 60))])) for i in range(1, 90)]
    texts, found = dict(pairs), {}
    for r in chunks.repeats(cases.made(spark, pairs)).collect():
        piece = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert r["kept_in"] < r["doc_id"] and piece in texts[r["kept_in"]]
        found.setdefault(r["doc_id"], []).append(piece)
    for i, t in pairs:
        earlier = [u for j, u in pairs if j < i]
        if any(shares(t, u, 60) for u in earlier):
            assert sum(len(p.split()) for p in found[i]) >= 40
        if not any(shares(t, u, 32) for u in earlier):
            assert i not in found


def test_rows_of_one_id_keep_their_own_texts(spark):
    p = cases.prose(50, 150)
    other = "ä" + cases.prose(51, 300)
    pairs = [(1, p), (2, "x " + p + " y"), (2, other), (3, "no repeats here"), (3, "z " + p), (2, "x " + p + " y")]
    got = sorted((r["doc_id"], r["text"]) for r in chunks.deduplicate(cases.made(spark, pairs)).collect())
    assert (1, p) in got and (2, other) in got and (3, "no repeats here") in got and len(got) == len(pairs)
    short = [t for i, t in got if (i, t) not in {(1, p), (2, other), (3, "no repeats here")}]
    assert len(short) == 3 and all(len(t) < 0.2 * len(p) for t in short) and short[0] == short[1]


def test_rows_without_an_id_are_cut(spark):
    p, q = cases.prose(52, 150), cases.prose(53, 150)
    got = [r["text"] for r in chunks.deduplicate(cases.made(spark, [(7, p), (None, "a " + p), (None, q), (None, q), (None, None), (None, "")])).collect()]
    assert sorted(t or "" for t in got if not t or len(t) < 200)[:2] == ["", ""] and got.count(q) == 2 and got.count(p) == 1
    assert len([t for t in got if t and len(t) < 0.2 * len(p)]) == 1


def test_identical_texts_of_many_ids(spark):
    p = cases.prose(54, 120)
    got = {r["doc_id"]: r["text"] for r in chunks.deduplicate(cases.made(spark, [(i, p) for i in range(5, 25)])).collect()}
    assert got[5] == p and all(got[i] == "" for i in range(6, 25))
