"""Statistics and features against plain Python; conflicting labels."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa

from lectern.llm import common, quality, toxicity
from tests.llm import cases
from tests.llm.test_operators import words

MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
SYMBOLS = "#$%&*@^~|<>{}[]_=+\\/"


def texts():
    rng = random.Random(2)
    extra = ["a a a a b", "A!! #tag (x) ... 12 é", "one\ntwo three\none\n\none\n", "x", "", " \n\t ", "!!! ??", "tail\n", "\n\nhead two", "a b c d e a b c d e f"]
    return extra + [cases.prose(i, rng.randrange(1, 60)) for i in range(20)] + [r[1] for r in cases.rows() if r[1]]


def plain_statistics(text):
    w, data = words(text), text.encode()
    n, size = max(len(w), 1), max(len(data), 1)

    def share(test):
        return sum(map(test, data)) / size

    def grams(k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []

    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    kinds = {tuple(words(line)) for line in lines}
    return [
        math.log1p(len(w)), sum(len(x.encode()) for x in w) / n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: chr(b) in SYMBOLS), share(lambda b: chr(b) in ".,;:?"),
        share(lambda b: b == 33), share(lambda b: b >= 128), share(lambda b: b in (32, 9, 10, 11, 12, 13)), len(set(w)) / n, len(set(grams(2))) / max(len(grams(2)), 1), len(set(grams(5))) / max(len(grams(5)), 1),
        max(map(w.count, w), default=0) / n, math.log1p(len(w) / max(len(lines), 1)), len(kinds) / max(len(lines), 1) if w else 0.0, sum(chr(x.encode()[-1]) in SYMBOLS for x in w) / n,
    ]


def test_statistics_against_plain_python():
    own = texts()
    got = quality.measure(pa.array(own))
    for t, row in zip(own, got, strict=True):
        want = plain_statistics(t)
        off = [k for k, a, b in zip(quality.STATS, row, want, strict=True) if abs(a - b) > 1e-6 and k != "distinct_lines"]
        assert not off, (t[:40], off)
        assert abs(row[14] - want[14]) < 1e-6 or not words(t), (t[:40], row[14], want[14])


def bare(word):
    data = word.encode()
    a, b = 0, len(data)
    for _ in range(3):
        b -= b - a > 1 and chr(data[b - 1]) in MARKS
        a += b - a > 1 and chr(data[a]) in MARKS
    return data[a:b]


def test_features_are_those_of_plain_python():
    """Equal plain features have equal numbers, others hardly ever."""
    own, number = texts(), {}
    f, doc = toxicity.features(pa.array(own))
    for d, t in enumerate(own):
        w = [bare(x) for x in words(t)]
        plain = {("w", x) for x in w} | {("p", g, a, b) for g in (1, 2) for a, b in zip(w, w[g:], strict=False)} | {("s", k, x[:k]) for k in toxicity.STEMS for x in w if len(x) > k}
        assert len(plain) >= len(set(f[doc == d].tolist())) >= 0.99 * len(plain)
        for x in plain:
            number.setdefault(x, set()).add(d)
    holders = {}
    for d in range(len(own)):
        for x in set(f[doc == d].tolist()):
            holders.setdefault(x, set()).add(d)
    assert sorted(map(len, holders.values())) != [] and np.isclose(sum(map(len, holders.values())), sum(map(len, number.values())), rtol=0.01)


def test_conflicting_labels_and_texts(spark):
    docs = cases.made(spark, [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    rows = [{tuple(r) for r in common.labelled(docs.repartition(n), labels.repartition(n), "toxic", 10, 10**9, 1).collect()} for n in (1, 4)]
    assert rows[0] == rows[1] and {r[:2] for r in rows[0]} == {(1, 1), (2, 0)}
    assert re.fullmatch("[ab]", next(r[2] for r in rows[0] if r[0] == 1))
