"""Rates against a plain solution of the dual; rows that are alike; reruns."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from lectern.llm import mixing
from tests.llm import cases
from tests.llm.test_operators import words


def rows_of(n=900, seed=3):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(5)] + [None]
    return [(i, cases.prose(i % 7, int(rng.paretovariate(1.2) * 5) % 900), "en", sources[min(5, int(rng.expovariate(0.9)))], 0, 0.0, 0, "", 0) for i in range(n)]


def test_rates_solve_the_dual(spark):
    rows = rows_of()
    got = defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in mixing.balance(cases.docs(spark, rows)).collect():
        got[source[r["doc_id"]]].append(r)
    for own in got.values():
        target, total = own[0]["target"], sum(r["size"] for r in own)
        assert abs(sum(r["rate"] * r["size"] for r in own) - target) <= 1e-6 * target
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        if target >= 3 * total:
            assert all(r["rate"] == 3.0 for r in own if r["size"])
            continue
        mean = total / len(own)

        def mass(lam, own=own, mean=mean):
            return sum(r["size"] * min(3.0, math.exp(min(2.0, lam * r["size"] / (r["size"] + mean)))) for r in own)

        low, high = -5000.0, 5000.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if mass(middle) >= target else (middle, high)
        for r in own:
            want = min(3.0, math.exp(min(2.0, low * r["size"] / (r["size"] + mean)))) if r["size"] else 0.0
            assert abs(r["rate"] - want) < 1e-5
    assert any(len({round(r["rate"], 6) for r in own if r["size"]}) > 5 for own in got.values())


@pytest.mark.parametrize("rows", [
    [(1, "a b c", "en", "s", 0, 0.0, 0, "", 0)] * 4 + [(2, "d " * 8, "en", "t", 0, 0.0, 0, "", 0)],
    [(None, f"w{i} x", "en", "s", 0, 0.0, 0, "", 0) for i in range(7)] + [(5, "y " * 20, "en", None, 0, 0.0, 0, "", 0)],
    [(1, f"w{i} x y", "en", f"s{i % 2}", 0, 0.0, 0, "", 0) for i in range(9)],
])
def test_mix_takes_what_balance_says(spark, rows):
    """Equal rows, rows without an id, one id in two sources."""
    taken = sum(r["taken"] for r in mixing.balance(cases.docs(spark, rows)).collect())
    first = [tuple(r) for r in mixing.mix(cases.docs(spark, rows)).collect()]
    assert sum(len(words(r[1])) for r in first) == taken
    again = [tuple(r) for r in mixing.mix(cases.docs(spark, rows[::-1]).repartition(3)).collect()]
    assert Counter(first) == Counter(again)
    whole = Counter(map(tuple, cases.docs(spark, rows).collect()))
    assert all(n <= 3 * whole[r] for r, n in Counter(first).items())


def test_mix_and_balance_agree_by_document(spark):
    rows = rows_of(300, 8)
    taken = {r["doc_id"]: r["taken"] for r in mixing.balance(cases.docs(spark, rows)).collect()}
    got = Counter()
    for r in mixing.mix(cases.docs(spark, rows)).collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert {i: n for i, n in taken.items() if n} == dict(got)
