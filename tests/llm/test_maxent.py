"""The model's probabilities sum to one; its scores equal a plain evaluation;
the fit climbs to the penalised likelihood's top."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import common, maxent
from lectern.llm import textnum as tn
from tests.llm import cases
from tests.llm.test_operators import words


def likelihood(a, b, by_g, by_u, both):
    z = np.log(np.exp(b) @ np.exp(a).T)
    first = np.log(by_g.sum(axis=0) + 0.1)
    return (by_g * a).sum() + (by_u * b).sum() - (both * z).sum() - (maxent.PRIOR_G * ((a - first) ** 2).sum() + maxent.PRIOR_U * (b**2).sum()) / 2


def test_fit_is_at_the_top():
    rng = np.random.default_rng(5)
    joint = rng.poisson(rng.gamma(0.5, 4, (4, 3, 7)))
    by_g, by_u, both = joint.sum(axis=0), joint.sum(axis=1), joint.sum(axis=2)
    a, b = maxent.fit(by_g, by_u, both, 2000)
    top = likelihood(a, b, by_g, by_u, both)
    assert top >= likelihood(*maxent.fit(by_g, by_u, both), by_g, by_u, both) >= top - 0.05
    for _ in range(200):
        x, y = a + rng.normal(0, 0.03, a.shape), b + rng.normal(0, 0.03, b.shape)
        assert likelihood(x, y, by_g, by_u, both) <= top + 1e-6


@pytest.fixture
def corpus():
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(cases.WORDS) + str(rng.randrange(1 + i % 9)) for _ in range(rng.randrange(0, 60)))) for i in range(300)]


def models_of(spark, monkeypatch, docs):
    """Scores by document, with the cells and model that were broadcast."""
    seen = []
    real = maxent.Model.__init__
    monkeypatch.setattr(maxent.Model, "__init__", lambda self, cells, found: (real(self, cells, found), seen.append((cells, self)))[0])
    return maxent.score_documents(docs).collect(), *seen[0]


def test_probabilities_sum_to_one(spark, monkeypatch, corpus):
    _, cells, model = models_of(spark, monkeypatch, cases.made(spark, corpus))
    places = np.arange(len(cells.place))
    classes = maxent.deal.owner(np.diff(cells.edges))
    assert cells.edges[-1] == len(places) and np.diff(cells.edges).max() <= maxent.MEMBERS
    for u in range(cells.classes + 1):
        for g in range(maxent.GROUPS + 1):
            total = np.exp(model.log(places, classes, np.full(len(places), u), np.full(len(places), g)).astype(float)).sum()
            assert abs(total - 1) < 1e-4


def test_scores_token_by_token(spark, monkeypatch, corpus):
    rows, cells, model = models_of(spark, monkeypatch, cases.made(spark, corpus))
    train = {}
    for i, t in corpus:
        if not next(r for r in rows if r["doc_id"] == i)["held_out"]:
            for w in words(t):
                train[w] = train.get(w, 0) + 1
    cell_of = {w: int(tn.words_of(pa.array([w])).hash[0]) >> (64 - cells.bits) for w in {w for _, t in corpus for w in words(t)}}
    mass = {}
    for w, c in train.items():
        mass[cell_of[w]] = mass.get(cell_of[w], 0.1) + c + 0.1
    for i, t in corpus[:60]:
        total, u, g = 0.0, cells.classes, 0
        for w in [*words(t), None]:
            y = 1 << cells.bits if w is None else cell_of[w]
            c = int(cells.of[y])
            log = float(model.context[u, g, c]) + float(model.a[g, cells.place[y]]) + float(model.b[u, cells.place[y]])
            total += log / np.log(10) + (0 if w is None else np.log10((train.get(w, 0) + 0.1) / mass.get(y, 0.1)))
            u, g = c, int(cells.group[y]) or g
        assert abs(next(r for r in rows if r["doc_id"] == i)["score"] - total) < 1e-3 * max(1, abs(total))


def test_reruns_agree(spark, corpus):
    first, again = ({r["doc_id"]: r["score"] for r in maxent.score_documents(cases.made(spark, corpus).repartition(n)).collect()} for n in (1, 5))
    assert all(abs(first[i] - again[i]) < 1e-6 * max(1, abs(first[i])) for i in first)


def test_hash_space_grows_with_the_words(spark, monkeypatch, corpus):
    few = models_of(spark, monkeypatch, cases.made(spark, corpus[:20]))[1].bits
    monkeypatch.undo()
    many = models_of(spark, monkeypatch, cases.made(spark, [(i, cases.prose(i, 400)) for i in range(40)]))[1].bits
    assert maxent.LEAST_BITS <= few < many <= maxent.MOST_BITS


def test_held_out_gain(spark):
    docs = common.documents(spark, "/root/testdata/sf0.1")
    own = SimpleNamespace(**maxent.score_documents(docs).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first().asDict())
    gain = (getattr(own, "sum(score)") - getattr(own, "sum(base_score)")) / getattr(own, "sum(n_tokens)")
    assert gain > 0.25, gain
