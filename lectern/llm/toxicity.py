"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes of its words (case folded, outer
punctuation stripped) and of their stems, adjacent word pairs and pairs with
one word skipped.
FTRL-proximal keeps a learning rate for each coordinate and an L1 penalty
leaves few weights non-zero; those go to the workers, at most ``2**BITS`` of
them.

Cases: null and empty texts have no features and get the bias' probability;
null labels are not learnt from; repeated rows are scored row by row and learnt
from once (see ``labelled``); without
labelled rows the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import store
from lectern.llm import textnum as tn
from lectern.llm.common import frugal, held_out, labelled

#: Labelled rows that the fit uses, taken in the order of a hash of the id.
MAX_LABELLED = 8_000
#: Bytes of their features, four each; rows beyond are not learnt from.
MAX_BYTES = 256 << 20
BITS = 20
#: Stems of words in bytes: the same insult with another ending is one feature.
STEMS = (4, 5, 6, 7, 8)
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 1.0, 4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every occurrence in a slice of texts."""
    words = tn.words_of(column)
    h, doc = words.bare(), words.docs()
    out, owner = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append(tn.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))[same])
            owner.append(doc[gap:][same])
    for size in STEMS:
        stem, at = words.stems(size)
        out.append(tn.mix(stem + np.uint64(size)))
        owner.append(at)
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


@dataclass
class SparseWeights:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> SparseWeights:
    """One pass over the examples per epoch; the last coordinate is the bias, not penalised."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    penalty = np.full((1 << BITS) + 1, L1)
    penalty[-1] = 0.0

    def weights(at):
        own = z[at]
        w = -(own - np.sign(own) * penalty[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= penalty[at], 0.0, w)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], 1 << BITS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    return SparseWeights(index, w[index], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, folds: int = 4, test_fold: int = 2) -> SparseWeights:
    def run(batches):
        for piece in tn.pieces(batches):
            f, doc = features(piece.column("text"))
            tagged = np.unique((doc << BITS) | f)
            cuts = np.searchsorted(tagged >> BITS, np.arange(len(piece) + 1))
            own = (tagged & ((1 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "label", "features"])

    own = labelled(frugal(docs), labels, "toxic", limit, folds, test_fold)
    got = store.table(own.mapInArrow(run, "doc_id long, label int, features binary"), "features")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of at most ``limit`` rows
    fits = got.withColumn("sofar", F.sum(F.octet_length("features")).over(order)).filter(F.col("sofar") <= MAX_BYTES)
    got = fits.drop("sofar").toArrow()
    order = pa.compute.sort_indices(got, [("doc_id", "ascending"), ("features", "ascending")]).to_numpy()
    rows_of = [np.frombuffer(got["features"][int(i)].as_py(), "<u4").astype(np.int64) for i in order]
    return ftrl(rows_of, got["label"].to_numpy()[order].astype(float))


def classify(docs: DataFrame, model: SparseWeights, threshold: float = 0.3, folds: int = 4, test_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        dense, bias = shared.value.dense(), shared.value.bias
        for piece in tn.pieces(batches):
            f, doc = features(piece.column("text"))
            hit = np.flatnonzero(dense[f])
            tagged = np.unique((doc[hit] << BITS) | f[hit])
            total = np.bincount(tagged >> BITS, dense[tagged & ((1 << BITS) - 1)], minlength=len(piece)) + bias
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    own = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = own.mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out("doc_id", folds, test_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
