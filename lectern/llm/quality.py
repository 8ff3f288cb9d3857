"""Quality classifier: a sparse ensemble of rules over text statistics.

``statistics`` measures every whole text.  ``fit`` grows shallow trees on
random subsets of labelled rows, takes every path from a root as a
conjunctive rule, fits the rules' weights by logistic regression with an L1
penalty, and ``RuleModel.score`` compiles what remains into one Spark column
expression over the statistics.

Cases: null or empty text has all statistics 0 and is scored like any other
row; rows with null labels are not learnt from; ids occurring more than once
are scored row by row and learnt from once (see ``labelled``); without labelled rows of both classes the model is the
constant prior 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import textnum as tn
from lectern.llm.common import frugal, held_out, labelled

#: Labelled rows that the fit uses, taken in the order of a hash of the id.
MAX_LABELLED = 20_000
TREES, DEPTH, MIN_LEAF, PENALTY, ITERATIONS, SEED = 40, 3, 20, 0.002, 400, 7

STATS = (
    "log_words", "word_len", "upper", "digit", "symbol", "stop", "bang", "non_ascii", "space",
    "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "line_words", "distinct_lines", "symbol_ends",
)

_CLASS = np.zeros((7, 256), np.float32)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [ord(c) for c in "#$%&*@^~|<>{}[]_=+\\/"]] = 1
_CLASS[3, [ord(c) for c in ".,;:?"]] = 1
_CLASS[4, ord("!")] = 1
_CLASS[5, 128:] = 1
_CLASS[6, [32, 9, 10, 11, 12, 13]] = 1


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]]."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent value) of each document."""
    n = len(first) - 1
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    tagged = np.sort((doc << np.uint64(44)) | (keys >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate(([True], tagged[1:] != tagged[:-1])))
    runs = np.diff(np.append(new, len(tagged)))
    owner = (tagged[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), top


def measure(column: pa.Array) -> np.ndarray:
    """(documents, statistics) of a slice of texts."""
    data, offsets = tn.utf8_buffers(column)
    words = tn.Words(data, offsets)
    n_bytes, n_words = np.diff(offsets), words.counts
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    out = np.zeros((len(n_bytes), len(STATS)))
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = _per_doc((words.end - words.start).astype(float), words.first) / per_word
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) if len(n_bytes) else np.zeros((0, 256))
    out[:, 2:9] = (hist @ _CLASS.T) / per_byte[:, None]
    found, top = _distinct(words.hash, words.first)
    out[:, 9], out[:, 12] = found / per_word, top / per_word
    for at, k in ((10, 2), (11, 5)):
        h, first = tn.shingles(words, k)
        out[:, at] = _distinct(h, first)[0] / np.maximum(np.diff(first), 1)
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate((offsets, ends + 1))) if len(offsets) else ends
    cuts = cuts[cuts <= len(data)]
    lines = np.diff(np.searchsorted(cuts, offsets)) if len(offsets) else np.zeros(0, np.int64)
    out[:, 13] = np.log1p(n_words / np.maximum(lines, 1))
    if len(cuts) > 1 and len(words.hash):
        at_word = np.searchsorted(words.start, cuts)
        total = np.zeros(len(words.hash) + 1, np.uint64)
        place = np.arange(len(words.hash)) - np.repeat(at_word[:-1], np.diff(at_word))[: len(words.hash)]
        np.cumsum(tn.mix(words.hash + place.astype(np.uint64)), out=total[1:])
        value = tn.mix(total[at_word[1:]] - total[at_word[:-1]])
        out[:, 14] = _distinct(value, np.searchsorted(cuts[:-1], offsets))[0] / np.maximum(lines, 1)
    if len(words.hash):
        out[:, 15] = _per_doc(_CLASS[2][data[words.end - 1]], words.first) / per_word
    return out


#: Of statistics beside other columns.
PREFIX = "lectern_stat_"


def statistics(docs: DataFrame, keep: bool = False, text: bool = True) -> DataFrame:
    """doc_id and one double column for each of STATS, one row per document;
    with ``keep`` all columns of docs, less the text if not wanted, and the
    statistics under PREFIX."""
    docs = frugal(docs)
    if not keep:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c for c in docs.columns if text or c != "text"] if keep else ["doc_id"]
    prefix = PREFIX if keep else ""

    def run(batches):
        for piece in tn.pieces(batches):
            got = measure(piece.column("text"))
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], *[pa.array(got[:, i]) for i in range(len(STATS))]], [*names, *[prefix + s for s in STATS]])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(prefix + s, T.DoubleType()) for s in STATS])
    return docs.mapInArrow(run, schema)


@dataclass
class RuleModel:
    """Rules as lists of (statistic, '<=' or '>', threshold), with weights."""

    intercept: float = 0.0
    rules: list[tuple[list[tuple[str, str, float]], float]] = field(default_factory=list)

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1, in the JVM."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            hit = None
            for name, sign, value in rule:
                test = F.col(prefix + name) <= float(value) if sign == "<=" else F.col(prefix + name) > float(value)
                hit = test if hit is None else hit & test
            total = total + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple) -> list[tuple]:
    """Every path below a node: the split with the least Gini impurity among
    quantile thresholds of the given columns, then both sides."""
    own = y[rows]
    if depth == 0 or len(rows) < 2 * MIN_LEAF or own.min() == own.max():
        return []
    best = None
    for c in columns:
        values = x[rows, c]
        for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, 25))):
            left = values <= cut
            a = int(left.sum())
            if MIN_LEAF <= a <= len(rows) - MIN_LEAF:
                p, q = own[left].mean(), own[~left].mean()
                impurity = a * p * (1 - p) + (len(rows) - a) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, c, cut, left)
    if best is None:
        return []
    _, c, cut, left = best
    out = []
    for sign, side in (("<=", left), (">", ~left)):
        longer = (*path, (int(c), sign, float(cut)))
        out += [longer, *_paths(x, y, rows[side], columns, depth - 1, longer)]
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> RuleModel:
    """Trees on bootstrap rows and random columns; weights by accelerated
    proximal gradient on the L1-penalised logistic loss."""
    if not len(y) or y.min() == y.max():
        return RuleModel()
    rng = np.random.default_rng(seed)
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), 2000), replace=True)
        columns = rng.choice(len(STATS), len(STATS) // 2, replace=False)
        found.update(dict.fromkeys(tuple(sorted(set(p))) for p in _paths(x, y, rows, columns, DEPTH, ())))
    rules, hits = [], []
    for rule in found:
        hit = np.ones(len(y), bool)
        for c, sign, cut in rule:
            hit &= (x[:, c] <= cut) if sign == "<=" else (x[:, c] > cut)
        if 0 < hit.sum() < len(y):
            rules.append(rule)
            hits.append(hit)
    if not rules:
        return RuleModel(intercept=float(np.log(y.mean() / (1 - y.mean()))))
    m = np.stack(hits, axis=1).astype(np.float32)
    w = z = np.zeros(m.shape[1], np.float32)
    b = zb = float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(m.shape[1], np.float32) / np.sqrt(m.shape[1])
    for _ in range(20):
        v = m.T @ (m @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    rate, t = 4.0 * len(y) / (norm + len(y)), 1.0
    for _ in range(ITERATIONS):
        error = 1 / (1 + np.exp(-(m @ z + zb))) - y
        w_new = z - rate * (m.T @ error) / len(y)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * PENALTY, 0)
        b_new = zb - rate * float(error.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new.astype(np.float32), b_new, t_new
    kept = [([(STATS[c], sign, cut) for c, sign, cut in rules[i]], float(w[i])) for i in np.flatnonzero(w)]
    return RuleModel(b, kept)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, folds: int = 4, test_fold: int = 2) -> RuleModel:
    """Learns from at most ``limit`` labelled rows outside the test fold."""
    own = labelled(docs, labels, "quality", limit, folds, test_fold)
    got = statistics(own.select("doc_id", "label", "text"), keep=True, text=False)
    pdf = got.orderBy("doc_id").toPandas()
    return fit_rules(pdf[[PREFIX + s for s in STATS]].to_numpy(float), pdf["label"].to_numpy(float))


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.7, folds: int = 4, test_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; then the statistics."""
    got = statistics(docs).withColumn("score", model.score())
    return got.select("doc_id", held_out("doc_id", folds, test_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATS)


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """The documents, with their columns, whose score reaches the threshold."""
    return statistics(docs, keep=True).filter(model.score(PREFIX) >= threshold).select(*docs.columns)
