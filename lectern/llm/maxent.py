"""Language-model scores by a hashed maximum-entropy model.

Counting.  Every text becomes its words.  Slices of texts deal their distinct
words to buckets, where exact counts over the training documents are summed;
each entry's count comes back to its slice, which sums log10(c + 0.1).  A word
that several documents of a slice hold is sent once, with its sum.

Model.  Every word, however rare, is a cell of a hash space that is sized from
the number of distinct words.  Cells belong to classes of at most MEMBERS
cells, by what precedes them (a random projection of their left neighbours,
clustered) and by frequency.  The probability of a word is

    P(class | u, g) * P(cell | class, u, g) * share of the word in its cell

with u the class of the word before (bigram), g the group of the last frequent
word however far back (skip).  Both softmaxes sum features: the class or cell
alone, with g, and with u.  A word's share is (c + 0.1) over that sum of its
cell and one unseen word more, so the probabilities of all words and the end
sum to one.

Training.  The softmax of a class depends on its own cells' features alone, so
the counts of each class meet in a partition of its own, which takes the
gradient steps there; one more partition fits the classes themselves.  Counts
travel sparse; what comes to the driver is of the size of the hash space, at
most 2**16 cells, and so is the broadcast model.  Texts are scored a slice at
a time in numpy.

Cases: null text is empty and consists of the end alone; a row without an id
is neither learnt from nor held out; identical rows get identical scores;
without training documents every count is 0 and the model is uniform over its
classes and cells; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import deal, store
from lectern.llm import textnum as tn
from lectern.llm.common import held_out, parts

#: Bits of the hash space, from the number of distinct words.
LEAST_BITS, MOST_BITS = 8, 16
#: Cells of a class, clusters of cells, groups of frequent words, dimensions of the projection.
MEMBERS, CLUSTERS, GROUPS, DIMS = 1024, 24, 24, 12
#: A cell with this share of the tokens marks a group.
FREQUENT = 1 / 4000
#: A word that so many documents of a slice hold is counted before it is sent.
COMMON = 3
#: (document, word) entries that a task gathers before it deals them out.
SLICE_ENTRIES = 1_500_000
STEPS = 80
#: Penalties of weights with a group and with the class before.
PRIOR_G, PRIOR_U = 0.5, 3.0
U64 = np.uint64


def learns(ids: list, folds: int, test_fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds != test_fold for i in ids], bool)


_DDL = (
    "slice long, bucket int, kind int, ids binary, nulls binary, texts binary, words binary, words_more binary, train binary, counts binary, counts_more binary, "
    "tf binary, tf_more binary, keys binary, sums binary, sums_more binary, places binary, places_more binary, order binary"
)
_TYPES = deal.types(_DDL)


def _pair(name: str, values: np.ndarray) -> dict:
    one, more = deal.to_bytes(values)
    return {name: one, f"{name}_more": more}


def _read(row: dict, name: str) -> np.ndarray:
    return deal.from_bytes(row[name], row[f"{name}_more"])


def _deal(buckets: int, folds: int, test_fold: int):
    """Words of slices by bucket.  Of those that COMMON documents hold the
    header has who holds them, as ranks by falling frequency."""

    def measure(piece):
        words = tn.words_of(piece.column("text"))
        keys, inverse = np.unique(words.hash, return_inverse=True)
        codes, tf = np.unique(words.docs() * max(len(keys), 1) + inverse, return_counts=True)
        ids = piece.column("doc_id")
        return keys[codes % max(len(keys), 1)], codes // max(len(keys), 1), tf, words.counts, ids.fill_null(0).to_numpy().astype("<i8"), np.asarray(ids.is_null()), piece.column("text_key").to_numpy().astype("<i8"), learns(ids.to_pylist(), folds, test_fold)

    def pack(slice_id, held):
        base = np.cumsum([0, *[len(h[3]) for h in held]])
        keys, tf, n_words, ids, nulls, texts, train = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4, 5, 6, 7))
        doc, n = np.concatenate([h[1] + b for h, b in zip(held, base, strict=False)]), len(ids)
        own, inverse, holders = np.unique(keys, return_inverse=True, return_counts=True)
        common = np.flatnonzero(holders >= COMMON)
        by = np.argsort(-holders[common], kind="stable")
        rank = np.zeros(len(own), np.int64)
        rank[common[by]] = np.arange(len(common))
        hot = holders[inverse] >= COMMON
        places = rank[inverse[hot]]
        sums = np.bincount(inverse, tf * train[doc], minlength=len(own)).astype(np.int64)[common]
        bits = np.packbits(train).tobytes()
        yield deal.row(
            _TYPES, slice=slice_id, bucket=slice_id % buckets, kind=1, ids=ids.tobytes(), nulls=np.packbits(nulls).tobytes(), texts=texts.tobytes(), **_pair("words", n_words), **_pair("counts", np.bincount(doc[hot], minlength=n)),
            **_pair("tf", tf[hot]), places=np.minimum(places, 65535).astype("<u2").tobytes(), places_more=places[places >= 65535].astype("<u4").tobytes(), order=by.astype("<u4").tobytes(),
        )
        at = np.flatnonzero(~hot)
        to = _bucket(keys[at], buckets)
        at = at[np.argsort(to, kind="stable")]
        edges = np.arange(buckets + 1)
        cuts, common_cuts = np.searchsorted(np.sort(to), edges), np.searchsorted(_bucket(own[common], buckets), edges)
        for b in np.flatnonzero(np.diff(cuts) + np.diff(common_cuts)).tolist():
            x, c = at[cuts[b] : cuts[b + 1]], slice(common_cuts[b], common_cuts[b + 1])
            yield deal.row(_TYPES, slice=slice_id, bucket=b, kind=0, train=bits, **_pair("counts", np.bincount(doc[x], minlength=n)), **_pair("tf", tf[x]), keys=np.concatenate((keys[x], own[common[c]])).tobytes(), **_pair("sums", sums[c]))

    return lambda batches: deal.slices(batches, SLICE_ENTRIES, measure, pack)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so that a cell is in one bucket."""
    return ((keys >> U64(48)) * U64(buckets) >> U64(16)).astype(np.int64)


def _count(batches):
    """Counts of a bucket's words, back to the slices in the order they came;
    kind 2: tokens and distinct words of its cells."""
    headers: list = []
    inner = deal.inner_rows(batches, headers)
    for r in headers:
        yield deal.row(_TYPES, **r)
    if not inner:
        return
    keys, weights, sizes = [], [], []
    for r in inner:
        per, tf = _read(r, "counts"), _read(r, "tf")
        train = np.unpackbits(np.frombuffer(r["train"], np.uint8))[: len(per)]
        keys.append(np.frombuffer(r["keys"], "<u8"))
        weights.append(np.concatenate((tf * train[deal.owner(per)], _read(r, "sums"))))
        sizes.append(len(tf))
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(inverse, np.concatenate(weights), minlength=len(own)).astype(np.int64)
    at = 0
    for r, k, n in zip(inner, keys, sizes, strict=True):
        mine = c[inverse[at : at + len(k)]]
        at += len(k)
        yield deal.row(_TYPES, slice=r["slice"], bucket=r["bucket"], kind=0, counts=r["counts"], counts_more=r["counts_more"], tf=r["tf"], tf_more=r["tf_more"], **_pair("words", mine[:n]), **_pair("sums", mine[n:]))
    seen = c > 0
    cell = (own[seen] >> U64(48)).astype(np.int64)
    first, types = deal.runs(cell)
    if len(first):
        yield deal.row(_TYPES, slice=-1 - inner[0]["bucket"], bucket=0, kind=2, keys=cell[first].astype("<i8").tobytes(), sums=np.add.reduceat(c[seen], first).astype("<i8").tobytes(), counts=types.astype("<i8").tobytes())


_BASE = "doc_id long, text_key long, n_words long, known long, raw double, cells binary, tokens binary, types binary"
_BASE_TYPES = deal.types(_BASE)


def _sum(batches):
    """Per document: words, known words, sum of log10(c + 0.1)."""
    for _, rows in deal.groups(batches, "slice"):
        if rows[0]["kind"] == 2:
            for r in rows:
                yield deal.row(_BASE_TYPES, cells=r["keys"], tokens=r["sums"], types=r["counts"])
            continue
        head = next(r for r in rows if r["kind"] == 1)
        inner = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["bucket"])
        ids, texts = (np.frombuffer(head[k], "<i8") for k in ("ids", "texts"))
        n = len(ids)
        raw, known = np.zeros(n), np.zeros(n)

        def add(doc, tf, c, raw=raw, known=known, n=n):
            raw += np.bincount(doc, tf * np.log10(c + 0.1), minlength=n)
            known += np.bincount(doc, tf * (c > 0), minlength=n)

        for r in inner:
            add(deal.owner(_read(r, "counts")), _read(r, "tf"), _read(r, "words"))
        places = np.frombuffer(head["places"], "<u2").astype(np.int64)
        places[places == 65535] = np.frombuffer(head["places_more"], "<u4")
        if len(places):
            c = np.concatenate([_read(r, "sums") for r in inner])[np.frombuffer(head["order"], "<u4")]
            add(deal.owner(_read(head, "counts")), _read(head, "tf"), c[places])
        none = [None] * n
        nulls = np.unpackbits(np.frombuffer(head["nulls"], np.uint8))[:n].astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(texts), pa.array(_read(head, "words")), pa.array(known.astype(np.int64)), pa.array(raw), *[pa.array(none, pa.binary())] * 3], list(_BASE_TYPES))


def tokens(words: tn.Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each token, the end being 2**bits; place of the token before,
    -1 at a start; document)."""
    n_docs = len(words.first) - 1
    doc = np.repeat(np.arange(n_docs), words.counts + 1)
    y = np.full(len(doc), 1 << bits, np.int64)
    if len(words.hash):
        y[np.arange(len(words.hash)) + words.docs()] = (words.hash >> U64(64 - bits)).astype(np.int64)
    before = np.arange(len(doc)) - 1
    before[words.first[:-1] + np.arange(n_docs)] = -1
    return y, before, doc


def projection(bits: int) -> np.ndarray:
    """Whole numbers for each cell as a left neighbour; sums of them are exact."""
    return np.random.default_rng(bits).integers(-64, 65, ((1 << bits) + 1, DIMS))


def _neighbours(bits: int, folds: int, test_fold: int, ranges: int):
    """Sums of the projections of the cells before each cell, by ranges of cells."""

    def run(batches):
        vectors, size = projection(bits), (1 << bits) + 1
        total = np.zeros((size, DIMS), np.int64)
        for piece in tn.pieces(batches):
            y, before, doc = tokens(tn.words_of(piece.column("text")), bits)
            at = np.flatnonzero((before >= 0) & learns(piece.column("doc_id").to_pylist(), folds, test_fold)[doc])
            for d in range(DIMS):
                total[:, d] += np.bincount(y[at], vectors[y[before[at]], d], minlength=size).astype(np.int64)
        for b, x in enumerate(np.array_split(total, ranges)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.astype("<i4").tobytes()])], ["bucket", "sums"])

    return run


def _added(batches):
    total = None
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["sums"], "<i4" if total is None or len(r["sums"]) * 2 == total.nbytes else "<i8").astype(np.int64)
            total, bucket = x if total is None else total + x, r["bucket"]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([total.astype("<i8").tobytes()])], ["bucket", "sums"])


def _means(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Cluster of each row: weighted k-means from far apart beginnings."""
    if len(x) <= k:
        return np.arange(len(x))
    rng = np.random.default_rng(3)
    centre = [x[int(np.argmax(weight))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0) * weight
        centre.append(x[int(rng.choice(len(x), p=far / far.sum()))] if far.sum() > 0 else x[0])
    c = np.stack(centre)
    for _ in range(rounds):
        own = np.argmin((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), axis=1)
        for g in range(k):
            if weight[own == g].sum() > 0:
                c[g] = np.average(x[own == g], axis=0, weights=weight[own == g])
    return own


class Cells:
    """Order of the cells by class, the classes' edges in it, groups."""

    def __init__(self, bits: int, count: np.ndarray, sums: np.ndarray):
        """count and sums of the projections of the cells and, last, the end."""
        self.bits, n = bits, 1 << bits
        every = sums.sum(axis=0) / max(count.sum(), 1)
        x = ((sums + 8 * every) / (count[:, None] + 8) - every)[:n]
        cluster = _means(x, np.minimum(count[:n], 1000) + 1e-3, CLUSTERS)
        order = np.lexsort((np.arange(n), -count[:n], cluster))
        edges = [0]
        for c in np.unique(cluster):
            size = int((cluster == c).sum())
            pieces = -(-size // MEMBERS)
            edges += [edges[-1] + size * (i + 1) // pieces for i in range(pieces)]
        self.edges = np.array([*edges, n + 1])
        self.place = np.empty(n + 1, np.int64)
        self.place[order], self.place[n] = np.arange(n), n
        self.classes = len(self.edges) - 1
        self.of = deal.owner(np.diff(self.edges))[self.place]  # class of each cell
        frequent = np.flatnonzero(count[:n] >= max(2, FREQUENT * count.sum()))
        self.group = np.zeros(n + 1, np.int64)
        if len(frequent):
            self.group[frequent] = _means(x[frequent], count[frequent].astype(float), GROUPS) + 1

    def contexts(self, words: tn.Words) -> tuple[np.ndarray, ...]:
        """(cell, its place, its class, class before, group of the last frequent cell, document)."""
        y, before, doc = tokens(words, self.bits)
        u = np.where(before >= 0, self.of[y[before]], self.classes)
        mark = np.where(self.group[y] > 0, np.arange(len(y)), -1)
        last = np.append(-1, np.maximum.accumulate(mark)[:-1]) if len(y) else mark
        start = np.concatenate(([0], np.cumsum(words.counts + 1)))[:-1]
        g = np.where(last >= start[doc], self.group[y[last]], 0)
        return y, self.place[y], self.of[y], u, g, doc


def _sparse(x: np.ndarray) -> dict:
    flat = x.ravel()
    at = np.flatnonzero(flat)
    return {**_pair("places", np.diff(at, prepend=0)), **_pair("counts", flat[at])}


_STATS = "bucket int, places binary, places_more binary, counts binary, counts_more binary"
_STATS_TYPES = deal.types(_STATS)


def _statistics(shared, folds: int, test_fold: int):
    """Counts of a task's tokens, by class: of its cells with the groups, of
    its cells with the classes before, of itself with both; last, of all classes."""

    def run(batches):
        cells: Cells = shared.value
        k, n = cells.classes, len(cells.place)
        by_g, by_u, by_c = np.zeros((GROUPS + 1) * n, np.int64), np.zeros((k + 1) * n, np.int64), np.zeros((k + 1) * (GROUPS + 1) * k, np.int64)
        for piece in tn.pieces(batches):
            _, place, c, u, g, doc = cells.contexts(tn.words_of(piece.column("text")))
            at = np.flatnonzero(learns(piece.column("doc_id").to_pylist(), folds, test_fold)[doc])
            place, c, u, g = place[at], c[at], u[at], g[at]
            for total, code in ((by_g, g * n + place), (by_u, u * n + place), (by_c, (u * (GROUPS + 1) + g) * k + c)):
                values, counts = np.unique(code, return_counts=True)
                total[values] += counts
        by_g, by_u, by_c = by_g.reshape(-1, n), by_u.reshape(-1, n), by_c.reshape(k + 1, GROUPS + 1, k)
        for c, (a, b) in enumerate(zip(cells.edges[:-1].tolist(), cells.edges[1:].tolist(), strict=True)):
            x = np.concatenate((by_g[:, a:b].ravel(), by_u[:, a:b].ravel(), by_c[:, :, c].ravel()))
            if x.any():
                yield deal.row(_STATS_TYPES, bucket=c, **_sparse(x))
        if by_c.any():
            yield deal.row(_STATS_TYPES, bucket=k, **_sparse(np.concatenate((by_c.sum(axis=0).ravel(), by_c.sum(axis=1).ravel(), by_c.sum(axis=2).ravel()))))

    return run


def fit(by_g: np.ndarray, by_u: np.ndarray, both: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (groups, members), (classes before, members) of a softmax over
    members whose score is their sum.  ``both`` counts the contexts (classes
    before, groups).  Gradients of the penalised likelihood over its curvature,
    damped; the first weights hold what a member has alone."""
    a = np.zeros(by_g.shape) + np.log(by_g.sum(axis=0) + 0.1)
    first, b = a[0].copy(), np.zeros(by_u.shape)
    for _ in range(steps):
        ea, eb = np.exp(a), np.exp(b)
        scale = both / (eb @ ea.T)
        want_g, want_u = ea * (scale.T @ eb), eb * (scale @ ea)
        a += np.clip(0.5 * (by_g - want_g - PRIOR_G * (a - first)) / (want_g + PRIOR_G), -1, 1)
        b += np.clip(0.5 * (by_u - want_u - PRIOR_U * b) / (want_u + PRIOR_U), -1, 1)
    return a, b


def _train(shared):
    """Sums the statistics of a class and fits it."""

    def run(batches):
        cells: Cells = shared.value
        k = cells.classes
        total, bucket = None, None
        for batch in batches:
            for r in batch.to_pylist():
                bucket = r["bucket"]
                m = k if bucket == k else int(cells.edges[bucket + 1] - cells.edges[bucket])
                if total is None:
                    total = np.zeros((GROUPS + 1) * m + (k + 1) * m + (k + 1) * (GROUPS + 1))
                total[np.cumsum(_read(r, "places"))] += _read(r, "counts")
        if total is not None:
            cut = (GROUPS + 1) * m, (GROUPS + 1) * m + (k + 1) * m
            a, b = fit(total[: cut[0]].reshape(-1, m), total[cut[0] : cut[1]].reshape(-1, m), total[cut[1] :].reshape(k + 1, -1))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([a.astype("<f4").tobytes()]), pa.array([b.astype("<f4").tobytes()])], ["bucket", "a", "b"])

    return run


class Model:
    """Natural logs: scores of cells with groups and with classes before, and
    by context (class before, group, class) what turns them to probabilities."""

    def __init__(self, cells: Cells, found: dict[int, tuple[bytes, bytes]]):
        k, n = cells.classes, len(cells.place)
        self.a, self.b = np.zeros((GROUPS + 1, n), np.float32), np.zeros((k + 1, n), np.float32)
        top_a, top_b = np.zeros((GROUPS + 1, k)), np.zeros((k + 1, k))
        for c, (a, b) in found.items():
            x, y = np.frombuffer(a, "<f4").reshape(GROUPS + 1, -1), np.frombuffer(b, "<f4").reshape(k + 1, -1)
            if c == k:
                top_a, top_b = x.astype(float), y.astype(float)
            else:
                self.a[:, cells.edges[c] : cells.edges[c + 1]], self.b[:, cells.edges[c] : cells.edges[c + 1]] = x, y
        top = top_b[:, None, :] + top_a[None, :, :]
        low = np.empty((k + 1, GROUPS + 1, k))
        for c in range(k):
            x = slice(cells.edges[c], cells.edges[c + 1])
            low[:, :, c] = np.log(np.exp(self.b[:, x].astype(float)) @ np.exp(self.a[:, x].astype(float)).T)
        self.context = (top - np.log(np.exp(top).sum(axis=2, keepdims=True)) - low).astype(np.float32)

    def log(self, place: np.ndarray, c: np.ndarray, u: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.context[u, g, c] + self.a[g, place] + self.b[u, place]


def score_documents(docs: DataFrame, folds: int = 10, test_fold: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    n, spark = parts(docs), docs.sparkSession
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    back = deal.by_bucket(own.mapInArrow(_deal(n, folds, test_fold), _DDL), n).mapInArrow(_count, _DDL)
    base = store.table(deal.by_slice(back, n).mapInArrow(_sum, _BASE), "base")

    tokens_of, types_of = np.zeros(1 << MOST_BITS, np.int64), np.zeros(1 << MOST_BITS, np.int64)
    for r in base.filter("cells is not null").select("cells", "tokens", "types").collect():  # at most 2**16 cells, each in one row
        at = np.frombuffer(r["cells"], "<i8")
        tokens_of[at], types_of[at] = np.frombuffer(r["tokens"], "<i8"), np.frombuffer(r["types"], "<i8")
    base = base.filter("cells is null")
    train_docs = base.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, test_fold)).count()
    total, types = int(tokens_of.sum()) + train_docs, int(types_of.sum()) + (1 if train_docs else 0)
    bits = int(np.clip(int(np.ceil(np.log2(max(types, 2)))) - 3, LEAST_BITS, MOST_BITS))
    count, kinds = (x.reshape(1 << bits, -1).sum(axis=1) for x in (tokens_of, types_of))

    ranges = min(n, 32)
    near = deal.by_bucket(own.select("doc_id", "text").mapInArrow(_neighbours(bits, folds, test_fold, ranges), "bucket int, sums binary"), ranges)
    sums = [np.zeros((len(x), DIMS), np.int64) for x in np.array_split(np.arange((1 << bits) + 1), ranges)]
    for r in near.mapInArrow(_added, "bucket int, sums binary").collect():  # of the size of the hash space
        sums[r["bucket"]] = np.frombuffer(r["sums"], "<i8").reshape(-1, DIMS)
    cells = Cells(bits, np.append(count, train_docs), np.concatenate(sums))

    shared_cells = spark.sparkContext.broadcast(cells)
    stats = deal.by_bucket(own.select("doc_id", "text").mapInArrow(_statistics(shared_cells, folds, test_fold), _STATS), cells.classes + 1)
    found = {r["bucket"]: (r["a"], r["b"]) for r in stats.mapInArrow(_train(shared_cells), "bucket int, a binary, b binary").toLocalIterator()}
    minus = np.append(np.log10(count + 0.1 * kinds + 0.1), 0.0)
    shared = spark.sparkContext.broadcast((cells, Model(cells, found), minus))

    def run(batches):
        own_cells, model, below = shared.value
        for piece in tn.pieces(batches):
            y, place, c, u, g, doc = own_cells.contexts(tn.words_of(piece.column("text")))
            got = np.bincount(doc, model.log(place, c, u, g) / np.log(10) - below[y], minlength=len(piece))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(got)], ["doc_id", "text_key", "model"])

    scored = own.mapInArrow(run, "doc_id long, text_key long, model double")
    once = base.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n_words", "known", "raw")
    both = scored.join(once, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    end, below = float(np.log10(train_docs + 0.1)), float(np.log10(total + 0.1 * (types + 1)))
    n_tokens = F.col("n_words") + 1
    return both.select(
        "doc_id", held_out("doc_id", folds, test_fold).alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("known") + (1 if train_docs else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("raw") + end - n_tokens * below).alias("base_score"), (F.col("model") + F.col("raw")).alias("score"),
    )
