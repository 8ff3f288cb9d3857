"""Nearest neighbours by cosine with a hash-prefix forest.

Rows are dealt to shards of bounded size.  In a shard every tree is a sorted
array of 64-bit strings of random-hyperplane signs.  A query descends in each
tree to its longest matching prefix; then all trees ascend together, one bit
at a time, until their ranges hold CANDIDATE_SHARE of the shard (LEAST rows at
least).  Those candidates are compared exactly, in double precision, and the
best of all shards are merged.

Every row is indexed.  The share is what recall of 0.9 needs on vectors
without any structure; on clustered vectors the same share finds more.

Cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors are scaled by a
power of two before anything is squared, so that none over- or underflows;
only vectors of one length are compared; equal scores go to the smaller id;
rows with one id are candidates each, but never of their own id; as queries
they are one if they are equal, else each has its own ranks; with fewer
candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import parts

TREES, BITS, SHARD_ROWS = 16, 64, 16_384
CANDIDATE_SHARE, LEAST = 0.45, 1024
U64 = np.uint64


def hyperplanes(dim: int) -> np.ndarray:
    """(dim, TREES * BITS), orthogonal in groups of dim."""
    rng = np.random.default_rng(dim)
    groups = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-TREES * BITS // dim))]
    return np.concatenate(groups, axis=1)[:, : TREES * BITS].astype(np.float32)


def strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings, first sign in the highest bit."""
    signs = (unit @ planes > 0).reshape(len(unit), TREES, BITS)
    return np.packbits(signs, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is in
    [0.5, 1); cosines stay as they are, to the last bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, scaled(vectors)
        vectors = self.vectors
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        self.planes = hyperplanes(vectors.shape[1])
        codes = strings(self.unit, self.planes)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each tree holds the strings with the query's first ``depth`` bits."""
        rest = U64((1 << (BITS - depth)) - 1) if depth else U64(0xFFFFFFFFFFFFFFFF)
        lo, hi = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(TREES):
            lo[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] & ~rest, side="left")
            hi[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] | rest, side="right")
        return lo, hi

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
        """(query, its place in the block, vector, cosine) of the k best candidates of each query."""
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        unit = (queries / norms[:, None]).astype(np.float32)
        codes = strings(unit, self.planes)
        enough = min(len(self.ids), max(LEAST, int(CANDIDATE_SHARE * len(self.ids))))
        levels = [self.ranges(codes, depth) for depth in range(BITS // 2 + 1)]
        totals = np.stack([(hi - lo).sum(axis=1) for lo, hi in levels])
        out = []
        for q in range(len(queries)):
            depth = int(np.flatnonzero(totals[:, q] >= enough)[-1])
            inside = np.zeros(len(self.ids), bool)
            while True:
                lo, hi = levels[depth][0][q], levels[depth][1][q]
                for t in range(TREES):
                    inside[self.order[lo[t] : hi[t], t]] = True
                if depth == 0 or int(inside.sum()) >= enough:
                    break
                depth -= 1
            at = np.flatnonzero(inside & (self.ids != query_ids[q]))
            if len(at) > k:
                rough = self.unit[at] @ unit[q]
                at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-5]
            score = (self.vectors[at] * queries[q]).sum(axis=1) / (self.norm[at] * norms[q])
            best = np.lexsort((self.ids[at], -score))[:k]
            out += [(int(query_ids[q]), q, int(self.ids[at[b]]), float(score[b])) for b in best]
        return out


def _valid(batches):
    for batch in batches:
        column = batch.column("embedding")
        values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        rows = [(i, a, b) for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)) if b > a and np.isfinite(values[a:b]).all() and values[a:b].any()]
        take = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), pa.array([r[2] - r[1] for r in rows], pa.int32()), pa.array([values[a:b].tobytes() for _, a, b in rows], pa.binary())], ["vec_id", "dim", "vector"])


def _search(k: int):
    def flush(forest, rows):
        if forest is not None and rows:
            found = forest.search(np.array([r[0] for r in rows], np.int64), np.stack([np.frombuffer(r[1]) for r in rows]), k)
            marks = [xxhash.xxh3_64_intdigest(r[1]) - (1 << 63) for r in rows]
            columns = [[f[0] for f in found], [marks[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "mark", "vec_id", "score"])

    def run(batches):
        key, members, queries, forest = None, [], [], None
        for batch in batches:
            for shard, dim, kind, vec_id, vector in zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "kind", "vec_id", "vector")), strict=True):
                if (shard, dim) != key:
                    yield from flush(forest, queries)
                    key, members, queries, forest = (shard, dim), [], [], None
                if kind == 0:
                    members.append((vec_id, vector))
                    continue
                if forest is None and members:
                    forest = Forest(np.array([m[0] for m in members], np.int64), np.stack([np.frombuffer(m[1]) for m in members]))
                    members = []
                queries.append((vec_id, vector))
                if len(queries) == 256:
                    yield from flush(forest, queries)
                    queries = []
        yield from flush(forest, queries)

    return run


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row whose
    vec_id is divisible by ``every``.  The queries go to every shard, in blocks."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = own.filter("vec_id is not null and embedding is not null").mapInArrow(_valid, "vec_id long, dim int, vector binary")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    members = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    members = members.withColumn("kind", F.lit(0))
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    both = members.unionByName(queries).repartition(max(parts(vectors), shards), "shard", "dim").sortWithinPartitions("shard", "dim", "kind", "vec_id")
    found = both.select("shard", "dim", "kind", "vec_id", "vector").mapInArrow(_search(k), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
