"""Dealing packed arrays to buckets of hashes and back to their slices.

A task gathers slices of its texts (``slices``), sends one row of packed
numbers to each bucket and a header that comes back to the slice.  Bucket b is
partition b, so no partition is empty while another holds two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textnum as tn

U64 = np.uint64
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def types(ddl: str) -> dict[str, pa.DataType]:
    return {c.split()[0]: _ARROW[c.split()[1]] for c in ddl.split(", ")}


def row(kinds: dict[str, pa.DataType], **values) -> pa.RecordBatch:
    """A batch of one row; missing values are null."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], t) for c, t in kinds.items()], list(kinds))


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionById(n, F.col("bucket"))


def by_slice(df: DataFrame, n: int) -> DataFrame:
    """Slices of consecutive tasks in consecutive partitions, in order inside."""
    to = F.pmod(F.shiftright("slice", 32) + F.col("slice").bitwiseAND(0xFFFFFFFF) * 61, F.lit(n)).cast("int")
    return df.repartitionById(n, to).sortWithinPartitions("slice")


def slices(batches, limit: int, measure, pack):
    """pack(slice id, measured pieces) of pieces whose measure(piece)[0] have
    ``limit`` items together, or what is left of the task."""
    base, n_slice, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for piece in tn.pieces(batches):
        held.append(measure(piece))
        size += len(held[-1][0])
        if size >= limit:
            yield from pack(base + n_slice, held)
            n_slice, held, size = n_slice + 1, [], 0
    if held:
        yield from pack(base + n_slice, held)


def inner_rows(batches, headers: list) -> list[dict]:
    """Rows of kind 0 of a bucket; those of kind 1 go to ``headers``."""
    inner: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            (headers if r["kind"] == 1 else inner).append(r)
    return inner


def groups(batches, *names):
    """(key, rows) of rows that arrive sorted by the named columns."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            own = tuple(r[n] for n in names)
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(r)
    if rows:
        yield key, rows


def owner(counts) -> np.ndarray:
    """0, 0, …, 1, …: counts[i] times i."""
    return np.repeat(np.arange(len(counts)), counts)


def runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of equal values."""
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(ranked)))


def to_bytes(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as single bytes, those of 255 and more once again as four."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u4").tobytes()


def from_bytes(one: bytes, more: bytes) -> np.ndarray:
    out = np.frombuffer(one, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(more, "<u4")
    return out


def to_five(keys: np.ndarray) -> tuple[bytes, bytes]:
    """The low 40 bits as four bytes and one."""
    return (keys & U64(0xFFFFFFFF)).astype("<u4").tobytes(), ((keys >> U64(32)) & U64(0xFF)).astype(np.uint8).tobytes()


def from_five(low: bytes, high: bytes) -> np.ndarray:
    return (np.frombuffer(high, np.uint8).astype(np.uint64) << U64(32)) | np.frombuffer(low, "<u4").astype(np.uint64)
