"""Vector bin packing of token pieces into fixed-length sequences.

Items have a demand vector (tokens, one segment, loss-bearing tokens); a
sequence has limits on all three.  The heuristic fills one sequence at a time:
of the items that still fit under every limit it takes the one whose demand
has the largest dot product with the remaining capacity, both scaled by the
limits.  Where cutting is allowed, a piece that no longer fits whole is cut to
the room left, so that sequences come out full.

``pack_documents`` tokenises whole documents and packs them inside each
input partition, without a shuffle.  Texts are taken a few megabytes at a
time; only items that the last window left over are carried on.  What remains
at the end of a partition goes into sequences whose lengths are powers of two,
which need no padding.  Sequences that come to the segment limit wait for
longer documents, of which a piece fills them up.

Cases: null text is empty and yields the end token alone; a text longer than
a sequence is cut into full sequences and a rest; documents with one id are
packed row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textnum as tn
from lectern.llm.common import frugal

LENGTH = 2048
END = 1
#: Segments of one sequence.
MAX_SEGMENTS = 64
#: Words that a worker keeps the ids of, by hash; then it starts anew.
CACHE_WORDS = 700_000
#: Sequences of short documents that a partition holds back to be filled up.
MAX_SHORT = 2000


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = LENGTH
    segments: int = MAX_SEGMENTS
    loss: int = LENGTH


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def units(words: tn.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, units of each word): a word, or a word that ends with a
    letter or digit and the one to three marks after it.

    The pre-tokeniser parts letters from marks, so a cut between an ASCII
    letter or digit, or a two-byte Latin letter, and a mark changes no id; but
    the lower case of \u0130 ends in a mark itself.
    """
    data, start, end = words.data, words.start, words.end
    cut = end.copy()
    for _ in range(3):
        cut -= _TAIL[data[cut - 1]] & (cut - start > 1)
    last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
    latin = (before >= 0xC3) & (before <= 0xC9) & (last >= 0x80) & (last < 0xC0) & (cut - start > 1)
    latin &= ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((before == 0xC4) & (last == 0xB0))
    parted = (cut < end) & (_SOLID[last] | latin)
    per = 1 + parted.astype(np.int64)
    at = np.cumsum(per) - per
    starts, ends = np.empty(int(per.sum()), np.int64), np.empty(int(per.sum()), np.int64)
    starts[at], ends[at] = start, np.where(parted, cut, end)
    starts[at[parted] + 1], ends[at[parted] + 1] = cut[parted], end[parted]
    return starts, ends, per


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The vocabulary's pre-tokeniser splits at white space and its normaliser
    lower-cases, so the ids of a text are the concatenated ids of its
    lower-cased words.  Each distinct unit is tokenised once and found again
    by the 64-bit hash of its lower-cased bytes; a slice that may hold a
    special token's string is hashed as written, in a cache of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.caches = {True: _Cache(), False: _Cache()}

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words.  Words of letters alone are one pre-token
        each, whose last id is marked as such, and go many to a call."""
        plain = np.array([w.isalpha() and w.lower().isalpha() and unicodedata.is_normalized("NFC", w) for w in words], bool)
        found: list = [None] * len(words)
        own = np.flatnonzero(plain).tolist()
        chunks = [own[i : i + 64] for i in range(0, len(own), 64)]
        for chunk, got in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            pieces = np.split(ids, cuts[:-1]) if len(cuts) == len(chunk) else [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[i] for i in chunk], add_special_tokens=False)]
            for i, x in zip(chunk, pieces, strict=True):
                found[i] = x
        rest = np.flatnonzero(~plain).tolist()
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(got.ids, np.uint32)
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of a slice of texts, each ended by END."""
        data, offsets = tn.utf8_buffers(column)
        raw = data.tobytes()
        lower = b"<|" not in raw
        words, cache = tn.Words(data, offsets, lower=lower), self.caches[lower]
        n_docs = len(offsets) - 1
        if not len(words.hash):
            return np.full(n_docs, END, np.uint32), np.arange(n_docs + 1)
        start, end, per = units(words)
        keys, index, inverse = np.unique(words.spans(start, end), return_index=True, return_inverse=True)
        if len(cache.keys) > CACHE_WORDS:
            cache = self.caches[lower] = _Cache()
        new = cache.unknown(keys)
        if new.any():
            own = index[new]
            cache.learn(keys[new], *self._ids([raw[a:b].decode() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
        slot = np.searchsorted(cache.keys, keys)[inverse]
        size, at = cache.size[slot], cache.at[slot]
        unit_first = np.concatenate(([0], np.cumsum(per)))[words.first]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        first = total[unit_first] + np.arange(n_docs + 1)
        out = np.full(int(total[-1]) + n_docs, END, np.uint32)
        doc_of = np.repeat(np.arange(n_docs), np.diff(unit_first))
        source = np.arange(int(total[-1])) - np.repeat(total[:-1] - at, size)
        out[np.arange(int(total[-1])) + np.repeat(doc_of, size)] = cache.pool[source]
        return out, first


class _Cache:
    """Hash -> ids, as sorted arrays."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = slot < len(self.keys)
        new[inside] = self.keys[slot[inside]] != keys[inside]
        return new

    def learn(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.pool) + np.cumsum(size) - size
        keys, at, size = np.concatenate((self.keys, keys)), np.concatenate((self.at, at)), np.concatenate((self.size, size))
        order = np.argsort(keys)
        self.keys, self.at, self.size, self.pool = keys[order], at[order], size[order], np.concatenate((self.pool, ids))


#: Of this worker process, by path; tasks of one worker share the cache.
_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(vocabulary: str) -> WordTokenizer:
    import os

    import public_tokenizers

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def choose(demand: np.ndarray, left: np.ndarray, scale: np.ndarray) -> int:
    """Index of the item that fits and agrees best with the room left; -1 if none fits."""
    score = np.where((demand <= left).all(axis=1), (demand / scale) @ (left / scale), -1.0)
    best = int(np.argmax(score))
    return best if score[best] >= 0 else -1


def fill(demand: np.ndarray, limits: Limits, cut: bool = True, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Packs items given as rows (tokens, segments, loss-bearing tokens).

    Returns sequences, each a list of (item, start, length), and the (item,
    start) that stay open.  With ``cut`` an item is cut to the room left (its
    loss-bearing tokens are then taken to be spread evenly); items stay open
    where they could not fill a sequence and ``last`` is false.
    """
    scale = np.array([limits.tokens, limits.segments, limits.loss], float)
    demand = demand.astype(float)
    live = demand[:, 0] > 0
    start = np.zeros(len(demand), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    order = np.flatnonzero(live)
    while len(order):
        if not last and demand[order, 0].sum() < limits.tokens:
            break
        left, inside = scale.copy(), []
        while len(order):
            i = choose(demand[order], left, scale)
            if i >= 0:
                at, take = int(order[i]), int(demand[order[i], 0])
            elif cut and left[0] >= 1 and left[1] >= 1 and left[2] >= 1:
                i = int(np.argmax(demand[order, 0]))
                at = int(order[i])
                share = demand[at, 2] / demand[at, 0]
                take = int(min(left[0], left[2] / share if share else left[0], demand[at, 0]))
            else:
                break
            share = demand[at, 2] / demand[at, 0]
            inside.append((at, int(start[at]), take))
            left -= (take, 1, take * share)
            start[at] += take
            demand[at, 0] -= take
            demand[at, 2] -= take * share
            if demand[at, 0] <= 0:
                order = np.delete(order, i)
            elif left[0] <= 0:
                break
        if not inside:  # an item over a limit by itself, which may not be cut
            raise ValueError("an item exceeds the limits of a sequence")
        out.append(inside)
    return out, [(int(i), int(start[i])) for i in order]


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_DDL = ", ".join(f"{c} long" for c in _OUT)


@dataclass
class _Item:
    """Ids of a document from place ``begin`` on, and how many of them bear loss."""

    doc: int | None
    ids: np.ndarray
    begin: int
    total: int
    loss: float

    def part(self, start: int, length: int) -> _Item:
        return _Item(self.doc, self.ids[start : start + length], self.begin + start, self.total, self.loss * length / max(len(self.ids), 1))


class _Packer:
    """Packs the documents of one partition, window by window."""

    def __init__(self, limits: Limits, base: int):
        self.limits, self.sequence = limits, base
        self.open: list[_Item] = []
        #: Sequences that came to the segment limit before they were full.
        self.short: list[list[_Item]] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[_Item]) -> None:
        offset = 0
        for x in pieces:
            self.rows.append((x.doc, x.begin, len(x.ids), zlib.crc32(x.ids.astype("<u4").tobytes()), x.total, self.sequence, offset))
            offset += len(x.ids)
        self.sequence += 1

    def add(self, docs: list, ids: np.ndarray, first: np.ndarray, loss: list) -> None:
        """Short documents by vector packing; long ones first fill up what the
        segment limit closed, then are full sequences and a rest."""
        size, long = self.limits.tokens, []
        for d, a, b, own in zip(docs, first[:-1].tolist(), first[1:].tolist(), loss, strict=True):
            (long if b - a >= size else self.open).append(_Item(d, ids[a:b], 0, b - a, own))
        self._fill_short()
        self._pack()
        self.open = [_Item(x.doc, x.ids.copy(), x.begin, x.total, x.loss) for x in self.open]
        for x in long:
            while len(x.ids) >= size and x.loss * size / len(x.ids) <= self.limits.loss:
                before = self.short.pop() if self.short else []
                room = size - sum(len(y.ids) for y in before)
                if sum(y.loss for y in before) + x.part(0, room).loss > self.limits.loss:
                    self.short.append(before)
                    break
                self._emit([*before, x.part(0, room)])
                x = x.part(room, len(x.ids) - room)
            if len(x.ids):
                self.open.append(_Item(x.doc, x.ids.copy(), x.begin, x.total, x.loss))

    def _fill_short(self) -> None:
        """Sequences of many short documents are filled up from the longest items."""
        self.open.sort(key=lambda x: -len(x.ids))
        at, kept = 0, []
        for pieces in self.short:
            room = self.limits.tokens - sum(len(x.ids) for x in pieces)
            if at < len(self.open) and len(self.open[at].ids) > room and sum(x.loss for x in pieces) + self.open[at].part(0, room).loss <= self.limits.loss:
                item = self.open[at]
                self._emit([*pieces, item.part(0, room)])
                self.open[at] = item.part(room, len(item.ids) - room)
                at += 1
            else:
                kept.append(pieces)
        self.short = kept

    def _pack(self) -> None:
        items = self.open
        demand = np.array([(len(x.ids), 1, x.loss) for x in items], float).reshape(-1, 3)
        sequences, left = fill(demand, self.limits, last=False)
        self.open = [items[i].part(s, len(items[i].ids) - s) for i, s in left]
        for pieces in sequences:
            own = [items[i].part(s, n) for i, s, n in pieces]
            if sum(len(x.ids) for x in own) == self.limits.tokens:
                self._emit(own)
            elif len(own) == self.limits.segments and len(self.short) < MAX_SHORT:
                self.open.append(own.pop())
                self.short.append(own)
            else:
                self._tail(own)

    def _tail(self, items: list[_Item]) -> None:
        """Sequences of powers of two, without padding."""
        queue = items[::-1]
        for room in _powers(sum(len(x.ids) for x in items)):
            own, left = [], room
            while left:
                x = queue.pop()
                n = min(len(x.ids), left)
                own.append(x.part(0, n))
                if n < len(x.ids):
                    queue.append(x.part(n, len(x.ids) - n))
                left -= n
            self._emit(own)

    def end(self) -> None:
        """What is open holds less than one sequence; segments and loss stay in limits."""
        for own in self.short:
            self._tail(own)
        demand = np.array([(len(x.ids), 1, x.loss) for x in self.open], float).reshape(-1, 3)
        for pieces in fill(demand, self.limits)[0]:
            self._tail([self.open[i].part(s, n) for i, s, n in pieces])
        self.open, self.short = [], []

    def take(self) -> pa.RecordBatch:
        """The rows so far; a null id stays null."""
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(_OUT)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _OUT)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limits: Limits = Limits(), loss: str | None = None) -> DataFrame:  # noqa: B008
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is a file name of the public tokenizers or a path that every
    worker can open.  Sequence ids hold the partition in their upper bits.
    ``loss`` names a column with the share, 0 to 1, of a document's tokens that
    bear loss (those of the answers, in instruction data); null, or without
    the column, it is 1.  The end id bears none.
    """

    def run(batches):
        tokenizer = tokenizer_of(vocabulary)
        packer = _Packer(limits, TaskContext.get().partitionId() << 36)
        for piece in tn.pieces(batches):
            ids, first = tokenizer.encode(piece.column("text"))
            bearing = (np.diff(first) - 1) * piece.column("share").to_numpy()
            packer.add(piece.column("doc_id").to_pylist(), ids, first, bearing.tolist())
            yield packer.take()
        packer.end()
        yield packer.take()

    share = F.lit(1.0) if loss is None else F.least(F.greatest(F.coalesce(F.col(loss).cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), share.alias("share")).mapInArrow(run, _DDL)


def pack_conversations(turns: DataFrame, vocabulary: str = "word_bpe_49k.json", limits: Limits = Limits(loss=LENGTH // 2), answers: str = "assistant") -> DataFrame:  # noqa: B008
    """Conversations (conv_id, turn, role, text) as instruction data: one
    document each, its turns in order, of which those of the role ``answers``
    bear loss, by their share of the characters.  Columns as pack_documents,
    conv_id as doc_id.  Null texts are empty, null roles bear no loss."""
    size = F.sum(F.length(F.coalesce("text", F.lit(""))))
    own = F.sum(F.when(F.col("role") == answers, F.length(F.coalesce("text", F.lit("")))).otherwise(0))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    examples = turns.groupBy("conv_id").agg(said.alias("text"), (own / F.greatest(size, F.lit(1))).alias("share"))
    return pack_documents(examples.select(F.col("conv_id").alias("doc_id"), "text", "share"), vocabulary, limits, "share")
