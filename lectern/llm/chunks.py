"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of every whole text; where its chosen bits
are zero, and no such place lies within the LEAST bytes before, a chunk ends.
The place depends on a few bytes of content only, so insertions shift nothing
but their surroundings.  A long stretch without such a place is cut where its
most frequent hash recurs.  Digests of two adjoining chunks are dealt to
buckets; a bucket names for each digest the least document that holds it.  In
every other document runs of such chunks of RUN_WORDS words or RUN_BYTES bytes
are repeats.  The chunks that hold the two ends of a passage do not match, so
the passage is some words longer than the run and its ends stay.

``repeats`` returns the spans, ``deduplicate`` the documents without them.
The first holder keeps its text; repeats inside one document stay.

Cases: null and empty texts have no chunks and stay as they are; a short text
without boundary is one chunk and cannot repeat in part; rows with one id are
one document, so they do not repeat each other, and each row's own spans are
cut from it; a row without an id can repeat others and is cut, but is the
holder only of what no row with an id has; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import deal, store
from lectern.llm import textnum as tn
from lectern.llm.common import parts, small

#: Bits of the gear hash that are zero at a boundary, on average one in 8.
MASK_BITS, WINDOW = 3, 16
LEAST = 8
#: Words, or bytes where there are few spaces, of a run that is a repeat: a
#: passage of over 50 words less a chunk at either end.
RUN_WORDS, RUN_BYTES = 40, 600
#: Pairs of chunks that a task gathers before it deals them out.
SLICE_PAIRS = 1_500_000
#: Chunks longer than LONGEST are cut at recurring places, STRIDE apart.
LONGEST, STRIDE = 112, 24
NO_ID = (1 << 63) - 1
U64 = np.uint64
_GEAR = (tn.mix(np.arange(1000, 1256, dtype=np.uint64)) & U64(0xFFFFFFFF)).astype(np.uint32)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, first): chunk ends in the buffer and each document's range of them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # h_i = sum of GEAR[b_(i-j)] << j over WINDOW bytes, by doubling.
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    hit = (h >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1) == 0
    hit[:-1] &= (data[1:] & 0xC0) != 0x80  # not inside a character
    at = np.flatnonzero(hit) + 1
    last = offsets[1:][np.diff(offsets) > 0]
    # Boundaries of one document do not see the bytes of the one before.
    begin = offsets[np.searchsorted(offsets, at - 1, side="right") - 1]
    at = at[at - begin >= WINDOW]
    gap = np.diff(at, prepend=-(1 << 40))
    at = at[gap > LEAST]
    ends = np.union1d(at, last)
    ends = np.union1d(ends, _periodic(h, data, ends))
    return ends, np.searchsorted(ends, offsets, side="right").astype(np.int64)


def _periodic(h: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cuts inside chunks of more than LONGEST bytes, mostly one word over and
    over: where the least of the frequent hashes stands, STRIDE bytes apart at
    least.  In periodic text these are whole periods, whatever comes before."""
    more = []
    begins = np.append(0, ends[:-1])
    for k in np.flatnonzero(ends - begins > LONGEST).tolist():
        a, b = int(begins[k]) + WINDOW, int(ends[k])
        values, count = np.unique(h[a:b], return_counts=True)
        place = a + 1 + np.flatnonzero(h[a:b] == values[2 * count >= count.max()].min())
        place = place[place < b]
        place = place[(data[place] & 0xC0) != 0x80]
        before = -STRIDE
        for x in place.tolist():
            if x - before >= STRIDE:
                more.append(x)
                before = x
    return np.array(more, np.int64)


_DDL = "slice long, bucket int, kind int, ids binary, texts binary, counts binary, more binary, keys binary, at binary, at_more binary, again binary, sizes binary, sizes_more binary, words binary, words_more binary"
_TYPES = deal.types(_DDL)


def _deal(buckets: int):
    """Pairs of chunks by bucket.  Of a pair that several documents of the
    slice hold only the least document's is sent; the header names that one's
    place for the others, and has the sizes of all chunks in bytes and words."""

    def measure(piece):
        data, offsets = tn.utf8_buffers(piece.column("text"))
        ends, first = boundaries(data, offsets)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        words = tn.Words(data, offsets, lower=False)
        counts = np.diff(first)
        doc = deal.owner(counts)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        keys = words.spans(starts[pair], ends[pair + 1]) if len(pair) and len(words.hash) else np.zeros(0, np.uint64)
        ids, texts = piece.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8"), piece.column("text_key").to_numpy().astype("<i8")
        return keys, pair[: len(keys)], doc[pair[: len(keys)]], counts, ends - starts, np.diff(np.searchsorted(words.start, np.concatenate(([0], ends)))), ids, texts

    def pack(slice_id, held):
        bases = np.cumsum([0, *[len(h[4]) for h in held]]), np.cumsum([0, *[len(h[3]) for h in held]])
        pair, doc = (np.concatenate([h[i] + base for h, base in zip(held, bases[i - 1], strict=False)]) for i in (1, 2))
        keys, counts, sizes, words, ids, texts = (np.concatenate([h[i] for h in held]) for i in (0, 3, 4, 5, 6, 7))
        order = np.lexsort((pair, ids[doc], keys))
        at, length = deal.runs(keys[order])
        sent = order[at]
        first_of = np.empty(len(keys), np.int64)
        first_of[order] = np.repeat(sent, length)
        again = np.zeros(len(keys), bool)
        again[sent[length > 1]] = True
        local = np.flatnonzero(first_of != np.arange(len(keys)))
        (n_chunks, n_more), (size, size_more), (word, word_more) = (deal.to_bytes(x) for x in (counts, sizes, words))
        yield deal.row(
            _TYPES, slice=slice_id, bucket=slice_id % buckets, kind=1, ids=ids.tobytes(), texts=texts.tobytes(), counts=n_chunks, more=n_more, sizes=size, sizes_more=size_more, words=word, words_more=word_more,
            keys=pair[first_of[local]].astype("<u4").tobytes(), at=pair[local].astype("<u4").tobytes(),
        )
        sent = np.sort(sent)
        to = (keys[sent] % U64(buckets)).astype(np.int64)
        sent = sent[np.argsort(to, kind="stable")]
        cuts = np.searchsorted(np.sort(to), np.arange(buckets + 1))
        steps = np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            x = sent[cuts[b] : cuts[b + 1]]
            (count, more), (gap, gap_more) = deal.to_bytes(np.bincount(doc[x], minlength=len(ids))), deal.to_bytes(np.diff(pair[x], prepend=0))
            yield deal.row(_TYPES, slice=slice_id, bucket=b, kind=0, ids=steps, counts=count, more=more, keys=keys[x].tobytes(), at=gap, at_more=gap_more, again=np.packbits(again[x]).tobytes())

    return lambda batches: deal.slices(batches, SLICE_PAIRS, measure, pack)


def _holders(batches):
    """Of each pair that another document than its least holder has: that
    holder, back to the slices; also of pairs that a slice holds repeatedly."""
    headers: list = []
    inner = deal.inner_rows(batches, headers)
    for r in headers:
        yield deal.row(_TYPES, **r)
    if not inner:
        return
    key = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in inner])
    doc = np.concatenate([np.cumsum(np.frombuffer(r["ids"], "<i8"))[deal.owner(deal.from_bytes(r["counts"], r["more"]))] for r in inner])
    order = np.lexsort((doc, key))
    start, length = deal.runs(key[order])
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(doc[order][start], length)
    at = 0
    for r in inner:
        n = len(r["keys"]) // 8
        own = slice(at, at + n)
        at += n
        keep = (least[own] != doc[own]) | np.unpackbits(np.frombuffer(r["again"], np.uint8))[:n].astype(bool)
        if keep.any():
            yield deal.row(_TYPES, slice=r["slice"], bucket=0, kind=0, ids=least[own][keep].tobytes(), at=np.cumsum(deal.from_bytes(r["at"], r["at_more"]))[keep].astype("<u4").tobytes())


_SPANS = "doc_id long, text_key long, start long, end long, kept_in long"


def _spans(batches):
    """Runs of repeated chunks of a slice's documents, in bytes of the text."""
    for _, rows in deal.groups(batches, "slice"):
        head = next(r for r in rows if r["kind"] == 1)
        inner = [r for r in rows if r["kind"] == 0]
        if not inner:
            continue
        ids, texts = np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["texts"], "<i8")
        counts, sizes, words = (deal.from_bytes(head[c], head[m]) for c, m in (("counts", "more"), ("sizes", "sizes_more"), ("words", "words_more")))
        doc, ends = deal.owner(counts), np.cumsum(sizes)
        begins, said = ends - sizes, np.concatenate(([0], np.cumsum(words)))
        at, least = np.concatenate([np.frombuffer(r["at"], "<u4") for r in inner]).astype(np.int64), np.concatenate([np.frombuffer(r["ids"], "<i8") for r in inner])
        local = np.frombuffer(head["at"], "<u4").astype(np.int64)
        if len(local):
            order = np.argsort(at)
            of = order[np.searchsorted(at[order], np.frombuffer(head["keys"], "<u4"))]
            at, least = np.append(at, local), np.append(least, least[of])
        other = least != ids[doc[at]]
        at, least = at[other], least[other]
        mark, holder = np.zeros(len(ends) + 1, bool), np.full(len(ends) + 1, NO_ID)
        for k in (0, 1):
            mark[at + k] = True
            np.minimum.at(holder, at + k, least)
        mark, holder = mark[: len(ends)], holder[: len(ends)]
        follows = np.append(False, mark[:-1] & mark[1:] & (doc[1:] == doc[:-1]))
        first = np.flatnonzero(mark & ~follows)
        last = np.flatnonzero(mark & ~np.append(follows[1:], False))
        long = (said[last + 1] - said[first] >= RUN_WORDS) | (ends[last] - begins[first] >= RUN_BYTES)
        inside = np.zeros(len(ends) + 1, np.int64)
        inside[first[long]] += 1
        inside[last[long] + 1] -= 1
        inside = np.cumsum(inside)[:-1] > 0
        # A run may repeat one document after another: a span for each.
        same = np.append(False, inside[:-1] & follows[1:] & (holder[1:] == holder[:-1]))
        edge = np.flatnonzero(inside & ~same)
        stop = np.flatnonzero(inside & ~np.append(same[1:], False))
        base = np.concatenate(([0], ends))[np.cumsum(counts) - counts][doc[edge]]
        own, kept = ids[doc[edge]], holder[edge]
        yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(texts[doc[edge]]), pa.array(begins[edge] - base), pa.array(ends[stop] - base), pa.array(kept, mask=kept == NO_ID)], [c.split()[0] for c in _SPANS.split(", ")])


def _found(docs: DataFrame) -> DataFrame:
    n = parts(docs)
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    back = deal.by_bucket(own.mapInArrow(_deal(n), _DDL), n).mapInArrow(_holders, _DDL)
    return deal.by_slice(back, n).mapInArrow(_spans, _SPANS)


def repeats(docs: DataFrame) -> DataFrame:
    """One row per repeated span: doc_id, start, end (bytes of the UTF-8
    text), kept_in (the document that keeps the passage)."""
    return _found(docs).select("doc_id", "start", "end", "kept_in")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of its UTF-8 bytes."""
    data, at, out = text.encode(), 0, []
    for a, b in sorted(spans):
        if a > at:
            out.append(data[at:a])
        at = max(at, b)
    out.append(data[at:])
    return b"".join(out).decode()


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with their columns; repeated spans are gone from text,
    and n_chars, where there is such a column, counts what remains.  A span
    belongs to the rows of its id, null too, with the very text it was found in."""
    per = _found(docs).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("lectern_spans"))
    per = store.table(per.select(F.col("doc_id").alias("lectern_id"), F.col("text_key").alias("lectern_key"), "lectern_spans"), "cuts")
    columns = docs.columns

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("lectern_spans").to_pylist()
            new = [cut(t, [(s["start"], s["end"]) for s in x]) if x and t else t for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("lectern_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("lectern_key"))
    per = small(per)
    untouched = docs.join(per, same, "left_anti")
    out = docs.join(per, same).select(*columns, "lectern_spans").mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return untouched.union(out.select(*columns))
