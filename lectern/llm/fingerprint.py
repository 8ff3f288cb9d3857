"""Canonical exact digests of documents.

A text's canonical form is NFKC, case folded, NFKC again, with every run of
white space one space and none at the ends.  Its fingerprint is the 128-bit
xxhash of that form.  Documents are grouped by fingerprint, and the canonical
bytes are compared inside each equal bucket, so that even a collision
separates.  Only texts of buckets with two documents or more are read again
and move; a bucket of more than BUCKET_ROWS is compared in parts, of which the
forms meet by their SHA-256.  ``likeness`` of two texts is 1.0 where digest
and canonical bytes agree, else 0.0.

Cases: null text is the empty text; equal texts have equal fingerprints; of
rows with one id the order is that of their text; rows without an id come
after all others; a lone document is its own next one; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import deal, store
from lectern.llm import textnum as tn
from lectern.llm.common import frugal, parts, small

#: Documents of one fingerprint that are compared in one part.
BUCKET_ROWS = 2000


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def fingerprint(text: str | None) -> str:
    return digest(canonical(text))


def likeness(a: str, b: str) -> float:
    """Of two canonical forms: equal digests, confirmed by the bytes."""
    return 1.0 if digest(a) == digest(b) and a == b else 0.0


_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, text_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(entries: list[tuple]) -> pa.RecordBatch:
    """entries: (place, no id, id, text, key of the text) in order, the last one only as the next of the one before."""
    rows = []
    form = canonical(entries[0][3])
    mark = digest(form)
    for here, after in zip(entries[:-1], entries[1:], strict=True):
        text = here[3]
        k = len(text) // 4
        changed = text[: len(text) - k] + after[3][:k]
        changed_form, after_form = canonical(changed), canonical(after[3])
        changed_mark, after_mark = digest(changed_form), digest(after_form)
        rows.append((here[2], here[4], len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, changed_mark, float(mark == changed_mark and form == changed_form), float(mark == after_mark and form == after_form)))
        form, mark = after_form, after_mark
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)] if rows else [pa.array([], f.type) for f in _OUT], schema=_OUT)


def _edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, which ends with the
    start of the next document by id; with a 64-bit key of the text.

    Ranges of ids come from quantiles that are ids of the table, so the first
    document of each range is known and is also sent to the range before it;
    each range is then independent.  Texts travel once, compressed by range.
    """
    own = _keyed(docs)
    n = parts(docs)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("cuts"), F.min("doc_id").alias("least")).first()
    least = got["least"]
    cuts = np.array(sorted({c for c in got["cuts"] or [] if c != least}), np.int64)
    last = len(cuts)

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for piece in tn.pieces(batches, 16 << 20):
            ids, texts = piece.column("doc_id"), piece.column("text")
            none = np.asarray(ids.is_null())
            values, keys = ids.fill_null(0).to_numpy().astype(np.int64), piece.column("text_key").to_numpy().astype(np.int64)
            bucket = np.where(none, last, np.searchsorted(cuts, values, side="right"))
            sent = [(bucket, np.arange(len(values)), 0)]
            heads = np.flatnonzero(~none & (bucket > 0) & (values == (cuts[np.maximum(bucket - 1, 0)] if last else -1)))
            sent.append((bucket[heads] - 1, heads, 1))
            firsts = np.flatnonzero(~none & (values == least)) if least is not None else np.arange(len(values))
            sent.append((np.full(len(firsts), last), firsts, 2))
            for to, rows, place in sent:
                for b in np.unique(to):
                    at = rows[to == b]
                    data, offsets = tn.utf8_buffers(texts.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([place], pa.int32()), pa.array([values[at].tobytes()]), pa.array([keys[at].tobytes()]), pa.array([none[at].tobytes()]), pa.array([np.diff(offsets).astype(np.int32).tobytes()]), pa.array([squeeze.compress(data.tobytes())])], ["bucket", "place", "ids", "keys", "nulls", "sizes", "texts"])

    def finish(entries):
        mine = sorted((e for e in entries if e[0] == 0), key=lambda e: e[1:])
        guests = sorted((e for e in entries if e[0] > 0), key=lambda e: e)
        if mine:
            for at in range(0, len(mine), 2000):
                yield _edited([(e[0], e[1], None if e[1] else e[2], e[3], e[4]) for e in (mine[at : at + 2001] if at + 2000 < len(mine) else [*mine[at:], guests[0]])])

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        bucket, entries = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from finish(entries)
                    bucket, entries = row["bucket"], []
                data, at = expand.decompress(row["texts"]) if row["texts"] else b"", 0
                ids, keys, none, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["sizes"], np.int32)
                for i, k, x, s in zip(ids.tolist(), keys.tolist(), none.tolist(), sizes.tolist(), strict=True):
                    entries.append((row["place"], x, i, data[at : at + s].decode(), k))
                    at += s
        yield from finish(entries)

    dealt = own.mapInArrow(send, "bucket int, place int, ids binary, keys binary, nulls binary, sizes binary, texts binary")
    return deal.by_bucket(dealt, n).mapInArrow(run, _DDL)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fingerprint of every document."""

    def run(batches):
        for piece in tn.pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array([fingerprint(t) for t in piece.column("text").to_pylist()], pa.string())], ["doc_id", "text_key", "fingerprint"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, fingerprint string")


def _compared(batches):
    """Rows of a part of a bucket -> the SHA-256 of their canonical form, taken
    once for each form that the part holds."""
    key, forms = None, {}
    for batch in batches:
        for piece in tn.pieces([batch]):
            kinds = []
            for mark, part, text in zip(*(piece.column(c).to_pylist() for c in ("fingerprint", "part", "text")), strict=True):
                if (mark, part) != key:
                    key, forms = (mark, part), {}
                form = canonical(text).encode("utf-8", "surrogatepass")
                if form not in forms:
                    forms[form] = hashlib.sha256(form).hexdigest()
                kinds.append(forms[form])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), piece.column("fingerprint"), pa.array(kinds, pa.string())], ["doc_id", "text_key", "fingerprint", "form"])


def groups(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (doc_id, text_key, fingerprint) of all documents -> doc_id,
    text_key, group_id of those whose canonical text another row has too."""
    n = parts(docs)
    several = marks.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fingerprint").alias("bucket"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("parts"))
    # One fingerprint may be that of a third of all rows: the least ids by key come first.
    wanted = marks.distinct().join(small(store.table(several, "buckets")), F.col("fingerprint") == F.col("bucket"))
    wanted = store.table(wanted.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "fingerprint", "parts"), "members")
    own = _keyed(docs).join(small(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    part = F.pmod(F.xxhash64("doc_id", "text_key", F.spark_partition_id()), F.col("parts")).cast("int")
    dealt = own.select("doc_id", "text_key", "fingerprint", part.alias("part"), "text").repartition(n, "fingerprint", "part").sortWithinPartitions("fingerprint", "part")
    found = store.table(dealt.mapInArrow(_compared, "doc_id long, text_key long, fingerprint string, form string").distinct(), "forms")
    least = found.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"))
    least = least.select(F.col("fingerprint").alias("bucket"), F.col("form").alias("kind"), "group_id")
    return found.join(small(store.table(least, "least")), (F.col("fingerprint") == F.col("bucket")) & (F.col("form") == F.col("kind"))).select("doc_id", "text_key", "group_id")


def _grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with group_id: that of found, else their own id."""
    own = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("group_id").alias("least"))
    both = rows.join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return both.withColumn("group_id", F.coalesce("least", "doc_id")).drop("id", "key", "least", "text_key")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and group_id: the least id with the same canonical
    text (null where none of these has an id)."""
    rows = store.table(_edits(docs), "edits")
    return _grouped(rows, groups(docs, rows.select("doc_id", "text_key", "fingerprint")))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id of every document."""
    rows = store.table(fingerprints(docs), "fingerprints")
    return _grouped(rows, groups(docs, rows))
