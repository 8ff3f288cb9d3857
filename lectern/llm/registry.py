"""Queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import chunks, fingerprint, forest, jaccard, licenses, maxent, mixing, packing, quality, toxicity
from lectern.llm.common import documents, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the compiled rules."""
    docs = documents(spark, sf_dir)
    return quality.classify(docs, quality.fit(docs, labels(spark, sf_dir)))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit(docs, labels(spark, sf_dir)))


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 5-word shingle Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and of its edited text."""
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of 2048."""
    return packing.pack_documents(documents(spark, sf_dir))


@query
def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that repeat another document's passage."""
    return chunks.repeats(documents(spark, sf_dir))


@query
def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document."""
    return maxent.score_documents(documents(spark, sf_dir))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in every document."""
    return licenses.scan(documents(spark, sf_dir))


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth vector."""
    return forest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.balance(documents(spark, sf_dir))


#: Exact links by a join on shingles of all documents, then reachability.
ORACLE_SQL["op3_jaccard"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 5 THEN array_to_string(l, ' ') ELSE array_to_string(l[i + 1 : i + 5], ' ') END AS g FROM (SELECT doc_id, l, unnest(range(CASE WHEN len(l) = 0 THEN 0 ELSE greatest(len(l) - 4, 1) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
k AS (SELECT r.doc_id, any_value(n.n) AS n FROM r JOIN n USING (doc_id) GROUP BY r.doc_id HAVING 100 * count(*) >= 75 * any_value(n.n)),
c AS (SELECT r.doc_id, r.g, k.n FROM r JOIN k USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
