"""Narrated-text views of the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NARRATIVE = "SELECT CAST(doc_id AS STRING) AS book_id, 0 AS chapter_index, lang, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"

DIALOGUE = """
WITH b AS (
  SELECT conv_id, turn, replace(text, chr(10), ' ') AS t,
    CASE CAST((conv_id * 5 + turn) % 6 AS INT) WHEN 0 THEN 'whispered' WHEN 1 THEN 'shouted' WHEN 2 THEN 'asked'
      WHEN 3 THEN 'sobbed' WHEN 4 THEN 'said' ELSE 'snapped' END AS verb
  FROM conversations)
SELECT conv_id, turn, CASE CAST((conv_id + turn) % 7 AS INT)
  WHEN 0 THEN chr(34) || t || chr(34) || ' she ' || verb || '.'
  WHEN 1 THEN t || '!'
  WHEN 2 THEN chr(34) || t || ',' || chr(34) || ' he ' || verb || '?'
  WHEN 3 THEN t || '.'
  WHEN 4 THEN chr(39) || t || chr(39) || ' THE END IS NEAR.'
  WHEN 5 THEN t || ' ' || chr(34) || substr(t, 1, 12) || chr(34) || ' ' || t || '.'
  ELSE t || '...' END AS text
FROM b
"""

FIGURES = """
SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS STRING) || ' of ' || CAST(year(o_orderdate) AS STRING)
  || ' cost $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
  || ', ' || CAST(o_orderkey % 101 AS STRING) || '% paid, ranked ' || CAST(o_orderkey % 17 + 4 AS STRING)
  || 'th by Dr. No.' AS text
FROM orders
"""

WER_PAIRS = """
SELECT doc_id, lower(replace(text, chr(10), ' ')) AS reference,
  trim(replace(' ' || lower(replace(text, chr(10), ' ')) || ' ', ' the ', ' xxx ')) AS hyp_sub,
  trim(replace(' ' || lower(replace(text, chr(10), ' ')) || ' ', ' the ', ' ')) AS hyp_del
FROM documents
"""

#: The whole text: all of it in quotes, marks at its start, and at every comma, full stop and line after that.
MARKED = """
SELECT doc_id, '\u201c' || substr(text, 1, 40) || '\u201d\u2014' || substr(text, 41, 30) || ' -- ' || substr(text, 71, 30) || '\u2026'
  || replace(replace(replace(substr(text, 101), ', ', '\u201d \u2013'), '. ', '\u2026\u200b -- \u201c'), chr(10), '.....' || chr(10) || 'it\u2019s . . . ')
  || '\u200b so it\u2019s.....  . . . end' AS text
FROM documents
"""

TABLES = ("documents", "conversations", "orders", "lineitem", "part", "events", "pages", "benchmark")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the driver's tables; each is a scan of its own."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
