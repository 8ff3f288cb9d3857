"""Shared column expressions and limits of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % k


def held_out(doc_id: str | Column, k: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; a null id is not."""
    return F.coalesce(fold(doc_id, k) == remainder, F.lit(False))


#: Bytes of an Arrow batch between the JVM and its workers.
BATCH_BYTES = 8 << 20


def frugal(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_BYTES: the buffers
    of both sides count against an executor's memory beyond its heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = str(conf.get(key, "67108864b")).lower().rstrip("b")
    if not found.isdigit() or int(found) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def parts(df: DataFrame, least: int = 12) -> int:
    """Shuffle partitions to deal packed arrays to: the session's number."""
    return max(least, int(frugal(df).sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes up to which a side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value, about."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return 32 * F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """A table to be joined with whole texts: broadcast where its rows and its
    bytes, both counted, are within the limits, else left to a shuffled join."""
    size = df.agg(F.count("*").alias("rows"), F.sum(sum((_width(f) for f in df.schema), F.lit(0))).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int, folds: int, test_fold: int) -> DataFrame:
    """doc_id, label, text of at most ``limit`` labelled documents outside the
    test fold, taken in the order of a hash of the id.  Of unequal labels of
    one id the greatest counts, of unequal texts the one with the least hash."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & (fold("doc_id", folds) != test_fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(text)
