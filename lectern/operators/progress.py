"""Resumable progress as an append-only table.

Every event is one row (book_id, chapter_index, chunk_index, kind, state_key,
audio_path, ts); the latest row of a key wins.  kind is "chunk", "chapter" or
"book"; state_key identifies input and settings, so that rows of other inputs
or settings count no more.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "book_id string, chapter_index int, chunk_index int, kind string, state_key string, completed boolean, audio_path string, ts timestamp"


def state_key(content: Column, chapters: Column, settings: dict) -> Column:
    """Key of a book's bytes, its number of chapters and the settings."""
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), chapters.cast("string"), F.lit(json.dumps(settings, sort_keys=True))), 256)


def latest(events: DataFrame) -> DataFrame:
    """The last state of every book, chapter and chunk; of equal times the completed one."""
    keys = ["book_id", "kind", "chapter_index", "chunk_index"]
    order = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("completed").desc(), F.col("audio_path").desc())
    return events.withColumn("lectern_rn", F.row_number().over(order)).filter("lectern_rn = 1").drop("lectern_rn")


def valid(events: DataFrame, books: DataFrame) -> DataFrame:
    """Events whose key is that of books (book_id, state_key): same input, same settings."""
    return events.join(books.select("book_id", "state_key"), ["book_id", "state_key"], "left_semi")


def pending_chunks(chunks: DataFrame, events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Chunks without a completed event, or, where files (path) are given, whose file is gone."""
    done = latest(events.filter("kind = 'chunk'")).filter("completed")
    if files is not None:
        done = done.join(files.select(F.col("path").alias("audio_path")), "audio_path", "left_semi")
    return chunks.join(done, ["book_id", "chapter_index", "chunk_index"], "left_anti")


def pending_chapters(chapters: DataFrame, events: DataFrame) -> DataFrame:
    done = latest(events.filter("kind = 'chapter'")).filter("completed")
    return chapters.join(done, ["book_id", "chapter_index"], "left_anti")


def finished_books(events: DataFrame) -> DataFrame:
    return latest(events.filter("kind = 'book'")).filter("completed").select("book_id")


def marked(rows: DataFrame, kind: str, ts: Column | None = None) -> DataFrame:
    """Events that complete the given rows, ready to be appended."""
    has = set(rows.columns)
    value = lambda c, t: F.col(c).cast(t) if c in has else F.lit(None).cast(t)
    return rows.select("book_id", value("chapter_index", "int").alias("chapter_index"), value("chunk_index", "int").alias("chunk_index"), F.lit(kind).alias("kind"), value("state_key", "string").alias("state_key"), F.lit(True).alias("completed"), value("audio_path", "string").alias("audio_path"), (F.current_timestamp() if ts is None else ts).alias("ts"))


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The events at a path; none where there is nothing yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def reset(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def progress(totals: DataFrame, events: DataFrame) -> DataFrame:
    """totals (book_id, total_chapters, total_chunks) -> completed counts and
    percent with one decimal, half to even; 0 where there is nothing to do."""
    done = latest(events).filter("completed").groupBy("book_id").agg(F.count_if(F.col("kind") == "chapter").alias("completed_chapters"), F.count_if(F.col("kind") == "chunk").alias("completed_chunks"))
    out = totals.join(done, "book_id", "left").fillna(0, ["completed_chapters", "completed_chunks"])
    share = F.bround(100.0 * F.col("completed_chapters") / F.col("total_chapters"), 1)
    return out.withColumn("percent", F.when(F.col("total_chapters") > 0, share).otherwise(0.0))


def eta(events: DataFrame, totals: DataFrame) -> DataFrame:
    """events (book_id, chapter_index, seconds) in order of work -> mean time
    so far and seconds left after each chapter."""
    order = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)
    out = events.join(totals.select("book_id", "total_chapters"), "book_id")
    out = out.withColumns({"mean_seconds": F.avg("seconds").over(order), "done": F.count("*").over(order)})
    return out.withColumn("eta_seconds", F.col("mean_seconds") * (F.col("total_chapters") - F.col("done")))
