"""A folder of books as a stream: new files are annotated once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chapters import text_chapters
from lectern.operators.narration import assign_chunks, chunks
from lectern.plans.book import annotate
from lectern.plans.config import Settings
from lectern.sources.books import text_books


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New .txt files of a folder: path, content, book_id, format."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").load(folder)
    return found.select("path", "content").withColumns({"book_id": F.sha2("content", 256), "format": F.lit("txt")})


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:  # noqa: B008
    """Appends the chunks of each micro-batch to ``output``/batch=<id>; a batch
    that is repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = assign_chunks(annotate(text_chapters(text_books(batch)), settings), settings.processing.chunk_chars)
        chunks(own).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
