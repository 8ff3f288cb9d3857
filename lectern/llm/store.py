"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage
    ends there, so lost executors cost no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove a table() whose rows nothing reads any more."""
    files = df.inputFiles()
    for item in list(_made):
        if any(item[1].rsplit("/", 1)[-1] in f for f in files[:1]):
            _remove(*item)
            _made.remove(item)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone already
            _remove(spark, path)
