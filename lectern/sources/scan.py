"""Scans that feed every core."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input for each core from which a scan's own splits suffice.
BYTES_PER_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores where its input is so small that a file
    or row group may leave most of them idle; larger inputs are left as they
    are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_PER_CORE else df
