"""Cutting the lineage of iterative programs in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumispan.functions.store import scratch


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table in the folder of :func:`lumispan.functions.store.shared_dir`.

    A checkpoint would carry its plan's size and constraints along: sizes of joins are products, so over rounds that join what
    earlier rounds gave their digits double each time, until the driver is busy with nothing else. A table has the size of its files.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
