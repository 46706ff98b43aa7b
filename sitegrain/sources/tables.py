"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table.

    With ``spread_by`` a table of fewer splits than cores, such as one file with a single
    row group, is spread over the cores by that column; parsing pages costs far more
    than moving so few of them. Tables with enough splits are never shuffled.
    """
    rows = spark.read.parquet(path)
    if spread_by is None:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, spread_by)
