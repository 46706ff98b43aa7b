"""Session settings that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Run-time plans: broadcast what turns out small, split skewed join partitions,
    # merge small shuffle partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long column expressions build faster without recording a call site per node.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Page rows are wide: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(app: str = "sitegrain", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
