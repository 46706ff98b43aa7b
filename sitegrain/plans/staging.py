"""Intermediate tables in shared storage.

A staged table cuts the lineage of an iterative job. It outlives the executor that
wrote it, and unlike a cached block it tells the optimizer its size.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local master may do
    without the setting; it gets a temporary folder removed at exit."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="sitegrain-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _application_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/sitegrain/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _table_prefix(spark: SparkSession) -> str:
    return re.sub(r"\W", "_", f"sitegrain_{spark.sparkContext.applicationId}_").lower()


def release_all(spark: SparkSession) -> None:
    """Delete every staged table of this application."""
    for t in spark.catalog.listTables(pattern=_table_prefix(spark) + "*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    _delete(spark, _application_folder(spark))


class Staging:
    """A private folder for the staged tables of one job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self._id = uuid.uuid4().hex
        self.path = f"{_application_folder(spark)}/{label}-{self._id}"
        self._tables: set[str] = set()

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def append_buckets(self, df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
        """Append ``df`` to a table laid out by the hash of ``keys`` and return the whole table.

        A join or aggregate on ``keys`` takes the table as it lies and moves its other side only.
        The table is known to the session's catalog under a name of its own until ``release``.
        """
        known = f"{_table_prefix(self.spark)}{self._id}_{name}"
        self._tables.add(known)
        df.write.mode("append").format("parquet").bucketBy(buckets, *keys).option("path", f"{self.path}/{name}").saveAsTable(known)
        return self.spark.table(known)

    def release(self) -> None:
        """Delete the folder; tables read from it are gone afterwards."""
        for known in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{known}`")
        self._tables.clear()
        _delete(self.spark, self.path)
