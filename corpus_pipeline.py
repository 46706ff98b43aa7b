"""A training corpus from raw documents: quality rules, line de-duplication, one document of
each group of near duplicates, decontamination, and mixing.

Each stage takes what the one before kept, as a written table, and all but the last return the
columns of ``documents``. The last adds how many words the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import lines, mixing, ngram_join, outliers, winnowing
from sitegrain.llm.common import table
from sitegrain.plans.staging import Staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source; repeated rows all or none."""
    return outliers.keep_good(docs, Staging(spark, "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document all of whose lines go is empty and goes too."""
    cut = lines.drop_repeated_lines(docs, Staging(spark, "lines"))
    return cut.where((F.col("_n_dropped") == 0) | (F.btrim("text", F.lit(lines.SPACES)) != "")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the least ``doc_id``; rows without a word stay."""
    return ngram_join.keep_one(docs, Staging(spark, "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), Staging(spark, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``size``, ``target`` (of the source) and ``taken``."""
    mixed = mixing.mix(docs, Staging(spark, "mix"))
    return mixed.where("_taken > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_size").alias("size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Two stages fit estimates and draw by hash, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to shared storage before the next."""
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), str(i))
    return docs
