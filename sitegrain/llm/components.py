"""Connected components of links, by alternating large and small stars.

Each step is a minimum per node (combined before the shuffle) and a plain join, so a hub is
never gathered in one place, and each step is written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.plans.staging import Staging


def _star(pairs: DataFrame, towards_larger: bool) -> DataFrame:
    """Links every neighbour of a node (only larger ones, or only smaller ones) to the least of all."""
    if towards_larger:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if towards_larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, stage: Staging, name: str) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``, not null) but the roots themselves;
    a root is the least node of its component."""

    def mark(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
        return row["n"], row["s"]

    pairs, step = stage.write(links.where("a <> b").select("a", "b").distinct(), f"{name}-0"), 0
    before = mark(pairs)
    while True:
        step += 1
        pairs = stage.write(_star(_star(pairs, True), False), f"{name}-{step}")
        now = mark(pairs)
        if now == before:
            return pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = now
