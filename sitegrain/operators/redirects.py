"""Redirect detection and one-hop following against the page snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls as U
from sitegrain.functions.redirects import redirect_candidates
from sitegrain.operators.fetch import page_index


def detect_redirects(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``(key, kind, target)`` of each page's first redirect."""
    # A generator, not a filter on the first candidate: Spark would move the filter
    # below the extraction and run it twice.
    first = F.slice(redirect_candidates(html, url), 1, 1)
    return pages.select(key, F.explode(first).alias("r")).select(
        key, F.col("r.kind").alias("kind"), F.col("r.target").alias("target")
    )


def follow_redirects(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with the body of their redirect target, one hop; the page keeps its URL.

    All candidates of a page are looked up and the first one in the snapshot wins: the page
    of exactly that URL, else that of the smallest URL under its key. ``redirect_kind`` tells
    which rule it was, null for pages left as they were. A URL may have several pages: each
    follows its own redirect, and a redirect to such a URL gives a row with each of its bodies.
    Pages without a redirect pass through without a shuffle; the lookups move keys, and bodies
    only for the pages that do redirect.
    """
    candidates = redirect_candidates(html, url)
    stays = F.size(candidates) == 0
    unmoved = pages.filter(stays).withColumn("redirect_kind", F.lit(None).cast("string"))
    # Pages of one URL are told apart by their bodies; of equal ones the redirect is the same.
    moving = pages.filter(~stays).withColumn("_of", F.md5(html))

    targets = pages.select(F.col(url).alias("_from"), F.md5(html).alias("_of"), F.posexplode(candidates).alias("pos", "r")).select(
        "_from", "_of", "pos", "r.kind", "r.target", U.url_key(F.col("r.target")).alias("url_key")
    )
    known = pages.select(F.col(url).alias("_exact")).distinct()
    chosen = (
        targets.filter(F.col("url_key").isNotNull())
        .join(page_index(pages, url), "url_key")
        .join(known, F.col("target") == F.col("_exact"), "left")
        .groupBy("_from", "_of")
        .agg(F.min(F.struct("pos", F.col("kind").alias("redirect_kind"), F.coalesce("_exact", "page_url").alias("page_url"))).alias("c"))
        .select("_from", "_of", "c.redirect_kind", "c.page_url")
    )
    bodies = pages.select(F.col(url).alias("_target"), F.col(html).alias("_body"))
    moved = (
        moving.join(chosen.withColumnRenamed("_of", "_its"), (F.col(url) == F.col("_from")) & (F.col("_of") == F.col("_its")), "left")
        .join(bodies, F.col("page_url") == F.col("_target"), "left")
        .withColumn(html, F.coalesce("_body", html))
    )
    return unmoved.unionByName(moved.select(*unmoved.columns))
