"""Frontier operators: snapshot lookup, first arrivals, deny lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.functions import urls as U
from sitegrain.operators.quality import decode_pages


def page_index(pages: DataFrame, url: str = "url", *extra: str) -> DataFrame:
    """One narrow row per canonical URL of the snapshot, led by its smallest URL."""
    return (
        pages.select(U.url_key(F.col(url)).alias("url_key"), F.struct(F.col(url).alias("page_url"), *extra).alias("p"))
        .filter(F.col("url_key").isNotNull())
        .groupBy("url_key")
        .agg(F.min("p").alias("p"))
        .select("url_key", "p.*")
    )


def fetch(
    frontier: DataFrame, pages: DataFrame, url: str = "url", body: str | None = None, first: str | None = None
) -> DataFrame:
    """Frontier rows with ``page_url`` and ``outcome``: ``success`` where the snapshot
    has the key, else ``failed``; ``invalid`` for URLs that have no key.

    ``body`` names the column of ``pages`` that comes along as ``body``, text or bytes, with
    ``page_text``, the same decoded; null where nothing was fetched. Keys meet first, bodies last.
    Of pages of one URL the one with the least ``first``, a column of ``pages``, counts, then the least body.
    """
    if body is not None:
        found = fetch(frontier, pages.select(F.col("url")), url)
        order = F.struct(*[F.col(c) for c in (first, body) if c is not None])
        bodies = pages.groupBy(F.col("url").alias("page_url")).agg(F.min_by(F.col(body), order).alias("body"))
        if isinstance(bodies.schema["body"].dataType, T.BinaryType):
            bodies = decode_pages(bodies, "body", "page_text")
        else:
            bodies = bodies.withColumn("page_text", F.col("body"))
        # Rows that found no page join under their own text, as above.
        own = F.coalesce("page_url", F.concat(F.lit("none:"), F.col(url)))
        return found.join(bodies.withColumnRenamed("page_url", "_page"), own == F.col("_page"), "left").drop("_page")
    keyed = frontier.withColumn("url_key", U.url_key(F.col(url)))
    # Rows without a key join under their own text, which matches nothing: as nulls they
    # would all land in one partition.
    sought = F.coalesce("url_key", F.concat(F.lit("invalid:"), F.col(url)))
    index = page_index(pages).withColumnRenamed("url_key", "_key")
    return (
        keyed.join(index, sought == F.col("_key"), "left")
        .drop("_key")
        .withColumn(
            "outcome",
            F.when(F.col("url_key").isNull(), "invalid")
            .when(F.col("page_url").isNull(), "failed")
            .otherwise("success"),
        )
    )


def first_per_key(frontier: DataFrame, task: str = "task") -> DataFrame:
    """One row per ``task, url_key``: the smallest URL."""
    return frontier.groupBy(task, "url_key").agg(F.min("url").alias("url"))


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows whose ``task, url_key`` was not visited."""
    return frontier.join(visited.select("task", "url_key"), ["task", "url_key"], "left_anti")


def frontier_new(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """First arrivals not seen before. Aggregated before the join, on the same key, so
    that one exchange of the frontier serves both."""
    return unvisited(first_per_key(frontier), visited)


def drop_denied(
    df: DataFrame,
    domains: DataFrame | Sequence[str] = (),
    hosts: DataFrame | Sequence[str] = (),
    urls: DataFrame | Sequence[str] = (),
    url: str = "url",
) -> DataFrame:
    """Rows whose site domain, host and exact URL are all unlisted.

    A list given as a sequence becomes a literal test. A one-column table becomes an
    anti join, for which Spark picks broadcast or shuffle by the table's size.
    """
    host = U.host_of(F.col(url))
    for denied, value in ((domains, U.site_domain(host)), (hosts, host), (urls, F.col(url))):
        if isinstance(denied, DataFrame):
            listed = denied.select(F.col(denied.columns[0]).alias("_denied")).distinct()
            df = df.join(listed, value == F.col("_denied"), "left_anti")
        elif denied:
            df = df.filter(~F.coalesce(value.isin(list(denied)), F.lit(False)))
    return df
