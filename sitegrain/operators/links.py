"""Link extraction, completion and scoping.

The page-level steps work on arrays inside the row: links of one page are
de-duplicated, completed and scoped without a shuffle, so the same code runs on
streams. ``explode`` comes last.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import html as H
from sitegrain.functions import urls as U

LEVELS = (0, 1, 2)


def check_level(level: int) -> int:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    return level


def anchor_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct anchor links per page, as written."""
    return pages.select(key, F.explode(F.array_distinct(H.anchors(html))).alias("link"))


def frame_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct frame and iframe sources per page, as written."""
    return pages.select(key, F.explode(F.array_distinct(H.frames(html))).alias("link"))


def text_urls(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct address-like words per text."""
    return df.select(key, F.explode(F.array_distinct(H.addresses(text))).alias("url"))


@lru_cache
def page_links(
    html: str,
    text: str,
    url: str,
    keep_port: bool = False,
    strict_resolve: bool = False,
) -> Column:
    """Distinct completed links of a page: array of ``(link, scope)``. The arguments name
    columns. A built expression is kept, as it has some hundred nodes."""
    raw = F.array_distinct(F.concat(H.markup_links(html), H.addresses(text)))
    wanted = F.filter(F.coalesce(raw, F.array().cast("array<string>")), U.is_page_link)
    return U.let(
        U.page_base(F.col(url), keep_port),
        lambda page: F.transform(
            F.array_distinct(F.transform(wanted, lambda x: U.complete_link(page, x, strict_resolve))),
            lambda x: F.struct(x.alias("link"), U.link_scope(page, x).alias("scope")),
        ),
    )


def extract_links(
    pages: DataFrame,
    level: int = 0,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    text: str | None = None,
    keep_port: bool = False,
    strict_resolve: bool = False,
) -> DataFrame:
    """``(key, link)``: anchors, frames and address-like words of each page, without
    links to listed file types, completed, distinct, and inside ``level``."""
    check_level(level)
    links = page_links(html, text or html, url, keep_port, strict_resolve)
    return (
        pages.select(key, F.explode(links).alias("l"))
        .filter(F.col("l.scope") <= level)
        .select(key, F.col("l.link").alias("link"))
    )


def resolve_links(
    links: DataFrame,
    base: str = "url",
    link: str = "link",
    keep_port: bool = False,
    strict_resolve: bool = False,
) -> DataFrame:
    """Adds ``resolved``: the link completed against the page URL in ``base``."""
    return links.withColumn(
        "resolved",
        U.let(
            U.page_base(F.col(base), keep_port),
            lambda page: U.complete_link(page, F.col(link), strict_resolve),
        ),
    )


def drop_special_links(links: DataFrame, link: str = "link") -> DataFrame:
    """Rows whose link does not end in a listed file type."""
    return links.filter(U.let(F.col(link), U.is_page_link))


def in_scope(links: DataFrame, level: int, base: str = "url", link: str = "link") -> DataFrame:
    """Rows whose link stays on the page's host (0), site domain (1) or anywhere (2)."""
    check_level(level)
    if level == 2:
        return links
    # Bound to a variable, so that a computed link is not written out many times when
    # Spark moves the filter below its computation.
    reach = U.site_domain if level == 1 else lambda host: host
    place = lambda c: U.let(U.let(F.col(c), U.host_of), reach)
    return links.filter(place(link) == place(base))


def distinct_links(links: DataFrame, link: str = "link") -> DataFrame:
    """Each link once, with the number of rows that had it."""
    return links.groupBy(link).agg(F.count("*").alias("n"))


def union_links(*parts: DataFrame) -> DataFrame:
    """Set union of link tables with the same columns."""
    return reduce(DataFrame.unionByName, parts).distinct()
