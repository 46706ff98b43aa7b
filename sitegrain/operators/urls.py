"""Reports and de-duplication by URL part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls as U


def url_inventory(df: DataFrame, url: str = "url") -> DataFrame:
    """Row count per ``protocol, host, port``; unparsable URLs form the all-null row."""
    return (
        df.select(U.url_parts(F.col(url)).alias("p"))
        .groupBy(
            F.col("p.protocol").alias("protocol"),
            F.col("p.host").alias("host"),
            F.col("p.port").alias("port"),
        )
        .agg(F.count("*").alias("n"))
    )


def with_url_key(df: DataFrame, url: str = "url", with_rest: bool = True) -> DataFrame:
    return df.withColumn("url_key", U.url_key(F.col(url), with_rest))


def dedup_by_url_key(df: DataFrame, url: str = "url", with_rest: bool = True) -> DataFrame:
    """One row per canonical URL (per site root without ``with_rest``): the smallest
    URL that has the key, and how many rows had it. Invalid URLs are left out."""
    return (
        with_url_key(df.select(url), url, with_rest)
        .filter(F.col("url_key").isNotNull())
        .groupBy("url_key")
        .agg(F.min(url).alias("url"), F.count("*").alias("n"))
    )


def rollup_by_host(
    df: DataFrame,
    url: str = "url",
    body: str = "html",
    with_port: bool = False,
    with_type: bool = False,
) -> DataFrame:
    """Pages and characters per host. ``with_type`` puts the scheme in front and
    ``with_port`` the port behind; a URL that lacks the part gives a null host."""
    u = F.col(url)
    host = U.host_of(u)
    if with_type:
        scheme = U.blank_to_null(F.lower(F.regexp_extract(u, r"^([^/:]+):", 1)))
        host = F.concat(scheme, F.lit("://"), host)
    if with_port:
        port = U.blank_to_null(F.regexp_extract(u, r"^(?:[^/:]+:)?//[^/#?]*:([0-9]+)(?=[/#?]|\z)", 1))
        host = F.concat(host, F.lit(":"), port)
    return (
        df.select(host.alias("host"), F.length(body).cast("bigint").alias("chars"))
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
    )


def rollup_by_site_domain(df: DataFrame, url: str = "url") -> DataFrame:
    """Pages and hosts per registrable domain.

    Counted per host first, so that a domain holding much of the table arrives at
    the second step as one row per host.
    """
    return (
        df.select(U.host_of(F.col(url)).alias("host"))
        .groupBy("host")
        .agg(F.count("*").alias("pages"))
        .groupBy(U.site_domain(F.col("host")).alias("domain"))
        .agg(F.sum("pages").alias("pages"), F.count("host").alias("hosts"))
    )


def ip_link_report(links: DataFrame, link: str = "link") -> DataFrame:
    """Links per target whose host is an IP address."""
    return (
        links.select(U.host_of(F.col(link)).alias("ip"))
        .filter(U.is_ip(F.col("ip")))
        .groupBy("ip")
        .agg(F.count("*").alias("n"))
    )


def filter_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is http(s) and more than the bare scheme."""
    return df.filter(U.is_http_url(F.col(url)))
