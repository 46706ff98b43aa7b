"""Inputs the queries derive from the given tables.

The tables hold no redirects, frames or placeholder pages, and no page links to
another one. Where an operator needs such content, it is woven into every row of the
given table with the expressions below, so the input grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions import urls as U
from sitegrain.plans.staging import Staging
from sitegrain.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def pages_for_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table, spread over the cores where its files have too few splits."""
    return read_table(spark, f"{sf_dir}/pages.parquet", spread_by="page_id")


def documents_for_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", spread_by="doc_id")


def by_turn(key: str, *options: Column | str) -> Column:
    """The option whose place is the key's remainder by the number of options."""
    picked = F.lit(None).cast("string")
    for i, o in enumerate(options):
        value = F.lit(o) if isinstance(o, str) else o
        picked = F.when(F.col(key) % len(options) == i, value).otherwise(picked)
    return picked


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked site with one page per row of ``pages``: ``page_id, url, html``.

    Page i links to three others by arithmetic on i, in front of the row's own html; some
    targets do not exist, some are written with a trailing slash. Some pages are blank,
    some are placeholders without or with a body, the latter being too long to be dropped.
    """
    pages = pages_for_parsing(spark, sf_dir).select("page_id", "html")
    n = table(spark, sf_dir, "pages").count()
    i = F.col("page_id")

    def link(target: Column, slash: Column | str = "") -> Column:
        tail = F.lit(slash) if isinstance(slash, str) else slash
        return F.concat(F.lit('<a href="/p'), target.cast("string"), tail, F.lit('">x</a>'))

    anchors = F.concat(
        link((i * 3 + 1) % n),
        link((i * 7 + 2) % (n + n // 5)),
        link((i / 2).cast("bigint"), F.when(i % 3 == 0, "/").otherwise("")),
    )
    html = (
        F.when(i % 17 == 3, "")
        .when(i % 26 == 5, F.concat(F.lit("404 Not Found "), anchors))
        .when(i % 26 == 18, F.concat(F.lit("404 Not Found "), anchors, "html"))
        .otherwise(F.concat(anchors, "html"))
    )
    return pages.select(
        "page_id", F.concat(F.lit("http://g.example.com/p"), i.cast("string")).alias("url"), html.alias("html")
    )


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task file lines: page URLs, JSON without a URL, JSON strings, and JSON tasks
    with and without an explicit null."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    u = F.col("url")
    as_json = by_turn(
        "page_id",
        F.concat(F.lit('{"url":"'), u, F.lit('","level":null}')),
        F.concat(F.lit('{"url":"'), u, F.lit('","level":1,"max_depth":3}')),
        F.concat(F.lit('"'), u, F.lit('"')),
        F.concat(F.lit('{"timeout":7,"url":"'), u, F.lit('"}')),
    )
    return (
        pages.select(F.concat(F.lit("  "), u, F.lit(" ")).alias("value"))
        .unionByName(pages.select(as_json.alias("value")))
        .unionByName(events.select(F.col("props").alias("value")))
    )


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs and other spellings of them."""
    u = F.col("url")
    spellings = F.array(
        u,
        F.concat(u, F.lit("/")),
        F.regexp_replace(u, "^http", "HTTP"),
        F.regexp_replace(u, "^(http://[^/]+)", "$1:80"),
        F.regexp_replace(u, "^https?://", ""),
        F.concat(F.lit("mailto:"), F.col("page_id").cast("string"), F.lit("@x.y")),
    )
    return table(spark, sf_dir, "pages").select(F.explode(spellings).alias("url"))


def written_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, link``: every page with one link of each form."""
    n = F.col("page_id").cast("string")
    links = F.array(
        F.concat(F.lit("/a"), n, F.lit(".")),
        F.concat(F.lit("a"), n),
        F.concat(F.lit("a"), n, F.lit(".html")),
        F.concat(F.lit("a"), n, F.lit(".html?x=1")),
        F.concat(F.lit("d/a.b"), n, F.lit(".html")),
        F.concat(F.lit("http://o"), n, F.lit(".com/z")),
        F.concat(F.lit("//cdn.x.com/"), n),
        F.concat(F.lit("#t"), n),
        F.concat(F.lit("?x="), n),
        F.concat(F.lit("tel:"), n),
        F.concat(F.lit("/x"), n, F.lit(".png")),
        F.concat(F.lit("http://e"), n, F.lit(".ai")),
        F.lit("css"),
        F.lit("download/app"),
        F.lit(""),
    )
    return table(spark, sf_dir, "pages").select("url", F.explode(links).alias("link"))


def framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a frame at their end: kept, blank, ``about:blank`` or with ``*``."""
    n = F.col("page_id").cast("string")
    frame = by_turn(
        "page_id",
        F.concat(F.lit('<iframe src="/f'), n, F.lit('"></iframe>')),
        '<iframe src=" "></iframe>',
        F.concat(F.lit('<FRAME name="x" src=\'http://f.example.com/'), n, F.lit("'>")),
        '<iframe src="about:blank"></iframe>',
        '<frame src="/*/x">',
    )
    return pages_for_parsing(spark, sf_dir).select("page_id", F.concat("html", frame).alias("html"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole page texts, most led by a phrase, and beside each under ``-page_id - 1`` a text
    of 990, 999, 1000 or 1010 characters made of the phrase alone."""
    size = F.get(F.array(*map(F.lit, (990, 999, 1000, 1010))), F.col("page_id") % 4)
    phrase = by_turn("page_id", "404 Not Found", "网站维护中", "", "loading...", "BadRequest(InvalidHostname)")
    pages = table(spark, sf_dir, "pages")
    whole = pages.select("page_id", F.concat(phrase, "html").alias("html"))
    return whole.unionByName(pages.select((-F.col("page_id") - 1).alias("page_id"), F.rpad(phrase, size, ".").alias("html")))


def redirecting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that redirect to their neighbour by one of the four rules, to themselves,
    to nowhere, or not at all: ``page_id, url, html``."""
    pages = pages_for_parsing(spark, sf_dir)
    n = pages.count()
    to = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("to"))
    joined = pages.join(to, (F.col("page_id") + 1) % n == F.col("_id"))
    t, h = F.col("to"), F.col("html")
    body = by_turn(
        "page_id",
        F.concat(F.lit('<head><meta http-equiv="refresh" content="0;URL='), t, F.lit('"></head>'), h),
        F.concat(F.lit('<head><script>window.onload=function(){top.location.href="'), t, F.lit('"}</script></head>'), h),
        F.concat(F.lit('<body>\r\n<script>window.navigate("'), t, F.lit('")</script></body>'), h),
        F.concat(F.lit('<script>location="'), t, F.lit('"</script>'), h),
        F.concat(F.lit('<head><meta content="0;url='), F.col("url"), F.lit('"></head>'), h),
        F.concat(F.lit('<head><meta content="0;url=http://gone.example.com/x"></head>'), h),
        h,
    )
    # Written out, as a snapshot would be: the queries search the body many times.
    return Staging(spark, "redirecting").write(joined.select("page_id", "url", body.alias("html")), "pages")


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result rows: ``task, url, ref_content_id, update_time``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("task"),
        F.col("event_type").alias("url"),
        F.col("event_id").cast("string").alias("ref_content_id"),
        F.col("ts").alias("update_time"),
    )


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results per site domain. Their content ids point five documents apart,
    so some of them dangle."""
    return table(spark, sf_dir, "pages").select(
        U.site_domain(U.host_of(F.col("url"))).alias("task"),
        "url",
        F.md5((F.col("page_id") * 5).cast("string")).alias("ref_content_id"),
        F.timestamp_seconds("page_id").alias("update_time"),
    )
