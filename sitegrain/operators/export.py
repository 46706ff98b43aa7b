"""Exporting stored pages and saving crawled ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.constants import TASK_DEFAULTS
from sitegrain.functions import urls as U
from sitegrain.functions.text import base64_name, escaped_name, file_name
from sitegrain.operators.quality import drop_blank_pages
from sitegrain.operators.search import find_results


def attach_contents(results: DataFrame, contents: DataFrame) -> DataFrame:
    """Results with their stored content; rows without one are left out."""
    return results.join(
        contents.select(F.col("content_id").alias("ref_content_id"), "content", "length"),
        "ref_content_id",
    )


def missing_contents(results: DataFrame, contents: DataFrame) -> DataFrame:
    """Results that point to no stored content."""
    return results.join(
        contents.select(F.col("content_id").alias("ref_content_id")), "ref_content_id", "left_anti"
    )


def export_pages(
    results: DataFrame, contents: DataFrame, task: str | None = None, url: str | None = None
) -> DataFrame:
    """``task, url, host, file_name, page_text, length`` of the selected results; all
    results without a selection."""
    if task or url:
        results = find_results(results, task, url)
    return attach_contents(results, contents).select(
        "task",
        "url",
        U.host_of(F.col("url")).alias("host"),
        escaped_name(F.col("url")).alias("file_name"),
        F.decode("content", "UTF-8").alias("page_text"),
        "length",
    )


def first_page(results: DataFrame, contents: DataFrame, task: str | None = None, url: str | None = None) -> DataFrame:
    """What an export without a target prints: the newest selected page that has content.
    It is found on narrow rows; one body is read."""
    stored = contents.select(F.col("content_id").alias("ref_content_id"))
    found = (
        find_results(results.select("task", "url", "ref_content_id", "update_time"), task, url)
        .join(stored, "ref_content_id", "left_semi")
        .orderBy(F.desc("update_time"), F.desc("ref_content_id"))
        .limit(1)
    )
    return attach_contents(found, contents).limit(1).select("task", "url", F.decode("content", "UTF-8").alias("page_text"))


def page_file_names(pages: DataFrame, url: str = "url") -> DataFrame:
    """The names a page can be saved under, and the one used by default."""
    u = F.col(url)
    return pages.select(
        u.alias("url"),
        escaped_name(u).alias("escaped"),
        base64_name(u).alias("b64"),
        file_name(u).alias("final_name"),
    )


def write_by_host(rows: DataFrame, path: str, mode: str = "append", above: Sequence[str] = ()) -> None:
    """Write rows under one folder per host, itself under a folder per value of ``above``.

    The rebalance hint gathers a host into few files, and lets Spark split a host
    that holds much of the data over several tasks.
    """
    folders = [*above, "host"]
    rows.hint("rebalance", *[F.col(c) for c in folders]).write.mode(mode).partitionBy(*folders).parquet(path)


def save_pages(
    pages: DataFrame,
    path: str,
    naming: str = "escaped",
    url: str = "url",
    text: str = "page_text",
    bs64: str | None = None,
    base_output_dir: str | None = None,
) -> None:
    """Write non-empty pages under their host as ``file_name, url, page_text``.

    ``bs64`` and ``base_output_dir`` name columns with the options of a page's task: whether its
    name is in base64, and the folder above the hosts (null: the default of a task)."""
    name = file_name(F.col(url), naming)
    if bs64:
        name = F.when(F.col(bs64), file_name(F.col(url), "base64")).otherwise(name)
    folder = []
    if base_output_dir:
        folder = [F.coalesce(F.col(base_output_dir), F.lit(TASK_DEFAULTS["base_output_dir"])).alias("base_output_dir")]
    rows = drop_blank_pages(pages, text).select(
        *folder,
        U.host_of(F.col(url)).alias("host"),
        name.alias("file_name"),
        F.col(url).alias("url"),
        F.col(text).alias("page_text"),
    )
    write_by_host(rows, path, above=["base_output_dir"] if folder else [])
