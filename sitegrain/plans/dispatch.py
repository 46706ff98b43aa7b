"""Crawling a task table with registered handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.operators.export import save_pages
from sitegrain.operators.links import LEVELS
from sitegrain.operators.routing import Registry, route_tasks
from sitegrain.plans.crawl import Crawl, crawl, task_id


def _runnable() -> Column:
    return F.coalesce(F.col("level").isin(*LEVELS) & F.col("max_depth").isNotNull(), F.lit(False))


def rejected_tasks(tasks: DataFrame, registry: Registry) -> DataFrame:
    """Tasks ``crawl_tasks`` leaves out: no such handler, an impossible level, no depth."""
    routed = route_tasks(tasks, registry.table(tasks.sparkSession))
    return routed.filter(~F.col("known") | ~_runnable()).drop("known")


def crawl_tasks(
    tasks: DataFrame,
    pages: DataFrame,
    registry: Registry,
    output: str | None = None,
    naming: str = "escaped",
    **options,
) -> Crawl:
    """Walk all tasks of a resolved task table at once, then hand every handler the kept
    pages of its own tasks: its hook first, then its sinks in name order. Pages of a
    handler without sinks are saved under ``output`` when that is given, as the task options
    ``bs64`` and ``base_output_dir`` say if the task table has them.

    Bodies are joined once for all handlers and written by handler, with the hooks applied; every
    sink reads its handler's part. A task of several handlers comes to each of them. The
    walk's ``release`` deletes that table too.
    """
    routed = route_tasks(tasks, registry.table(tasks.sparkSession)).filter(F.col("known") & _runnable())
    walk = crawl(routed.select("url", "level", "max_depth"), pages, **options)
    names = [n for n in registry.names() if registry.sinks_of(n) or output]
    if not names:
        return walk
    saving = [c for c in ("bs64", "base_output_dir") if c in tasks.columns]
    task = task_id(F.col("url"), F.col("level"), F.col("max_depth")).alias("task_id")
    owners = routed.filter(F.col("spider").isin(names)).select(task, "spider", *saving)
    # One row per task and handler, so that a body is joined and handed on once.
    owners = owners.groupBy("task_id", "spider").agg(F.collect_set(F.struct(*saving or ["spider"])).alias("saves"))
    text = F.col("page_text")
    for name in names:
        if registry[name].hook:
            text = F.when(F.col("spider") == name, registry[name].hook(F.col("page_text"))).otherwise(text)
    kept = walk.results.join(owners, "task_id").withColumn("page_text", text)
    parts = walk.keep(kept, "bodies", "spider")
    for name in names:
        own = parts.filter(F.col("spider") == name).drop("spider")
        sinks = registry.sinks_of(name)
        for sink in sinks.values():
            sink(own.drop("saves"))
        if not sinks:
            each = own.select("*", F.explode("saves").alias("o")).select("url", "page_text", "o.*") if saving else own
            save_pages(each, output, naming, **{c: c for c in saving})
    return walk
