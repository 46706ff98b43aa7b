"""Named hooks and sinks, and routing of tasks to them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.constants import DEFAULT_SPIDER
from sitegrain.errors import DuplicateNameError
from sitegrain.plans.staging import Staging

Hook = Callable[[Column], Column]
Sink = Callable[[DataFrame], None]


@dataclass
class Handler:
    hook: Hook | None = None
    sinks: Mapping[str, Sink] = field(default_factory=dict)


class Registry:
    """Handlers by name."""

    def __init__(self) -> None:
        self._handlers: dict[str, Handler] = {}
        self._shared: list[tuple[str, Sink, frozenset[str] | None]] = []

    def register(self, name: str, hook: Hook | None = None, sinks: Mapping[str, Sink] | None = None) -> None:
        if name in self._handlers:
            raise DuplicateNameError(name)
        self._handlers[name] = Handler(hook, dict(sinks or {}))

    def add_sink(self, name: str, sink: Sink, handlers: Iterable[str] | None = None) -> None:
        """A sink of several handlers, or of every one, those registered later included."""
        self._shared.append((name, sink, None if handlers is None else frozenset(handlers)))

    def sinks_of(self, handler: str) -> dict[str, Sink]:
        """All sinks of a handler by name, in name order."""
        sinks = dict(self._handlers[handler].sinks)
        for name, sink, handlers in self._shared:
            if handlers is None or handler in handlers:
                if name in sinks:
                    raise DuplicateNameError(name)
                sinks[name] = sink
        return dict(sorted(sinks.items()))

    def __getitem__(self, name: str) -> Handler:
        return self._handlers[name]

    def names(self) -> list[str]:
        return sorted(self._handlers)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n,) for n in self.names()], "name string")


def route_tasks(tasks: DataFrame, registry: DataFrame, spider: str = "spider") -> DataFrame:
    """Tasks with ``known``: whether their handler is registered. A task without a
    handler name goes to the default one."""
    named = tasks.withColumn(
        spider, F.coalesce(F.nullif(F.col(spider), F.lit("")), F.lit(DEFAULT_SPIDER))
    )
    names = registry.select(F.col("name").alias("_name")).distinct()
    return (
        named.join(names, F.col(spider) == F.col("_name"), "left")
        .withColumn("known", F.col("_name").isNotNull())
        .drop("_name")
    )


def unknown_tasks(tasks: DataFrame, registry: DataFrame, spider: str = "spider") -> DataFrame:
    """Tasks that would be skipped because no handler has their name."""
    return route_tasks(tasks, registry, spider).filter(~F.col("known")).drop("known")


def result_batches(results: DataFrame) -> DataFrame:
    """Results nested as ``task, results map<url, page_text>``, one page per batch, the
    way pages are handed on during a crawl."""
    return results.select("task", F.create_map("url", "page_text").alias("results"))


def run_sinks(
    batch: DataFrame, sinks: Mapping[str, Sink] | Iterable[tuple[str, Sink]], done: Callable[[str], None] = lambda name: None
) -> None:
    """Hand a batch to every sink in name order; ``done`` hears of each that has taken it. For
    several sinks the batch is written once to shared storage, from where each reads it."""
    ordered = sorted(dict(sinks).items())
    staging = Staging(batch.sparkSession, "sinks") if len(ordered) > 1 else None
    try:
        batch = staging.write(batch, "batch") if staging else batch
        for name, sink in ordered:
            sink(batch)
            done(name)
    finally:
        if staging:
            staging.release()
