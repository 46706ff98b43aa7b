"""Crawl tasks: parsing lines, filling defaults."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.constants import TASK_DEFAULTS
from sitegrain.functions.text import strip

TASK = (
    T.StructType()
    .add("url", "string")
    .add("base_output_dir", "string")
    .add("concurrent_limit", "integer")
    .add("max_depth", "integer")
    .add("level", "integer")
    .add("user_agent", "string")
    .add("use_splash", "boolean")
    .add("use_proxy", "boolean")
    .add("bs64", "boolean")
    .add("timeout", "integer")
    .add("time_wait", "integer")
    .add("spider", "string")
)
OPTIONS = [f for f in TASK if f.name != "url"]


def _override_map(overrides: Mapping[str, Any] | None) -> Column:
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    unknown = set(given) - {f.name for f in OPTIONS}
    if unknown:
        raise ValueError(f"unknown task options: {sorted(unknown)}")
    texts = [F.lit(x) for k, v in given.items() for x in (k, str(v).lower() if isinstance(v, bool) else str(v))]
    return F.create_map(*texts).cast("map<string,string>")


def parse_tasks(
    lines: DataFrame, overrides: Mapping[str, Any] | None = None, value: str = "value"
) -> DataFrame:
    """``kind, url, options map<string,string>`` per task line.

    A JSON object is a task of its own (``json``), a JSON string a bare URL task
    (``json``, no options), any other JSON a ``reject``; so is an object without a
    URL. A line that is no JSON is a URL (``url``) and takes the overrides; a blank
    line is the URL ``''``.
    """
    line = F.col("line")
    options = F.from_json(line, "map<string,string>")
    parsed = lines.select(strip(F.coalesce(F.col(value), F.lit(""))).alias("line")).withColumn(
        "json", F.try_parse_json("line")
    )
    shape = F.schema_of_variant(F.col("json"))
    kind = (
        F.when(F.col("json").isNull() | (line == ""), "url")
        .when(shape == "STRING", "json")
        .when(shape.startswith("OBJECT") & F.map_contains_key(options, "url"), "json")
        .otherwise("reject")
    )
    return parsed.withColumn("kind", kind).select(
        "kind",
        F.when(F.col("kind") == "url", line)
        .when(line.startswith('"'), F.try_variant_get(F.col("json"), "$", "string"))
        .when(F.col("kind") == "json", options["url"])
        .alias("url"),
        F.when(F.col("kind") == "url", _override_map(overrides))
        .when((F.col("kind") == "json") & ~line.startswith('"'), options)
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("options"),
    )


def typed_task_options(tasks: DataFrame) -> DataFrame:
    """Options as typed columns; null both for a missing key and for an explicit null."""
    return tasks.select(
        "kind", "url", *[F.col("options")[f.name].try_cast(f.dataType).alias(f.name) for f in OPTIONS]
    )


def resolve_task_defaults(tasks: DataFrame, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Task table with every option filled. A key that is present keeps its value, a
    null included; only a missing key takes the default. Rejects are left out."""
    defaults = {**TASK_DEFAULTS, **(defaults or {})}

    def filled(f: T.StructField) -> Column:
        return (
            F.when(F.map_contains_key("options", f.name), F.col("options")[f.name].try_cast(f.dataType))
            .otherwise(F.lit(defaults[f.name]).cast(f.dataType))
            .alias(f.name)
        )

    return tasks.filter(F.col("kind") != "reject").select("url", *[filled(f) for f in OPTIONS])


def union_tasks(tasks: DataFrame, urls: DataFrame, overrides: Mapping[str, Any] | None = None) -> DataFrame:
    """Parsed task lines plus extra URLs, which take the overrides like URL lines.

    Order is not kept: a task table has none.
    """
    extra = urls.select(F.lit("url").alias("kind"), "url", _override_map(overrides).alias("options"))
    return tasks.unionByName(extra)


def read_tasks(spark: SparkSession, path: str, overrides: Mapping[str, Any] | None = None) -> DataFrame:
    """Parsed tasks of a text file, one per line."""
    return parse_tasks(spark.read.text(path), overrides)
