"""Keyed result and content tables: merge, update, delete, purge."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.constants import LOG_RETENTION_DAYS
from sitegrain.errors import MissingRowsError
from sitegrain.operators.search import Filter, find_results, matches
from sitegrain.plans.staging import Staging

RESULTS = (
    T.StructType()
    .add("task", "string")
    .add("url", "string")
    .add("ref_content_id", "string")
    .add("update_time", "timestamp")
)
CONTENTS = (
    T.StructType()
    .add("content_id", "string")
    .add("filename", "string")
    .add("content", "binary")
    .add("length", "long")
    .add("upload_date", "timestamp")
    .add("content_type", "string")
    .add("metadata", T.MapType(T.StringType(), T.StringType()))
)


class Stored(NamedTuple):
    results: DataFrame
    contents: DataFrame


def _column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- inserting ------------------------------------------------------------------


def insert(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a stored table. Ids are ordinary columns of the rows."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def put_contents(
    df: DataFrame,
    key: str,
    body: str,
    content_id: Column | None = None,
    upload_date: Column | None = None,
    content_type: str | None = None,
) -> DataFrame:
    """Content rows for text or bytes; ``key`` becomes the file name."""
    raw = F.col(body)
    if not isinstance(df.schema[body].dataType, T.BinaryType):
        raw = F.encode(raw, "UTF-8")
    name = F.col(key).cast("string")
    return df.select(
        (F.md5(name) if content_id is None else content_id).alias("content_id"),
        name.alias("filename"),
        raw.alias("content"),
        F.length(raw).cast("bigint").alias("length"),
        (F.current_timestamp() if upload_date is None else upload_date).alias("upload_date"),
        F.lit(content_type).cast("string").alias("content_type"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def _content_ids(batch: DataFrame) -> DataFrame:
    """Adds an id derived from the whole row, so that a replayed row keeps its id."""
    time = F.unix_micros(F.col("update_time").cast("timestamp")).cast("string")
    return batch.withColumn(
        "content_id", F.md5(F.concat_ws("\u0000", "task", "url", time, F.md5("page_text")))
    )


def upsert_results(
    results: DataFrame, contents: DataFrame, batch: DataFrame, staging: Staging | None = None
) -> Stored:
    """Both tables after a batch of ``task, url, page_text, update_time``.

    The newest row per ``task, url`` wins. The batch is evaluated once and staged with
    its ids, so both tables agree on them whatever it holds (a current time, say). What
    wins, what goes and what is superseded is decided on narrow rows. Page bodies then
    only meet lists of ids whose size is known, so that a short list is broadcast and
    the bodies stay where they are. A batch of equal rows replayed changes nothing.

    Both tables read from ``staging``, which the caller may pass, and release once they
    are stored.
    """
    staging = staging or Staging(batch.sparkSession, "upsert")
    bodies = staging.write(_content_ids(batch.select("task", "url", "page_text", "update_time")), "batch")
    arrived = bodies.select("task", "url", F.col("content_id").alias("ref_content_id"), "update_time")
    known = results.select("task", "url", "ref_content_id", "update_time")
    merged = staging.write(
        known.unionByName(arrived)
        .groupBy("task", "url")
        .agg(F.max(F.struct("update_time", "ref_content_id")).alias("r"))
        .select("task", "url", "r.ref_content_id", "r.update_time"),
        "results",
    )
    live = merged.select("ref_content_id")
    counted = arrived.groupBy("ref_content_id").agg(F.count("*").alias("n"))
    # Old contents that were replaced, and ids the batch stores anew.
    leaving = staging.write(
        known.select("ref_content_id")
        .join(live, "ref_content_id", "left_anti")
        .unionByName(arrived.select("ref_content_id").join(live, "ref_content_id", "left_semi"))
        .select(F.col("ref_content_id").alias("content_id"))
        .distinct(),
        "leaving",
    )
    superseded = counted.join(live, "ref_content_id", "left_anti").withColumn("live", F.lit(False))
    repeated = counted.filter("n > 1").join(live, "ref_content_id", "left_semi").withColumn("live", F.lit(True))
    special = staging.write(
        superseded.unionByName(repeated).select(F.col("ref_content_id").alias("content_id"), "live"), "special"
    )

    single = bodies.join(special, "content_id", "left_anti")
    once = bodies.join(special.filter("live"), "content_id", "left_semi").dropDuplicates(["content_id"])
    fresh = put_contents(
        single.unionByName(once).withColumn("_name", F.md5("url")),
        "_name",
        "page_text",
        content_id=F.col("content_id"),
        upload_date=F.col("update_time"),
    )
    return Stored(merged, drop_replaced(contents, leaving).unionByName(fresh))


def drop_replaced(contents: DataFrame, replaced: DataFrame) -> DataFrame:
    """Contents whose id is not among the replaced ones."""
    return contents.join(replaced.select("content_id"), "content_id", "left_anti")


def content_by_name(contents: DataFrame, names: DataFrame) -> DataFrame:
    """The newest content per wanted file name."""
    wanted = contents.join(names.select("filename").distinct(), "filename", "left_semi")
    newest = (
        wanted.groupBy("filename")
        .agg(F.max(F.struct("upload_date", "content_id")).alias("c"))
        .select("filename", "c.content_id", "c.upload_date")
    )
    # An upload date may be null; the newest of a name then is null only if all are.
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"n.{x}")) for x in ("content_id", "upload_date")]
    on = (F.col("c.filename") == F.col("n.filename")) & same[0] & same[1]
    return contents.alias("c").join(newest.alias("n"), on, "left_semi")


# --- updating -------------------------------------------------------------------


def _updated(df: DataFrame, hit: Column, assignments: Mapping[str, Any]) -> DataFrame:
    """``df`` with the assignments made where ``hit``; every value reads the old row."""
    return df.select(
        *[
            F.when(hit, _column(assignments[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
            if c in assignments
            else F.col(c)
            for c in df.columns
        ],
        *[F.when(hit, _column(v)).alias(c) for c, v in assignments.items() if c not in df.columns],
    )


def _modified(df: DataFrame, hit: Column, assignments: Mapping[str, Any]) -> Column:
    changes = [
        ~F.col(c).eqNullSafe(_column(v)) if c in df.columns else _column(v).isNotNull()
        for c, v in assignments.items()
    ]
    return hit & reduce(lambda a, b: a | b, changes, F.lit(False))


def update_rows(
    df: DataFrame,
    condition: Filter,
    assignments: Mapping[str, Any],
    upsert: bool = False,
    ignore_missing: bool = False,
) -> DataFrame:
    """All matching rows with the assignments made.

    Nothing changed raises ``MissingRowsError``, unless ``upsert`` or
    ``ignore_missing``. ``upsert`` needs a dict condition and adds the row it
    describes when there is no match.
    """
    hit = F.coalesce(matches(condition), F.lit(False))
    out = _updated(df, hit, assignments)
    if ignore_missing and not upsert:
        return out
    seen = df.agg(
        F.count_if(hit).alias("matched"), F.count_if(_modified(df, hit, assignments)).alias("modified")
    ).first()
    if upsert and not seen["matched"]:
        if not isinstance(condition, Mapping):
            raise ValueError("upsert needs a dict condition")
        new = {**condition, **assignments}
        row = df.sparkSession.range(1).select(
            *[_column(new.get(f.name)).cast(f.dataType).alias(f.name) for f in out.schema]
        )
        return out.unionByName(row)
    if not seen["modified"] and not upsert:
        raise MissingRowsError("no row was updated")
    return out


class VersionedUpdate(NamedTuple):
    table: DataFrame
    outcomes: DataFrame


def update_versioned(
    df: DataFrame, updates: DataFrame, key: Sequence[str], version: str = "version"
) -> VersionedUpdate:
    """Optimistic updates, of which at most one per key is applied.

    ``updates`` holds the key, the version that was read (same column name) and the
    columns to set. An update older than the stored version is ``rejected``;
    otherwise it is ``applied`` and the version goes up by one. Of several updates of a
    key the one that read the highest version goes first, then the one with the largest
    values; the others are then overdue, hence ``rejected``. A stored null version
    counts as 0. Keys without a row are ``missing``. Outcomes have a row per update.
    """
    key = list(key)
    values = [c for c in updates.columns if c not in key and c != version]
    # Combined before the shuffle: a key with most of the updates is a row per task.
    sent = (
        updates.select(
            *key, F.coalesce(F.col(version), F.lit(0)).alias("_sent"), *[F.col(c).alias(f"_new_{c}") for c in values]
        )
        .groupBy(*key)
        .agg(F.count("*").alias("_asked"), F.max(F.struct("_sent", *[f"_new_{c}" for c in values])).alias("_first"))
        .select(*key, "_asked", "_first.*")
    )
    stored = F.coalesce(F.col(version), F.lit(0))
    ok = F.coalesce(F.col("_sent") >= stored, F.lit(False))
    joined = df.join(sent, key, "left")
    table = joined.select(
        *[
            F.when(ok, stored + 1).otherwise(F.col(c)).alias(c)
            if c == version
            else F.when(ok, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in df.columns
        ]
    )
    known = df.select(*key, version, F.lit(True).alias("_known"))
    each = sent.join(known, key, "left").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_asked"))))
    outcomes = each.select(
        *key,
        F.when(F.col("_known").isNull(), "missing")
        .when((F.col("_sent") >= stored) & (F.col("_turn") == 1), "applied")
        .otherwise("rejected")
        .alias("status"),
        F.when(F.col("_known").isNull(), F.lit(None))
        .when(F.col("_sent") >= stored, stored + 1)
        .otherwise(stored)
        .alias(version),
    )
    return VersionedUpdate(table, outcomes)


def update_by_partition(
    spark: SparkSession,
    path: str,
    condition: Filter,
    assignments: Mapping[str, Any],
    partition_col: str,
    ignore_missing: bool = False,
) -> None:
    """Update a table partitioned by ``partition_col``, rewriting only the partitions
    that hold a match. Rows stay in the task that read them: there is no shuffle, and
    a partition with most of the rows is rewritten by as many tasks as it has splits.

    New partitions are written beside the table and moved into place when all of them are there, so
    a job that fails leaves the table as it was."""
    if partition_col in assignments:
        raise ValueError("the partition column cannot be assigned")
    table = spark.read.parquet(path)
    hit = F.coalesce(matches(condition), F.lit(False))
    changed = table.filter(_modified(table, hit, assignments)).select(partition_col).distinct()
    if changed.isEmpty():
        if ignore_missing:
            return
        raise MissingRowsError("no row was updated")
    # The null partition is a partition like any other.
    same = F.col(f"t.`{partition_col}`").eqNullSafe(F.col(f"x.`{partition_col}`"))
    touched = table.alias("t").join(changed.alias("x"), same, "left_semi")
    draft = f"{path.rstrip('/')}/_update-{uuid.uuid4().hex}"
    try:
        _updated(touched, hit, assignments).write.partitionBy(partition_col).parquet(f"{draft}/new")
        _move_partitions(spark, f"{draft}/new", path, f"{draft}/old")
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(draft)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _move_partitions(spark: SparkSession, new: str, path: str, old: str) -> None:
    """Put the partition folders of ``new`` in the place of those of ``path``. One that cannot be put
    there gives its place back."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(old))
    for folder in [s.getPath() for s in fs.listStatus(at(new)) if s.isDirectory()]:
        name = folder.getName()
        place, aside = at(at(path), name), at(at(old), name)
        if not fs.rename(place, aside):
            raise OSError(f"{place} cannot be moved")
        if not fs.rename(folder, place):
            fs.rename(aside, place)
            raise OSError(f"{folder} cannot be moved")


# --- deleting -------------------------------------------------------------------


def delete_rows(df: DataFrame, condition: Filter, ignore_missing: bool = False) -> DataFrame:
    """Rows that do not match. A delete that finds nothing raises ``MissingRowsError``
    unless ``ignore_missing``."""
    hit = F.coalesce(matches(condition), F.lit(False))
    if not ignore_missing and df.filter(hit).isEmpty():
        raise MissingRowsError("no row was deleted")
    return df.filter(~hit)


def delete_contents(
    results: DataFrame,
    contents: DataFrame,
    task: str | None = None,
    url: str | None = None,
    cascade: bool = False,
) -> Stored:
    """Content of the selected results removed. The result rows stay, and dangle,
    unless ``cascade``."""
    gone = find_results(results, task, url).select(F.col("ref_content_id").alias("content_id")).distinct()
    kept = drop_replaced(contents, gone)
    if cascade:
        results = results.join(gone, F.col("ref_content_id") == F.col("content_id"), "left_anti")
    return Stored(results, kept)


def purge_overdue(
    results: DataFrame, older_than: str, now: Column | None = None, time: str = "update_time"
) -> DataFrame:
    """Rows not older than an interval such as ``'30 days'``. Rows without a time stay."""
    now = F.current_timestamp() if now is None else now
    return results.filter(F.coalesce(F.col(time) >= now - F.expr(f"interval {older_than}"), F.lit(True)))


def purge_by_whole_days(
    df: DataFrame, time: str, days: int = LOG_RETENTION_DAYS, now: Column | None = None
) -> DataFrame:
    """Rows whose age in whole 24-hour days is at most ``days``. Rows without a time stay."""
    now = F.current_timestamp() if now is None else now
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))
    return df.filter(F.coalesce(F.floor(seconds / 86400) <= days, F.lit(True)))
