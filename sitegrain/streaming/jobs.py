"""Streams of tasks, pages and visits.

Sources are file streams and every run uses ``availableNow``, so it ends once the
files that were there at its start are done. Run again with the same checkpoint, a
job picks up what is new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sitegrain.constants import TASK_MAX_AGE_SECONDS
from sitegrain.operators.keyed import KeyedTables
from sitegrain.operators.links import extract_links
from sitegrain.operators.routing import Sink, run_sinks
from sitegrain.operators.search import latest_per_key
from sitegrain.operators.store import CONTENTS, RESULTS, Stored, upsert_results
from sitegrain.plans.staging import Staging
from sitegrain.sources.tasks import parse_tasks


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_tasks(
    spark: SparkSession, path: str, overrides: Mapping[str, Any] | None = None, max_files: int | None = None
) -> DataFrame:
    """Task lines arriving as text files, parsed."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_tasks(reader.text(path), overrides)


def _event_time(stream: DataFrame, time: str, seconds: int) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{seconds} seconds")


def _combine(stream: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Repeats inside an Arrow batch reduced to their newest row.

    Stateful operators have no map-side combine. Without this step every message of a
    key that dominates the stream would reach one task.
    """
    keys = list(keys)

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(time, kind="stable").drop_duplicates(keys, keep="last")

    return stream.mapInPandas(newest, stream.schema)


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _one_per_instant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an Arrow batch that agree in key and time reduced to one, the least of the rest."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        same = [c for c in t.column_names if c != "_rest"]
        firsts = t.sort_by("_rest").group_by(same, use_threads=False).aggregate([("_rest", "first")])
        yield from firsts.rename_columns({"_rest_first": "_rest"}).select(t.column_names).combine_chunks().to_batches()


def _as_grouped(stream: DataFrame, key: str) -> Column:
    """A key column in which equal values are written alike: zero has no sign."""
    of = stream.schema[key].dataType
    plain = F.col(f"`{key}`")
    return (F.when(plain == 0, F.lit(0).cast(of)).otherwise(plain) if isinstance(of, T.FractionalType) else plain).alias(key)


def dedup_tasks(
    stream: DataFrame, keys: Sequence[str], time: str, max_age_seconds: int = TASK_MAX_AGE_SECONDS, buckets: int = 4096
) -> DataFrame:
    """Tasks without repeats: a row is dropped if the last row of its key that was let through is
    less than ``max_age_seconds`` before it. Messages older than that behind the newest of earlier
    micro-batches are dropped as expired, and so are rows without a time.

    The time of the last row let through is kept per key, and forgotten once no row within
    the age can come any more. A micro-batch is walked in order of time, so rows that arrive in that
    order give the same result however they are cut into micro-batches. Rows of one key and
    instant are combined before the shuffle (the least of their other columns stays); further apart,
    any of them may be the next to be let through, so none can be left out before the state is known.

    Keys are walked by ``buckets`` of their hash, each with the times of its keys as its state, since a call of Python
    for every key costs far more than its rows. A micro-batch reads and writes the state of the buckets it touches.
    A checkpoint belongs to one number of buckets.
    """
    keys, rest = list(keys), [c for c in stream.columns if c not in keys and c != time]
    age = max_age_seconds * 1_000_000
    packed = stream.where(F.col(time).isNotNull()).select(
        F.to_json(F.struct(*[_as_grouped(stream, k) for k in keys]), _JSON).alias("_key"),
        F.col(time).cast("timestamp").alias("_time"),
        F.to_json(F.struct(*rest), _JSON).alias("_rest") if rest else F.lit("{}").alias("_rest"),
    )
    timed = packed.mapInArrow(_one_per_instant, packed.schema).withWatermark("_time", f"{max_age_seconds} seconds")
    timed = timed.withColumn("_us", F.unix_micros("_time")).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))

    def walk(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, passed = dict(zip(*state.get, strict=True)) if state.exists else {}, []
        if not state.hasTimedOut:
            rows = pd.concat([f[["_key", "_us", "_rest"]] for f in frames]).sort_values(["_us", "_rest"])
            for i, (key, us) in enumerate(zip(rows["_key"].tolist(), rows["_us"].tolist(), strict=True)):
                if key not in last or us - last[key] >= age:
                    passed.append(i)
                    last[key] = us
        now = state.getCurrentWatermarkMs()
        last = {key: us for key, us in last.items() if (us + age) // 1000 >= now}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp((max(last.values()) + age) // 1000 + 1)
        elif state.exists:
            state.remove()
        if passed:
            yield rows.iloc[passed].reset_index(drop=True)

    walked = timed.groupBy("_bucket").applyInPandasWithState(
        walk, "_key string, _us long, _rest string", "keys array<string>, last array<long>", "append", "EventTimeTimeout"
    )
    of_key, of_rest = (F.from_json(c, T.StructType([stream.schema[k] for k in names]), _JSON) for c, names in (("_key", keys), ("_rest", rest)))
    columns = {time: F.timestamp_micros("_us"), **{k: of_key[k] for k in keys}, **{c: of_rest[c] for c in rest}}
    return walked.select(*[columns[c].alias(c) for c in stream.columns])


def dedup_tasks_per_window(
    stream: DataFrame, keys: Sequence[str], time: str, max_age_seconds: int = TASK_MAX_AGE_SECONDS
) -> DataFrame:
    """One row per key and window of ``max_age_seconds``: ``keys, window_start``. The
    result does not depend on how the stream is cut into micro-batches."""
    start = F.window(F.col(time).cast("timestamp"), f"{max_age_seconds} seconds")["start"]
    columns = [*keys, "window_start"]
    windowed = _combine(stream.select(*keys, start.alias("window_start")), columns, "window_start")
    return _event_time(windowed, "window_start", max_age_seconds).dropDuplicates(columns)


def stream_links(
    pages: DataFrame, level: int = 0, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Links of each page as it arrives. De-duplicated inside the page, hence stateless."""
    return extract_links(pages, level, key, url, html)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream into a parquet table, each row exactly once."""
    _finish(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)


def run_upsert(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of changes into a change table, one partition per micro-batch.

    A batch only adds files. Replayed, it overwrites its own partition, so nothing is
    stored twice. ``read_upserted`` gives the current rows.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    _finish(stream.writeStream.foreachBatch(save), checkpoint)


def page_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTables:
    """Results and contents by ``task, url``, as ``run_page_upsert`` keeps them. Contents carry their key."""
    contents = T.StructType([*RESULTS.fields[:2], *CONTENTS.fields])
    return KeyedTables(spark, path, ["task", "url"], {"results": RESULTS, "contents": contents}, buckets)


def run_page_upsert(pages: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Run a stream of ``task, url, page_text, update_time`` into a page store.

    Each micro-batch replaces result and content of its pages, the newest row per ``task, url`` winning.
    Only buckets with one of these pages are read and written. Both tables change at once,
    and a batch that is replayed changes nothing.
    """
    spark = pages.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        staging = Staging(spark, "page-upsert")

        def change(now: dict[str, DataFrame], arrived: DataFrame) -> dict[str, DataFrame]:
            after = upsert_results(now["results"], now["contents"].drop("task", "url"), arrived, staging)
            owner = after.results.select("task", "url", F.col("ref_content_id").alias("content_id"))
            return {"results": after.results, "contents": after.contents.join(owner, "content_id")}

        try:
            page_store(spark, path, buckets).apply(batch, change, _query_id(spark, checkpoint), batch_id)
        finally:
            staging.release()

    _finish(pages.writeStream.foreachBatch(save), checkpoint)


def read_page_store(spark: SparkSession, path: str, buckets: int = 64) -> Stored:
    """Current results and contents."""
    store = page_store(spark, path, buckets)
    manifest = store.manifest()
    return Stored(store.read("results", manifest=manifest), store.read("contents", manifest=manifest).drop("task", "url"))


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row per key of a change table."""
    return latest_per_key(spark.read.parquet(path).drop("batch"), keys, order_by)


def compact_upserted(
    spark: SparkSession, path: str, into: str, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """Write the current rows of a change table as the first partition of a new one."""
    latest = read_upserted(spark, path, keys, order_by)
    latest.withColumn("batch", F.lit(-1).cast("bigint")).write.partitionBy("batch").parquet(into)


def run_sinks_per_batch(stream: DataFrame, sinks: Mapping[str, Sink], checkpoint: str) -> None:
    """Hand every micro-batch to the sinks in name order.

    A sink that has taken a batch is noted in a ledger inside the checkpoint, which belongs to one
    query. When a batch that failed is run again, only the sinks without a note get it; one that
    failed midway sees its rows again.
    """
    spark = stream.sparkSession

    def note(batch_id: int, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/sinks/{batch_id}/{quote(name, safe='')}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def noted(batch_id: int, name: str) -> bool:
        files, path = note(batch_id, name)
        return files.exists(path)

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        def done(name: str) -> None:
            files, path = note(batch_id, name)
            files.createNewFile(path)

        run_sinks(batch, {n: s for n, s in sinks.items() if not noted(batch_id, n)}, done)

    _finish(stream.writeStream.foreachBatch(hand_on), checkpoint)


def count_by(stream: DataFrame, *keys: str) -> DataFrame:
    """Running row counts per key. Keys must be few, such as tasks or outcomes: they
    are the state."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def crawl_counters(visits: DataFrame, *keys: str) -> DataFrame:
    """Running counters per task (``keys``) of a stream of visits: ``downloads``, ``success``, ``useless``, as
    ``crawl_stats`` counts them."""
    outcome, state = F.col("outcome"), F.col("page_state")
    return visits.groupBy(*keys).agg(
        F.count_if(outcome.isin("success", "failed")).alias("downloads"),
        F.count_if(outcome == "success").alias("success"),
        F.count_if(F.coalesce(state.isin("blank", "useless"), F.lit(False))).alias("useless"),
    )


def _totals_table(spark: SparkSession, path: str, query: str, schema: T.StructType, keys: Sequence[str]) -> KeyedTables:
    return KeyedTables(spark, f"{path}/{query}", keys, {"totals": schema}, 16)


def run_totals(totals: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> None:
    """Run an aggregating stream. A micro-batch hands on the keys that changed, whose totals take the
    place of the older ones in a table by key; each query has a folder of its own. ``keys`` are by
    default the columns that are no whole numbers."""
    spark, schema = totals.sparkSession, totals.schema
    keys = list(keys) or [f.name for f in schema if not isinstance(f.dataType, T.LongType)]

    def save(batch: DataFrame, batch_id: int) -> None:
        def change(now: dict[str, DataFrame], arrived: DataFrame) -> dict[str, DataFrame]:
            same = [F.col(f"n.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in keys]
            kept = now["totals"].alias("n").join(arrived.alias("a"), reduce(lambda x, y: x & y, same), "left_anti")
            return {"totals": kept.unionByName(arrived)}

        query = _query_id(spark, checkpoint)
        _totals_table(spark, path, query, schema, keys).apply(batch, change, query, batch_id)

    _finish(totals.writeStream.outputMode("update").foreachBatch(save), checkpoint)


def read_totals(spark: SparkSession, path: str, checkpoint: str, schema: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The totals of the query that owns ``checkpoint``, as ``run_totals`` left them."""
    return _totals_table(spark, path, _query_id(spark, checkpoint), schema, keys).read("totals")


def _finish(writer, checkpoint: str) -> None:
    query: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
