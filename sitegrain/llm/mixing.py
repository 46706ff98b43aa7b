"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from weights and a limit on repeats. The mix is cut into equal blocks of
words; blocks go to sources, and each source's blocks to its shards, by highest quotients
(votes / 1, / 3, / 5 …), so quotas are whole numbers that add up. Inside a shard documents
stand in a seeded order on a ring, and a quota takes that many blocks in a row from a
seeded start. Shards hold about ``shard_words`` words whatever the source's size, so no
window, group or task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.llm.common import SPACE_RUN, SPACES
from sitegrain.plans.staging import Staging

#: Bounds tried at once, and rounds of it: the quotients left between two bounds are then few.
_GRID, _ROUNDS = 16, 3


def word_count(text: Column) -> Column:
    """Number of words between white space, long; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def ranked(values: DataFrame, column: str, stage: Staging, name: str) -> DataFrame:
    """``values`` with ``_rank`` from 0 in the order of ``column``, nulls last. Ranks are counted
    inside range partitions and shifted by what lies before, so no task sorts everything."""
    order = F.col(column).asc_nulls_last()
    parts = stage.write(
        values.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), f"{name}-parts"
    )
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = values.sparkSession.createDataFrame(starts, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_rank", within - 1).join(before, "_part").withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame, stage: Staging, max_repeats: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``source, source_size, target``. Sources by code point, null last, weigh ``weights`` in
    turn and share the words of all of them; a target stops at ``max_repeats`` times its
    source's size, and what is above is shared anew by weight until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranks = stage.write(ranked(sizes, "source", stage, "sources").withColumn("_w", weight).withColumn("_most", max_repeats * F.col("source_size").cast("double")), "weights")
    level, capped = 0.0, -1
    while True:
        # Sources at or below the level reached are full; the level never falls, so the set only grows.
        full = F.col("_most") <= F.lit(level) * F.col("_w")
        row = ranks.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("_most"))).alias("given"),
            F.sum(F.when(~full, F.col("_w"))).alias("w"),
            F.count_if(full).alias("n"),
        ).first()
        if not row["all"] or row["w"] is None or row["n"] == capped:
            break
        capped = row["n"]
        level = (row["all"] - (row["given"] or 0.0)) / row["w"]
    return ranks.select("source", "source_size", F.least("_most", F.lit(level) * F.col("_w")).alias("target"))


def apportion(cells: DataFrame, group: list[str], key: list[str], stage: Staging, name: str) -> DataFrame:
    """Highest quotients. ``cells`` has ``group`` and ``key`` columns (never null), ``votes`` (double) and
    the group's number of ``_seats``; gives ``group``, ``key`` and ``quota`` (long).

    A bound q gives each cell as many seats as it has quotients of q or more. The right
    bound is bracketed from votes and seats, narrowed by trying a grid of bounds in one
    pass, and the quotients left inside are ranked; ties go by ``key``.
    """
    seats_at = lambda bound: F.floor((F.col("votes") / bound + 1) / 2)
    cells = cells.where(F.col("votes") > 0)
    n, v, s = F.count(F.lit(1)), F.sum("votes"), F.max("_seats")
    bounds = stage.write(
        cells.groupBy(*group).agg(
            (v / (2 * s + n + 1)).alias("_low"),
            F.when(2 * s > n, v / (2 * s - n)).otherwise(F.max("votes") * 1.001).alias("_high"),
        ),
        f"{name}-bounds0",
    )
    for r in range(1, _ROUNDS + 1):
        tried = [F.col("_low") + (F.col("_high") - F.col("_low")) * (i / _GRID) for i in range(_GRID + 1)]
        counts = cells.join(bounds, group).groupBy(*group, "_low", "_high").agg(
            F.max("_seats").alias("_seats"), F.array(*[F.sum(seats_at(t)) for t in tried]).alias("_counts")
        )
        # The largest bound that still gives out all seats, and the one after it.
        last = F.greatest(F.size(F.filter("_counts", lambda c: c >= F.col("_seats"))) - 1, F.lit(0))
        at = lambda i: F.col("_low") + (F.col("_high") - F.col("_low")) * F.least(i, F.lit(_GRID)) / _GRID
        bounds = stage.write(counts.select(*group, at(last).alias("_low"), at(last + 1).alias("_high")), f"{name}-bounds{r}")
    given = cells.join(bounds, group).select(*group, *key, "votes", "_seats", seats_at(F.col("_high")).alias("_sure"), seats_at(F.col("_low")).alias("_can"))
    given = stage.write(given, f"{name}-given")
    left = given.groupBy(*group).agg((F.max("_seats") - F.sum("_sure")).alias("_left"))
    order = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *key, "_seat")
    extra = (
        given.where("_can > _sure")
        .withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_can"))))
        .withColumn("_quotient", F.col("votes") / (2 * F.col("_seat") - 1))
        .withColumn("_place", F.row_number().over(order))
        .join(left, group)
        .where(F.col("_place") <= F.col("_left"))
        .groupBy(*group, *key)
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    return given.join(extra, group + key, "left").select(*group, *key, (F.col("_sure") + F.coalesce("_extra", F.lit(0))).cast("long").alias("quota"))


def _taken(start: Column, size: Column, cell: Column, take: Column, begin: Column) -> Column:
    """Words of [start, start + size) that ``take`` words in a row take from a ring of ``cell``
    words, beginning at ``begin`` and going round as often as needed."""
    whole, rest = F.floor(take / cell), take % cell
    overlap = lambda a, b: F.greatest(F.least(start + size, b) - F.greatest(start, a), F.lit(0).cast("long"))
    end = begin + rest
    return (whole * size + overlap(begin, F.least(end, cell)) + overlap(F.lit(0).cast("long"), end - cell)).cast("long")


def _source_id() -> Column:
    """Sources as numbers, so that null is a key like any other."""
    return F.xxhash64(F.col("source").isNull(), "source")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"_size": word_count(F.col("text")), "_h": F.xxhash64(F.lit(seed), "doc_id", "text"), "_sid": _source_id()})


def quotas(sizes: DataFrame, stage: Staging, seed: int, block_words: int, shard_words: int, max_repeats: int, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """From rows with ``source, _sid, _size, _h``: the sources (``_sid, _shards``), and the words
    to take from each shard (``_sid, _shard, _cell, _source_size, _target, _take``)."""
    goal = targets(sizes.groupBy("source").agg(F.sum("_size").alias("source_size")), stage, max_repeats, weights)
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    goal = stage.write(goal.select(_source_id().alias("_sid"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), shards.alias("_shards")), "goal")
    total = goal.agg(F.sum("_source_size")).first()[0] or 0
    blocks = F.lit(round(total / block_words)).cast("long").alias("_seats")
    by_source = apportion(goal.select(F.lit(0).alias("_all"), "_sid", F.col("_target").alias("votes"), blocks), ["_all"], ["_sid"], stage, "blocks")
    cells = stage.write(_sharded(sizes, goal, seed).groupBy("_sid", "_shard").agg(F.sum("_size").alias("_cell")), "cells")
    votes = cells.join(by_source.select("_sid", F.col("quota").alias("_seats")), "_sid").withColumn("votes", F.col("_cell").cast("double"))
    by_shard = apportion(votes, ["_sid"], ["_shard"], stage, "shards")
    words = F.least(F.coalesce("quota", F.lit(0)) * block_words, F.col("_cell") * max_repeats).alias("_take")
    take = (
        cells.join(by_shard, ["_sid", "_shard"], "left")
        .join(goal, "_sid")
        .select("_sid", "_shard", "_cell", "_source_size", "_target", words)
    )
    return goal.select("_sid", "_shards"), stage.write(take, "take")


def _sharded(rows: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    return rows.join(goal.select("_sid", "_shards"), "_sid").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("_shards")))


def _laid_out(rows: DataFrame, goal: DataFrame, take: DataFrame, seed: int) -> DataFrame:
    """``rows`` with what the mix takes of each."""
    ring = Window.partitionBy("_sid", "_shard").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "_sid", "_shard"), F.greatest("_cell", F.lit(1)))
    placed = _sharded(rows, goal, seed).join(take, ["_sid", "_shard"]).withColumns({"_start": F.sum("_size").over(ring) - F.col("_size"), "_begin": begin})
    taken = F.when(F.col("_cell") > 0, _taken(F.col("_start"), F.col("_size"), F.col("_cell"), F.col("_take"), F.col("_begin"))).otherwise(0)
    return placed.withColumn("_taken", taken.cast("long"))


def mix(
    docs: DataFrame, stage: Staging, seed: int = 7, block_words: int = 8, shard_words: int = 1 << 16,
    max_repeats: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0),
) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_taken`` (long) and ``_target`` (double).

    ``_taken`` is the number of words the mix takes from a row, repeats counted: at most
    ``max_repeats`` times its size, and per source within a block of the target. Rows are
    ordered by a seeded hash of ``doc_id`` and text; equal rows stand side by side, and which of them
    is the first makes no difference. Null and empty texts have no words and give none; null
    sources are one source; empty tables give no rows. Other columns pass through; names that begin
    with an underscore are reserved.
    """
    sized = _sized(docs, seed)
    goal, take = quotas(stage.write(sized.select("source", "_sid", "_size", "_h"), "sizes"), stage, seed, block_words, shard_words, max_repeats, weights)
    return _laid_out(sized, goal, take, seed).select(*[F.col(f"`{c}`") for c in docs.columns], "_size", "_source_size", "_target", "_taken")


def mix_report(docs: DataFrame, stage: Staging, seed: int = 7, block_words: int = 8, shard_words: int = 1 << 16, max_repeats: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``; texts are read once."""
    sizes = stage.write(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    goal, take = quotas(sizes, stage, seed, block_words, shard_words, max_repeats, weights)
    return _laid_out(sizes, goal, take, seed).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )
