"""Finding, counting and paging stored rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.plans.staging import Staging

Filter = Column | Mapping[str, Any] | None


def matches(condition: Filter) -> Column:
    """A filter given as a column or as equalities; a null value matches null."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, Mapping):
        return reduce(
            lambda a, b: a & b,
            [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in condition.items()],
            F.lit(True),
        )
    return condition


def find(
    df: DataFrame, condition: Filter = None, projection: Sequence[str] | None = None, id_col: str | None = None
) -> DataFrame:
    """Matching rows, reduced to the chosen columns; ``id_col`` always comes along."""
    rows = df.filter(matches(condition))
    if not projection:
        return rows
    return rows.select(*dict.fromkeys(([id_col] if id_col else []) + list(projection)))


def find_one(df: DataFrame, condition: Filter = None, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first matching row in the given order, as a table of at most one row."""
    if not order_by:
        raise ValueError("find_one needs an order, or its row is arbitrary")
    return df.filter(matches(condition)).orderBy(*order_by).limit(1)


def count_matching(df: DataFrame, condition: Filter = None) -> DataFrame:
    """Number of matching rows as a one-row table."""
    return df.filter(matches(condition)).agg(F.count("*").alias("n"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row per key. Combined before the shuffle, so that a key with most of
    the rows arrives as one row per input task."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def find_results(
    results: DataFrame,
    task: str | None = None,
    url: str | None = None,
    tiebreak: str = "ref_content_id",
) -> DataFrame:
    """Results of a task and/or URL, newest first; only the newest when a URL is given."""
    if not (task or url):
        raise ValueError("give a task, a URL, or both")
    wanted = {k: v for k, v in (("task", task), ("url", url)) if v}
    rows = results.filter(matches(wanted)).orderBy(F.desc("update_time"), F.desc(tiebreak))
    return rows.limit(1) if url else rows


def latest_per_url(results: DataFrame, tiebreak: str = "ref_content_id") -> DataFrame:
    """``find_results`` for every task and URL at once."""
    return latest_per_key(results, ["task", "url"], ["update_time", tiebreak])


def page_rows(
    df: DataFrame,
    sort: str,
    tiebreak: str,
    offset: int = 0,
    limit: int = 0,
    condition: Filter = None,
) -> tuple[DataFrame, int]:
    """One page of rows sorted descending, and the number of rows before paging.

    ``tiebreak`` makes the order total; of rows equal in both columns all come along if one
    does. A limit of 0 means all rows; nulls come last. The two columns alone are dealt into
    sorted, written runs, whose sizes tell where the page begins and ends. Rows between those
    two keys are then read with all their columns, so no task holds the rows that were skipped.
    """
    rows = df.filter(matches(condition))
    keys = rows.select(F.col(sort).alias("_s"), F.col(tiebreak).alias("_t"))
    runs, sizes = _sorted_runs(keys, [F.desc("_s"), F.desc("_t")])
    total = sum(sizes.values())
    end = min(total, offset + limit) if limit else total
    if offset >= end:
        return rows.filter(F.lit(False)), total
    s, t, page = F.col(sort), F.col(tiebreak), rows
    if offset:
        first = _key_at(runs, sizes, offset)
        page = page.filter(~_precedes(s, t, first["_s"], first["_t"]))
    if end < total:
        last = _key_at(runs, sizes, end - 1)
        page = page.filter(~_precedes(last["_s"], last["_t"], s, t))
    return page.orderBy(F.desc(sort), F.desc(tiebreak)), total


def _precedes(s: Column, t: Column, other_s: Column, other_t: Column) -> Column:
    """Whether key ``(s, t)`` comes before another one, descending with nulls last."""

    def larger(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), False).when(b.isNull(), True).otherwise(a > b)

    return larger(s, other_s) | (s.eqNullSafe(other_s) & larger(t, other_t))


def _key_at(runs: DataFrame, sizes: Mapping[int, int], rank: int) -> Column:
    """The key with ``rank`` keys before it, as a scalar of the run that has it."""
    for run in sorted(sizes):
        if rank < sizes[run]:
            break
        rank -= sizes[run]
    place = F.row_number().over(Window.partitionBy("_run").orderBy(F.desc("_s"), F.desc("_t")))
    numbered = runs.filter(F.col("_run") == run).withColumn("_n", place)
    return numbered.filter(F.col("_n") == rank + 1).select(F.struct("_s", "_t")).scalar()


def _sorted_runs(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, dict[int, int]]:
    """Rows dealt by ranges of ``order``, ``_run`` being the range, and rows per run. Written
    once, because run numbers must not change between counting and cutting."""
    runs = Staging(rows.sparkSession, "paging").write(
        rows.repartitionByRange(*order).withColumn("_run", F.spark_partition_id()), "runs"
    )
    return runs, dict(runs.groupBy("_run").count().collect())


def _cut_sorted(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    runs, sizes = _sorted_runs(rows, order)
    total, end = sum(sizes.values()), offset + limit if limit else None
    before, wanted = 0, []
    for run, n in sorted(sizes.items()):
        if before + n > offset and (end is None or before < end):
            wanted.append((run, offset - before, None if end is None else end - before))
        before += n
    if not wanted:
        return runs.filter(F.lit(False)).drop("_run"), total
    (first, skip, _), (last, _, keep) = wanted[0], wanted[-1]
    inside = runs.filter(F.col("_run").between(first, last))
    # Only the runs at both ends need row numbers.
    edge = F.col("_run").isin(first, last)
    numbered = inside.filter(edge).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_run").orderBy(*order))
    )
    cut = numbered.filter((F.col("_run") != first) | (F.col("_n") > skip))
    if keep is not None:
        cut = cut.filter((F.col("_run") != last) | (F.col("_n") <= keep))
    whole = inside.filter(~edge)
    return cut.drop("_n").unionByName(whole).drop("_run").orderBy(*order), total


def aggregate_paged(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    order_by: Sequence[Column],
    offset: int = 0,
    limit: int = 0,
) -> tuple[DataFrame, int]:
    """A caller's aggregation, then one page of its rows in ``order_by``, and its total."""
    return _cut_sorted(fn(df), order_by, offset, limit)
