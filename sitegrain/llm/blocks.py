"""Groups of rows dealt out as blocks, for operators that compare the members of a group.

A group is cut into blocks of bounded size and every two blocks of it meet in one cell, so no
group is gathered in one place. Cells arrive sorted in Arrow batches; a task sees one at a time.
Comparisons return a spanning forest of the pairs they find: as many rows as members at most,
whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns held by this many members and more are multiplied as dense blocks of this many columns.
DENSE_DF, DENSE_COLUMNS = 32, 2048


def deal(rows: DataFrame, group: str, member: str, n_blocks: Column) -> DataFrame:
    """``rows`` with ``cell``, once for every pair of blocks (and block alone, if there is one)
    that holds the row. ``n_blocks`` is the number of blocks of the row's group."""
    mine = F.pmod(F.xxhash64(member), F.col("_n")).cast("int")
    pairs = F.when(
        F.col("_n") > 1,
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), lambda b: b != F.col("_b")),
            lambda b: F.struct(F.least(b, F.col("_b")).alias("i"), F.greatest(b, F.col("_b")).alias("j")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    dealt = rows.withColumn("_n", n_blocks).withColumn("_b", mine).withColumn("_p", F.explode(pairs))
    return dealt.withColumn("cell", F.xxhash64(group, "_p.i", "_p.j")).drop("_n", "_b", "_p")


def by_cell(dealt: DataFrame, compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], columns: list[str]) -> DataFrame:
    """``a, b`` from ``compare`` of every cell's rows (``columns``; ``c`` names the member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if t.num_rows > 1:
                a, b = compare(t)
                if len(a):
                    c = t["c"].to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])], ["a", "b"])

        for batch in batches:
            cells = batch["cell"].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e == s:
                    continue
                if held and held[-1]["cell"][0].as_py() != cells[s]:
                    yield from out()
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from out()

    # A fixed number of partitions: little data, much work.
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("cell", *columns).repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def forest(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of a graph of ``m`` nodes; ``near(i, others)`` tells which of ``others`` have an edge to ``i``.

    A node meets only nodes not reached yet, so a dense group costs little more than its size."""
    left, a, b = np.arange(m), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), i))
            b.append(found)
            todo.extend(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def overlaps(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many columns each two rows of an incidence matrix share: the product with its transpose.

    Columns of few rows add one to each of their pairs; the others are dense blocks of columns."""
    m = len(first) - 1
    row = np.repeat(np.arange(m), np.diff(first))
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
    df = np.diff(np.append(start, len(token)))
    out = np.zeros(m * m, np.int32)
    few = np.repeat((df > 1) & (df <= DENSE_DF), df)
    t, r = token[few], row[few]
    for d in range(1, DENSE_DF):
        same = np.flatnonzero(t[d:] == t[:-d])
        if not len(same):
            break
        np.add.at(out, r[same] * m + r[same + d], 1)
    out = out.reshape(m, m)
    out += out.T.copy()
    many = np.flatnonzero(df > DENSE_DF)
    for i in range(0, len(many), DENSE_COLUMNS):
        part = many[i : i + DENSE_COLUMNS]
        x = np.zeros((m, len(part)), np.float32)
        at = np.repeat(start[part] - np.concatenate(([0], np.cumsum(df[part])[:-1])), df[part]) + np.arange(df[part].sum())
        x[row[at], np.repeat(np.arange(len(part)), df[part])] = 1
        out += (x @ x.T).astype(np.int32)
    return out


def linked_sets(similar: int) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """For ``by_cell``: spanning forest of sets (``tokens``, 64-bit numbers, packed or in a list) whose Jaccard
    similarity is at least ``similar`` hundredths, by exact overlaps."""

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        listed = pa.types.is_list(t["tokens"].type)
        sets = [x.values.to_numpy().view(np.uint64) if listed else np.frombuffer(x.as_py(), np.uint64) for x in t["tokens"]]
        n = np.array([len(x) for x in sets], np.int64)
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            hit = 100 * both >= similar * (n.sum() - both)
            return (np.zeros(int(hit), np.int64), np.ones(int(hit), np.int64))
        both = overlaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))))
        return forest(len(n), lambda i, o: 100 * both[i, o] >= similar * (n[i] + n[o] - both[i, o]))

    return compare
