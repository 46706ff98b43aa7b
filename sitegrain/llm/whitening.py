"""Whitening of embeddings by the covariance of their distinct vectors.

Entries become whole numbers (``floor(scale * entry)``), so equal vectors are found exactly: they
are grouped, and each distinct vector is fitted and whitened once, with weight one or its number
of copies. Sums are exact. Centred blocks of vectors are multiplied in tasks, and only the
covariance (dimensions squared) and the sums reach the driver, which takes its eigenvectors.
What is whitened is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.plans.staging import Staging

SCALE, COMPONENTS = 256, 4
#: A vector that more than one row in so many has is hot: there are at most so many of them.
HOT = 1000
#: Components whose variance is below this share of the largest have none but rounding.
LEAST_SHARE = 1e-12
#: Vectors of a block of a product.
BLOCK = 1 << 14
_LIMIT = 2**63


@dataclass
class Fit:
    """What was fitted on the vectors of one length: weight ``n``, exact ``sums``, ``matrix``
    (a row per component: eigenvector over root of eigenvalue) and ``explained``."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: list[float]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * entry)`` of each entry as longs; null if the vector or an entry is null or not finite."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(wide, lambda c: F.floor(c * scale).cast("long")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length as a matrix, and their weights."""
    for batch in batches:
        dims = batch["dims"].to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            part = batch.take(pa.array(at))
            for i in range(0, len(at), BLOCK):
                x = part["x"].slice(i, BLOCK)
                yield int(d), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d), part["weight"].slice(i, BLOCK).to_numpy()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights and weighted sums per dimension, high and low halves apart so that none overflows."""
    total: dict[int, list] = {}
    for d, x, w in _blocks(batches):
        t = total.setdefault(d, [0, [0] * d])
        t[0] += int(w.sum())
        if w.max() < 1 << 16:
            high, low = ((x >> 32) * w[:, None]).sum(0), ((x & 0xFFFFFFFF) * w[:, None]).sum(0)
            t[1] = [a + (int(h) << 32) + int(v) for a, h, v in zip(t[1], high, low, strict=True)]
        else:  # very many copies: whole numbers of any size
            t[1] = [a + sum(int(v) * int(k) for v, k in zip(c, w, strict=True)) for a, c in zip(t[1], x.T, strict=True)]
    rows = [(d, n, i, str(s)) for d, (n, sums) in total.items() for i, s in enumerate(sums)]
    yield pa.RecordBatch.from_pydict(
        {"dims": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()), "i": pa.array([r[2] for r in rows], pa.int32()), "s": pa.array([r[3] for r in rows], pa.string())}
    )


def _centred(x: np.ndarray, n: int, sums: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean. The whole part of the mean goes first, in whole numbers: a large common offset costs no digits."""
    if len(x) and max(-int(x.min()), int(x.max()), int(np.abs(sums).max())) >= _LIMIT // 2:
        return x.astype(np.float64) - sums - rest / n
    return (x - sums).astype(np.float64) - rest / n


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([s - n * q for s, q in zip(sums, whole, strict=True)], np.float64)


def _products(means: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Callable:
    """Centred, weighted products of all vectors of a task: one row per row of each matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x, w in _blocks(batches):
            if d in means:
                y = _centred(x, *means[d])
                total[d] = total.get(d, 0) + (y * w[:, None]).T @ y
        for d, v in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v[i, j])], ["dims", "i", "j", "v"]
            )

    return run


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fit of each vector length of ``distinct`` (``dims, x, weight``).

    The driver gets a number per pair of dimensions of each length. Lengths are taken to be few."""
    parts = distinct.select("dims", "x", "weight")
    sums: dict[int, tuple[int, list[int]]] = {}
    wide = F.sum(F.col("s").cast("decimal(38,0)"))
    for r in parts.where("dims > 0").mapInArrow(_sums, "dims int, n long, i int, s string").groupBy("dims", "i").agg(F.sum("n").alias("n"), wide.alias("s")).orderBy("dims", "i").collect():
        sums.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    means = {d: (n, *_mean(n, s)) for d, (n, s) in sums.items()}
    cov = {d: np.zeros((d, d)) for d in sums}
    for r in parts.where("dims > 0").mapInArrow(_products(means), "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        cov[r["dims"]][r["i"], r["j"]] = cov[r["dims"]][r["j"], r["i"]] = r["v"] / sums[r["dims"]][0]
    fits = {}
    for d, (n, s) in sums.items():
        values, vectors = np.linalg.eigh(cov[d])
        order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > max(LEAST_SHARE * values.max(), 0)]
        fits[d] = Fit(n, s, (vectors[:, order] / np.sqrt(values[order])).T, [float(values[k] / np.trace(cov[d])) for k in order])
    return fits


def _whiten(fits: dict[int, Fit]) -> Callable:
    means = {d: (f.n, *_mean(f.n, f.sums)) for d, f in fits.items()}

    def deviations(f: Fit, x: np.ndarray) -> list[int | None]:
        far = max(abs(int(x.max())), abs(int(x.min()))) * f.n + max(map(abs, f.sums))
        if far * far * x.shape[1] < _LIMIT:
            return ((x * f.n - np.array(f.sums)) ** 2).sum(1).tolist()
        exact = (sum((f.n * int(v) - s) ** 2 for v, s in zip(row, f.sums, strict=True)) for row in x)
        return [v if v < _LIMIT else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims):
                if d not in fits:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)
                w = _centred(x, *means[d]) @ fits[d].matrix.T
                offsets = pa.array(np.arange(len(part) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["dims"], part["h"], part["copies"], part["weight"], pa.array(deviations(fits[d], x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))],
                    ["dims", "h", "copies", "weight", "deviation", "w"],
                )

    return run


def _identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the covariance of whitened vectors minus the identity, per length."""
    k = max((len(f.explained) for f in fits.values()), default=0)
    if not k:
        return {}
    w = [F.get("w", F.lit(i)) for i in range(k)]
    n = F.sum("weight")
    mean = [F.sum(w[i] * F.col("weight")) / n for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = white.groupBy("dims").agg(*[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.sum(w[i] * w[j] * F.col("weight")) / n).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    # Whitened vectors are centred already, so the means to take off are rounding.
    return {
        r["dims"]: max((abs(r[f"p{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i, j in pairs if r[f"p{i}_{j}"] is not None), default=0.0) for r in rows
    }


def whiten(
    rows: DataFrame, stage: Staging, vector: str = "embedding", row_id: str = "vec_id", scale: int = SCALE, components: int = COMPONENTS, by_count: bool = False
) -> DataFrame:
    """Per row and component ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    The fit takes each distinct vector once (``by_count``: as often as it occurs); ``n`` is its weight. Rows
    whose vector is null or has a null or non-finite entry are dropped. Vectors of each length are a set
    of their own; empty ones have no component. Components without variance are left out, so equal vectors
    alone give no row. Repeated rows and null ids give rows of their own. ``deviation`` is null beyond 64
    bits. Entries beyond 64 bits after scaling count as the nearest 64-bit number. Vectors are
    told apart by themselves, and joined back by a 128-bit hash. Other columns are not looked at.
    """
    x = whole_numbers(F.col(f"`{vector}`"), scale)
    given = rows.select(F.col(f"`{row_id}`").alias("vec_id"), x.alias("x")).where("x IS NOT NULL")
    key = F.struct(F.xxhash64("x").alias("p"), F.xxhash64(F.lit(1), "x").alias("q")).alias("h")
    grouped = given.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = stage.write(
        grouped.select(F.size("x").alias("dims"), "x", key, "copies", (F.col("copies") if by_count else F.lit(1).cast("long")).alias("weight")), "distinct"
    )
    fits = fit(distinct, components)
    white = stage.write(distinct.mapInArrow(_whiten(fits), "dims int, h struct<p:long,q:long>, copies long, weight long, deviation long, w array<double>"), "white")
    errors = _identity_errors(white, fits)
    known = [
        F.struct(F.lit(d).alias("dims"), F.lit(f.n).cast("long").alias("n"), F.array(*map(F.lit, f.explained)).cast("array<double>").alias("explained"), F.lit(errors.get(d)).cast("double").alias("error"))
        for d, f in fits.items()
    ]
    narrow = given.select("vec_id", key)
    # Copies of a hot vector stay where they are; the few hot vectors come to them.
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT > total
    hot = F.broadcast(white.where(is_hot).select("h", "dims", "deviation", "w"))
    cold = white.where(~is_hot).select("h", "dims", "deviation", "w")
    joined = narrow.join(hot, "h").unionByName(narrow.join(hot.select("h"), "h", "left_anti").join(cold, "h"))
    out = joined.select("vec_id", "dims", "deviation", F.posexplode("w").alias("at", "whitened"))
    of = F.element_at(F.filter(F.array(*known), lambda f: f["dims"] == F.col("dims")), 1) if known else F.lit(None).cast("struct<dims:int,n:long,explained:array<double>,error:double>")
    return out.withColumn("f", of).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "f.n", "deviation", "whitened", F.get("f.explained", F.col("at")).alias("explained"), F.col("f.error").alias("identity_error")
    )
