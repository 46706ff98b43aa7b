"""Near duplicates by b-bit MinHash.

Each distinct shingle set has ``MINIMA`` minima. Runs of ``BAND`` minima are band keys, and sets
that share a key are candidates. Of every minimum only its low ``BITS`` bits are kept, packed into
four longs; the number of equal bit groups, corrected for those that agree by chance, estimates
the similarity. Sets estimated near ``similar`` (``SLACK`` below it, five standard errors) are put
into one family; inside families full sets are compared, and only such links count.

A pair of the least similarity that counts, 0.8, shares no key once in 20 million pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.arrays import mix64, slices
from sitegrain.llm.bits import bit_table, known
from sitegrain.llm.blocks import by_cell, deal, forest, linked_sets
from sitegrain.llm.common import text_key
from sitegrain.llm.components import components
from sitegrain.llm.ngram_join import shingles
from sitegrain.plans.staging import Staging

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, SIMILAR = 4, 80
MINIMA, BAND, BITS = 128, 4, 2
#: The estimate's standard error at 0.8 is 0.042.
SLACK = 0.21
#: Members of a block of a bucket, and shingles of a block of a family.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 18

_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIRS = np.uint64(0x5555555555555555)


def minima(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``MINIMA`` least hashes of each set; the greatest number for an empty one."""
    out = np.full((len(first) - 1, MINIMA), ~np.uint64(0))
    some = np.flatnonzero(np.diff(first))
    for i in range(MINIMA if len(some) else 0):
        out[some, i] = np.minimum.reduceat((token ^ _XOR[i]) * _ODD[i], first[some])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each run of ``BAND`` minima."""
    keys = np.broadcast_to(np.arange(MINIMA // BAND, dtype=np.uint64), (len(least), MINIMA // BAND)).copy()
    for j in range(BAND):
        keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, j::BAND])
    return keys


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, 32 to a word."""
    low = mix64(least) & np.uint64((1 << BITS) - 1)
    shift = np.uint64(BITS) * np.arange(64 // BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(low), -1, 64 // BITS) << shift, axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures, corrected for bit groups that agree by chance."""
    x = a ^ b
    unequal = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def _set_ids(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number per distinct set; 0 for the empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(token ^ np.uint64(0x2545F4914F6CDD1D)))))
    return np.where(np.diff(first) > 0, mix64(sums[first[1:]] - sums[first[:-1]]), 0).view(np.int64)


def _sign(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                token, first = shingles(part["text"], k)
                least = minima(token, first)
                keys, signs = band_keys(least), signature(least)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], part["_k"], pa.array(np.diff(first).astype(np.int64)), pa.array(_set_ids(token, first)),
                        pa.array([x.tobytes() for x in signs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "_k", "n_shingles", "c", "sign", "keys"],
                )

    return run


def _sets(k: int, wanted) -> Callable:
    """Sets of the rows that the table of ``wanted`` hashes lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(known(wanted.value, batch["g"].to_numpy().view(np.uint64)))))
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                token, first = shingles(part["text"], k)
                sets = pa.array([token[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["_k"], sets], ["doc_id", "_k", "tokens"])

    return run


def _near(similar: int) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the members of a bucket whose sizes fit and whose estimates are near ``similar``."""
    least = similar / 100 - SLACK

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n = t["n"].to_numpy()
        signs = np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint64).reshape(len(n), -1)
        return forest(len(n), lambda i, o: (100 * np.minimum(n[o], n[i]) >= similar * np.maximum(n[o], n[i])) & (estimate(signs[o], signs[i]) >= least))

    return compare


def _in_chunks(column: str, most: int):
    """How many blocks hold ``column`` at ``most`` each."""
    n = F.ceil(F.col(column) / F.lit(float(most)))
    return F.greatest(n, F.lit(1)).cast("long")


def families(signed: DataFrame, stage: Staging, similar: int) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (``c, n, sign, doc``), and ``c, root`` of the families of those that may have a link."""
    one = stage.write(
        signed.where("n_shingles > 0").groupBy("c").agg(F.first("n_shingles").alias("n"), F.first("sign").alias("sign"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "_k")).alias("doc")),
        "one",
    )
    members = one.select("c", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stage.write(members.join(several, "key"), "buckets").join(one.select("c", "n", "sign"), "c")
    near = by_cell(deal(buckets, "key", "c", _in_chunks("size", BLOCK_MEMBERS)), _near(similar), ["c", "n", "sign"])
    roots = components(near, stage, "families")
    everyone = roots.select(F.col("node").alias("c"), "root").unionByName(roots.select(F.col("root").alias("c"), "root")).distinct()
    return one, stage.write(everyone, "families")


def links(docs: DataFrame, one: DataFrame, family: DataFrame, stage: Staging, k: int, similar: int) -> DataFrame:
    """``a, b``: links between sets of one family, confirmed on full sets; enough of them to connect what is linked."""
    sized = family.join(one.select("c", "n", "doc"), "c")
    total = sized.groupBy("root").agg(F.sum("n").alias("total"))
    left = stage.write(sized.join(total, "root").select("c", "root", _in_chunks("total", BLOCK_SHINGLES).alias("blocks"), "doc.doc_id", "doc._k"), "left")
    # Texts stay where they are; only the sets of rows that stand for a set of a family are moved.
    g = F.xxhash64("doc_id", "_k").alias("g")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(left.select(g)))
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", text_key("text").alias("_k")).select("*", g)
    found = keyed.mapInArrow(_sets(k, wanted), f"doc_id {dict(docs.dtypes)['doc_id']}, _k binary, tokens binary").alias("d")
    sets = found.join(left.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d._k") == F.col("l._k"))).select("c", "root", "blocks", "tokens")
    # Rows that repeat an id and a text are one.
    distinct = sets.groupBy("c", "root", "blocks").agg(F.first("tokens").alias("tokens"))
    return by_cell(deal(distinct, "root", "c", F.col("blocks")), linked_sets(similar), ["c", "tokens"])


def near_duplicates(docs: DataFrame, stage: Staging, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the least ``doc_id`` reachable by links. Null texts and texts without a word have no
    shingle and are classes of their own. Rows with a null ``doc_id`` link like others, have the least id of
    their class (null if it has none) and are not kept. Copies are one set until the end. Of repeated rows
    (one id, one text) all are reported, and all kept or none. Shingles are 64-bit hashes. Other columns
    of ``docs`` are not looked at.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    signed = stage.write(
        docs.select("doc_id", "text", text_key("text").alias("_k"))
        .mapInArrow(_sign(k), f"doc_id {id_type}, _k binary, n_shingles long, c long, sign binary, keys array<long>")
        # Empty sets link with nothing; a number each keeps them from meeting in one task.
        .withColumn("c", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.xxhash64("doc_id", "_k"))),
        "signed",
    )
    one, family = families(signed, stage, similar)
    roots = components(links(docs, one, family, stage, k, similar), stage, "roots")
    rows = stage.write(
        signed.select("doc_id", "n_shingles", "c").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")).drop("c"), "rows"
    )
    least = stage.write(rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
