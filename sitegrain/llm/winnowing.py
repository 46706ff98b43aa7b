"""Benchmark decontamination by winnowing.

A document's fingerprints are the smallest k-gram hashes of its sliding windows, so that
every shared span of ``window`` words has one in common. Fingerprints meet those of the
benchmark, hits are extended to the whole windows around them, and windows are compared
word by word. Before the join, a bit table of fixed size drops fingerprints that no
benchmark item has; a benchmark of any size can use it, and the join decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.arrays import ALNUM, Words, grams, grams_inside, slices
from sitegrain.llm.common import text_key
from sitegrain.plans.staging import Staging

WINDOW, GRAM = 10, 5
#: Slots of the bit table: 2 MiB.
SLOT_BITS = 24


def window_prints(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Fingerprint of the window at each position: the least hash of its k-grams."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    g = grams(words, gram)
    n = len(words) - window + 1
    least = g[:n].copy()
    for s in range(1, window - gram + 1):
        np.minimum(least, g[s : s + n], out=least)
    return least


def _slots(prints: np.ndarray) -> np.ndarray:
    return prints >> np.uint64(64 - SLOT_BITS)


def _item_windows(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lengths, prints, slots = [], [], [], [], []
            for lo, hi in slices(batch["text"]):
                w = Words(batch["text"].slice(lo, hi - lo), ALNUM)
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    item, names = batch["item_id"][lo + i], [w.word(j) for j in range(a, b)]
                    fp = window_prints(w.hash[a:b], window, gram) if n == window else grams(w.hash[a:b], n)
                    for p, h in enumerate(fp):
                        ids.append(item.as_py())
                        texts.append(" ".join(names[p : p + n]))
                    lengths += [n] * len(fp)
                    prints.append(fp.view(np.int64))
                    slots.append(_slots(fp).astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch["item_id"].type), pa.array(texts), pa.array(lengths, pa.int32()), pa.array(np.concatenate(prints)), pa.array(np.concatenate(slots))],
                    names=["item_id", "window", "length", "print", "slot"],
                )

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``item_id, window`` (words with blanks between), ``length``, ``print``, ``slot`` of each window
    of each item; an item of fewer words is one window."""
    id_type = dict(benchmark.dtypes)["item_id"]
    return benchmark.select("item_id", "text").where("text IS NOT NULL").mapInArrow(
        _item_windows(window, gram), f"item_id {id_type}, window string, length int, print long, slot long"
    )


def bit_table(slots: DataFrame) -> np.ndarray:
    """Which slots occur, as bits in bytes: 512 rows of 4 KiB come to the driver, for any input."""
    rows = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    table = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for row in rows:
        at = (row["part"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def _candidates(window: int, gram: int, long_bits: np.ndarray, short_bits: dict[int, np.ndarray]) -> Callable:
    def known(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
        s = _slots(prints)
        return (bits[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w = Words(part["text"], ALNUM)
                rows, starts, lengths, prints = [], [], [], []
                for n in [window, *short_bits]:
                    fp = window_prints(w.hash, window, gram) if n == window else grams(w.hash, n)
                    at = np.flatnonzero(known(fp, long_bits if n == window else short_bits[n]) & grams_inside(w.first, len(w.hash), n))
                    rows.append(np.searchsorted(w.first, at, "right") - 1)
                    starts.append(at)
                    lengths.append(np.full(len(at), n))
                    prints.append(fp[at])
                row, start, length, fp = map(np.concatenate, (rows, starts, lengths, prints))
                order = np.argsort(row, kind="stable")
                row, start, length, fp = row[order], start[order], length[order], fp[order]
                texts = [" ".join([w.word(j) for j in range(s, s + n)]) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                hits = pa.StructArray.from_arrays(
                    [pa.array(start - w.first[row], pa.int32()), pa.array(length, pa.int32()), pa.array(fp.view(np.int64)), pa.array(texts, pa.string())], ["start", "length", "print", "window"]
                )
                offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["_k"], pa.array(w.counts(), pa.int64()), pa.ListArray.from_arrays(offsets, hits)], ["doc_id", "_k", "n_words", "hits"]
                )

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, stage: Staging, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` (``_row, doc_id, _k, n_words``), their windows that an item has (``_row, start,
    length, window``), and the items' windows."""
    items = stage.write(item_windows(benchmark, window, gram), "items")
    short = sorted(r["length"] for r in items.select("length").where(F.col("length") < window).distinct().collect())
    bits = bit_table(items.where(F.col("length") == window).select("slot"))
    short_bits = {n: bit_table(items.where(F.col("length") == n).select("slot")) for n in short}
    id_type = dict(docs.dtypes)["doc_id"]
    found = stage.write(
        docs.select("doc_id", "text", text_key("text").alias("_k"))
        .mapInArrow(_candidates(window, gram, bits, short_bits), f"doc_id {id_type}, _k binary, n_words long, hits array<struct<start:int,length:int,print:long,window:string>>")
        .withColumn("_row", F.monotonically_increasing_id()),
        "found",
    )
    # Equal prints and equal words: the print is the join of fingerprints, the words prove it.
    hits = found.select("_row", F.explode("hits").alias("h")).select("_row", "h.*").join(items.select("print", "window").distinct(), ["print", "window"], "left_semi")
    return found.drop("hits"), hits, items


def _covered(spans):
    """Positions inside any span of an ascending array of (start, length)."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
            (a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, stage: Staging, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words, on either side. An item of fewer than ``window`` words
    is one window. Items that repeat an ``item_id`` are one item; windows of items with a null id
    hit words but are not listed. Repeated documents are reported each.
    """
    rows, hits, items = find_windows(docs, benchmark, stage, window, gram)
    hits = stage.write(hits, "hits")
    spans = hits.groupBy("_row").agg(_covered(F.sort_array(F.collect_set(F.struct("start", "length")))).alias("n_hit"))
    listed = (
        hits.select("_row", "window")
        .distinct()
        .join(items.select("window", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL").distinct(), "window")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(spans, "_row", "left")
        .join(listed, "_row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, stage: Staging, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of ``docs`` without a window of an item, all columns kept, whatever their names. Null texts, and of
    repeated rows all or none, stay."""
    rows, hits, _ = find_windows(docs, benchmark, stage, window, gram)
    bad = stage.write(rows.join(hits.select("_row").distinct(), "_row", "left_semi").select("_k").distinct(), "bad")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(bad, text_key(F.col("row.text")) == F.col("_k"), "left_anti").select("row.*")
