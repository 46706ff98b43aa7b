"""A bit table of hashes, to leave out rows in tasks before they are shuffled.

It lets every row pass whose hash is in the set and a few others; what decides is the join after it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most slots: 128 KiB and 64 MiB. A table has 16 slots for each hash, up to that bound.
SLOT_BITS = (20, 29)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Slots of ``g`` as bits in bytes. A set beyond the bound fills its table more, lets more through and
    changes no result."""
    n = hashes.count()
    bits = min(max(SLOT_BITS[0], int(np.ceil(np.log2(16 * n + 1)))), SLOT_BITS[1])
    slot = F.col("g").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        at = (row["part"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the set."""
    slot = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
