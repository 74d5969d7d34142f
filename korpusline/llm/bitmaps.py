"""Bitmaps of hashed keys: they keep most rows out of a shuffle, and the join that follows decides.

The bits are set by Spark, one range of slots per group, so only finished bytes reach the driver, at
most MOST bits (64 MB). A bitmap has per_key bits for every key until then; beyond it, it keeps out
fewer rows, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 20, 1 << 29
#: Bits of one range.
RANGE = 1 << 18


def bits_for(keys: int, per_key: int = 16) -> int:
    """A power of two, per_key bits a key, within the bounds."""
    return min(MOST, max(LEAST, 1 << (keys * per_key - 1).bit_length()))


def of_slots(slots: DataFrame, bits: int) -> np.ndarray:
    """The packed bitmap of a table's one column of slots (bigint, below `bits`)."""
    slot = F.col(slots.columns[0])

    def run(table: pa.Table) -> pa.Table:
        own = np.zeros(RANGE, bool)
        own[table.column(1).to_numpy()] = True
        return pa.table({"part": table.column(0)[:1], "bytes": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    ranges = slots.select(F.shiftright(slot, 18).alias("part"), slot.bitwiseAND(F.lit(RANGE - 1)).alias("at")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for part, packed in zip(*(c.to_pylist() for c in ranges.groupBy("part").applyInArrow(run, "part bigint, bytes binary").toArrow().columns)):
        out[part * RANGE // 8 : (part + 1) * RANGE // 8] = np.frombuffer(packed, np.uint8)
    return out


def of_keys(keys: DataFrame) -> np.ndarray:
    """The packed bitmap of a table's one column of 64-bit hashes; `has` asks it."""
    bits = bits_for(keys.count())
    return of_slots(keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))), bits)


def set_at(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def has(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the slot of each 64-bit key is set."""
    return set_at(packed, keys & np.int64(8 * len(packed) - 1))
