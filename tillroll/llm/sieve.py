"""A sieve of fixed size: which of very many 64-bit keys can be in a set.

``2 ** BITS`` bits, one a key by its hash, however many keys there are. It has
no false negatives; the larger the set, the more strangers pass, so it is only
put before a join that decides exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .textarrays import seeded

BITS, BLOCK_BITS = 25, 15


def _slots(keys: np.ndarray) -> np.ndarray:
    return seeded(keys.astype(np.int64, copy=False).view(np.uint64), 31) >> np.uint64(64 - BITS)


def build(keys: DataFrame, column: str) -> Broadcast:
    """The sieve of a column of longs, sent to all executors (4 MB)."""

    def bits(batches):
        table = np.zeros(1 << BITS, bool)
        for batch in batches:
            table[_slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
        blocks = np.packbits(table).reshape(-1, 1 << BLOCK_BITS >> 3)
        for part in np.array_split(np.flatnonzero(blocks.any(axis=1)), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([blocks[i].tobytes() for i in part], pa.binary())], ["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << BLOCK_BITS >> 3, np.uint8)
        for raw in table.column("bits"):
            out |= np.frombuffer(raw.as_buffer(), np.uint8)
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    rows = (keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(bits, "block int, bits binary")
            .groupBy("block").applyInArrow(join, "block int, bits binary").collect())  # 4 MB at most
    out = np.zeros((1 << BITS - BLOCK_BITS, 1 << BLOCK_BITS >> 3), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def passes(sent: Broadcast, keys: np.ndarray) -> np.ndarray:
    """Which keys the sieve lets through."""
    table = np.frombuffer(sent.value, np.uint8)
    slot = _slots(keys)
    return (table[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1


def sifted(sent: Broadcast):
    """``passes`` as a column function; null never passes."""

    @arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        ok = passes(sent, keys.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(ok & ~np.asarray(keys.is_null()))

    return test
