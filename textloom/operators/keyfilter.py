"""A bit filter of bounded size that tells which keys can't be in a set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_CHUNK, _MERGED = 1 << 16, 256
_PARTED = "chunk int, part int, bits binary"


class KeyFilter:
    """A bit for each hash range that holds a key of a set.  It may hold keys outside the set, never misses one inside.

    Keys must be well mixed 64-bit hashes.  Beyond MOST_BITS / 16 keys more
    outsiders pass, so what it lets through must be checked by a join.
    """

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed
        self.shift = np.uint64(64 - (8 * len(packed)).bit_length() + 1)

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> "KeyFilter":
        """Of the one long column of ``keys``, with 16 bits for each of ``count`` up to MOST_BITS.

        What comes to the driver is bounded, and no task gets the marks of all
        partitions.
        """
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))

        def mark(batches):
            filled = cls(np.zeros(bits // 8, np.uint8))
            for batch in batches:
                filled.add(batch.column(0).to_numpy().view(np.uint64))
            packed = filled.packed.reshape(-1, _CHUNK)
            used = np.flatnonzero(packed.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[u].tobytes() for u in used], pa.binary())], names=["chunk", "bits"])

        def merge(pdf):
            import pandas as pd

            whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": np.zeros(1, np.int32), "bits": [whole.tobytes()]})

        out = np.zeros((bits // 8 // _CHUNK, _CHUNK), np.uint8)
        marked = keys.mapInArrow(mark, "chunk int, bits binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_MERGED))).select("chunk", "part", "bits")
        merged = marked.groupBy("chunk", "part").applyInPandas(merge, _PARTED).groupBy("chunk").applyInPandas(merge, _PARTED)
        for r in merged.toLocalIterator():
            out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
        return cls(out.reshape(-1))

    def add(self, keys: np.ndarray) -> None:
        bit = np.unique(keys >> self.shift)
        byte, first = np.unique(bit >> np.uint64(3), return_index=True)
        if len(bit):
            self.packed[byte.astype(np.intp)] |= np.bitwise_or.reduceat(np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8), first)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> self.shift
        return (self.packed[(bit >> np.uint64(3)).astype(np.intp)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 > 0
