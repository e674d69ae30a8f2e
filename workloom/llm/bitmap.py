"""A set of 64-bit hashes as a bitmap, to drop rows before a join.

Its size follows the number of hashes, 16 bits or more for each, up to 2**MOST_BITS bits (8 MB). With
more hashes than that it only lets more rows through, which the join behind it then drops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 26


class Bitmap:
    def __init__(self, words: np.ndarray, bits: int, spark) -> None:
        self.bits = bits
        self.sent = spark.sparkContext.broadcast(words)  # 2**(bits - 3) bytes

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bitmap:
        """The lowest bits of every hash of a column; one word of 32 bits at a time reaches the driver."""
        count = df.agg(F.approx_count_distinct(column)).first()[0]
        bits = min(max(LEAST_BITS, int(count * 16).bit_length()), MOST_BITS)
        bit = F.col(column).bitwiseAND((1 << bits) - 1)
        words = df.select(bit.alias("b")).distinct().groupBy(F.shiftright("b", 5).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(b & 31 AS INT))")).alias("bits"))
        out = np.zeros(1 << (bits - 5), np.uint32)
        found = words.toPandas()
        out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
        return cls(out, bits, df.sparkSession)

    def __getstate__(self):
        return {"sent": self.sent, "bits": self.bits}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        word = self.sent.value[(at >> np.uint64(5)).astype(np.int64)]
        return (word >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
