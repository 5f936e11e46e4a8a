"""Deterministic generators of ordered words (pos, k)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import narrow
from ..session import ship

#: Multiplier, increment, seeds and the constant word of the sequences.
A, C = 6364136223846793005, 1442695040888963407
SEEDS = (10**4, 10**12, 10**18, 3)
WORD = 32
_MASK = (1 << 64) - 1


def constant(spark: SparkSession, n: int, word: int = WORD) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(word).cast("long").alias("k"))


def jump(steps: int) -> tuple[int, int]:
    """(a, c) of the affine map that does so many steps at once, by squaring."""
    a, c, pa_, pc = 1, 0, A, C
    while steps:
        if steps & 1:
            a, c = a * pa_ & _MASK, (c * pa_ + pc) & _MASK
        pa_, pc = pa_ * pa_ & _MASK, (pc * pa_ + pc) & _MASK
        steps >>= 1
    return a, c


def lcg(spark: SparkSession, n: int, width: int = 64) -> DataFrame:
    """n words of four interleaved congruential sequences: word i is of lane i mod 4, after i div 4 + 1 steps, its high
    `width` bits. Each batch jumps to its place, so no part waits for another."""
    ship(spark)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = sums = np.zeros(0, np.uint64)
        for b in batches:
            pos = b.column(0).to_numpy()
            if not len(pos):
                continue
            first = int(pos[0]) // 4
            steps = int(pos[-1]) // 4 - first + 1
            if len(powers) < steps:
                powers = np.multiply.accumulate(np.full(steps, A, np.uint64))  # A^1, A^2, ...
                sums = np.concatenate([[np.uint64(1)], powers[:-1]]).cumsum(dtype=np.uint64) * np.uint64(C)
            a, c = jump(first)
            start = np.array([(a * s + c) & _MASK for s in SEEDS], np.uint64)
            k = (powers[:steps, None] * start[None, :] + sums[:steps, None]).ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k[pos - 4 * first].view(np.int64))], names=["pos", "k"])

    out = spark.range(n).mapInArrow(f, "pos long, k long")
    return out if width == 64 else out.withColumn("k", narrow(F.col("k"), width))
