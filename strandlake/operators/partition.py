"""Partitioning by key digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digit, flip
from ..session import cut, partitions_for
from .order import sort


def histogram(df: DataFrame, bits: int = 8, key: str = "k") -> DataFrame:
    """(digit, n) of the top digit; counts are partial before the shuffle."""
    return df.groupBy(digit(F.col(key), 64 - bits).alias("digit")).agg(F.count("*").alias("n"))


def two_level(df: DataFrame, first: int = 8, second: int = 8, key: str = "k") -> DataFrame:
    """(d0, d1, n): counts by the first two digits. Where the two are longer than the key, the second digit starts at
    its last bit and overlaps the first."""
    k = F.col(key)
    return df.groupBy(digit(k, 64 - first).alias("d0"), digit(k, 64 - first - second, second).alias("d1")).agg(F.count("*").alias("n"))


def by_digit(df: DataFrame, bits: int = 6, key: str = "k", parts: int | None = None) -> DataFrame:
    """df with its top digit in `digit` and in unsigned order, partition after partition. Each digit's rows are in
    neighbouring partitions: small digits share one, a digit (or key) with most of the rows has many, as the ranges
    come from the keys' distribution and a running number breaks ties."""
    return sort(df, key, parts or max(1 << bits, partitions_for(df, 64))).withColumn("digit", digit(F.col(key), 64 - bits).cast("int"))


def drained(df: DataFrame, key: str = "k") -> DataFrame:
    """(digit, part, n, low, high) of by_digit()'s partitions, from the partitions as they stand."""
    rows = df.withColumn("part", F.spark_partition_id())
    f = flip(F.col(key))
    return rows.groupBy("digit", "part").agg(F.count("*").alias("n"), flip(F.min(f)).alias("low"), flip(F.max(f)).alias("high"))


def concatenated(pieces: DataFrame) -> DataFrame:
    """drained() pieces as the ordered union of the digits: (digit, n, low, high, first) where first is the place of the
    digit's first key in the whole, from 0. There are at most 2^bits digits."""
    f = flip(F.col("low"))
    pieces = cut(pieces, "pieces")  # a row a digit and partition
    digits = pieces.groupBy("digit").agg(F.sum("n").alias("n"), flip(F.min(f)).alias("low"), flip(F.max(flip(F.col("high")))).alias("high"))
    counts = {r["digit"]: r["n"] for r in digits.select("digit", "n").collect()}
    at, rows = 0, []
    for d in sorted(counts):
        rows.append((d, at))
        at += counts[d]
    return digits.join(F.broadcast(pieces.sparkSession.createDataFrame(rows, "digit int, first long")), "digit")
