"""Global order of keys, ranks, and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import flip, modulus, require_keys, unsigned
from ..session import cut, partitions_for


def sort_ranked(df: DataFrame, key: str = "k", parts: int | None = None) -> DataFrame:
    """df in ascending unsigned order of key, with rk from 1. A null key fails.

    The sorted rows are written to the shared folder once; a partition's ranks are its rows' numbers after the counts
    of the partitions before, of which there is one row each.
    """
    names = df.columns
    rows = sort(df, key, parts).select(*names, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))
    rows = cut(rows, "sorted")
    before = _offsets(rows.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()) or [(-1, 0)], "__part int, __before long"))  # a row a partition
    return rows.join(offsets, "__part").select(*names, (F.col("__before") + F.col("__row") + 1).alias("rk"))


def sort(df: DataFrame, key: str = "k", parts: int | None = None) -> DataFrame:
    """df in ascending unsigned order of key, partition after partition, by one range exchange and a sort in each
    partition. A null key fails.

    A running number takes part in the ranges, so that a key with a third of all rows is spread over partitions. It is
    no sort key: rows of equal keys have no order.
    """
    parts = parts or partitions_for(df, 64)
    rows = require_keys(df, key).withColumn("__tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(parts, flip(F.col(key)), "__tie").sortWithinPartitions(flip(F.col(key))).drop("__tie")


def _offsets(counts: list) -> dict[int, int]:
    """For each partition number the rows of those before it, from rows (number, count)."""
    at, out = 0, {}
    for part, n in sorted((r[0], r[1]) for r in counts):
        out[part] = at
        at += n
    return out


def check_sorted(df: DataFrame, pos: str = "pos", key: str = "k", block: int = 1 << 20) -> DataFrame:
    """One row: n_unsorted (neighbours by pos of which the first is larger, unsigned) and n_processed.

    Neighbours meet within blocks of positions; across blocks, the ends of each block do.
    """
    w = Window.partitionBy("b").orderBy("p")
    rows = require_keys(df.select(F.col(pos).alias("p"), F.col(key).alias("k")), "k").select("p", flip(F.col("k")).alias("f"), F.floor(F.col("p") / F.lit(block)).alias("b"))
    inner = rows.withColumn("bad", F.coalesce((F.lag("f").over(w) > F.col("f")).cast("long"), F.lit(0)))
    blocks = inner.groupBy("b").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"), F.min(F.struct("p", "f"))["f"].alias("first"), F.max(F.struct("p", "f"))["f"].alias("last"))
    over = Window.orderBy("b")  # a row a block
    ends = blocks.select("n", (F.col("bad") + F.coalesce((F.lag("last").over(over) > F.col("first")).cast("long"), F.lit(0))).alias("bad"))
    return ends.agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_unsorted"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_processed"))


def fingerprint(df: DataFrame, key: str = "k") -> DataFrame:
    """One row that permutations of the keys share: count, wrapping sum, xor, and the wrapping sum of hashes."""
    h = F.xxhash64(key)
    return df.agg(F.count("*").alias("n"), wrapping_sum(F.col(key)).alias("total"), F.bit_xor(key).alias("mixed"), wrapping_sum(h).alias("hashed"))


def wrapping_sum(k: Column) -> Column:
    """The sum modulo 2^64, as text."""
    return F.pmod(F.sum(unsigned(k).cast("decimal(38,0)")), modulus()).cast("decimal(20,0)").cast("string")


def lane_sums(df: DataFrame, lanes: int = 2, pos: str = "pos", key: str = "k") -> DataFrame:
    """(lane, total): sums modulo 2^64 of the words at positions of each remainder; partial sums go before the shuffle.
    A null key fails."""
    rows = require_keys(df.select(F.col(pos).alias("pos"), F.col(key).alias("k")), "k")
    return rows.groupBy(F.pmod(F.col("pos"), F.lit(lanes)).cast("int").alias("lane")).agg(wrapping_sum(F.col("k")).alias("total"))


def sort_small_arrays(df: DataFrame, group: str, key: str = "k") -> DataFrame:
    """(group, keys): each group's keys in ascending unsigned order; for groups that fit a row."""
    return df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(flip(F.col(key)))), flip).alias("keys"))
