"""Point lookup in disjoint half-open intervals [a, b), and their upkeep. An interval table is (a, b, payload).

Tables that are too large to broadcast are scanned in order: one range exchange by quantiles of the values themselves (a
running number breaks ties, so a dense stretch or a hot value is spread over partitions), one pass over each partition,
and what a partition hands to the next ones is a row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..errors import StreamError
from ..session import cut, partitions_for, ship

#: Intervals up to which they are broadcast to the points, blocks of the value range that they meet by, and intervals
#: that a block may hold for that: a point is compared with all of its block.
SMALL, BLOCKS, DENSE = 100_000, 4096, 256


def stab(points: DataFrame, intervals: DataFrame, x: str = "x", small: int = SMALL, parts: int | None = None) -> DataFrame:
    """points with a and payload of the interval that holds x, null where none does, or where x is null.

    Few intervals (their number is counted) are broadcast, each under every block of the value range it touches, which
    for disjoint ones is a row an interval and block at most. Many, or many in one block, are scanned in order with the
    points.
    """
    span = intervals.agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")).first()
    names = points.columns
    if not span["n"]:
        none = intervals.schema
        return points.select(*names, F.lit(None).cast(none["a"].dataType).alias("a"), F.lit(None).cast(none["payload"].dataType).alias("payload"))
    if span["n"] > small:
        return _merged(points, intervals, x, parts)
    width = max(1, (span["hi"] - span["lo"]) // BLOCKS + 1)
    block = lambda c: F.floor((c - F.lit(span["lo"])) / F.lit(width))
    held = intervals.select(F.explode(F.sequence(block(F.col("a")), block(F.col("b") - 1))).alias("__block"), F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("payload").alias("__payload"))
    if not held.groupBy("__block").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).isEmpty():
        return _merged(points, intervals, x, parts)
    keyed = points.withColumn("__x", F.col(x)).withColumn("__own", block(F.col(x)))
    met = keyed.join(F.broadcast(held), (F.col("__own") == F.col("__block")) & (F.col("__a") <= F.col("__x")) & (F.col("__x") < F.col("__b")), "left")
    return met.select(*names, F.col("__a").alias("a"), F.col("__payload").alias("payload"))


def _merged(points: DataFrame, intervals: DataFrame, x: str, parts: int | None) -> DataFrame:
    ship(points.sparkSession)
    names = points.columns
    own = F.struct("a", "b", "payload")
    starts = intervals.select(F.col("a").cast("long").alias("v"), F.lit(0).alias("kind"), own.alias("own"), F.lit(None).cast(points.schema).alias("row"))
    probes = points.select(F.col(x).cast("long").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["own"].dataType).alias("own"), F.struct(*names).alias("row"))
    both = starts.unionByName(probes).withColumn("tie", F.monotonically_increasing_id())
    parts = parts or max(partitions_for(points, 64), partitions_for(intervals, 64))
    both = both.repartitionByRange(parts, "v", "kind", "tie").sortWithinPartitions("v", "kind", "tie").withColumn("part", F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last start so far, as an array of one
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column("kind").to_numpy()
            at = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
            pool = pa.concat_arrays([pa.nulls(1, b.column("own").type) if held is None else held, b.column("own")])
            found = pool.take(pa.array(at + 1))  # place 0 is the start from before this batch
            held = found.slice(len(found) - 1, 1)
            probe = pa.array(kind == 1)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("v"), found, b.column("row")], names=["part", "v", "own", "row"]).filter(probe)
            part = b.column("part").slice(0, 1)
        if held is not None and held[0].is_valid:  # what the next partitions need, if they begin within this interval
            yield pa.RecordBatch.from_arrays([part, pa.nulls(1, pa.int64()), held, pa.nulls(1, b.schema.field("row").type)], names=["part", "v", "own", "row"])

    seen = cut(both.mapInArrow(scan, both.select("part", "v", "own", "row").schema), "stabbed")
    ends = {r["part"]: r["own"] for r in seen.where("row is null").select("part", "own").collect()}  # a row a partition
    carried, last = [], None
    for part in range(max(ends, default=0) + 2 if ends else 0):
        carried.append((part, last))
        last = ends.get(part, last)
    top = len(carried) - 1
    before = points.sparkSession.createDataFrame(carried or [(0, None)], StructType([StructField("home", IntegerType()), StructField("before", starts.schema["own"].dataType)]))
    met = seen.where("row is not null").withColumn("home", F.least("part", F.lit(max(0, top)))).join(F.broadcast(before), "home", "left")
    at = F.coalesce("own", "before")
    hit = F.when((at["a"] <= F.col("v")) & (F.col("v") < at["b"]), at)
    return met.select("row.*", hit["a"].alias("a"), hit["payload"].alias("payload"))


def overlaps(intervals: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, reaches): the intervals that begin before another that starts no later has ended, with the largest end
    before them; touching ones are apart."""
    ship(intervals.sparkSession)
    rows = intervals.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).withColumn("tie", F.monotonically_increasing_id())
    parts = parts or partitions_for(intervals, 64)
    rows = rows.repartitionByRange(parts, "a", "b", "tie").sortWithinPartitions("a", "b", "tie").withColumn("part", F.spark_partition_id())
    none = np.iinfo(np.int64).min

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = none
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column("b").to_numpy()
            reach = np.maximum.accumulate(np.concatenate([[most], b]))
            most = int(reach[-1])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("a"), batch.column("b"), pa.array(reach[:-1], mask=reach[:-1] == none)], names=["part", "a", "b", "within"])

    seen = cut(rows.mapInArrow(scan, "part int, a long, b long, within long"), "overlaps")
    ends = {r["part"]: r["m"] for r in seen.groupBy("part").agg(F.max("b").alias("m")).collect()}  # a row a partition
    carried, most = [], None
    for part in sorted(ends):
        carried.append((part, most))
        most = ends[part] if most is None else max(most, ends[part])
    before = intervals.sparkSession.createDataFrame(carried, "part int, before long")
    met = seen.join(F.broadcast(before), "part").withColumn("reaches", F.greatest("within", "before"))
    return met.where("reaches > a").select("a", "b", "reaches")


def add(intervals: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' intervals; StreamError if any overlap or are empty."""
    out = intervals.unionByName(new)
    if not out.where("a >= b").isEmpty() or not overlaps(out).isEmpty():
        raise StreamError("intervals overlap or are empty")
    return out


def remove(intervals: DataFrame, starts: DataFrame) -> DataFrame:
    """Without the intervals that start at the given a's; StreamError if none starts at one of them."""
    if not starts.join(intervals, "a", "left_anti").isEmpty():
        raise StreamError("no interval starts there")
    return intervals.join(starts, "a", "left_anti")


def walk(intervals: DataFrame) -> DataFrame:
    """In ascending order of start, with each interval's number in `step`, from 1."""
    from .order import sort_ranked

    # Starts are signed: a walk orders them as they are, so the key is the start with its sign bit turned.
    ranked = sort_ranked(intervals.withColumn("__k", F.col("a").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), "__k")
    return ranked.withColumnRenamed("rk", "step").drop("__k")
