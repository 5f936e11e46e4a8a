"""Arrays that vanish as they are read, streams held in memory, and streams by name."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StreamError
from ..session import ship


class Vanishing:
    """Blocks that exist from their writing until the reader has passed them: a read gives the oldest block and frees
    the one read before. Reading what was never written, or again, raises StreamError."""

    def __init__(self, blocks: Iterator | None = None):
        self._source, self._held, self.written, self.read_blocks = blocks, deque(), 0, 0

    def write(self, block) -> None:
        self._held.append(block)
        self.written += 1

    @property
    def held(self) -> int:
        return len(self._held)

    def read(self):
        if not self._held and self._source is not None:
            for block in self._source:
                self.write(block)
                break
        if not self._held:
            raise StreamError("nothing is there to read: it was never written, or was read before")
        self.read_blocks += 1
        return self._held.popleft()

    def __iter__(self):
        while True:
            try:
                yield self.read()
            except StreamError:
                return


def one_pass(df: DataFrame, f: Callable[[Vanishing], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over each partition's batches as a vanishing array: one batch is in memory at a time, nothing is kept."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: f(Vanishing(batches)), schema)


def from_array(spark: SparkSession, words: np.ndarray) -> DataFrame:
    """(pos, k) of an array of unsigned words in the driver's memory."""
    k = np.ascontiguousarray(words).astype(np.uint64).view(np.int64)
    return spark.createDataFrame(pa.table({"pos": pa.array(np.arange(len(k))), "k": pa.array(k)}))


def to_array(df: DataFrame, most: int = 1 << 24) -> np.ndarray:
    """The words of (pos, k) in order, in the driver's memory; StreamError beyond `most` words, or if positions aren't
    dense from 0."""
    got = df.select("pos", "k").limit(most + 1).toArrow()
    if got.num_rows > most:
        raise StreamError(f"more than {most} words don't go into the driver's memory")
    pos, k = got.column("pos").to_numpy(), got.column("k").to_numpy().astype(np.int64)
    out = np.empty(len(k), np.int64)
    if not (np.sort(pos) == np.arange(len(pos))).all():
        raise StreamError("positions are not dense")
    out[pos] = k
    return out.view(np.uint64)


class Registry:
    """Streams by name, as views of the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def add(self, name: str, df: DataFrame) -> None:
        if self.find(name) is not None:
            raise StreamError(f"there is a stream {name}")
        df.createTempView(name)

    def find(self, name: str) -> DataFrame | None:
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def remove(self, name: str) -> None:
        if not self.spark.catalog.dropTempView(name):
            raise StreamError(f"there is no stream {name}")

    def names(self) -> DataFrame:
        """(name) of every stream, in order."""
        return self.spark.createDataFrame(sorted((t.name,) for t in self.spark.catalog.listTables() if t.isTemporary), "name string").orderBy(F.col("name"))
