"""Bounded pipes: a producer writes blocks of rows, a streaming query takes a few of them at a time, in order.

A block is one Parquet file of block_rows positions, named by its number. Admission control stands for back-pressure:
a micro-batch takes at most `ahead` new blocks. The consumer also sees the last `consumer_back` blocks before them; blocks
further back are removed once they can't be asked for, and a request for them raises StreamError. The producer may write
at most `producer_back` blocks behind the row it wrote before; the check goes on across calls and restarts, as its place
is kept with the pipe. What a pipe holds is its folder: reset() empties it, close() removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StreamError
from ..functions.metrics import SpeedReport
from ..operators.lookback import violations
from ..operators.order import wrapping_sum
from ..session import scratch


@dataclass(frozen=True)
class PipeConfig:
    """consumer_back and producer_back in blocks of block_rows rows; ahead: blocks that the consumer takes at a time;
    rows: how many the stream is declared to have, if that is known (it may end before, not after)."""

    block_rows: int = 1 << 18
    consumer_back: int = 0
    producer_back: int = 0
    ahead: int = 2
    rows: int | None = None

    @property
    def blocks(self) -> int:
        """Blocks that are held at a time, at most."""
        return self.consumer_back + self.producer_back + self.ahead + 1

    @property
    def back_rows(self) -> int:
        return self.producer_back * self.block_rows


class Window:
    """What a consumer may look at in one micro-batch: the new rows, and those of the blocks before that it may revisit."""

    def __init__(self, rows: DataFrame, pos: str, first: int, begin: int, end: int):
        self._rows, self._pos = rows, pos
        #: First position that may be looked at, first new one, and the one after the last.
        self.first, self.begin, self.end = first, begin, end

    def new(self) -> DataFrame:
        return self.since(self.begin)

    def since(self, position: int) -> DataFrame:
        """Rows from a position on; StreamError if that is further back than the pipe keeps."""
        if position < self.first:
            raise StreamError(f"position {position} is gone: the pipe keeps rows from {self.first} on")
        return self._rows.where(F.col(self._pos) >= position)


def _digest(p: Column) -> list[Column]:
    h = F.xxhash64(p.cast("long"))
    return [F.bit_xor(h).alias("mixed"), wrapping_sum(h).alias("total")]


class Pipe:
    """One producer, one consumer. Rows have a dense position column from 0."""

    def __init__(self, spark: SparkSession, config: PipeConfig = PipeConfig(), pos: str = "pos", path: str | None = None):
        """A new pipe, or with path one that another session left."""
        self.spark, self.config, self.pos = spark, config, pos
        self.path, self.report = path or scratch(spark, "pipe"), SpeedReport(0)

    # --- places: small files beside the blocks, replaced by a rename --------------------------------------------------

    def _fs(self, name: str):
        path = f"{self.path}/{name}"
        return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)

    def _get(self, name: str, default):
        store, path = self._fs(name)
        if store.get_file_info(path).type != fs.FileType.Directory:
            return default
        found = sorted((x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".json")), key=lambda x: int(x.rsplit("/", 1)[-1][:-5]))
        if not found:
            return default
        with store.open_input_stream(found[-1]) as f:
            return json.loads(f.read())

    def _put(self, name: str, number: int, value) -> None:
        store, path = self._fs(name)
        store.create_dir(path, recursive=True)
        new = f"{path}/{uuid.uuid4().hex}.new"
        with store.open_output_stream(new) as f:
            f.write(json.dumps(value).encode())
        if store.get_file_info(f"{path}/{number}.json").type == fs.FileType.File:
            store.delete_file(f"{path}/{number}.json")
        store.move(new, f"{path}/{number}.json")
        if store.get_file_info(old := f"{path}/{number - 2}.json").type == fs.FileType.File:  # the one before stays for who reads now
            store.delete_file(old)

    def _delete(self, name: str) -> None:
        store, path = self._fs(name)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)

    # --- producer -----------------------------------------------------------------------------------------------------

    def produce(self, df: DataFrame, order: str | None = None) -> None:
        """Write rows that go on where the ones before ended. `order` numbers the rows as they were written; without it
        they come by position. A step back by more than the rule allows, a gap, and rows beyond the declared number
        raise StreamError before a block is there to be read."""
        state = self._get("producer", {"calls": 0, "rows": 0, "last": None, "schema": None})
        p = F.col(self.pos)
        ends = df.agg(F.count("*").alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi"), *_digest(p), *([F.min_by(p, F.col(order)).alias("first"), F.max_by(p, F.col(order)).alias("last")] if order else [])).first()
        if ends["n"]:
            # Every position once: as many as the range has, with the same hashes in all.
            whole = self.spark.range(state["rows"], state["rows"] + ends["n"]).agg(*_digest(F.col("id"))).first()
            if (ends["lo"], ends["hi"] + 1, ends["mixed"], ends["total"]) != (state["rows"], state["rows"] + ends["n"], whole["mixed"], whole["total"]):
                raise StreamError(f"positions {ends['lo']} to {ends['hi']} don't go on from {state['rows']}")
            if self.config.rows is not None and state["rows"] + ends["n"] > self.config.rows:
                raise StreamError(f"the stream was declared to have {self.config.rows} rows")
            if state["rows"] % self.config.block_rows:
                raise StreamError("a block is full before the next one begins: write whole blocks but for the last")
            first, last = (ends["first"], ends["last"]) if order else (ends["lo"], ends["hi"])
            if order and (state["last"] is not None and first < state["last"] - self.config.back_rows or not violations(df, self.config.back_rows, order, self.pos).isEmpty()):
                raise StreamError(f"the producer goes back by more than {self.config.back_rows} rows")
            rows = df.drop(order) if order else df
            blocks = rows.withColumn("block", F.floor(p / F.lit(self.config.block_rows)))
            blocks.repartition("block").sortWithinPartitions("block", self.pos).write.partitionBy("block").mode("append").parquet(f"{self.path}/blocks")
            state |= {"rows": state["rows"] + ends["n"], "last": last, "schema": rows.schema.json()}
        self._put("producer", state["calls"], state | {"calls": state["calls"] + 1})

    def finish(self) -> int:
        """No more rows come; returns how many there were, which may be fewer than declared."""
        return self._get("producer", {"rows": 0})["rows"]

    # --- consumer -----------------------------------------------------------------------------------------------------

    def _blocks(self) -> set[int]:
        store, path = self._fs("blocks")
        if store.get_file_info(path).type != fs.FileType.Directory:
            return set()
        return {int(x.base_name[6:]) for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("block=")}

    def _next(self, at: int) -> int:
        """The end of the blocks that are there from `at` on without a gap, `ahead` of them at most."""
        store, path = self._fs("blocks")
        found = store.get_file_info([f"{path}/block={b}" for b in range(at, at + self.config.ahead)])
        return at + next((k for k, x in enumerate(found) if x.type != fs.FileType.Directory), len(found))

    def _read(self, schema: StructType, first: int, end: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/blocks/block={b}" for b in range(first, end)))

    def consume(self, each: Callable[[Window, int], None], timeout: int = 600) -> int:
        """Hand every block there is to each(window, number), `ahead` of them at a time, in order; returns how many rows
        were new. It can be called again after more was produced, or after a failure: the place is kept. A pipe that
        stands still for `timeout` seconds, where no micro-batch ends and Spark runs no job, raises TimeoutError; one that
        goes on may take as long as its rows ask for."""
        name, c, sc = "pipe_" + uuid.uuid4().hex, self.config, self.spark.sparkContext
        kept = max(c.consumer_back, 1)  # blocks before the next one that stay
        state = self._get("producer", {"schema": None, "rows": 0})
        if state["schema"] is None:
            return 0
        schema, rows = StructType.fromJson(json.loads(state["schema"])), state["rows"]
        there = self._blocks()
        begin = self._get("consumer", {"next": 0})["next"]
        missing = set(range(begin, max(there, default=-1) + 1)) - there
        if missing:
            raise StreamError(f"block {min(missing)} is missing")
        for b in there:
            if b < begin - kept:  # left by a batch that failed after its place was kept
                self._delete(f"blocks/block={b}")
        moved = time.monotonic()
        width = sum(8 if f.dataType.simpleString() in ("bigint", "double", "timestamp") else 4 for f in schema)
        self.report = SpeedReport(rows * width)

        def batch(arrived: DataFrame, number: int) -> None:
            nonlocal moved
            state = self._get("consumer", {"next": 0, "batch": -1})
            if number <= state["batch"]:
                return  # done before a restart
            # Files come in any order: each batch goes on with as many blocks as arrived in it, the next in order.
            end = self._next(at := state["next"])
            if end > at:
                first = max(0, at - c.consumer_back)
                each(Window(self._read(schema, first, end), self.pos, first * c.block_rows, at * c.block_rows, min(rows, end * c.block_rows)), number)
                self.report.add((min(rows, end * c.block_rows) - at * c.block_rows) * width)
            self._put("consumer", number, {"next": end, "batch": number})
            for b in range(max(0, at - kept), end - kept):
                self._delete(f"blocks/block={b}")
            moved = time.monotonic()

        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", c.ahead).parquet(f"{self.path}/blocks")
        query = stream.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        try:
            while not query.awaitTermination(min(1, timeout)):
                if sc.statusTracker().getActiveJobsIds():
                    moved = time.monotonic()
                elif time.monotonic() - moved > timeout:
                    raise TimeoutError(f"the pipe stood still for {timeout} s")
        finally:
            query.stop()
        return min(self._get("consumer", {"next": 0})["next"] * c.block_rows, rows) - min(begin * c.block_rows, rows)

    # --- life cycle ---------------------------------------------------------------------------------------------------

    def reset(self) -> None:
        """Empty the pipe for another stream: blocks, places and checkpoint go."""
        self.close()
        self.report = SpeedReport(0)

    def close(self) -> None:
        store, path = self._fs("")
        if store.get_file_info(path.rstrip("/")).type == fs.FileType.Directory:
            store.delete_dir(path.rstrip("/"))

    def __enter__(self) -> Pipe:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def lane_sums(pipe: Pipe, lanes: int = 2, key: str = "k", timeout: int = 600) -> DataFrame:
    """(lane, total) modulo 2^64 over all that the pipe has and had: a micro-batch adds up its rows in the executors,
    and a number a lane is kept with the pipe."""
    def add(window: Window, number: int) -> None:
        done = pipe._get("sums", {"batch": -1, "totals": {}})
        if number <= done["batch"]:
            return
        totals = done["totals"]
        for r in window.new().groupBy(F.pmod(F.col(pipe.pos), F.lit(lanes)).cast("int").alias("lane")).agg(wrapping_sum(F.col(key)).alias("s")).collect():
            totals[str(r["lane"])] = str((int(totals.get(str(r["lane"]), 0)) + int(r["s"])) % (1 << 64))
        pipe._put("sums", number, {"batch": number, "totals": totals})

    pipe.consume(add, timeout)
    return pipe.spark.createDataFrame(sorted((int(k), v) for k, v in pipe._get("sums", {"totals": {}})["totals"].items()), "lane int, total string")
