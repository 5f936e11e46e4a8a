"""Headerless files of little-endian words as a Spark data source.

A stream is a plain file, a folder of plain files (which follow each other by name), or a folder with a manifest: the
list of its live files in order, which the writer replaces as the last step of a commit. Readers of such a folder read
what the manifest names and nothing else, so neither a failed write nor one that is under way is ever seen.

Read: spark.read.format("rawwords").option("path", file or folder).load() gives (pos long, k long); a partition takes
about `split` bytes in blocks of `block` bytes, an Arrow batch a block. Trailing bytes that fill no word are left out,
or, with unit=16, those that fill no pair of words. limit ends the stream early, after so many words.

Write: df (pos, k) with dense positions. mode("append") starts an empty target or goes on where its words end; other
positions fail (StreamError). mode("overwrite") replaces the stream at the commit. Options: width (8, 16, 32, 64 bits).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import StreamError
from ..session import partitions_for, ship

SCHEMA = "pos long, k long"
MANIFEST = "_manifest-"
BLOCK, SPLIT = 1 << 20, 1 << 26


def _open(path: str):
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[str]:
    """The manifests of a folder, the newest last."""
    store, top = _open(path)
    if store.get_file_info(top).type != fs.FileType.Directory:
        return []
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(top)) if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def manifest_of(path: str) -> list[tuple[str, int]] | None:
    """The live files and their bytes by the folder's newest manifest; None if it has none."""
    store, top = _open(path)
    if not (found := _manifests(path)):
        return None
    with store.open_input_stream(found[-1]) as f:
        return [(f"{top}/{x}", n) for x, n in json.loads(f.read())]


def commit_manifest(path: str, files: list[tuple[str, int]]) -> None:
    """Name the live files, in order, by one rename to a new name, which any store can do; then remove the manifests
    before it, and files that the last of them named and this one does not."""
    store, top = _open(path)
    before = _manifests(path)
    old = {x for x, _ in manifest_of(path) or []}
    number = int(before[-1][-13:-5]) + 1 if before else 0
    fresh = f"{top}/_new-{uuid.uuid4().hex}"
    with store.open_output_stream(fresh) as f:
        f.write(json.dumps([(x.rsplit("/", 1)[-1], n) for x, n in files]).encode())
    store.move(fresh, f"{top}/{MANIFEST}{number:08d}.json")
    for x in [*before, *(old - {x for x, _ in files})]:
        store.delete_file(x)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files of a stream in order, with their sizes."""
    store, top = _open(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    named = manifest_of(path)
    if named is not None:
        return named
    found = store.get_file_info(fs.FileSelector(top))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def metadata(spark: SparkSession, path: str, width: int = 64) -> DataFrame:
    """(file, name, bytes, first, words): the stream's files in order, with the position of their first word."""
    rows, at = [], 0
    for k, (name, size) in enumerate(files_of(path)):
        rows.append((k, name.rsplit("/", 1)[-1], size, at * 8 // width, (at + size) * 8 // width - at * 8 // width))
        at += size
    return spark.createDataFrame(rows, "file int, name string, bytes long, first long, words long")


@dataclass
class Split(InputPartition):
    blocks: list  # (path, offset, bytes, position of the first word)


def splits(files: list[tuple[str, int]], total: int, width: int, block: int, split: int) -> list[list[tuple[str, int, int, int]]]:
    """The first `total` bytes of the files as lists of blocks, of about `split` bytes a list."""
    out, held, pos, left = [], 0, 0, total
    for path, size in files:
        size = min(size // width * width, left)
        for at in range(0, size, block):
            n = min(block, size - at)
            if not out or held + n > split:
                out.append([])
                held = 0
            out[-1].append((path, at, n, pos))
            held += n
            pos += n // width
        left -= size
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 64)) // 8
        self.block, self.unit = int(options.get("block", BLOCK)), int(options.get("unit", 0)) or int(options.get("width", 64)) // 8
        self.split = int(options.get("split", SPLIT))
        self.limit = int(options["limit"]) if "limit" in options else None
        if self.width not in (1, 2, 4, 8) or self.block % self.width:
            raise StreamError("width is 8, 16, 32 or 64, and a block holds whole words")

    def partitions(self) -> list[Split]:
        listed = files_of(self.path)
        for path, size in listed[:-1]:
            if size % self.width:
                raise StreamError(f"{path} ends within a word")
        total = sum(size for _, size in listed) // self.unit * self.unit
        if self.limit is not None:
            total = min(total, self.limit * self.width)
        return [Split(x) for x in splits(listed, total, self.width, self.block, self.split)] or [Split([])]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        store = _open(self.path)[0]
        for path, offset, size, pos in part.blocks:
            with store.open_input_file(path) as f:
                f.seek(offset)
                data = f.read(size)
            if len(data) != size:
                raise StreamError(f"{path} became shorter")
            k = np.frombuffer(data, f"<u{self.width}").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + len(k))), pa.array(k)], names=["pos", "k"])


@dataclass
class Runs(WriterCommitMessage):
    runs: list  # (first position, words, file)


def live(path: str) -> list[tuple[str, int]]:
    """The files of a stream, none if there is no such path yet."""
    try:
        return files_of(path)
    except FileNotFoundError:
        return []


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.width = options["path"], int(options.get("width", 64)) // 8
        self.before = [] if overwrite else live(self.path)
        if self.before and manifest_of(self.path) is None:
            raise StreamError(f"{self.path} holds files that this writer did not commit")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Runs:
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        runs, out, after = [], None, None
        for b in batches:
            pos, k = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            if not len(pos):
                continue
            data = k.astype(np.int64).view(np.uint64).astype(f"<u{self.width}")
            cuts = np.flatnonzero(np.diff(pos) != 1) + 1
            for p, d in zip(np.split(pos, cuts), np.split(data, cuts)):
                if out is None or p[0] != after:
                    if out is not None:
                        out.close()
                    name = f"{top}/part-{int(p[0]):020d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                    runs.append([int(p[0]), 0, name])
                out.write(d.tobytes())
                runs[-1][1] += len(p)
                after = int(p[-1]) + 1
        if out is not None:
            out.close()
        return Runs([tuple(r) for r in runs])

    def commit(self, messages: list) -> None:
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        runs = sorted(r for m in messages if m is not None for r in m.runs)
        at = sum(size for _, size in self.before) // self.width
        for first, n, _ in runs:
            if first != at:
                self.abort(messages)
                raise StreamError(f"positions are not dense: {at} expected, {first} found")
            at += n
        commit_manifest(self.path, self.before + [(name, n * self.width) for _, n, name in runs])

    def abort(self, messages: list) -> None:
        store = _open(self.path)[0]
        for m in messages:
            for _, _, name in m.runs if m is not None else ():
                if store.get_file_info(name).type == fs.FileType.File:
                    store.delete_file(name)


class RawWords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawwords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RawWords)


def read_words(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("rawwords").options(path=path, **options).load()


def write_words(df: DataFrame, path: str, block: int = BLOCK, mode: str = "append", **options) -> None:
    """Blocks of positions stay together, so that each task writes few runs."""
    register(df.sparkSession)
    words = block * 8 // int(options.get("width", 64))
    rows = df.select(F.col("pos").cast("long").alias("pos"), F.col("k").cast("long").alias("k"), F.floor(F.col("pos") / F.lit(words)).alias("__b"))
    rows = rows.repartitionByRange(partitions_for(df, 64), "__b").sortWithinPartitions("pos").select("pos", "k")
    rows.write.format("rawwords").options(path=path, **options).mode(mode).save()


def truncate_words(path: str, words: int, width: int = 64) -> int:
    """End a committed stream after so many words, whatever was written: files beyond go, the one that holds the end is
    cut. Returns the words that are there then."""
    store, _ = _open(path)
    files = manifest_of(path)
    if files is None:
        raise StreamError(f"{path} has no manifest")
    left, keep = words * width // 8, []
    for name, size in files:
        n = min(size, left)
        if 0 < n < size:
            shorter = f"{name.rsplit('-', 1)[0]}-{uuid.uuid4().hex}"
            _copy(store, name, 0, n, store, shorter)
            name = shorter
        if n:
            keep.append((name, n))
        left -= n
    commit_manifest(path, keep)
    return sum(n for _, n in keep) * 8 // width


def _copy(store, source: str, offset: int, size: int, to, target: str, step: int = 1 << 22) -> None:
    with store.open_input_file(source) as f, to.open_output_stream(target) as g:
        f.seek(offset)
        while size:
            data = f.read(min(step, size))
            if not data:
                raise StreamError(f"{source} became shorter")
            g.write(data)
            size -= len(data)


def copy_words(spark: SparkSession, source: str, target: str, split: int = SPLIT) -> int:
    """A copy, byte for byte, also of bytes that fill no word; returns their number. A task copies about `split` bytes as
    bytes, block by block; the target's manifest is committed once all are there. The driver holds a row a split."""
    ship(spark)
    if live(target):
        raise StreamError(f"{target} is not empty")
    listed = files_of(source)
    work = [(k, path, at, n) for k, x in enumerate(splits(listed, sum(n for _, n in listed), 1, split, split)) for path, at, n, _ in x]
    if not work:
        _open(target)[0].create_dir(_open(target)[1], recursive=True)
        commit_manifest(target, [])
        return 0

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, to, top = _open(source)[0], *_open(target)
        to.create_dir(top, recursive=True)
        for b in batches:
            rows = b.to_pylist()
            names = [f"{top}/part-{r['split']:012d}-{r['at']:020d}-{uuid.uuid4().hex}" for r in rows]
            for r, name in zip(rows, names):
                _copy(store, r["path"], r["at"], r["size"], to, name)
            yield pa.RecordBatch.from_arrays([b.column("number"), pa.array(names, pa.string()), b.column("size")], names=["number", "name", "size"])

    jobs = spark.createDataFrame([(number, *w) for number, w in enumerate(work)], "number long, split long, path string, at long, size long")
    done = jobs.repartitionById(work[-1][0] + 1, F.col("split").cast("int")).mapInArrow(f, "number long, name string, size long").collect()
    commit_manifest(target, [(r["name"], r["size"]) for r in sorted(done)])
    return sum(r["size"] for r in done)

