"""Shared by the operators: inputs, Arrow batches of whole texts, rolling hashes, and the packed exchange."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, input_bytes, partitions_for, release, scratch, shared_dir, ship  # noqa: F401

#: Bytes of text that a Python worker handles at a time.
PIECE = 4_000_000
#: Entries that a task gathers before it packs them into a row for each bucket.
ENTRIES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own, meant for short rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes, whatever else the table has; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """texts() with uid, a hash of both columns: rows that share a doc_id stay apart, and equal rows have equal results."""
    return texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about that many bytes each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum([0 if x is None else len(x) for x in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words (runs without ASCII white space) of the texts; all words one after another, as places among
    them; and where each text's words begin, with the end of the last."""
    raw = pa.array(texts, pa.large_binary())
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers()))
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends parts off an empty word
    coded = flat.filter(some).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), ends


_TURN: list = ["", lambda: None]


def turn(owner: str, clear: Callable[[], None]) -> None:
    """To be called by an operator before it fills a cache of this Python worker: workers live on from stage to stage,
    so another operator's cache goes first, and the memory returns to the system."""
    if _TURN[0] == owner:
        return
    _TURN[1]()
    _POWERS.clear()
    _TURN[:] = [owner, clear]
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system, which a long-lived worker's allocator would keep."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    pa.default_memory_pool().release_unused()


# --- rolling hashes -------------------------------------------------------------------------------------------------

_C = np.uint64(0x9E3779B97F4A7C15)
_CI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << int(n - 1).bit_length() if n > 1 else 1
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, c, np.uint64)])) for c in (_C, _CI)]
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolled:
    """Hashes of any windows of a sequence of 64-bit symbols, from one pass of prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.inverse = _powers(n + 1)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(n + 1)[0][:n], out=self.sums[1:])

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[at + width] - self.sums[at]) * self.inverse[at])


# --- packed exchange ------------------------------------------------------------------------------------------------
# A row of Spark costs tens of bytes besides its values, so millions of (hash, document, position) entries travel as
# a few rows of byte planes: each column is delta-coded and transposed, and planes of zeros vanish in shuffle compression.

PACKED = "bucket int, n int, " + ", ".join(f"c{k} binary" for k in range(5))


def _planes(x: np.ndarray, delta: bool, width: int) -> bytes:
    x = x.astype(np.int64, copy=False).view(np.uint64)
    if delta and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, delta: bool, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    x = out.reshape(-1).view(np.uint64)
    if width < 8 and delta:
        x = np.cumsum(x, dtype=np.uint64) & np.uint64((1 << 8 * width) - 1)
    elif delta:
        x = np.cumsum(x, dtype=np.uint64)
    return x.view(np.int64)


def pack(h: np.ndarray, columns: list[np.ndarray], buckets: int, keep: int = 8, widths: tuple[int, ...] = (8, 4), known: bool = False) -> Iterator[pa.RecordBatch]:
    """Entries as one row per bucket. h picks the bucket with its high half and travels with its low `keep` bytes.
    Entries that are `known` have their answer already and only pass through: their n is negative, and no hash is kept."""
    if not len(h):
        return
    b = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65536 else np.uint32)
    order = np.argsort(b, kind="stable")
    own, counts = np.unique(b, return_counts=True)
    ends = np.cumsum(counts)
    h, columns = h[order], [c[order] for c in columns]
    rows: dict[str, list] = {"bucket": own.tolist(), "n": (-counts if known else counts).tolist(), **{f"c{k}": [] for k in range(5)}}
    for end, n in zip(ends.tolist(), counts.tolist()):
        s = slice(end - n, end)
        rows["c0"].append(b"" if known else _planes(h[s].view(np.int64), False, keep))
        for i in range(4):
            rows[f"c{i + 1}"].append(_planes(columns[i][s], True, widths[i]) if i < len(columns) else b"")
    yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["n"], pa.int32()), *(pa.array(rows[f"c{k}"], pa.binary()) for k in range(5))], names=["bucket", "n", "c0", "c1", "c2", "c3", "c4"])


def unpack(batches: Iterator[pa.RecordBatch], keep: int = 8, widths: tuple[int, ...] = (8, 4)) -> Iterator[tuple[np.ndarray | None, ...]]:
    """The entries of one bucket after another: hash, then the columns; and as they come, known ones without a hash.
    A bucket's rows are neighbours (exchange), so a task holds one bucket at a time."""
    held: list[tuple] = []
    bucket = None

    def whole():
        trim()
        rows, held[:] = held[:], []
        return (np.concatenate([_unplanes(r[1], r[0], False, keep) for r in rows]).view(np.uint64), *(np.concatenate([_unplanes(r[i + 2], r[0], True, w) for r in rows]) for i, w in enumerate(widths)))

    for batch in batches:
        for row in batch.to_pylist():
            if row["n"] < 0:
                yield (None, *(_unplanes(row[f"c{i + 1}"], -row["n"], True, w) for i, w in enumerate(widths)))
                continue
            if row["bucket"] != bucket and held:
                yield whole()
            bucket = row["bucket"]
            held.append((row["n"], row["c0"], row["c1"], row["c2"], row["c3"], row["c4"]))
    if held:
        yield whole()


#: Partitions of an exchange at most; more buckets than that share partitions, in order.
PARTITIONS = 20_000


def exchange(packed: DataFrame, buckets: int, most: int = PARTITIONS) -> DataFrame:
    """Each bucket's rows in one partition, next to each other. There are as many buckets as the data asks for; where
    they are more than the partitions, Spark's own sort, which spills, brings a partition's rows in order of bucket."""
    if buckets <= most:
        return packed.repartitionById(buckets, F.col("bucket"))
    return packed.repartitionById(most, F.col("bucket") % most).sortWithinPartitions("bucket")


def groups(h: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts h, starts of the runs of equal values in it, and each entry's run (in sorted order). With second,
    a run's entries have that in common too."""
    order = np.argsort(h)
    s = h[order]
    new = np.empty(len(s), bool)
    if len(s):
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        if second is not None and (~new[1:] & (second[order][1:] != second[order][:-1])).any():  # two that share h alone
            order = np.lexsort((second, h))
            new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def packed(entries: Iterator[tuple[np.ndarray, list[np.ndarray]]], buckets: int, keep: int, widths: tuple[int, ...], settle: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """pack() over a task's entries, some million at a time (more, the more buckets there are).

    settle(h, columns) -> (sent, known), two masks over the entries: those that must meet their equals in the bucket, and
    those whose answer the task knows from the entries before it. So a hash that holds a third of all rows costs its
    bucket a few entries a million, and the known ones are dealt evenly, by document.
    """
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    most = min(8 * ENTRIES, max(ENTRIES, 50 * buckets))

    def flush():
        h, columns = np.concatenate([h for h, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held))]
        held.clear()
        if settle is not None:
            sent, known = settle(h, columns)
            yield from pack(mix(columns[0][known].view(np.uint64)), [c[known] for c in columns], buckets, 0, widths, True)
            h, columns = h[sent], [c[sent] for c in columns]
        yield from pack(h, columns, buckets, keep, widths)

    for h, columns in entries:
        held.append((h, columns))
        if sum(len(x) for x, _ in held) >= most:
            yield from flush()
    if held:
        yield from flush()
    trim()


def answer_buckets(buckets: int) -> int:
    """Answers are a small part of what was asked: fewer, fuller rows carry them than one for each pair of buckets."""
    return max(8, buckets // 2)


def answers(entries: Iterator[list[np.ndarray]], buckets: int, widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Entries (key columns, then place) dealt by their keys. They come, and stay, in runs of one document each."""

    def with_hash():
        for columns in entries:
            h = np.zeros(len(columns[0]), np.uint64)
            for c in columns[:-1]:
                h = mix(h ^ c.view(np.uint64))
            yield h, columns

    yield from packed(with_hash(), buckets, 0, widths)


def assembled(batches: Iterator[pa.RecordBatch], names: list[str], widths: tuple[int, ...], before: int, after: int) -> Iterator[pa.RecordBatch]:
    """Each document's places as the union of [place - before, place + after): one row a document, with its keys and
    `spans`, pairs of little-endian uint32: start and length, ascending and apart."""
    for _, *columns in unpack(batches, 0, widths):
        *keys, pos = columns
        if not len(pos):
            continue
        new = np.zeros(len(pos), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        heads = [k[starts] for k in keys]
        order = np.lexsort(tuple(reversed(heads)))
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for k in heads:
            fresh[1:] |= k[order][1:] != k[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        heads = [k[order][fresh] for k in heads]
        key = np.repeat(number, np.diff(np.append(starts, len(pos)))) << 32 | pos
        key.sort()
        doc, pos = key >> 32, key & 0xFFFFFFFF
        apart = np.ones(len(pos), bool)
        apart[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > before + after)
        first = np.flatnonzero(apart)
        last = np.append(first[1:], len(pos)) - 1
        begin = np.maximum(0, pos[first] - before)
        spans = np.stack([begin, pos[last] + after - begin], axis=1).astype("<u4")
        at = np.searchsorted(doc[first], np.arange(len(heads[0]) + 1))
        for i in range(0, len(heads[0]), 20_000):
            own = at[i : i + 20_001]
            offsets = ((own - own[0]) * 8).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spans[own[0] : own[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([*(pa.array(k[i : i + len(own) - 1], pa.int64()) for k in heads), blob], names=[*names, "spans"])


def within(spans: list[bytes] | bytes | None, n: int) -> np.ndarray:
    """Mask over n places: those in any span."""
    if isinstance(spans, list):
        spans = b"".join(spans)
    s = np.frombuffer(spans or b"", "<u4").reshape(-1, 2).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(s[:, 0], n), 1)
    np.add.at(edge, np.minimum(s[:, 0] + s[:, 1], n), -1)
    return np.cumsum(edge[:n]) > 0


def runs_of(mask: np.ndarray) -> np.ndarray:
    """The mask's maximal runs as pairs: start and length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], axis=1).astype("<u4")
