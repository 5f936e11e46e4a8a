"""Token-id output as length-delimited binary records, with an offset index for shuffled reads.

A shard is two files in one folder. The record file holds, for each document in ascending doc_id order (nulls first,
then by text): the payload's length as 8 bytes, the masked checksum of those 8 bytes as 4, the payload, and its masked
checksum as 4. A payload is the document's ids as little-endian words of 2 bytes (4, for vocabularies over 65,536).
The index file holds, for each record in the same order, three 8-byte integers: doc_id, the record's offset in the
record file, and its number of ids; a null doc_id is the smallest 8-byte integer. A checksum c (CRC-32) is stored
masked, as ((c >> 15) | (c << 17)) + 0xa282ead8 modulo 2^32, so that checksums of stored checksums stay meaningful.

Defined results: a null or empty text is a record of the end id alone; repeated rows are repeated records; an empty
table has no shards and no rows; other columns of the input are not read. A task that is run again writes a file of
another name, and only the names that its committed attempt reported are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions_for, pieces, scratch, texts
from .tokens import vocabulary, words_of

NULL_ID = -(1 << 63)
_LEN = struct.Struct("<Q")
_CRC = struct.Struct("<I")
MANIFEST = "shard long, records string, offsets string, width int, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = _LEN.pack(len(payload))
    return b"".join((size, _CRC.pack(masked(size)), payload, _CRC.pack(masked(payload))))


def unframe(f) -> bytes | None:
    """The next payload of an open file; None at its end. Raises ValueError if a checksum or a length is wrong."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _CRC.unpack(head[8:])[0]:
        raise ValueError("bad record length")
    body = f.read(n := _LEN.unpack(head[:8])[0])
    tail = f.read(4)
    if len(body) < n or len(tail) < 4 or masked(body) != _CRC.unpack(tail)[0]:
        raise ValueError("bad record")
    return body


def store(path: str):
    """The file system of a URI or a local path, and the path in it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_records(docs: DataFrame, folder: str, vocab: str, end_id: int = 2, shard_mb: float = 16) -> DataFrame:
    """Encode and write every document; returns the manifest, one row per shard, in shard order by `shard`."""
    t = texts(docs)
    shards = partitions_for(docs, shard_mb)
    t = t.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, files, n_docs, n_tokens, at = words_of(vocab), None, 0, 0, 0
        end = np.array([end_id], words.dtype).tobytes()
        shard, base = TaskContext.get().partitionId(), None
        for batch in batches:
            for part in pieces(batch):
                if files is None:
                    fs, top = store(folder)
                    fs.create_dir(top, recursive=True)
                    base = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
                    files = [fs.open_output_stream(store(base + x)[1]) for x in (".rec", ".idx")]
                ids = [x + end for x in words.encode(part.column("text").to_pylist())]
                framed = [frame(x) for x in ids]
                files[0].write(b"".join(framed))
                index = np.empty((len(ids), 3), "<i8")
                index[:, 0] = [NULL_ID if x is None else x for x in part.column("doc_id").to_pylist()]
                sizes = np.array([len(x) for x in framed])
                index[:, 1] = at + np.cumsum(sizes) - sizes
                index[:, 2] = [len(x) // words.dtype.itemsize for x in ids]
                files[1].write(index.tobytes())
                at += int(sizes.sum())
                n_docs += len(ids)
                n_tokens += int(index[:, 2].sum())
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "records": base + ".rec", "offsets": base + ".idx", "width": words.dtype.itemsize, "n_docs": n_docs, "n_tokens": n_tokens}], schema=pa.schema([("shard", pa.int64()), ("records", pa.string()), ("offsets", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return cut(t.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record, read back: doc_id, start (ids of all records before it), n_tokens, ids_crc32 and the ids' bytes.

    A shard's base, the ids of the shards before it, is a running sum over the manifest (a row a shard); a shard is read
    by one task as a stream.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    todo = cut(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "shards")
    n = max(1, todo.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store(row["records"])
                with fs.open_input_stream(store(row["offsets"])[1]) as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                crcs, kind = np.empty(len(index), np.int64), np.dtype(f"<u{row['width']}")
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for k in range(len(index)):
                        ids = np.frombuffer(unframe(f), kind)
                        if len(ids) != index[k, 2]:
                            raise ValueError("index and records differ")
                        crcs[k] = zlib.crc32(ids.astype("<u4").tobytes())
                n = index[:, 2]
                start = row["base"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(index[:, 0], pa.int64(), mask=index[:, 0] == NULL_ID), pa.array(start, pa.int64()), pa.array(n.copy(), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    number = F.row_number().over(Window.orderBy("shard")) - 1
    return todo.withColumn("number", number.cast("int")).repartitionById(n, F.col("number")).drop("number").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_record(records: str, offset: int, width: int = 2) -> np.ndarray:
    """One record by its offset, as a shuffled reader does."""
    fs, path = store(records)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return np.frombuffer(unframe(f), f"<u{width}")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return read_records(write_records(docs, scratch(spark, "records"), vocabulary()))
