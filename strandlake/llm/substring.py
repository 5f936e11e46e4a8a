"""Substring deduplication with fixed-block anchors.

Every document's non-overlapping blocks of `block` words are indexed; every rolling window of `block` words probes the
index. A window of `window` >= 2 * block - 1 words holds a whole block of any document it also starts in, so a repeat is
always probed. Blocks and probes meet by hash in packed rows (a block is also a probe, so one entry serves both);
probes that meet a block of a document with a smaller doc_id, and blocks so met, become anchors. Anchors are extended to
both sides, a window at a time: each window of `window` words that holds an anchor meets its equals by a 128-bit hash of
its words (two independent ones of 64 bits), and one whose word sequence also starts in a document with a smaller doc_id
belongs to a repeat; overlapping ones join into maximal repeats.

Hot blocks, windows and copies: a task settles what the million entries before it tell already (a window that also
stands in a smaller document there is a repeat; of a block that stands there in many documents all but the least are
anchors, which extension judges exactly) and sends a few entries of each such hash on. No pairs are made.

Defined results: words are runs of bytes that are no ASCII white space, unchanged. A null or empty text has no words. A
null doc_id is neither smaller nor larger than any: nothing is removed there and nothing because of it. Rows that share
a doc_id do not remove from each other. Windows are judged on the input. Other columns are read only to be carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, Rolled, answer_buckets, answers, assembled, cut, exchange, groups, keyed, mix, packed, partitions_for, pieces, release, runs_of, turn, unpack, within

WINDOW, BLOCK = 13, 7


#: Documents of a task's million entries in which a block stands before the task settles it.
OFTEN = 16


def _symbols(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word of the documents one after another, and the documents' sizes."""
    from xxhash import xxh3_64_intdigest

    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for d in docs:
        flat[at : at + len(d)] = list(map(xxh3_64_intdigest, d))
        at += len(d)
    return mix(flat), sizes


def _entries(part: pa.RecordBatch, words: list[list[bytes]], starts: np.ndarray | None, width: int, second: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the windows (all of them, or those that start at the given places of the documents one after another)
    with doc_id, the row's uid, and the place in the document; `second` hashes of the same windows go with the places."""
    flat, sizes = _symbols(words)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) if starts is None else starts
    mine = doc[at]
    at = at[at + width <= ends[mine]]
    mine = doc[at]
    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
    columns = [ids[mine].astype(np.int64), part.column("uid").to_numpy()[mine], at - (ends - sizes)[mine]]
    return Rolled(flat).windows(at, width), [*columns, Rolled(mix(flat ^ SECOND)).windows(at, width).view(np.int64)] if second else columns


#: What is turned in a word's symbol for its second hash.
SECOND = np.uint64(0x5851F42D4C957F2D)
_WIDTHS, _WIDE = (8, 8, 4), (8, 8, 4, 8)
_KEYS = ["doc_id", "uid"]


def removed_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """keyed docs -> (doc_id, uid, spans): the words in windows whose sequence also starts in a document with a smaller id."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    buckets = partitions_for(docs, 10)
    back = answer_buckets(buckets)
    large, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def settle_blocks(h: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that stand in OFTEN documents or more: all but the least are anchors. The least, the greatest and the
        least indexed one go on."""
        order, starts, run = groups(h)
        d, indexed = columns[0][order], columns[2][order] % block == 0
        often = (np.diff(np.append(starts, len(h))) >= OFTEN)[run]
        least, most = np.minimum.reduceat(d, starts)[run], np.maximum.reduceat(d, starts)[run]
        first = np.minimum.reduceat(np.where(indexed, d, large), starts)[run]
        on, settled = np.empty(len(h), bool), np.empty(len(h), bool)
        settled[order] = often & (d > least)
        on[order] = ~often | (d == least) | (d == most) | (indexed & (d == first))
        return on, settled

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (_entries(part, [t.split() for t in part.column("text").to_pylist()], None, block) for batch in batches for part in pieces(batch))
        turn("substring", lambda: None)
        yield from packed(entries, buckets, 5, _WIDTHS, settle_blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def anchors():
            for h, doc, uid, pos in unpack(batches, 5, _WIDTHS):
                if h is None:
                    yield [doc, uid, pos]
                    continue
                order, starts, run = groups(h)
                d, indexed = doc[order], pos[order] % block == 0
                least = np.minimum.reduceat(np.where(indexed, d, large), starts)
                most = np.maximum.reduceat(d, starts)
                found = np.empty(len(h), bool)
                found[order] = (d > least[run]) | (indexed & (d < most[run]))
                yield [doc[found], uid[found], pos[found]]

        yield from answers(anchors(), back, _WIDTHS)

    def gather(before: int, after: int):
        return lambda batches: assembled(batches, _KEYS, _WIDTHS, before, after)

    def dealt(df: DataFrame, f, before: int, after: int, name: str) -> DataFrame:
        out = cut(exchange(exchange(df, buckets).mapInArrow(f, PACKED), back).mapInArrow(gather(before, after), "doc_id long, uid long, spans binary"), name)
        release(spark)
        return out

    # Windows that hold an anchor start up to window - block words before it.
    held = dealt(known.mapInArrow(probe, PACKED), meet, window - block, 1, "anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for batch in batches:
                for part in pieces(batch):
                    words = [t.split() for t in part.column("text").to_pylist()]
                    masks = [within(s, len(w)) for s, w in zip(part.column("spans").to_pylist(), words)]
                    yield _entries(part, words, np.flatnonzero(np.concatenate(masks)), window, True)

        yield from packed(entries(), buckets, 8, _WIDE, settle_windows)

    def settle_windows(h: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Windows that stand in a smaller document here, too, are repeats; the least of each go on."""
        order, starts, run = groups(h, columns[3])
        d = columns[0][order]
        settled = np.empty(len(h), bool)
        settled[order] = d > np.minimum.reduceat(d, starts)[run]
        return ~settled, settled

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def again():
            for h, doc, uid, pos, second in unpack(batches, 8, _WIDE):
                if h is None:
                    yield [doc, uid, pos]
                    continue
                order, starts, run = groups(h, second)
                d = doc[order]
                found = np.empty(len(h), bool)
                found[order] = d > np.minimum.reduceat(d, starts)[run]
                yield [doc[found], uid[found], pos[found]]

        yield from answers(again(), back, _WIDTHS)

    anchored = known.join(held, _KEYS).select("doc_id", "uid", "text", "spans")
    return dealt(anchored.mapInArrow(extend, PACKED), judge, 0, window, "repeats")


def deduplicate(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """doc_id, uid, n_words, n_removed, spans (maximal removed runs as pairs of uint32: first word, length) and
    kept_text (the words that stay, joined by one space, in UTF-8), a row per row of docs; with carry, also those columns
    of docs in a struct `carried`."""
    rows = keyed(docs)
    found = removed_spans(rows, window, block).select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), "spans")
    if carry:
        rows = docs.select(F.struct(*carry).alias("carried"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    more = ["carried"] if carry else []
    rows = rows.join(found, (rows["doc_id"] == found["d"]) & (rows["uid"] == found["u"]), "left").select("doc_id", "uid", "text", "spans", *more)
    schema = rows.select("doc_id", "uid").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("spans", "binary"), ("kept_text", "binary")):
        schema = schema.add(name, kind)
    if carry:
        schema = schema.add(rows.schema["carried"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = text.split()
                    if spans is None:
                        out.append((len(words), 0, b"", b" ".join(words)))
                        continue
                    gone = within(spans, len(words))
                    out.append((len(words), int(gone.sum()), runs_of(gone).tobytes(), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])))
                n, m, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(spans, pa.binary()), pa.array(kept, pa.binary()), *(part.column(c) for c in more)], names=["doc_id", "uid", "n_words", "n_removed", "spans", "kept_text", *more])

    return rows.mapInArrow(remove, schema)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_id AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s),
gone AS (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM x JOIN least_id USING (s) WHERE doc_id > m) GROUP BY r),
words AS (SELECT d.r, d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
lost AS (SELECT r, unnest(js) AS j FROM gone),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.j) AS t FROM words LEFT JOIN lost ON words.r = lost.r AND words.j = lost.j WHERE lost.j IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
