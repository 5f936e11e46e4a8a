"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference-cover sample.

The sample takes, of every document, the places whose remainder modulo V lies in a difference cover: whichever two
places of the corpus hold equal strings, within V bytes both meet the sample together. Sample suffixes are named first,
by the `width` - V + 1 bytes that stand there, and only names that occur again matter: a string of `width` bytes that
occurs twice holds a named sample suffix, whatever its place. Suffixes that hold none are settled by that alone.

The other suffixes are sorted one block at a time. A block is a range of the 64-bit hashes of the suffixes' first
`width` bytes, so that equal strings share a block, and long ties cost one comparison. Each block is dealt over all
partitions, sorted there, and leaves only the places of suffixes with an equal neighbour; its shuffle files go before
the next begins. So memory and disk hold the sample or one block, never all suffixes, and no pairs are made of a run.

Defined results: a null or empty text is no bytes. Equal rows are copies of each other, so a repeated row of `width`
bytes or more loses all that it holds. Matches never cross documents. Other columns are not read. Kept bytes may end
inside a character, so they are returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, Rolled, answer_buckets, answers, assembled, cut, exchange, groups, keyed, mix, packed, partitions_for, pieces, release, runs_of, turn, unpack, within

WIDTH, BLOCKS, PRIME = 400, 5, 17
#: Bytes of uid, place, and the part of the second hash that travels: with the first one's 64 bits it makes 96.
_WIDTHS, _WIDE = (8, 4), (8, 4, 4)
SPANS = "uid long, spans binary"
#: Bytes of text that a worker hashes at a time.
PIECE = 2_000_000


@lru_cache
def difference_cover(q: int = PRIME) -> tuple[int, tuple[int, ...]]:
    """A perfect difference set: V = q^2 + q + 1 and q + 1 remainders whose differences are all remainders once.

    Singer's construction: the powers of a generator of the cubic extension of the field of q elements that lie in a
    plane, for a prime q.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x^3 = a x^2 + b x + c
                x, plane = (1, 0, 0), []
                for k in range(v):
                    if k and x[1] == 0 and x[2] == 0:
                        break
                    if x[2] == 0:
                        plane.append(k)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                else:
                    if len(plane) == q + 1 and len({(s - t) % v for s in plane for t in plane}) == v:
                        return v, tuple(plane)
    raise ValueError("q must be a prime")


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_OTHERS = mix(_BYTES ^ np.uint64(0x5851F42D4C957F2D))


def _hashes(texts: list[bytes], uids: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the windows at the given places of the texts one after another, with uid and place in the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    mine = np.searchsorted(ends, starts, "right")
    return Rolled(_BYTES[flat]).windows(starts, width), [uids[mine], starts - (ends - sizes)[mine]]


def _block(texts: list[bytes], uids: np.ndarray, starts: np.ndarray, width: int, block: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """_hashes() of those windows whose first hash is in the block's range; only they are hashed a second time."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    h = Rolled(_BYTES[flat]).windows(starts, width)
    mine = (h >> np.uint64(16)) % np.uint64(blocks) == block
    h, starts = h[mine], starts[mine]
    doc = np.searchsorted(ends, starts, "right")
    return h, [uids[doc], starts - (ends - sizes)[doc], (Rolled(_OTHERS[flat]).windows(starts, width) >> np.uint64(32)).view(np.int64)]


def repeated_spans(docs: DataFrame, width: int = WIDTH, blocks: int = BLOCKS, prime: int = PRIME) -> DataFrame:
    """keyed docs -> (uid, spans): the bytes in strings of `width` bytes that also start elsewhere; a row for each block
    of suffixes and document."""
    spark = docs.sparkSession
    v, cover = difference_cover(prime)
    name = width - v + 1
    if name < 8:
        raise ValueError("the cover's period must leave some bytes to name")
    residues = np.zeros(v, bool)
    residues[list(cover)] = True
    buckets = partitions_for(docs, 10)
    back = answer_buckets(buckets)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", lambda: None)

        def entries():
            for batch in batches:
                for part in pieces(batch, most=PIECE):
                    texts = part.column("text").to_pylist()
                    at, starts = 0, []
                    for t in texts:
                        if len(t) >= width:
                            starts.append(np.flatnonzero(np.resize(residues, len(t) - name + 1)) + at)
                        at += len(t)
                    if starts:
                        yield _hashes(texts, part.column("uid").to_numpy(), np.concatenate(starts), name)

        yield from packed(entries(), buckets, 5, _WIDTHS, settle)

    def settle(h: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Strings that a task has twice or more are settled there; the first of each goes on for the others' sake."""
        order, starts, run = groups(h, columns[2] if len(columns) > 2 else None)
        settled, on = np.empty(len(h), bool), np.zeros(len(h), bool)
        settled[order] = (np.diff(np.append(starts, len(h))) > 1)[run]
        on[order[starts]] = True
        return on, settled

    def again(keep: int, widths: tuple[int, ...]):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tied():
                for h, uid, pos, *second in unpack(batches, keep, widths):
                    if h is None:
                        yield [uid, pos]
                        continue
                    order, starts, run = groups(h, *second)
                    many = np.empty(len(h), bool)
                    many[order] = (np.diff(np.append(starts, len(h))) > 1)[run]
                    yield [uid[many], pos[many]]

            yield from answers(tied(), back, _WIDTHS)

        return f

    def dealt(df: DataFrame, keep: int, widths: tuple[int, ...], before: int, after: int, label: str) -> DataFrame:
        out = cut(exchange(exchange(df, buckets).mapInArrow(again(keep, widths), PACKED), back).mapInArrow(lambda x: assembled(x, ["uid"], _WIDTHS, before, after), SPANS), label)
        release(spark)
        return out

    # Suffixes that hold a named sample suffix within their first `width` bytes start up to v - 1 bytes before it.
    named = dealt(docs.mapInArrow(sample, PACKED), 5, _WIDTHS, v - 1, 1, "named")
    held = cut(docs.join(named, "uid").select("uid", "text", "spans"), "suspects")
    release(spark)

    def suffixes(block: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def entries():
                for batch in batches:
                    for part in pieces(batch, most=PIECE):
                        texts = part.column("text").to_pylist()
                        masks = []
                        for t, n in zip(texts, part.column("spans").to_pylist()):
                            m = within(n, len(t))
                            m[max(0, len(t) - width + 1) :] = False
                            masks.append(m)
                        starts = np.flatnonzero(np.concatenate(masks))
                        yield _block(texts, part.column("uid").to_numpy(), starts, width, block, blocks)

            yield from packed(entries(), buckets, 8, _WIDE, settle)

        return f

    return reduce(DataFrame.unionByName, [dealt(held.mapInArrow(suffixes(block), PACKED), 8, _WIDE, 0, width, "block") for block in range(blocks)])


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, uid, n_bytes, n_removed, spans (maximal removed runs as pairs of uint32: first byte, length) and kept, a
    row per row of docs."""
    rows = keyed(docs)
    found = repeated_spans(rows, width).groupBy("uid").agg(F.collect_list("spans").alias("spans"))  # a row a block
    rows = rows.join(found, "uid", "left").select("doc_id", "uid", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    if spans is None:
                        out.append((len(text), 0, b"", text))
                        continue
                    gone = within(spans, len(text))
                    out.append((len(text), int(gone.sum()), runs_of(gone).tobytes(), np.frombuffer(text, np.uint8)[~gone].tobytes()))
                n, m, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(spans, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "uid", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(remove, "doc_id long, uid long, n_bytes long, n_removed long, spans binary, kept binary")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.length("spans") / 8).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w JOIN twice USING (h)),
runs AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
cuts AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a FROM runs UNION ALL SELECT r, octet_length(b), coalesce((SELECT max(e) FROM runs WHERE runs.r = d.r), 0) FROM d),
kept AS (SELECT cuts.r, string_agg(CASE WHEN s > a THEN hex(b[a + 1 : s]) ELSE '' END, '' ORDER BY s) AS x FROM cuts JOIN d USING (r) GROUP BY cuts.r),
sums AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
