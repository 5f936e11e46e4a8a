"""SimHash near-duplicate groups through an inverted index of byte positions with count filtering.

A text's fingerprint has 64 bits in 8 bytes. Two fingerprints that differ in at most d bits share at least 8 - d bytes at
the same positions, the guaranteed count. The positions are dealt into cells (four of two bytes for d = 2, eight of one
byte for d = 4), of which d bits spoil d at most, so linked fingerprints agree on `cells - d` cells: a posting list holds
the fingerprints that agree on such a choice of cells, 32 bits in either case, as single bytes would each hold a 256th
of all rows. Within a list the bytes shared at all eight positions are tallied for each pair; pairs that reach the
guaranteed count are kept and verified by their bits. A list gives a link from each fingerprint to the least one it
reaches there, never all pairs. Only different fingerprints enter the index, so copies cost one entry; components follow
by contraction.

Defined results: a null or empty text has no words and the fingerprint zero, which links like any other; rows that
repeat are rows of the result each; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed, partitions_for, pieces, turn
from .graph import components


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, joined by spaces, ASCII capitals lowered; repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, uid, fp): the fingerprint's 64 bits as a long, one row per row of docs."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("simhash", lambda: None)
        for batch in batches:
            for part in pieces(batch):
                fp = np.array([fingerprint(shingle_hashes(t, k)) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), pa.array(fp, pa.int64())], names=["doc_id", "uid", "fp"])

    return keyed(docs).mapInArrow(f, "doc_id long, uid long, fp long")


_LOW7, _HIGH1 = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _masks(places: list[int], bits: int) -> int:
    """How many ways there are to turn so many of the places, at most."""
    return sum(comb(len(places), r) for r in range(1, bits + 1))


def _near(fps: np.ndarray, label: np.ndarray, bits: int, need: int, sure: int) -> np.ndarray:
    """For each fingerprint the least label among those linked to it: pairs by the tally of shared bytes (unless the list
    makes sure of as many), then their bits."""
    out = label.copy()
    for at in range(0, len(fps), 256):
        x = fps[at : at + 256, None] ^ fps[None, :]
        if sure < need:
            differ = np.bitwise_count(((x & _LOW7) + _LOW7 | x) & _HIGH1)  # bytes that aren't zero
            row, own = np.nonzero(8 - differ >= need)
            ok = np.bitwise_count(x[row, own]) <= bits
            row, own = row[ok], own[ok]
        else:
            row, own = np.nonzero(np.bitwise_count(x) <= bits)
        np.minimum.at(out, at + row, label[own])
    return out


def _least_reached(fps: np.ndarray, free: int, bits: int, need: int) -> np.ndarray:
    """For the different fingerprints of one posting list, ascending: the least one that each reaches through links in
    the list. A list with more fingerprints than there are ways to turn `bits` of its free bits looks the turned ones up
    instead of tallying pairs, so the work for a fingerprint has a bound that the list's length can't exceed."""
    n = len(fps)
    label = np.arange(n)  # the least index is the least fingerprint
    places = [b for b in range(64) if free >> b & 1]
    near: list[np.ndarray] = []
    if n > _masks(places, bits):
        for c in (c for r in range(1, bits + 1) for c in combinations(places, r)):
            other = fps ^ np.uint64(sum(1 << b for b in c))
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            near.append(np.where(fps[at] == other, at, np.arange(n)).astype(np.int32))
    while True:
        if near:
            new = label
            for at in near:
                new = np.minimum(new, label[at])
        else:
            new = _near(fps, label, bits, need, 8 - -(-len(places) // 8))
        new = new[new]
        if (new == label).all():
            return fps[label]
        label = new


def near_links(different: DataFrame, bits: int = 2) -> DataFrame:
    """different (fp long, all different) -> links (u, v) that join exactly the fingerprints within so many bits."""
    if not 1 <= bits <= 6:
        raise ValueError("1 to 6 bits may differ")
    need = 8 - bits
    spark = different.sparkSession
    wide = 2 if bits <= 2 else 1  # bytes in a cell
    cells = [sum(0xFF << 8 * (wide * c + k) for k in range(wide)) for c in range(8 // wide)]
    sets = [sum(chosen) for chosen in combinations(cells, len(cells) - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in sets]
    index = different.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("set", "post"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(different, 4))
    index = index.repartition(parts, "set", "post").sortWithinPartitions("set", "post", "fp")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(s, post, fp):
            if not len(fp):
                return None
            new = np.ones(len(fp), bool)
            new[1:] = (s[1:] != s[:-1]) | (post[1:] != post[:-1])
            at = np.append(np.flatnonzero(new), len(fp))
            us, vs = [], []
            for k in np.flatnonzero(np.diff(at) > 1):
                own = np.sort(fp[at[k] : at[k + 1]].view(np.uint64))
                root = _least_reached(own, ~sets[s[at[k]]] & (1 << 64) - 1, bits, need)
                moved = root != own
                us.append(own[moved])
                vs.append(root[moved])
            if not us:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (us, vs)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() for c in ("set", "post", "fp")))
            s, post, fp = (np.concatenate(x) for x in zip(*held))
            last = (s == s[-1]) & (post == post[-1])  # this list may go on in the next batch
            cut_at = len(s) - int(last.sum())
            if cut_at:
                held = [(s[cut_at:], post[cut_at:], fp[cut_at:])]
                if (out := links(s[:cut_at], post[:cut_at], fp[:cut_at])) is not None:
                    yield out
        if held and (out := links(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield out

    return index.mapInArrow(f, "u long, v long").distinct()


def near_groups(docs: DataFrame, k: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, uid, fp, root, component_id) for every row of docs, equal for rows of one doc_id and text. root is the
    group's own fingerprint, which tells groups apart even where rows of one doc_id are in several."""
    marked = cut(fingerprints(docs, k), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes.select("fp"), bits))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "root", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "uid", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, k: int = 3, bits: int = 2) -> DataFrame:
    """docs with one row of each group: of its least doc_id, or without one if no member has one."""
    groups = cut(near_groups(docs, k, bits).groupBy("root", "component_id", "doc_id", "uid").agg(F.count("*").alias("times")), "groups")
    least = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min(F.struct("uid", "times")).alias("m"))
    kept = least.select(F.col("component_id").alias("__d"), F.col("m.uid").alias("__u"), F.col("m.times").alias("__n"))
    rows = docs.withColumn("__uid", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    out = rows.join(kept, (rows["__uid"] == kept["__u"]) & rows["doc_id"].eqNullSafe(kept["__d"]))
    if not kept.where("__n > 1").isEmpty():  # rows that repeat doc_id and text
        out = out.dropDuplicates(["__uid", "doc_id"])
    return out.select(docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
