"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every window of the texts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, capitals A-Z lowered. An item's windows
are its runs of `width` words; an item with fewer words, but not none, is one window. The windows are dealt by hash into
parts of about `most` windows; each part is broadcast and scanned for in a pass of its own, and the passes' hits are
united, so what the driver and an executor hold is bounded whatever the size of the benchmark. A hash that is found is
verified word by word.

Defined results: a null or empty text has no words and is clean; an item without words or without an id is left out;
items that share an id are one item; repeated documents are rows of the result each; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolled, cut, keyed, mix, pieces, ship, turn, within

#: Every byte that is no part of a word becomes a space; capitals become small.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCANNED = "doc_id long, uid long, n_words long, n_hit long, spans binary, items array<long>"


def words_in(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    w = words_in(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


class Windows:
    """Windows by their hash, in one sorted array for each length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.items = windows
        by: dict[int, list[bytes]] = {}
        for w in windows:
            by.setdefault(len(w), []).extend(w)
        self.sorted = {n: np.sort(Rolled(symbols(flat)).windows(np.arange(0, len(flat), n), n)) for n, flat in by.items()}

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document the (first word, length) of every occurrence, and the items with any."""
        out: list[tuple[list, set]] = [([], set()) for _ in docs]
        flat = [w for d in docs for w in d]
        if not flat:
            return out
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the document's end
        rolled = Rolled(symbols(flat))
        for n, known in self.sorted.items():
            at = np.flatnonzero(room >= n)
            h = rolled.windows(at, n)
            hit = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            doc = np.searchsorted(ends, hit, "right")
            for k, p in zip(doc.tolist(), hit.tolist()):
                if items := self.items.get(tuple(flat[p : p + n])):
                    out[k][0].append((int(p - ends[k] + sizes[k]), n))
                    out[k][1].update(items)
        return out


def symbols(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return mix(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))


def hit_words(spans: list[bytes], n: int) -> int:
    """How many of n words lie in any of the spans (pairs of uint32: first word, length)."""
    return int(within(spans, n).sum()) if any(spans) else 0


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, n, window): the items' different windows of n words, joined by spaces."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [(i, len(w), b" ".join(w)) for i, t in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()) for w in item_windows(t, width)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["item_id", "n", "window"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(f, "item_id long, n int, window binary").distinct()


_WINDOWS: dict[str, Windows] = {}


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, most: int = 1_000_000) -> list[DataFrame]:
    """keyed docs -> for each part of the windows: doc_id, uid, n_words, spans (pairs of uint32: first word, length) and
    items, a row per row of docs.

    The executors make the windows; the driver counts them, and fetches and broadcasts one part at a time, of about
    `most` windows with an item each, dealt by hash. With several parts each pass ends, and its broadcast goes, before
    the next begins."""
    spark = docs.sparkSession
    ship(spark)
    every = cut(windows(benchmark, width), "windows")
    parts = max(1, -(-every.count() // most))
    out = []
    for number in range(parts):
        part: dict[tuple[bytes, ...], list[int]] = {}
        for r in every.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)) == number).toLocalIterator():
            part.setdefault(tuple(bytes(r["window"]).split(b" ")), []).append(r["item_id"])
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def f(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            turn("decontam", _WINDOWS.clear)
            if name not in _WINDOWS:
                _WINDOWS.clear()
                _WINDOWS[name] = Windows(sent.value)
            for batch in batches:
                for p in pieces(batch):
                    words = [words_in(t) for t in p.column("text").to_pylist()]
                    found = _WINDOWS[name].scan(words)
                    spans = [np.array(x, "<u4").tobytes() for x, _ in found]
                    hits = [hit_words([x], len(w)) for x, w in zip(spans, words)]
                    yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("uid"), pa.array([len(w) for w in words], pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.binary()), pa.array([sorted(i) for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "uid", "n_words", "n_hit", "spans", "items"])

        found = docs.mapInArrow(f, SCANNED)
        if parts > 1:
            found = cut(found, "hits")
            sent.unpersist(blocking=True)
        out.append(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, most: int = 1_000_000) -> DataFrame:
    """doc_id, uid, n_words, n_hit, items (sorted ids) and contaminated, a row per row of docs."""
    passes = scan(keyed(docs), benchmark, width, most)
    if len(passes) == 1:
        out = passes[0]
    else:  # a row of each pass for each document; equal rows of docs come as often as they were
        found = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "uid", "n_words").agg(F.collect_list("spans").alias("many"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(passes)).cast("int").alias("times"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [hit_words(many, n) for n, many in zip(b.column("n_words").to_pylist(), b.column("many").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "uid", "n_words", "items", "times")), pa.array(hits, pa.int64())], names=["doc_id", "uid", "n_words", "items", "times", "n_hit"])

        out = found.mapInArrow(merge, "doc_id long, uid long, n_words long, items array<long>, times int, n_hit long").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return out.select("doc_id", "uid", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, n, p, item_id FROM dw JOIN bw USING (n, s)),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
