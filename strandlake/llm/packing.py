"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Texts become ids, an end id is appended, and documents longer than a sequence are cut into full sequences and a rest.
The histogram (at most `capacity` lengths, so it fits the driver at any size) gives the covering program: fewest
sequences, each filled after one configuration, that hold all pieces. Multiplicative weights solve it: a length weighs
less the more it is covered beyond its turn, a knapsack dynamic program prices all spaces at once, and lengths that lack
take the best configurations that hold them, until every length is covered in full and none by more than the tolerance.
The solution is rounded and the program solved anew for what is left; the last few pieces go best fit first. The plan is
a list of configurations with counts, of a size that depends on `capacity` alone. Pieces are numbered within their
length, by a count per (length, salt) and a rank in it, and the plan turns numbers into places.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed as often as they
occur; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pieces, texts
from .tokens import vocabulary, words_of

LOG = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def token_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocab)
        end = np.array([end_id], words.dtype).tobytes()
        step = capacity * words.dtype.itemsize
        for batch in batches:
            for part in pieces(batch):
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = np.frombuffer(ids[at : at + step], words.dtype).astype("<u4").tobytes()
                        crc = zlib.crc32(own)
                        out.append((doc, k, k * capacity, len(own) // 4, crc, crc * 0x9E3779B1 + k + (0 if doc is None else doc) & 0x7FFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return texts(docs).mapInArrow(cutter, PIECES)


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the most weight in each space, and the index of a length that ends such a filling.

    Spaces that are best left partly empty have the answer of the largest space below, -1 if nothing fits.
    """
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    if not len(lengths):
        return best, pick
    # Weights by length, and the best fillings from the largest space down: both run on in memory for any space.
    by_length, place = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    by_length[lengths], place[lengths] = weights, np.arange(len(lengths))
    down = np.zeros(capacity + 1)
    for c in range(int(lengths[0]), capacity + 1):  # lengths ascend
        got = down[capacity - c + 1 :] + by_length[1 : c + 1]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], pick[c] = got[k], place[k + 1]
        else:
            best[c], pick[c] = best[c - 1], -2
        down[capacity - c] = best[c]
    return best, pick


def configuration(first: int, pick: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The filling of most weight that holds length `first`; where a limit cuts it short, best fit fills the space."""
    out, c = {first: 1}, capacity - int(lengths[first])
    while c > 0 and pick[c] != -1:
        k = int(pick[c])
        if k == -2:
            c -= 1
            continue
        if out.get(k, 0) < limits[k]:
            out[k] = out.get(k, 0) + 1
        c -= int(lengths[k])
    return fill(out, lengths, limits, capacity)


def fill(config: dict[int, int], lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Adds the longest pieces that still fit, best fit first."""
    space = capacity - sum(int(lengths[k]) * n for k, n in config.items())
    config = dict(config)
    live = np.flatnonzero(left > 0)  # lengths ascend
    at = len(live)
    while space > 0:
        at = int(np.searchsorted(lengths[live[:at]], space, "right"))
        if not at:
            break
        k = int(live[at - 1])
        n = min(int(left[k]) - config.get(k, 0), space // int(lengths[k]))
        if n > 0:
            config[k] = config.get(k, 0) + n
            space -= n * int(lengths[k])
        at -= 1
    return config


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, steps: int = 8, batch: int = 64, rate: float = 0.1, tolerance: float = 0.02, power: float = 1.3) -> tuple[dict[tuple, float], float]:
    """Covering program by multiplicative weights: configurations with the times each is used, and a lower bound.

    A step raises the share of every length that must be covered by 1 / steps, and ends when all are. The longest that
    lack are served first, as they fit least often, `batch` to a pricing: each takes the configuration of most weight that
    holds it, as often as the length lacks or another in it has room for. A length's weight falls the more it is covered beyond its turn, and
    it has no room left when it is covered 1 + tolerance times. The bound is the best of duals' values: need at prices
    at which no filling costs more than one (space taken, one for lengths over half, or the weights).
    """
    volume, room = lengths / capacity, need * (1 + tolerance)
    done, used = np.zeros(len(lengths)), {}
    bound = max(float(volume @ need), float(need[2 * lengths > capacity].sum()))
    for step in range(1, steps + 1):
        target = need * step / steps
        while len(short := np.flatnonzero(done < target - 1e-9 * need)):
            ahead = np.clip((done - target) / need * steps, -1, 30)
            # A first weight that grows faster than the space a piece takes: long pieces are harder to place.
            weight = volume**power * np.exp(-rate * ahead)
            best, pick = price(lengths, weight, capacity)
            bound = max(bound, float(weight @ need / best[capacity]))
            for k in short[::-1][:batch].tolist():
                if done[k] >= target[k]:
                    continue
                config = configuration(k, pick, lengths, np.where(room > 0.1 * tolerance * need, need, 0), capacity)
                x = min((target[k] - done[k]) / config[k], min(room[j] / n for j, n in config.items()))
                used[key] = used.get(key := tuple(sorted(config.items())), 0.0) + x
                for j, n in config.items():
                    done[j] += n * x
                    room[j] -= n * x
    return used, bound


def cover(lengths: np.ndarray, need: np.ndarray, capacity: int, passes: int = 6) -> tuple[list[tuple[int, list[tuple[int, int]]]], np.ndarray]:
    """The program's solution rounded, as in plan(), and the pieces of each length that it leaves.

    A configuration is used as often as the program does, rounded up, while all its pieces are there and if it is as full
    as the program's are on average. Then the program of what is left is solved, until it places a small part of it.
    """
    left, out = need.copy(), []
    for number in range(passes):
        live = np.flatnonzero(left)
        before = int(left.sum())
        if not before:
            break
        used, bound = solve(lengths[live], left[live], capacity)
        size = {c: sum(int(lengths[live[k]]) * m for k, m in c) for c in used}
        value = sum(used.values())
        least = min(0.995 * capacity, sum(size[c] * x for c, x in used.items()) / value - 1e-6)
        for config, x in sorted(used.items(), key=lambda kv: (-int(kv[1]), -size[kv[0]], -kv[1])):
            n = min(int(np.ceil(x - 1e-9)), min(int(left[live[k]]) // m for k, m in config))
            if n > 0 and size[config] >= least:
                out.append((n, [(int(lengths[live[k]]), m) for k, m in config]))
                for k, m in config:
                    left[live[k]] -= n * m
        placed = before - int(left.sum())
        LOG.info("pass %d: %d lengths, program %.1f sequences, lower bound %.1f, rounding placed %d of %d pieces", number, len(live), value, bound, placed, before)
        if placed < 0.2 * before:
            break
    return out, left


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Configurations (times used, [(length, pieces of it), ...]) that hold all pieces of the histogram exactly."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    out, left = cover(lengths, need, capacity)
    LOG.info("the program placed %d of %d pieces, %d of %d tokens", (need - left).sum(), need.sum(), lengths @ (need - left), lengths @ need)
    # The rest: the longest piece that is left opens a sequence, and the fullest filling of its space by pieces that are
    # left joins it. The same sequence is used as often as its pieces last.
    while left.any():
        live = np.flatnonzero(left)
        first = int(live[-1])
        config = best_filling(lengths, left, first, capacity)
        n = min(int(left[k]) // m for k, m in config.items())
        out.append((n, [(int(lengths[k]), m) for k, m in sorted(config.items())]))
        for k, m in config.items():
            left[k] -= n * m
    return out


def best_filling(lengths: np.ndarray, left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """A sequence that holds length `first` and, best fit first, the longest pieces that fit what is left.

    Of the two best-fit fillings (one piece that ends it exactly, if there is one, or longest first with a closing pair
    that fills the space exactly) the fuller one is taken.
    """
    config = {first: 1}
    space = capacity - int(lengths[first])
    have = left.copy()
    have[first] -= 1
    while space > 0:
        live = np.flatnonzero(have)
        live = live[lengths[live] <= space]
        if not len(live):
            break
        k = int(live[-1])
        if lengths[k] != space and len(live) > 1:
            # A pair that fills the space exactly beats the longest piece.
            other = space - lengths[live]
            at = np.searchsorted(lengths[live], other)
            ok = (at < len(live)) & (lengths[live[np.minimum(at, len(live) - 1)]] == other)
            ok &= (live[np.minimum(at, len(live) - 1)] != live) | (have[live] > 1)
            if ok.any():
                i = int(np.flatnonzero(ok)[-1])
                for j in (int(live[i]), int(live[at[i]])):
                    config[j] = config.get(j, 0) + 1
                break
        config[k] = config.get(k, 0) + 1
        have[k] -= 1
        space -= int(lengths[k])
    return config


def layout(configs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as a table sorted by (length, first number): pieces number first..first+times*per-1 of a length go, `per`
    to a sequence, into sequences base, base+1, ... from `offset` on."""
    rows, seen, base = [], {}, 0
    for times, parts in configs:
        offset = 0
        for length, per in parts:
            first = seen.get(length, 0)
            rows.append((length, first, per, base, offset))
            seen[length] = first + times * per
            offset += length * per
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "base", "offset"), a.T))


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    spark = docs.sparkSession
    p = cut(token_pieces(docs, vocab, end_id, capacity), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    table = layout(plan(histogram, capacity))
    salts = min(1024, max(1, -(-max(histogram.values(), default=1) // 200)))
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(salts)).cast("int"))
    counts = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "tie")) - 1
    p = p.withColumn("rank", rank).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("number"))
    sent = spark.sparkContext.broadcast(table)  # its size depends on capacity alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            # rows sort by (length, first): the last one not after (length, number) is the piece's
            lo = np.searchsorted(t["length"], length, "left")
            hi = np.searchsorted(t["length"], length, "right")
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                up = open_ & (t["first"][np.minimum(mid, len(t["first"]) - 1)] <= number)
                lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
            k = number - t["first"][lo]
            seq = t["base"][lo] + k // t["per"][lo]
            offset = t["offset"][lo] + (k % t["per"][lo]) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return p.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
