"""Quality rules with n-gram perplexity: a modified Kneser-Ney model counted by Spark, in sorted hash arrays.

The model's symbols are the code points of words and the end of a word; its n-grams are runs of up to ORDER symbols that
begin, at the earliest, with the white space before a word. Each language has a model. Tasks add up the n-grams of their
different words before the shuffle; counts, continuation counts, discounts, probabilities and back-off weights are
tables of Spark, which grow with the corpus. The finished model is a table of shards, each a sorted array of n-gram
hashes with their values; a scorer goes through the shards one at a time, so neither it nor the driver ever needs to
hold the model.

A document's perplexity is held against its language's band: the median of the logarithm over the language's documents
that pass the base rules, less or more `width` robust deviations. A deviation is LEAST plus one that falls with the
square root of a document's characters (1.4826 times the median absolute deviation at one character), as the mean over
a short text varies more.

Defined results: a null text has no words and fails the base rules; a null lang is a language of its own; a document of
a language none of whose documents passes the base rules fails them itself. Repeated rows count and are returned each.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, cut, mix, pieces, scratch, ship, split_words, turn
from .records import store

ORDER = 5
#: The deviation that any text may show; n-grams that a shard holds, about; bytes of shards that a worker keeps at most,
#: and bytes of text that it scores in one pass through the shards where they are more than that.
LEAST, SHARD, KEPT, MANY = 0.005, 500_000, 128_000_000, 16_000_000
SIGNS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The different words of some texts, as they stand in one run of symbols: a space before and after each."""

    def __init__(self, texts: list[bytes]):
        different, self.at, self.ends = split_words(texts)
        self.words = [w.decode("utf-8", "replace").replace("\0", "\ufffd") for w in different]
        self.symbols = np.frombuffer((" " + " ".join(self.words) + " ").encode("utf-32-le", "surrogatepass"), "<u4") if self.words else np.zeros(1, "<u4")
        space = self.symbols == 32
        begins = np.maximum.accumulate(np.where(space, np.arange(len(space)), 0))
        #: For each symbol but the first, the length of the n-gram that ends there, and its word.
        self.sizes = np.minimum(ORDER, np.arange(1, len(space)) - begins[:-1] + 1)
        self.word = np.cumsum(space)[:-1] - 1

    def hashes(self, seed: int) -> np.ndarray:
        """Hashes of the n-grams that end at each symbol but the first."""
        return gram_hashes(self.symbols, np.arange(1, len(self.symbols)), self.sizes, seed)

    def texts_of(self, places: np.ndarray) -> np.ndarray:
        """The n-grams that end at the given symbols."""
        out = np.zeros((len(places), ORDER), "<u4")
        size = self.sizes[places]
        for k in range(ORDER):
            own = k < size
            out[own, k] = self.symbols[places[own] + 2 - size[own] + k]
        return out.view(f"<U{ORDER}").ravel()


def gram_hashes(symbols: np.ndarray, last: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(last), np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) + sizes.astype(np.uint64)
    code = mix(symbols.astype(np.uint64) + np.uint64(1))
    for k in range(ORDER):
        own = sizes > k
        h = h * _STEP
        h[own] += code[last[own] - k]
    return mix(h)


def seed_of(lang: str | None) -> int:
    from xxhash import xxh3_64_intdigest

    return 1 if lang is None else xxh3_64_intdigest(lang, 2)


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): the n-grams over all words of all texts; each task adds up its own before the shuffle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality", forget)
        held: dict[str | None, list[tuple]] = {}

        def flush():
            for lang in list(held):
                h, n, gram = (np.concatenate(x) for x in zip(*held.pop(lang)))
                _, at, same = np.unique(h, return_index=True, return_inverse=True)
                total = np.bincount(same, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(gram[at].tolist(), pa.string()), pa.array(total)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in pieces(batch):
                for lang, own in by_language(part).items():
                    w = Words([part.column("text")[k].as_py() for k in own])
                    if not w.words:
                        continue
                    times = np.bincount(w.at, minlength=len(w.words))
                    h, at, same = np.unique(w.hashes(0), return_index=True, return_inverse=True)
                    held.setdefault(lang, []).append((h, np.bincount(same, times[w.word]), w.texts_of(at)))
                if sum(len(h) for x in held.values() for h, _, _ in x) > 1_000_000:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(f, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def by_language(part: pa.RecordBatch) -> dict[str | None, list[int]]:
    out: dict[str | None, list[int]] = {}
    for k, lang in enumerate(part.column("lang").to_pylist()):
        out.setdefault(lang, []).append(k)
    return out


def model(counts: DataFrame) -> DataFrame:
    """(lang, gram, p, weight): every n-gram's probability of its last symbol after the others, and, where it is a
    context, its back-off weight. Modified Kneser-Ney, interpolated, with Chen and Goodman's three discounts for each
    language and order; below it stands the even distribution over the language's symbols and one unknown.

    An n-gram that begins with white space, or has ORDER symbols, counts as often as it stands; the others count the
    different symbols before them.
    """
    longer, levels = None, {}
    for k in range(ORDER, 0, -1):
        own = counts.where(F.char_length("gram") == k)
        if longer is not None:
            shorter = longer.select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
            own = own.unionByName(shorter.where(~F.col("gram").startswith(" ") | (F.length("gram") == 1)))
        longer = levels[k] = cut(own.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "level")
    same = lambda a, b: a.eqNullSafe(b)
    symbols = levels[1].groupBy("lang").agg(F.count("*").alias("v")).select(F.col("lang").alias("l0"), "v")
    lower, out, contexts = None, None, None
    for k in range(1, ORDER + 1):
        level = levels[k]
        often = level.groupBy(F.col("lang").alias("l1")).agg(*(F.sum((F.col("n") == j).cast("double")).alias(f"n{j}") for j in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        fits = (F.col("n1") > 0) & (F.col("n2") > 0)
        # n_j of zero leaves half of what could go; without n_1 or n_2 every discount is a half. A tenth is the least,
        # so that no context keeps all it has for the symbols seen.
        cut_off = [F.when(fits, F.when(F.col(f"n{j}") > 0, F.greatest(F.lit(0.1), F.least(F.lit(float(j)), j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}")))).otherwise(0.5 * j)).otherwise(0.5).alias(f"d{j}") for j in (1, 2, 3)]
        rows = level.join(often.select("l1", *cut_off), same(level["lang"], F.col("l1"))).drop("l1")
        rows = rows.select("lang", "gram", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"), F.expr("left(gram, char_length(gram) - 1)").alias("context"))
        after = rows.groupBy(F.col("lang").alias("l2"), F.col("context").alias("c2")).agg(F.sum("n").alias("total"), F.sum("d").alias("off")).withColumn("weight", F.col("off") / F.col("total"))
        rows = rows.join(after, same(rows["lang"], F.col("l2")) & (rows["context"] == F.col("c2")))
        if lower is None:
            rows = rows.join(symbols, same(rows["lang"], F.col("l0"))).withColumn("below", 1 / (F.col("v") + 1))
        else:
            down = lower.select(F.col("lang").alias("l3"), F.col("gram").alias("g3"), F.col("p").alias("below"))
            rows = rows.join(down, same(rows["lang"], F.col("l3")) & (F.expr("substring(gram, 2)") == F.col("g3")))
        lower = cut(rows.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), "order")
        weights = after.select(F.col("l2").alias("lang"), F.col("c2").alias("gram"), "weight")
        out = lower if out is None else out.unionByName(lower)
        contexts = weights if contexts is None else contexts.unionByName(weights)
    both = out.select("lang", "gram", "p", F.lit(None).cast("double").alias("weight")).unionByName(contexts.select("lang", "gram", F.lit(None).cast("double").alias("p"), "weight"))
    unknown = symbols.select(F.col("l0").alias("lang"), F.lit("").alias("gram"), (1 / (F.col("v") + 1)).alias("p"), F.lit(None).cast("double").alias("weight"))
    return both.unionByName(unknown).groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight"))


SHARDS = "shard int, n int, hashes binary, logs binary, weights binary"


def sharded(table: DataFrame, path: str) -> None:
    """model() as a table of shards: ranges of the n-grams' hashes, sorted, with the logarithms of p and weight."""
    table = cut(table, "model")
    shards = max(1, -(-table.count() // SHARD))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.zeros(b.num_rows, np.uint64)
            grams = b.column("gram").to_pylist()
            for lang, own in by_language(b).items():
                sizes = np.array([len(grams[k]) for k in own])
                symbols = np.frombuffer(("x" + "".join(grams[k] for k in own)).encode("utf-32-le", "surrogatepass"), "<u4")
                h[own] = gram_hashes(symbols, np.cumsum(sizes), sizes, seed_of(lang))
            shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), b.column("p"), b.column("weight")], names=["shard", "h", "p", "weight"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shard, h = t.column("shard").to_numpy(), t.column("h").to_numpy().view(np.uint64)
        for k in np.unique(shard):
            own = np.flatnonzero(shard == k)
            own = own[np.argsort(h[own])]
            values = [np.log(np.maximum(t.column(c).to_numpy()[own].astype(np.float64), 1e-30)).astype("<f4").tobytes() for c in ("p", "weight")]  # null is not a number
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([h[own].tobytes()]), *(pa.array([v]) for v in values)], names=["shard", "n", "hashes", "logs", "weights"])

    rows = table.mapInArrow(name, "shard int, h long, p double, weight double").repartitionById(shards, F.col("shard"))
    rows.mapInArrow(pack, SHARDS).write.parquet(path)


_SHARDS: dict[str, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]] = {}


def read_shards(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, logs, weights) of one shard after another; as many as KEPT allows stay in the worker for the next time."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if path in _SHARDS:
        yield from _SHARDS[path]
        return
    files, top = store(path)
    kept, size, whole = [], 0, True
    for info in sorted(files.get_file_info(fs.FileSelector(top)), key=lambda x: x.path):
        if not info.base_name.endswith(".parquet"):
            continue
        for batch in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(1):
            for row in batch.to_pylist():
                shard = tuple(np.frombuffer(row[c], kind) for c, kind in (("hashes", "<u8"), ("logs", "<f4"), ("weights", "<f4")))
                size += 16 * row["n"]
                whole = whole and size <= KEPT
                if whole:
                    kept.append(shard)
                yield shard
    if whole:
        _SHARDS.clear()
        _SHARDS[path] = kept


# Functions that Spark ships refer to the module's own cache through these: what they name themselves is a copy.
def stays(path: str) -> bool:
    return path in _SHARDS


def forget() -> None:
    _SHARDS.clear()


def look_up(path: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p and log weight of n-grams by their hashes (ascending, different); not a number where there is none."""
    logs, weights = np.full(len(wanted), np.nan), np.full(len(wanted), np.nan)
    for hashes, p, w in read_shards(path):
        if not len(hashes):
            continue
        a, b = np.searchsorted(wanted, hashes[0]), np.searchsorted(wanted, hashes[-1], "right")
        at = np.searchsorted(hashes, wanted[a:b])
        hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == wanted[a:b])
        logs[a + hit], weights[a + hit] = p[at[hit]], w[at[hit]]
    return logs, weights


def word_logs(groups: list[tuple[Words, int]], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words of several languages (with their seeds): each different word's log probability (its symbols and its end)
    and its number of symbols. An n-gram that the model lacks backs off: the weight of its context, if that is known,
    times the n-gram without its first symbol. One pass through the shards serves all groups."""
    out = [np.zeros(len(w.sizes)) for w, _ in groups]
    todo, size = [np.arange(len(w.sizes)) for w, _ in groups], [w.sizes.copy() for w, _ in groups]

    def values(hashes: list[np.ndarray], column: int) -> list[np.ndarray]:
        different, same = np.unique(np.concatenate(hashes), return_inverse=True)
        return np.split(look_up(path, different)[column][same], np.cumsum([len(h) for h in hashes])[:-1])

    while any(len(t) for t in todo):
        p = values([gram_hashes(w.symbols, t + 1, n[t], seed) for (w, seed), t, n in zip(groups, todo, size)], 0)
        for k, x in enumerate(p):
            found = ~np.isnan(x)
            out[k][todo[k][found]] += x[found]
            todo[k] = todo[k][~found & (size[k][todo[k]] > 0)]  # with no symbol left, the language is unknown
        if not any(len(t) for t in todo):
            break
        weight = values([gram_hashes(w.symbols, t, n[t] - 1, seed) for (w, seed), t, n in zip(groups, todo, size)], 1)
        for k, x in enumerate(weight):
            out[k][todo[k]] += np.where(np.isnan(x), 0.0, x)
            size[k][todo[k]] -= 1
    return [(np.bincount(w.word, x, len(w.words)), np.bincount(w.word, minlength=len(w.words))) for (w, _), x in zip(groups, out)]


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = text.split()
    chars = sum(map(len, w)) - (len(text) - len(text.translate(None, CONTINUATION)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    threes = list(zip(w, w[1:], w[2:]))
    repeated = 0
    if len(set(threes)) < len(threes):
        often = Counter(threes)
        mask = bytearray(len(w))
        for k, t in enumerate(threes):
            if often[t] > 1:
                mask[k : k + 3] = b"\1\1\1"
        repeated = sum(mask)
    return len(w), chars, len(text) - len(text.translate(None, SIGNS)), len(lines) - len(set(lines)), repeated


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def score(docs: DataFrame, path: str) -> DataFrame:
    """The base measures of each document, and the logarithm of its perplexity under its language's model."""

    def scored(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [p.column("text").to_pylist() for p in parts]
        owners = [(k, own, seed_of(lang), Words([texts[k][i] for i in own])) for k, p in enumerate(parts) for lang, own in by_language(p).items()]
        owners = [x for x in owners if x[3].words]
        ppl = [np.zeros(len(t)) for t in texts]
        for (k, own, _, w), (logs, symbols) in zip(owners, word_logs([(w, seed) for _, _, seed, w in owners], path)):
            sums = [np.concatenate([[0.0], np.cumsum(x[w.at])]) for x in (logs, symbols)]
            total, n = (x[w.ends[1:]] - x[w.ends[:-1]] for x in sums)
            ppl[k][own] = -total / np.maximum(n, 1)
        for k, p in enumerate(parts):
            rules = list(zip(*map(base, texts[k])))
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("lang"), *(pa.array(c, pa.int64()) for c in rules), pa.array(ppl[k], pa.float64())], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality", forget)
        held, size, most = [], 0, PIECE
        for batch in batches:
            for part in pieces(batch):
                held.append(part)
                size += part.column("text").nbytes
                if size >= most:
                    yield from scored(held)
                    held, size = [], 0
                    most = PIECE if stays(path) else MANY  # a model that doesn't stay is worth a longer run of texts
        if held:
            yield from scored(held)

    return docs.mapInArrow(f, SCORED)


def judge(docs: DataFrame, width: float = 4.0) -> DataFrame:
    """The base measures, base_failed, log_ppl, its language's band and kept, a row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    path = scratch(spark, "model")
    sharded(model(cut(count(docs), "counts")), path)
    scored = cut(score(docs, path), "scored")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    good = scored.where(~F.col("base_failed"))
    middle = good.groupBy(F.col("lang").alias("l1")).agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("middle"))  # a row a language
    off = good.join(middle, good["lang"].eqNullSafe(F.col("l1"))).select("lang", "middle", (F.abs(F.col("log_ppl") - F.col("middle")) * F.sqrt("word_chars")).alias("off"))
    bands = cut(off.groupBy(F.col("lang").alias("l2"), "middle").agg((1.4826 * F.percentile_approx("off", 0.5, 10_000)).alias("one")), "bands")
    out = scored.join(bands, scored["lang"].eqNullSafe(F.col("l2")), "left").drop("l2")
    room = width * (LEAST + F.col("one") / F.sqrt(F.greatest("word_chars", F.lit(1))))
    low, high = F.col("middle") - room, F.col("middle") + room
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("low", low).withColumn("high", high).withColumn("kept", ~F.col("base_failed") & inside).drop("middle", "one")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")
