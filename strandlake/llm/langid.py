"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, of whatever length. The probability of a
word is the sum over all its segmentations into pieces, by the forward algorithm over the whole word; a text's is the
product over its words. Words are runs of letters in lower case with the vocabulary's word mark in front. Probabilities
of long words are kept in range by rescaling. The piece probabilities come from expectation maximisation
(forward-backward) over a bounded sample of labelled rows: at most `sample` documents of each language, those whose hash
of doc_id is least. Every text is scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing is labelled.
Ties go to the language that sorts first. The score is the posterior of the language under equal priors. A null doc_id
is neither held out nor learned from. Repeated rows are rows of the result each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolled, mix, pieces, ship, turn

MARK = "▁"
#: Probability of a letter that no piece has, and the words that a worker's cache holds at most.
FLOOR, CACHE_WORDS = 1e-9, 300_000
#: Entries of a lattice that are worked on at a time, letters between rescalings, and what a letter's probability is
#: multiplied by in training, where the sums over a word stay in range without rescaling.
ENTRIES, STRIDE, GAIN = 4_000_000, 16, 50.0
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of_text(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Vocabulary:
    """Finds the pieces that end at each letter of many words at once."""

    def __init__(self, names: list[str]):
        names = sorted({n for n in names if n and all(c.isalpha() or c == MARK for c in n)})
        self.size = len(names)
        self.longest = max(map(len, names), default=1)
        #: Letters of each piece; none for no piece, one for an unknown letter.
        self.letters = np.array([*map(len, names), 0, 1], np.float64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [k for k, x in enumerate(names) if len(x) == n]
            if own:
                h = Rolled(self._symbols("".join(names[k] for k in own))).windows(np.arange(0, n * len(own), n), n)
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array(own)[order]

    @staticmethod
    def _symbols(text: str) -> np.ndarray:
        return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time: their places in the list, and the piece that ends at a letter and has each
        number of letters (word, letter, letters of the piece - 1); self.size stands for no piece, self.size + 1 for an
        unknown letter."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            every = np.flatnonzero(sizes == n)
            most = max(1, ENTRIES // int(n * min(self.longest, n)))
            for first in range(0, len(every), most):
                own = every[first : first + most]
                rolled = Rolled(self._symbols("".join(words[k] for k in own.tolist())))
                base = np.arange(len(own)) * n
                out = np.full((len(own), n, min(self.longest, n)), self.size, np.int32)
                for k, (known, ids) in self.by_length.items():
                    if k > n:
                        break
                    at = (base[:, None] + np.arange(n - k + 1)[None, :]).ravel()
                    h = rolled.windows(at, k)
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    out[:, k - 1 :, k - 1] = np.where(known[i] == h, ids[i], self.size).reshape(len(own), -1)
                one = out[:, :, 0]
                one[one == self.size] = self.size + 1
                longest = max((k for k in self.by_length if k <= n and (out[:, :, k - 1] != self.size).any()), default=1)
                yield own, out[:, :, :longest]  # no longer piece is in these words

    def forward(self, lattice: np.ndarray, p: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        """Probability of each prefix under each language (word, letters, language), summed over all segmentations. With
        logs (word, language) the running sums are brought back to about one every few letters, and what they were
        divided by is added to logs: the last column then holds the word's probability up to that factor."""
        m, n, longest = lattice.shape
        a = np.zeros((m, n + 1, p.shape[1]))
        a[:, 0] = 1
        for end in range(1, n + 1):
            k = min(longest, end)
            a[:, end] = (a[:, end - k : end][:, ::-1] * p[lattice[:, end - 1, :k]]).sum(axis=1)
            if logs is not None and end % STRIDE == 0:
                recent = a[:, max(0, end - longest) : end + 1]
                size = recent.max(axis=1)
                recent /= size[:, None]
                logs += np.log(size)
        return a

    def backward(self, lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
        m, n, longest = lattice.shape
        b = np.zeros((m, n + 1, p.shape[1]))
        b[:, n] = 1
        for at in range(n - 1, -1, -1):
            for k in range(1, min(longest, n - at) + 1):
                b[:, at] += p[lattice[:, at + k - 1, k - 1]] * b[:, at + k]
        return b


def log_likelihoods(v: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), p.shape[1]))
    for own, lattice in v.lattices(words):
        logs = np.zeros((len(own), p.shape[1]))
        out[own] = np.log(np.maximum(v.forward(lattice, p, logs)[:, -1], 1e-300)) + logs
    return out


def train(v: Vocabulary, counts: list[Counter], rounds: int = 4) -> np.ndarray:
    """Piece probabilities (piece, language), with a row of zeros for no piece and one of FLOOR for unknown letters. A
    word whose probability is below the smallest number even so (some forty unknown letters) has no part in it."""
    words = sorted(set().union(*counts))
    times = np.array([[c[w] for c in counts] for w in words], np.float64)
    p = np.full((v.size + 2, len(counts)), 1 / max(1, v.size))
    p[v.size], p[v.size + 1] = 0, FLOOR
    gain = (GAIN**v.letters)[:, None]
    for _ in range(rounds):
        expected, scaled = np.full((v.size + 2, len(counts)), 0.05), p * gain
        for own, lattice in v.lattices(words):
            a, b = v.forward(lattice, scaled), v.backward(lattice, scaled)
            share = np.divide(times[own], a[:, -1], out=np.zeros_like(a[:, -1]), where=a[:, -1] > 1e-290)
            for k in range(1, lattice.shape[2] + 1):
                ids = lattice[:, k - 1 :, k - 1]
                some = ids != v.size
                if not some.any():
                    continue
                word, at = np.nonzero(some)
                got = a[word, at] * scaled[ids[some]] * b[word, at + k] * share[word]
                for lang in range(len(counts)):
                    expected[:, lang] += np.bincount(ids[some], got[:, lang], v.size + 2)
        p = expected / expected[: v.size].sum(axis=0)
        p[v.size], p[v.size + 1] = 0, FLOOR
    return p


def fit(docs: DataFrame, pieces_file: str, sample: int = 300) -> tuple[list[str], Vocabulary, np.ndarray] | None:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
    v = Vocabulary([sp.id_to_piece(k) for k in range(sp.get_piece_size())])
    # Everything that a prediction may learn from: text and lang of rows that are not held out.
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return None
    langs = sorted(rows)
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40))
    picked = None
    for lang in langs:  # about twice the sample by a threshold on the hash, then the least of those
        most = min(1 << 40, int((1 << 40) * 2 * sample / rows[lang]) + 1)
        part = (F.col("lang") == lang) & (place < most)
        picked = part if picked is None else picked | part
    counts = [Counter() for _ in langs]
    at = {x: k for k, x in enumerate(langs)}
    near = known.where(picked).select("lang", "text", "doc_id", place.alias("place"))
    first = near.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))).where(F.col("number") <= sample)
    for r in first.select("lang", "text").toLocalIterator():  # at most `sample` a language
        counts[at[r["lang"]]].update(MARK + w for w in words_of_text(r["text"]))
    return langs, v, train(v, counts)


class Scorer:
    """Sums of words' log likelihoods, with a bounded cache of words."""

    def __init__(self, v: Vocabulary, p: np.ndarray):
        self.v, self.p, self.known = v, p, {}
        self.table = np.zeros((0, p.shape[1]))

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.table = self.table[:0]
        missing = set()
        for words in texts:
            missing.update(words)
        missing.difference_update(self.known)
        if missing:
            new = sorted(missing)
            got = log_likelihoods(self.v, self.p, [MARK + w for w in new])
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, got])
        get = self.known.__getitem__
        out = np.zeros((len(texts), self.p.shape[1]))
        for k, words in enumerate(texts):
            if words:
                out[k] = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
        return out


_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: tuple[list[str], Vocabulary, np.ndarray] | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, with the prediction and its score under the given names (replacing columns of those names)."""
    import uuid

    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in keep if c not in (*names, "__text")]
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model)  # pieces of the vocabulary times languages
    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        turn("langid", _SCORERS.clear)
        if m is not None and name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(m[1], m[2])
        for batch in batches:
            for part in pieces(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                lettered = [any(map(str.isalpha, t)) for t in texts]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if m is not None:
                    got = _SCORERS[name].scores([words_of_text(t) if ok else [] for t, ok in zip(texts, lettered)])
                    best = got.argmax(axis=1)
                    top = 1 / np.exp(np.clip(got - got[np.arange(len(got)), best][:, None], -700, 0)).sum(axis=1)
                    for k, ok in enumerate(lettered):
                        if ok:
                            langs[k], scores[k] = m[0][best[k]], float(top[k])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return rows.mapInArrow(f, schema)


def pieces_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs, pieces_file()), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
