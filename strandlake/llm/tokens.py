"""Token ids of whole texts through the tokenizers library, with a bounded cache of words in each Python worker.

The vocabulary's pre-tokenizer never joins characters across white space, and its normaliser works within words, so the
ids of a text are the ids of its words (split at ASCII white space) one after another.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import turn

#: Words that a worker's cache holds at most; it starts anew beyond that (about 200 bytes a word).
CACHE_WORDS = 800_000
#: Punctuation that may end a word: a run of it after letters is a run of its own to the pre-tokenizer.
TAIL = b".,;:!?"
PROBE = "the école straße quickest über añade"
_OPEN: dict[str, "Words"] = {}


class Words:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 65536 else np.dtype("<u4")
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.by_words = bool(suffix)
        # For words that are normalised letters already: the same model without normaliser and patterns.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.bare.encode(PROBE, add_special_tokens=False).ids != self.tok.encode(PROBE, add_special_tokens=False).ids:
            self.bare = self.tok
        self.cache: dict[bytes, bytes] = {b"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, word: bytes) -> bytes | None:
        """The word as the normaliser leaves it, if that is letters alone; None if not, or if in doubt."""
        if word.isalpha():  # ASCII
            return word.lower()
        if word.isascii():
            return None
        s = word.decode("utf-8", "replace")
        if not s.isalpha() or "\u03a3" in s:  # Python lowers a last sigma in its own way
            return None
        s = unicodedata.normalize("NFC", s).lower()
        return s.encode() if s.isalpha() else None

    def _learn(self, missing: list[bytes]) -> None:
        """Words of letters alone, normalised here, are encoded hundreds at a time and parted at their last tokens.
        Letters with punctuation behind are two runs to the pre-tokenizer, encoded apart. Others go one by one."""
        known, plain, odd, tailed = self.cache, {}, [], []
        for w in missing:
            base = w.rstrip(TAIL)
            form = self._letters(base)
            if form is None:
                odd.append(w)
                continue
            if form not in known:
                plain[form] = None
            if form != w:
                tailed.append((w, form, w[len(base) :]))
        plain = list(plain)
        for k in range(0, len(plain), 256):
            part = plain[k : k + 256]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                odd += part
                continue
            data, size = ids.tobytes(), self.dtype.itemsize
            ends = (ends * size).tolist()
            known.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))
        odd += {tail for _, _, tail in tailed} - known.keys()
        if odd:
            known.update(zip(odd, self._encode([w.decode("utf-8", "replace") for w in odd])))
        known.update([(w, known[form] + known[tail]) for w, form, tail in tailed])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian in self.dtype."""
        if not self.by_words:
            return self._encode([t.decode("utf-8", "replace") for t in texts])
        if not texts:
            return []
        if len(self.cache) > CACHE_WORDS:
            self.cache = {b"": b""}
        # Equal texts once. ASCII capitals may go first, as the normaliser lowers them all; not where a special token
        # might stand.
        place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        raw = pa.array([t if b"<|" in t else t.lower() for t in place], pa.large_binary())
        words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers()))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.cast(pa.large_binary()).to_pylist()
        get = self.cache.get
        missing = [w for w in different if get(w) is None]
        if missing:
            self._learn(missing)
        ids = [self.cache[w] for w in different]
        flat, size = np.frombuffer(b"".join(ids), self.dtype), self.dtype.itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        each = lengths[at] if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        tokens = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], each)].tobytes() if len(at) else b""
        cuts = (ends[words.offsets.to_numpy() - words.offsets[0].as_py()] * size).tolist()
        done = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
        return [done[place[t]] for t in texts]


def words_of(path: str) -> Words:
    turn("tokens", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = Words(path)
    return _OPEN[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
