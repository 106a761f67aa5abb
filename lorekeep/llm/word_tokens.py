"""Exact ids of the lower-casing word BPE, with every distinct word encoded once.

In this tokenizer no merge crosses the words its splitter finds, so the ids of a
text are the ids of its words in turn.  Texts made of the letters, digits and
signs listed below are split here with array operations over a batch; a word is
known by a 64-bit hash with its length, and a bounded table holds the ids of the
words seen so far.  New words go to the library together, as one line.  Any
other text, and texts that hold one of the tokenizer's special strings, go to
the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The contractions the splitter knows, and the letters and signs
# whose lower case, composition and class are the same in every Unicode version.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
SIGNS = "¡¿«»‘’“”–—…"
SPACES = "\t\n\v\f\r "

MAX_WORDS = 1_000_000
SPACE, LETTER, DIGIT, SIGN, FOREIGN = range(5)
TOP = 0x2100
BASE = 0x9E3779B97F4A7C15
_kind = np.full(TOP + 1, FOREIGN, dtype=np.uint8)
_lower = np.arange(TOP + 1, dtype=np.uint32)
for _c in range(0x20, 0x7F):
    _kind[_c] = SIGN
for _c in LETTERS:
    _kind[ord(_c)] = LETTER
    if len(_c.upper()) == 1 and ord(_c.upper()) < TOP and _c != "ÿ":
        _kind[ord(_c.upper())] = LETTER
        _lower[ord(_c.upper())] = ord(_c)
for _c in "0123456789":
    _kind[ord(_c)] = DIGIT
for _c in SIGNS:
    _kind[ord(_c)] = SIGN
for _c in SPACES:
    _kind[ord(_c)] = SPACE

_powers: dict[int, np.ndarray] = held.setdefault("powers", {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0 .. n - 1 and the inverses, modulo 2 to the 64."""
    for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
        if len(_powers.get(k, ())) < n:
            step = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of code[start:end] for each span; the same wherever the span stands."""
    up, down = powers(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def split(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased codes, where the words start and end, and where foreign characters stand."""
    code = np.minimum(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), TOP)
    kind, code = _kind[code], _lower[code]
    begins = np.empty(len(code) + 1, dtype=bool)  # a word or a space begins
    begins[0] = begins[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[:-1] |= (kind == DIGIT) | (kind == SPACE)
    quote = np.flatnonzero(begins[:-1] & (code == ord("'")))
    if len(quote):  # a contraction is a word of its own, whatever letters follow it
        padded = np.concatenate([code, np.zeros(3, dtype=code.dtype)])
        for c in CONTRACTIONS:
            own = quote[np.all([padded[quote + 1 + j] == ord(x) for j, x in enumerate(c)], axis=0)]
            begins[own + 1] = False
            begins[own + 1 + len(c)] = True
    at = np.flatnonzero(begins)
    word = kind[at[:-1]] != SPACE
    return code, at[:-1][word], at[1:][word], np.flatnonzero(kind == FOREIGN)


class SpanTable:
    """The ids of words seen so far, by hash; ``most`` words at most, then all are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)  # of a word's first id in the pool
        self.sizes = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def find(self, hashes: np.ndarray, learn) -> np.ndarray:
        """Each word's number; ``learn`` gives (ids in turn, numbers of ids) of the words at some places."""
        if len(self.keys) > self.most:
            self.forget()
        keys, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            ids, sizes = learn(one[new])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.place = np.insert(self.place, where, self.used + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, where, sizes)
            self.used += len(ids)
            at = np.searchsorted(self.keys, keys)
        return at[place]

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in turn, and how many each has."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.place[words] - ends + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


class WordEncoder:
    """Ids of texts as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = SpanTable(MAX_WORDS)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):  # a word that the library splits otherwise: one by one
            each = [self._whole(w) for w in words]
            ids, last = np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, np.diff(last, prepend=0)

    def _words(self, joined: str, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number in the table of each word."""
        return self.table.find(span_hashes(code, start, end), lambda k: self._learn([joined[a:b] for a, b in zip(start[k].tolist(), end[k].tolist())]))

    def _plain(self, texts: list[str | None]):
        """The word numbers of all plain texts, how many each has, and the texts that aren't plain."""
        texts = [t or "" for t in texts]
        joined = "\n".join(texts) + "\n"
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(lengths + 1) - lengths - 1
        code, start, end, foreign = split(joined)
        other = np.zeros(len(texts), dtype=bool)
        other[np.searchsorted(first, foreign, "right") - 1] = True
        for s in self.special:
            if s in joined:
                other |= np.fromiter((s in t for t in texts), dtype=bool, count=len(texts))
        doc = np.searchsorted(first, start, "right") - 1
        if other.any():
            keep = ~other[doc]
            start, end, doc = start[keep], end[keep], doc[keep]
        words = self._words(joined, code, start, end) if len(start) else np.zeros(0, dtype=np.int64)
        return words, np.bincount(doc, minlength=len(texts)), np.flatnonzero(other).tolist()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a missing text is empty."""
        if not texts:
            return []
        words, each, other = self._plain(texts)
        ids, sizes = self.table.gather(words)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(each)])]
        out = np.split(ids, bounds[1:-1])
        for i in other:
            out[i] = self._whole(texts[i])
        return out

    def count_all(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        if not texts:
            return np.zeros(0, dtype=np.int64)
        words, each, other = self._plain(texts)
        total = np.concatenate([[0], np.cumsum(self.table.sizes[words])])[np.concatenate([[0], np.cumsum(each)])]
        out = np.diff(total)
        for i in other:
            out[i] = len(self._whole(texts[i]))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()


_encoders: dict[str, WordEncoder] = held.setdefault("words", {})


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
