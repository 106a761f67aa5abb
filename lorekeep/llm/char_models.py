"""Interpolated Kneser-Ney models over the characters of words, one for each class.

A word is a run of letters, lower-cased, with ``ORDER - 1`` start marks before
and an end mark after it.  Characters from code ``WIDE`` on (Han, Hangul, kana and
others) are two symbols each, so that none shares the symbols of another; the
n-grams are of symbols.  Counting: tasks count words, turn them into n-grams of
characters packed in 64 bits, and emit (class, n-gram, count); Spark sums them
over all training rows.  The driver gets all of them, so the model grows with the
different n-grams of the input.  A caller may bound it: with ``cells`` each class
keeps its own most frequent n-grams, ``cells / classes`` at most.  Lower orders use
continuation counts; these are each class's own, or shared by all classes.

The finished model holds for each order a sorted array of n-gram keys, and for
each key the log probabilities of the classes that have it; contexts and back-off
weights likewise.  Its size is in proportion to the (class, n-gram) pairs.
Scoring is a binary search for each position and order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, leanly, materialise

ORDER = 5
BITS = 12
WIDE = 4000  # characters from here on are two symbols: one of WIDE on, then one of 2 .. WIDE - 1
FLUSH_WORDS = 300_000
PART = 1 << 16  # n-grams smoothed at a time
END = 1
_letters = re.compile(r"[^\W\d_]+")
COUNTS = "class string, gram long, n long"


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    found = _letters.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def lengths_of(words: list[str]) -> np.ndarray:
    """The words' numbers of characters, the end included."""
    return np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of all words in turn, and how many each word has (a symbol each, the end included)."""
    lengths = lengths_of(words)
    joined = np.frombuffer((" ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(lengths) - 1
    code = joined
    wide = joined >= WIDE
    if wide.any():  # no letter is beyond 0x3FFFF, so that the first symbol stays below 1 << BITS
        at = np.cumsum(1 + wide) - 1 - wide
        code = np.zeros(len(joined) + int(wide.sum()), dtype=np.int64)
        code[at] = np.where(wide, WIDE + joined // (WIDE - 2), joined)
        code[at[wide] + 1] = 2 + joined[wide] % (WIDE - 2)
        ends = at[ends]
        lengths = np.diff(ends, prepend=-1)
    code[ends] = END
    at = np.arange(len(code)) - np.repeat(ends - lengths + 1, lengths)
    gram = code.copy()
    for back in range(1, ORDER):
        gram[back:] |= np.where(at[back:] >= back, code[:-back], 0) << (BITS * back)
    return gram, lengths


def count_grams(rows: DataFrame) -> DataFrame:
    """rows: class, text.  class, gram, n over all of them."""

    def emit(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counter in words.items():
            own = list(counter)
            gram, lengths = grams_of(own)
            times = np.repeat(np.fromiter(counter.values(), dtype=np.int64, count=len(own)), lengths)
            keys, place = np.unique(gram, return_inverse=True)
            n = np.bincount(place, weights=times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["class", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in by_bytes(batches, 1):
            by_class: dict[str, list[list[str]]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_class.setdefault(label, []).append(words_of(text))
            for label, lists in by_class.items():
                words.setdefault(label, Counter()).update(chain.from_iterable(lists))
            if sum(map(len, words.values())) > FLUSH_WORDS:
                yield from emit({k: v for k, v in words.items() if v})
                words.clear()
        yield from emit({k: v for k, v in words.items() if v})

    counted = rows.select("class", "text").mapInArrow(leanly(run), COUNTS)
    return counted.groupBy("class", "gram").agg(F.sum("n").alias("n"))


def apart_by_class(rows: DataFrame) -> Column:
    """``apart`` (by class and key), set anew for classes that have no row on one side, where their ids allow it."""
    sides = rows.groupBy("class").agg(F.count_if("apart").alias("apart"), F.count("*").alias("n")).collect()
    apart = F.col("apart")
    for label in sorted(r["class"] for r in sides if r["apart"] in (0, r["n"])):
        keys = rows.where(F.col("class") == label).select("key").distinct()
        ids = keys.count()
        first = keys.orderBy("key").limit(max(1, ids // 10)).agg(F.max("key")).first()[0]
        apart = F.when(F.col("class") == label, (F.col("key") <= first) if ids > 1 else F.lit(False)).otherwise(apart)
    return apart


def bounded(counts: DataFrame, cells: int | None = None) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The classes, and for each its n-grams with counts: all, or with ``cells`` its own most frequent ones."""
    counts = materialise(counts)
    classes = sorted(r["class"] for r in counts.select("class").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("class")) if classes else F.lit(1)
    kept = counts.select(place.cast("short").alias("place"), "gram", "n")
    if cells is not None:
        room = cells // max(1, len(classes))
        steps = kept.groupBy("place", F.least(F.col("n"), F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("grams"))
        least, total = {}, Counter()
        for row in sorted(steps.collect(), key=lambda r: -r["n"]):  # 65,536 rows for each class at most
            total[row["place"]] += row["grams"]
            if total[row["place"]] > room:
                least.setdefault(row["place"], row["n"] + 1)
        if least:
            own = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("place").cast("int")]
            kept = kept.where(F.col("n") >= F.coalesce(own, F.lit(1)))
    found = kept.toArrow()
    place, gram, n = (found.column(k).to_numpy() for k in ("place", "gram", "n"))
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(1, len(classes) + 2))
    return classes, {c: (gram[order[i:j]], n[order[i:j]]) for c, i, j in zip(classes, cuts, cuts[1:])}


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Cells:
    """Values of (key, class) pairs that exist: sorted keys, where each one's classes begin, classes and values."""

    keys: np.ndarray
    begin: np.ndarray
    classes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, classes: np.ndarray, values: np.ndarray) -> Cells:
        """From pairs sorted by key."""
        own, begin = np.unique(keys, return_index=True)
        return cls(own, np.append(begin, len(keys)), classes, values.astype(np.float32))

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair that exists: the place in ``wanted``, its class, its value."""
        at, hit = _find(self.keys, wanted)
        row = np.flatnonzero(hit)
        first = self.begin[at[row]]
        sizes = self.begin[at[row] + 1] - first if len(row) else first
        cell = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(row, sizes), self.classes[cell], self.values[cell]


@dataclass
class CharModel:
    """Log probabilities by order, back-off weights by context; ``classes`` names the columns."""

    classes: list[str]
    floor: np.ndarray
    log_p: list[Cells]
    back_off: list[Cells]

    def score(self, gram: np.ndarray, order: int | None = None) -> np.ndarray:
        """Natural log probabilities of the last characters, a column for each class."""
        out = np.tile(self.floor, (len(gram), 1))
        for k in range(1, (len(self.log_p) if order is None else order) + 1):
            own = gram & ((1 << (BITS * k)) - 1)
            row, column, value = self.back_off[k - 1].hits(own >> BITS)
            out[row, column] += value
            row, column, value = self.log_p[k - 1].hits(own)
            out[row, column] = value
        return out

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of whole words by class, and their numbers of characters, the end included."""
        if not words:
            return np.zeros((0, len(self.classes)), dtype=np.float32), np.zeros(0, dtype=np.int64)
        gram, lengths = grams_of(words)
        keys, place = np.unique(gram, return_inverse=True)
        return np.add.reduceat(self.score(keys)[place], np.cumsum(lengths) - lengths, axis=0, dtype=np.float64), lengths_of(words)


def build(classes: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], shared: bool = False) -> CharModel:
    """Kneser-Ney with one discount for each order; ``shared``: the lower orders pool all classes."""
    width = len(classes)
    none = np.zeros(0, dtype=np.int64)
    gram = np.concatenate([none, *(counts[c][0] for c in classes)])
    own = np.repeat(np.arange(width, dtype=np.int16), [len(counts[c][0]) for c in classes])
    n = np.concatenate([none, *(counts[c][1] for c in classes)])
    order = np.lexsort((own, gram))
    levels = [(gram[order], own[order], n[order])]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: kinds of the next order with that suffix
        above, own, _ = levels[-1]
        if shared:
            keys, kinds = np.unique(np.unique(above) & ((1 << (BITS * k)) - 1), return_counts=True)
            levels.append((np.repeat(keys, width), np.tile(np.arange(width, dtype=np.int16), len(keys)), np.repeat(kinds, width)))
        else:
            pairs, kinds = np.unique((above & ((1 << (BITS * k)) - 1)) * width + own, return_counts=True)
            levels.append((pairs // max(1, width), (pairs % max(1, width)).astype(np.int16), kinds))
    levels.reverse()
    alphabet = max(2, len(np.unique(levels[0][0])) + 1)
    model = CharModel(classes, np.full(width, -np.log(alphabet), dtype=np.float32), [], [])
    for k, (gram, own, c) in enumerate(levels, 1):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        pairs, place = np.unique((gram >> BITS) * width + own, return_inverse=True)
        total, kinds = np.bincount(place, weights=c, minlength=len(pairs)), np.bincount(place, minlength=len(pairs))
        weight = discount * kinds / np.maximum(total, 1)
        p = (c - discount) / total[place]
        for at in range(0, len(gram), PART):
            some = slice(at, at + PART)
            keys, row = np.unique(gram[some], return_inverse=True)
            p[some] += weight[place[some]] * np.exp(model.score(keys, k - 1).astype(np.float64))[row, own[some]]
        model.log_p.append(Cells.of(gram, own, np.log(p)))
        model.back_off.append(Cells.of(pairs // max(1, width), (pairs % max(1, width)).astype(np.int16), np.log(weight)))
    return model


def by_document(texts: list[str | None], model: CharModel, use: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list]) -> list:
    """Calls use(log p of each word, its length, first word of each text, words of each text) on a batch of texts."""
    lists = [words_of(t) for t in texts]
    number: dict[str, int] = {w: i for i, w in enumerate(set(chain.from_iterable(lists)))}
    log_p, lengths = model.score_words(list(number))
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
    return use(log_p[ids], lengths[ids], np.cumsum(sizes) - sizes, sizes)
