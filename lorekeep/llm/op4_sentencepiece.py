"""SentencePiece encoding and decoding by suffix-array matching.

For models of merges (BPE) with byte fallback.  A batch's texts are cut where no
piece can cross, before the space of each word and around characters without a
piece; the different words are joined
and indexed by a suffix array (sorted up to the longest piece).  Every piece is
looked up in it by binary search, a character at a time; its range lists all its
occurrences.  The occurrences are edges between positions.  Sorted by the
position where they end they are relaxed from left to right: an edge extends
the encoding of the part before it if no merge would cross the seam between the
last piece there and this one.  Exactly one edge into each position does, so
relaxing yields the encoding that merging by score gives.

Whether a merge crosses a seam follows from the merge trees alone: the nodes
along the left piece's right edge and the right piece's left edge meet while
both exist, and if they form a piece that merges before either is used up, the
seam does not hold.  Words in which scores tie (runs of spaces) and words that
hold a piece younger than its parts are merged with a queue instead; ``matched``
says for each text how many ids came from the suffix array.  Every batch is
indexed anew: different words are found by a 64-bit hash, and all their
characters are compared with those of the word that stands for them.

Models that are no BPE, or that normalise or pad texts otherwise than this
does, are refused.

Edge cases: null and empty texts have no ids.  Characters without a piece become
their bytes' pieces.  The space sign U+2581 in a text decodes as a space, as in
the library.  Null or repeated ids are kept row by row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, held, id_text, leanly, pick, table
from .word_tokens import span_hashes

REMEMBER = 1_000_000  # seams whose answer is kept
BATCH = 8 << 20  # bytes of text indexed together
SPACE = "▁"
LAST = np.int64(1) << 40  # a rank beyond all


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 0x7F) << shift
            shift += 7
            at += 1
            if message[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
            continue
        if key & 7 == 2:
            size, at = varint(at)
        if size is None:
            raise ValueError("not a model file")
        yield key >> 3, message[at : at + size]
        at += size


# Fields of a model file.
TRAINER, NORMALIZER, KIND, BYTE_FALLBACK, CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 3, 35, 2, 3, 4, 5
BPE = 2


def refuse_others(path: str) -> None:
    """Raises for models whose ids this method would not give."""
    with open(path, "rb") as f:
        model = dict(x for x in fields(f.read()) if x[0] in (TRAINER, NORMALIZER))
    trainer, normal = (dict(fields(model.get(k, b""))) for k in (TRAINER, NORMALIZER))
    wrong = {
        "is no BPE model": trainer.get(KIND, 1) != BPE,
        "has no byte fallback": not trainer.get(BYTE_FALLBACK, 0),
        "normalises characters": bool(normal.get(CHARSMAP, b"")),
        "puts no space before texts": not normal.get(DUMMY_PREFIX, 1),
        "removes spaces": bool(normal.get(REMOVE_SPACES, 1)),
        "keeps spaces as they are": not normal.get(ESCAPE_SPACES, 1),
    }
    if any(wrong.values()):
        raise ValueError(f"{path}: {', '.join(k for k, v in wrong.items() if v)}")


class Vocabulary:
    """The model's pieces as arrays, with the merge tree of each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        refuse_others(path)
        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, dtype=np.int64)
        normal = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        self.id = {self.pieces[i]: i for i in normal}
        rank = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = np.full(n + 1, -1, dtype=np.int64)  # characters are there from the start
        self.left = np.full(n, -1, dtype=np.int64)
        self.right = np.full(n, -1, dtype=np.int64)
        reached = []
        for i in normal:
            p = self.pieces[i]
            if len(p) == 1:
                reached.append(i)
                continue
            self.rank[i] = rank[self.score[p]]
            parts, tree = self.merge(p)
            if len(parts) == 1:
                self.left[i], self.right[i] = (self.id[x] for x in tree)
                reached.append(i)
        # Words for which the rule of seams is not known to hold: pieces younger than a part, or scores that tie.
        seen: dict[float, str] = {}
        self.odd = set()
        for p, s in self.score.items():
            if len(p) > 1 and seen.setdefault(s, p) != p:
                self.odd |= {p, seen[s]}
        for i in reached:
            if self.left[i] >= 0 and max(self.rank[self.left[i]], self.rank[self.right[i]]) >= self.rank[i]:
                self.odd.add(self.pieces[i])
        self.usable = np.array(reached)
        self.longest = max(map(len, self.id), default=1)
        joins = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    joins[a * n + b] = int(self.rank[i])
        self.join_keys = np.array(sorted(joins), dtype=np.int64)
        self.join_rank = np.array([joins[k] for k in self.join_keys.tolist()], dtype=np.int64)
        self.size = n
        self.crossing = any(SPACE in p[1:] and p.strip(SPACE) for p in self.id)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The pieces that merging by score leaves, leftmost first among equals; and the last merge."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, b, part[a] + part[b]))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        last = ("", "")
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not part[a] or not part[b] or part[a] + part[b] != joined or after[a] != b:
                continue
            last = (part[a], part[b])
            part[a], part[b] = joined, ""
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p], last

    def ids(self, parts: list[str]) -> list[int]:
        return list(chain.from_iterable([self.id[p]] if p in self.id else self.bytes[list(p.encode("utf-8", "surrogatepass"))].tolist() for p in parts))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.lengths = np.array([len(p) for p in v.pieces], dtype=np.int64)
        self.letters = np.zeros((len(v.usable), v.longest), dtype=np.int64)
        for row, i in enumerate(v.usable.tolist()):
            self.letters[row, : len(v.pieces[i])] = [ord(c) + 1 for c in v.pieces[i]]
        self.seam_keys = np.zeros(0, dtype=np.int64)
        self.seam_holds = np.zeros(0, dtype=bool)
        self.plain = re.compile(f"[^ {SPACE}]+| [^ {SPACE}]+")
        self.characters = np.zeros(0x110000, dtype=bool)
        self.characters[[ord(p) for p in v.id if len(p) == 1]] = True
        self.characters[32] = True
        single = set(v.bytes.tolist())
        out = [b"" if i in v.silent else bytes([int(p[3:5], 16)]) if i in single else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.byte_sizes = np.array(list(map(len, out)), dtype=np.int64)
        self.byte_place = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_pool = np.frombuffer(b"".join(out), dtype=np.uint8)
        odd = [re.escape(p.replace(SPACE, " ")) for p in v.odd if p.strip(SPACE)]
        self.has_odd = re.compile("|".join(odd)) if odd else None

    # seams

    def _holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the seam of pieces a and b."""
        v, holds = self.v, np.ones(len(a), dtype=bool)
        x, x_end = a.copy(), np.full(len(a), LAST)  # a node of a's right edge, and the rank that uses it up
        rows = np.arange(len(a))
        while len(rows):
            y, y_end, at = b[rows], np.full(len(rows), LAST), np.arange(len(rows))
            while len(at):
                xs, ends = x[at], x_end[at]
                key = xs * v.size + y[at]
                k = np.minimum(np.searchsorted(v.join_keys, key), len(v.join_keys) - 1)
                r = np.where(v.join_keys[k] == key, v.join_rank[k], LAST)
                meet = (v.rank[xs] <= y_end[at]) & (v.rank[y[at]] < ends)
                holds[rows[at[meet & (r < ends) & (r <= y_end[at])]]] = False
                y_end[at] = v.rank[y[at]]
                y[at] = v.left[y[at]]
                at = at[(y[at] >= 0) & holds[rows[at]]]
            x_end, x = v.rank[x], v.right[x]
            keep = (x >= 0) & holds[rows]
            rows, x, x_end = rows[keep], x[keep], x_end[keep]
        return holds

    def seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_holds`` with memory."""
        key, place = np.unique(a * self.v.size + b, return_inverse=True)
        at = np.searchsorted(self.seam_keys, key)
        new = np.ones(len(key), dtype=bool)
        inside = at < len(self.seam_keys)
        new[inside] = self.seam_keys[at[inside]] != key[inside]
        if new.any():
            own = key[new]
            if len(self.seam_keys) > REMEMBER:
                self.seam_keys, self.seam_holds = self.seam_keys[:0], self.seam_holds[:0]
                own = key
            where = np.searchsorted(self.seam_keys, own)
            self.seam_holds = np.insert(self.seam_holds, where, self._holds(own // self.v.size, own % self.v.size))
            self.seam_keys = np.insert(self.seam_keys, where, own)
            at = np.searchsorted(self.seam_keys, key)
        return self.seam_holds[at[place]]

    # matching

    def suffixes(self, code: np.ndarray) -> np.ndarray:
        """The suffix array of the codes, sorted up to the longest piece."""
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
        h = 1
        while h < self.v.longest:
            later = np.zeros(len(rank), dtype=np.int64)
            later[:-h] = rank[h:] + 1
            rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64)
            h *= 2
        return np.argsort(rank, kind="stable")

    def occurrences(self, code: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence, from a range of the suffix array for each piece."""
        padded = np.concatenate([code, np.zeros(self.v.longest, dtype=code.dtype)])
        low, high = np.zeros(len(self.v.usable), dtype=np.int64), np.full(len(self.v.usable), len(order), dtype=np.int64)
        own = self.lengths[self.v.usable]
        for depth in range(self.v.longest):
            rows = np.flatnonzero((own > depth) & (high > low))
            if not len(rows):
                break
            letter = self.letters[rows, depth]
            bounds = []
            for after in (False, True):
                a, b = low[rows].copy(), high[rows].copy()
                while (open_ := a < b).any():
                    middle = (a + b) // 2
                    there = padded[order[np.minimum(middle, len(order) - 1)] + depth]
                    less = open_ & ((there <= letter) if after else (there < letter))
                    a = np.where(less, middle + 1, a)
                    b = np.where(open_ & ~less, middle, b)
                bounds.append(a)
            low[rows], high[rows] = bounds
        n = np.maximum(high - low, 0)
        ends = np.cumsum(n)
        at = np.repeat(low - ends + n, n) + np.arange(int(n.sum()))
        return order[at], np.repeat(self.v.usable, n)

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words of known characters, in turn, how many each has, and which words took the queue."""
        joined = "\0".join(words) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(sizes + 1) - sizes - 1
        code[first + sizes] = 0  # between words
        start, piece = self.occurrences(code, self.suffixes(code))
        end = start + self.lengths[piece]
        word = np.repeat(np.arange(len(words)), sizes + 1)
        at = (end - first[word[start]]).astype(np.int32)
        order = np.argsort(at, kind="stable")
        start, piece, end, at = start[order], piece[order], end[order], at[order]
        begin = start == first[word[start]]
        last = np.full(len(code) + 1, -1, dtype=np.int64)  # the piece that ends at a position; -1: none yet
        broken = np.zeros(len(words), dtype=bool)
        steps = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(at)]):
            before = last[start[a:b]]
            ok = begin[a:b].copy()
            more = np.flatnonzero(~ok & (before >= 0))
            ok[more] = self.seams(before[more], piece[a:b][more])
            to = end[a:b][ok]
            last[to] = piece[a:b][ok]
            if len(to) > 1:
                to = np.sort(to)
                twice = to[1:][to[1:] == to[:-1]]
                if len(twice):
                    broken[word[twice - 1]] = True
        # back from the ends, all words at a time
        here, open_, back = first + sizes, np.arange(len(words)), []
        while len(open_):
            p = last[here[open_]]
            broken[open_[p < 0]] = True
            open_, p = open_[p >= 0], p[p >= 0]
            back.append((open_, p))
            here[open_] -= self.lengths[p]
            open_ = open_[here[open_] > first[open_]]
        n = np.bincount(np.concatenate([w for w, _ in back]), minlength=len(words))
        slow = {k: self.v.ids(self.v.merge(words[k])[0]) for k in np.flatnonzero(broken).tolist()}
        for k, ids in slow.items():
            n[k] = len(ids)
        begins = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), dtype=np.int32)
        for step, (w, p) in enumerate(back):
            good = ~broken[w]
            out[begins[w[good]] + n[w[good]] - 1 - step] = p[good]
        for k, ids in slow.items():
            out[begins[k] : begins[k] + n[k]] = ids
        return out, n, broken

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words in turn, how many each has, and which came from the suffix array."""
        plain = [k for k, w in enumerate(words) if self.plain.fullmatch(w) and not (self.has_odd and self.has_odd.search(w))]
        found: list[np.ndarray | None] = [None] * len(words)
        matched = np.zeros(len(words), dtype=bool)
        if plain:
            ids, n, broken = self._relax([words[k].replace(" ", SPACE) for k in plain])
            matched[plain] = ~broken
            for k, own in zip(plain, np.split(ids, np.cumsum(n)[:-1])):
                found[k] = own
        for k, w in enumerate(words):
            if found[k] is None:
                found[k] = np.array(self.v.ids(self.v.merge(w.replace(" ", SPACE))[0]), dtype=np.int32)
        return np.concatenate(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found)), matched

    @staticmethod
    def _distinct(joined: str, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words between bounds: the place of each different one, and which of these each word is."""
        start, sizes = bounds[:-1], np.diff(bounds)
        _, one, place = np.unique(span_hashes(code, start, bounds[1:]), return_index=True, return_inverse=True)
        same = sizes == sizes[one[place]]
        if same.all():  # the words tile the text, so their characters are the text's, in turn
            alike = code[start[0] : bounds[-1]] == code[np.repeat(start[one[place]] - start, sizes) + np.arange(start[0], bounds[-1])]
            if alike.all():
                return one, place
        words = [joined[a:b] for a, b in zip(start.tolist(), bounds[1:].tolist())]  # a hash that two words share
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        place = np.array([number[w] for w in words])
        return np.unique(place, return_index=True)[1], place

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.encode_counted(texts)[0]

    def encode_counted(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and how many of them came from the suffix array."""
        texts = [t or "" for t in texts]
        if not any(texts):
            return [np.zeros(0, dtype=np.int32) for _ in texts], np.zeros(len(texts), dtype=np.int64)
        joined = "".join(" " + t for t in texts if t)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begins = np.zeros(len(code) + 1, dtype=bool)
        begins[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = True
        begins[-1] = True
        if not self.v.crossing:
            space, alone = code == 32, ~self.characters[code]
            begins[1:-1] |= space[1:] & ~space[:-1]  # before the spaces of a word
            begins[:-1] |= alone  # a character without a piece merges with nothing
            begins[1:] |= alone
        bounds = np.flatnonzero(begins)
        one, place = self._distinct(joined, code, bounds)
        pool, n, matched = self._learn([joined[bounds[k] : bounds[k + 1]] for k in one.tolist()])
        each, first = n[place], np.cumsum(n) - n
        ends = np.cumsum(each)
        ids = pool[np.repeat(first[place] - ends + each, each) + np.arange(int(ends[-1]))]
        texts_end = np.searchsorted(bounds, np.cumsum(sizes))
        total, by_match = (np.concatenate([[0], np.cumsum(c)])[texts_end] for c in (each, each * matched[place]))
        return np.split(ids.astype(np.int32), total[:-1]), np.diff(by_match, prepend=0)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.byte_sizes[ids]
        ends = np.cumsum(sizes)
        return self.byte_pool[np.repeat(self.byte_place[ids] - ends + sizes, sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; unfinished bytes become the replacement character."""
        text = self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[int, Encoder] = held.setdefault("pieces", {})


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each worker process and model."""
    key = hash((len(vocabulary.pieces), zlib.crc32("\n".join(vocabulary.pieces).encode())))
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in by_bytes(batches, 1, BATCH):
            ids = pa.array(encoder.encode_all(batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(leanly(run, "pieces"), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(rows, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long"), "ids").mapInArrow(leanly(run, "pieces"), "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (32-bit little-endian ids), round_trip (the decoded ids are the text again), n_matched (ids by the suffix array)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in by_bytes(batches, 1, BATCH):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, matched = encoder.encode_counted(texts)
            same = [encoder.decode_bytes(x) == (f" {t.replace(SPACE, ' ')}".encode() if t else b"") for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()), pa.array(same), pa.array(matched)], ["doc_id", "n_ids", "ids_crc32", "round_trip", "n_matched"])

    return id_text(docs, id_col, text_col).mapInArrow(leanly(run, "pieces"), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, n_matched long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
