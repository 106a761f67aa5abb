"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always
stay.  The method proposes more spans, candidates of three further kinds, and
decides which of them to add:

* secret: a run of 16 or more letters, digits, ``_`` or ``-`` with a digit in it;
* handle: an address written out, such as ``name at host dot tld``;
* number: digit groups of 9 to 19 digits that are no base span.

On each candidate, base spans included, labelers vote yes, no or nothing:
regex labelers (shape of the span), a gazetteer labeler (issuer prefixes, common
top-level names) and context labelers (the words just before it, the
sign or quote next to it).  Votes are counted by kind and pattern over all documents; the
number of patterns is bounded by the labelers, not by the data.  From
these counts expectation-maximisation estimates every labeler's reliability for
yes and no; the posterior of each pattern then labels the training of the span
classifier.  This is a logistic model that does not see the votes, but the span and its
context: length, share of digits, letters, separators, variety, the word before
(hashed) and what follows, counted over all documents in these coarse steps.  Added spans are
the candidates it gives a half or more, unless they overlap a base span.

All finders are linear in the text: a pattern is tried once for each run of its characters.

Edge cases: null and empty texts hold nothing (counts 0, empty span lists).
Spans are in code points.  Overlapping added spans of one kind cannot occur;
spans of different kinds may overlap.  Null or repeated ids are kept row by row.
Other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, leanly, numbered, pick, place, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "handle", "number")
KINDS = BASE + ADDED

# The base patterns, without backtracking into a run of characters.
DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Gazetteers and context words.
TOP_NAMES = (
    "com org net edu gov mil int info biz name io dev app ai co me tv cloud online site tech de fr es uk eu it nl be at ch pl pt se no dk fi cz gr ie ru ua tr il in cn jp kr au nz ca us mx br ar za"
).split()
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6")
SECRET_WORDS = "token key secret password passwd pwd apikey api auth bearer credential".split()
CONTACT_WORDS = "call tel phone fax mobile mail email contact write reach card account iban ssn passport id".split()
HARMLESS_WORDS = "isbn issn doi commit sha md5 version page pages figure section chapter year".split()

_domain, _ip, _card, _phone = map(re.compile, (DOMAIN, IP, CARD, PHONE))
_secret = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}")
_at = re.compile(r" at | ?\(at\) ?| ?\[at\] ?", re.I)
_host = re.compile(r"[A-Za-z0-9-]++(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?|\.)[A-Za-z0-9-]++)+", re.I)
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")
_digits = re.compile(r"[0-9]")
_word_before = re.compile(r"([A-Za-z0-9]+)[\s:=\"'(#-]*\Z")
LABELERS = 6
YES, NO = 2, 1  # a vote's digit, base 3; 0: no vote
LENGTHS, VARIETY, WORDS = (16, 24, 40), (8, 14), 32
LOOKS = (len(LENGTHS) + 1, 3, 3, 3, len(VARIETY) + 1, WORDS, 3)  # how many values each feature of ``look`` has
BY_KIND = 5  # of them the first ones weigh by kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def local_start(text: str, free: int, end: int) -> int:
    """Where the run of characters of a local part begins that ends at ``end``, from ``free`` on."""
    if end <= free or _not_local.match(text, end - 1):
        return end
    step, start = 16, end
    while start > free:
        low = max(free, start - step)
        if bad := [m.end() for m in _not_local.finditer(text, low, start)]:
            return bad[-1]
        start, step = low, 2 * step
    return start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed and then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        if (m := _domain.match(text, at + 1)) and (start := local_start(text, free, at)) < at:
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no address goes on over this sign
        at = text.find("@", max(at + 1, free))
    if not _digits.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _card.finditer(text):
        if 16 <= m.end() - m.start() <= 2 * 19:
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def handles(text: str) -> list[tuple[int, int]]:
    """Addresses written out; the separator first, then outwards."""
    out, free = [], 0
    for sign in _at.finditer(text):
        if sign.start() < free:
            continue
        if not (m := _host.match(text, sign.end())):
            continue
        start = local_start(text, free, sign.start())
        if start < sign.start() and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            out.append((start, m.end()))
            free = m.end()
    return out


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans first, then those that the method may add."""
    out = base_spans(text)
    starts, ends = merged([s[1:] for s in out])

    def free(a: int, b: int) -> bool:
        return bisect_right(ends, a) == bisect_left(starts, b)

    if _digits.search(text):
        out += [(4, *m.span()) for m in _secret.finditer(text) if free(*m.span())]
        out += [(6, *m.span()) for m in _card.finditer(text) if 9 <= m.end() - m.start() <= 38 and 9 <= sum(c != " " and c != "-" for c in m.group()) <= 19 and free(*m.span())]
    out += [(5, *span) for span in handles(text) if free(*span)]
    return out


def word_before(text: str, start: int) -> str:
    m = _word_before.search(text[max(0, start - 40) : start])
    return m.group(1).lower() if m else ""


def look(text: str, start: int, end: int) -> int:
    """The classifier's features of a span and its context, as one number of LOOKS' mixed base."""
    span, after = text[start:end], text[end : end + 1]
    digits = sum(map(span.count, "0123456789"))
    word = word_before(text, start)
    values = (
        bisect_right(LENGTHS, len(span)),
        0 if 4 * digits < len(span) else 1 if 4 * digits < 3 * len(span) else 2,
        bool(re.search("[a-z]", span)) + bool(re.search("[A-Z]", span)),
        min(2, sum(map(span.count, " .-_@()[]"))),
        bisect_right(VARIETY, len(set(span))),
        1 + zlib.crc32(word.encode()) % (WORDS - 1) if word else 0,
        0 if not after or after.isspace() else 2 if after.isalnum() else 1,
    )
    out = 0
    for value, size in zip(reversed(values), reversed(LOOKS)):
        out = out * size + value
    return out


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The labelers' votes on a span as digits of base 3, the first labeler lowest."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before = text[max(0, start - 40) : start]
    word = word_before(text, start)
    near = before[-1:], text[end : end + 1]
    v = [0] * LABELERS
    # regex: shape
    if kind in (0, 1, 2, 3):
        v[0] = YES
    elif kind == 4:
        v[0] = YES if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_-]{24,}", span) and any(c.isalpha() for c in span) else NO
    elif kind == 5:
        v[0] = YES if re.search(r"[\[(]", span) else 0
    else:
        v[0] = YES if len(digits) >= 16 and luhn(digits) else NO
    # regex: mixture of characters
    kinds = len({c for c in span if c.isascii()})
    v[1] = (YES if kinds >= 10 else NO) if kind == 4 else (YES if re.search(r"[ .-]", span) and kind in (3, 6) else 0)
    # gazetteer
    if kind in (0, 5):
        v[2] = YES if re.split(r"[ .\])]+", span.rstrip(")]").lower())[-1] in TOP_NAMES else NO
    elif kind in (2, 6):
        v[2] = YES if digits.startswith(ISSUERS) and len(digits) >= 15 else NO
    # context: the word before
    v[3] = YES if word in SECRET_WORDS or word in CONTACT_WORDS else NO if word in HARMLESS_WORDS else 0
    # context: an assignment or a quote before the span
    v[4] = YES if re.search(r"[=:]\s*[\"']?\Z", before) or near[0] in ("\"", "'") and near[1] == near[0] else 0
    # context: the span goes on as part of a longer word or number
    v[5] = NO if any(c.isalnum() or c in "_/\\" for c in near if c) else YES
    return sum(x * 3**i for i, x in enumerate(v))


def unpack(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**i % 3 for i in range(LABELERS)], axis=1)


def estimate(kind: np.ndarray, pattern: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted patterns: each labeler's P(vote | no, yes), and the patterns' posteriors."""
    v = unpack(pattern)
    p = np.clip(0.5 + 0.12 * ((v == YES).sum(axis=1) - (v == NO).sum(axis=1)), 0.05, 0.95)
    p = np.where(kind < len(BASE), np.maximum(p, 0.9), p)
    reliable = np.full((LABELERS, 3, 2), 1 / 3)
    for _ in range(rounds):
        prior = np.array([[(n[kind == k] * (1 - p[kind == k])).sum() + 1, (n[kind == k] * p[kind == k]).sum() + 1] for k in range(len(KINDS))])
        prior /= prior.sum(axis=1, keepdims=True)
        for j in range(LABELERS):
            for x in range(3):
                own = v[:, j] == x
                reliable[j, x] = (n[own] * (1 - p[own])).sum() + 1, (n[own] * p[own]).sum() + 1
            # a vote of yes is at least as likely on true spans, a no on false ones
            reliable[j] /= reliable[j].sum(axis=0)
            if reliable[j, YES, 1] < reliable[j, YES, 0]:
                reliable[j, YES] = reliable[j, YES].mean()
            if reliable[j, NO, 0] < reliable[j, NO, 1]:
                reliable[j, NO] = reliable[j, NO].mean()
        log = np.log(prior[kind])
        for j in range(LABELERS):
            # silence says nothing
            log = log + np.where((v[:, j] == 0)[:, None], 0.0, np.log(reliable[j, v[:, j]]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return reliable, p


def design(kind: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """A column for each kind and each feature's value, and for the first features by kind too."""
    out, rest = [np.ones((len(kind), 1)), np.eye(len(KINDS))[kind]], looks
    for k, size in enumerate(LOOKS):
        value, rest = rest % size, rest // size
        out.append(np.eye(size)[value])
        if k < BY_KIND:
            out.append(np.eye(size * len(KINDS))[kind * size + value])
    return np.hstack(out)


def train(kind: np.ndarray, pattern: np.ndarray, looks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The span classifier's weights from counts of (kind, votes, features): fitted to the posteriors of the votes."""
    x = design(kind, looks)
    w = np.zeros(x.shape[1])
    if not len(n):
        return w
    pairs, place = np.unique(kind << 16 | pattern, return_inverse=True)
    _, posterior = estimate(pairs >> 16, pairs & 0xFFFF, np.bincount(place, weights=n))
    p = posterior[place]
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (n * (p - q)) - 0.1 * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts the votes and features over all documents and trains the classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for batch in by_bytes(batches, 0):
            for text in batch.column(0).to_pylist():
                for kind, a, b in candidates(text or ""):
                    key = kind, votes(text, kind, a, b), look(text, a, b)
                    counts[key] = counts.get(key, 0) + 1
        if counts:
            columns = [*zip(*counts), list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.int64()])], ["kind", "pattern", "look", "n"])

    rows = pick(docs, text=text_col).mapInArrow(leanly(run), "kind int, pattern int, look long, n long")
    # A row for each combination that occurs; the steps of the features and the votes bound these, not the documents.
    counted = rows.groupBy("kind", "pattern", "look").agg(F.sum("n").alias("n")).collect()
    counted.sort()
    kind, pattern, looks, n = (np.array([r[c] for r in counted], dtype=np.int64) for c in ("kind", "pattern", "look", "n"))
    return train(kind, pattern, looks, n.astype(float))


def spans_of(text: str | None, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans that are found, by kind as listed and then start."""
    if not text:
        return []
    found = candidates(text)
    more = [s for s in found if s[0] >= len(BASE)]
    if more:
        kind = np.array([s[0] for s in more])
        looks = np.array([look(text, a, b) for _, a, b in more])
        sure = np.concatenate([design(kind[i : i + 1024], looks[i : i + 1024]) @ weights for i in range(0, len(kind), 1024)]) >= 0
        more = [s for s, ok in zip(more, sure) if ok]
    return [s for s in found if s[0] < len(BASE)] + sorted(more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, n_added and n_spans (of all kinds)."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = spans_of(text, weights)
                base = [s for s in spans if s[0] < len(BASE)]
                each = [sum(s[0] == k for s in base) for k in range(len(BASE))]
                out.append((doc, *each, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base), len(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(leanly(run), schema)


def masked(text: str | None, weights: np.ndarray) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = sorted((a, b, k) for k, a, b in spans_of(text, weights))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs``, whatever its columns, with the spans in its texts masked."""
    at, rows = place(docs, text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            texts = pa.array([masked(t, weights) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return rows.mapInArrow(leanly(run), T.StructType(rows.schema.fields)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
