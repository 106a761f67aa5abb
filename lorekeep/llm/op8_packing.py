"""Packing of pieces into sequences through the configuration linear program.

1. Every document is encoded and cut into pieces of at most ``capacity`` ids.
   The pieces (lengths and checksums, no ids) are written once; while writing,
   a task numbers its pieces of each length.
2. The histogram of lengths, at most ``capacity`` numbers, goes to the driver.
   There the configuration program (cover each length's count by as few filled
   sequences as possible) is solved by multiplicative weights: a knapsack
   dynamic program prices configurations under the present weights, and lengths
   covered too little gain weight.  Each pricing also bounds the number of sequences from below.  The
   fractional solution is rounded down to
   what the counts allow, and the rest is filled best-fit, by counts.  The program
   is solved for every histogram, with more rounds unless within ``GAP`` of the bound;
   best-fit alone only checks its plan: where rounding made it worse, as with few
   pieces, the rounded configurations that are least full go to the rest.
3. The plan is a table of runs: the pieces of one length with numbers in a
   range fill a place of one configuration.  Its size depends on ``capacity``
   alone, never on the number of documents.

Edge cases: a null or empty text is one piece of the end id alone.  Null or
repeated ids are packed row by row.  An empty table gives no rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, id_text, leanly, materialise, table
from .word_tokens import default_path, word_encoder

CAPACITY = 4096
END_ID = 1
ROUNDS = 16
GAP = 0.001  # of the lower bound
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, counts = word_encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in by_bytes(batches, 1, 1 << 20):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                data = np.append(ids, END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(data), capacity)):
                    own = data[start : start + capacity]
                    out.append((doc, k, start, len(own), zlib.crc32(own), part, counts[len(own)]))
                    counts[len(own)] += 1
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(leanly(run, "words"), PIECES)


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the length taken last (0: one unit stays empty)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(value > 0)
    for room in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, room, "right")]
        best[room] = best[room - 1]
        if len(fit):
            total = value[fit] + best[room - fit]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], last[room] = total[k], fit[k]
    return best, last


def taken(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicative weights for the configuration program: configurations with their fractional multiples, and a lower bound.

    Any weights price the program's dual: no packing has fewer sequences than the
    weight of all pieces over that of the best configuration.
    """
    lengths = np.flatnonzero(counts)
    weight = np.zeros(capacity + 1)
    weight[lengths] = 1.0
    covered = np.zeros(capacity + 1)
    found: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for t in range(rounds):
        value = weight * np.arange(capacity + 1)
        best, last = price(value, capacity)
        if best[capacity] > 0:
            bound = max(bound, float((counts * value).sum()) / float(best[capacity]))
        target = (t + 1) / rounds
        for n in sorted(lengths.tolist(), reverse=True):  # the best configuration through each length that lags
            lack = target * counts[n] - covered[n]
            if lack <= 0:
                continue
            config = tuple(sorted([n, *taken(last, capacity - n)], reverse=True))
            many = Counter(config)
            step = min(lack / many[n], min(max(counts[u] * 1.02 - covered[u], counts[u] * 0.02 / rounds) / m for u, m in many.items()))
            found[config] = found.get(config, 0.0) + float(step)
            for u, m in many.items():
                covered[u] += step * m
        over = covered[lengths] / counts[lengths] - target
        weight[lengths] *= np.exp(-0.15 * np.clip(over * rounds, -1, 1))
    return found, bound


def size_bound(counts: np.ndarray, capacity: int) -> float:
    """The dual bound of some known weights: a piece weighs its length's share, rounded down to thirds, halves and so on."""
    n, out = np.arange(capacity + 1), float((counts * np.arange(capacity + 1)).sum()) / capacity
    for k in range(1, 9):  # 1 for pieces of over 1 / (k + 1) of the capacity: k of these fit
        out = max(out, float(counts[n * (k + 1) > capacity].sum()) / k)
    return out


def round_down(counts: np.ndarray, found: dict[tuple[int, ...], float], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole multiples that the counts allow, fullest configurations first, and what is left."""
    left, plan = counts.copy(), []
    order = sorted(found, key=lambda c: (-sum(c), -found[c], c))
    for whole in (np.floor, np.ceil):
        for config in order:
            if sum(config) < capacity - 2 and whole is np.ceil:
                break
            uses, many = np.unique(config, return_counts=True)
            k = int(min(whole(found[config]), (left[uses] // many).min()))
            if k > 0:
                left[uses] -= k * many
                plan.append((config, k))
    return plan, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: groups of sequences filled alike stand for their members."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(config: tuple[int, ...], k: int) -> None:
        room = capacity - sum(config)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((config, k))

    for n in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[n])
        while rest:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, rest)
                k = rest // each
                put((n,) * each, k)
                rest -= k * each
                continue
            room = rooms[at]
            config, k = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            used = min(k, rest)
            put((*config, n), used)
            if k > used:
                put(config, k - used)
            rest -= used
    return [g for room in sorted(groups) for g in groups[room]]


def solve(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Configurations with multiples that use every length exactly as often as counted, and a lower bound of their number.

    The program's plan, with more rounds where it is not within ``GAP`` of the bound.
    Of its rounded configurations, fullest first, as many are kept as leave the
    plan no worse than best-fit alone.
    """
    def used(plan: list[tuple[tuple[int, ...], int]]) -> int:
        return sum(k for _, k in plan)

    def filled(kept: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
        left = counts.copy()
        for config, k in kept:
            np.subtract.at(left, list(config), k)
        return kept + best_fit(left, capacity)

    most, bound, plans = used(best_fit(counts, capacity)), size_bound(counts, capacity), []
    for rounds in (ROUNDS, 2 * ROUNDS):
        found, dual = fractional(counts, capacity, rounds)
        bound = max(bound, dual)
        kept = sorted(round_down(counts, found, capacity)[0], key=lambda g: -sum(g[0]))
        plan = filled(kept)
        while used(plan) > most:
            kept = kept[: len(kept) // 2]
            plan = filled(kept)
        plans.append(plan)
        if used(plan) <= np.ceil(bound - 1e-6) * (1 + GAP):
            break
    return min(plans, key=used), bound


def runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces a sequence, offset of the first), sorted by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, k in plan:
        offset = 0
        for n in sorted(set(config), reverse=True):
            each = config.count(n)
            rows.append((n, used.get(n, 0), sequence, each, offset))
            used[n] = used.get(n, 0) + each * k
            offset += n * each
        sequence += k
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer_path, capacity, id_col, text_col))
    local = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in local.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    place = spark.sparkContext.broadcast(runs(solve(counts, capacity)[0]))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(local.select("part", "length", before.alias("before")), ["part", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = place.value
        key = table_[:, 0] << 48 | table_[:, 1] if len(table_) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            own = table_[np.searchsorted(key, length << 48 | number, "right") - 1]
            nth = number - own[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(leanly(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
