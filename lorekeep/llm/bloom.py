"""Bloom filters of 64-bit values, of bounded size: a fuller one lets more through, and never drops what is in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import leanly
from .shingles import mix

CHUNK_BITS = 19
MARKS = 8  # bits for each value


def places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Where the bits of values stand, one after the other."""
    mask = np.uint64((1 << bits) - 1)
    at, step = values.view(np.uint64), mix(values.view(np.uint64)) | np.uint64(1)
    for _ in range(MARKS):
        at = at + step
        yield ((at >> np.uint64(7)) & mask).astype(np.int64)


def bloom_of(values: DataFrame, limits: tuple[int, int]) -> tuple[int, list[tuple[int, bytes]]]:
    """The filter of a written table's only column: its number of bits as a power of 2, within ``limits``, and its chunks."""
    bits = min(max((24 * max(1, values.count()) - 1).bit_length(), limits[0]), limits[1])
    size = min(bits, CHUNK_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in places(batch.column(0).to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> size), pa.array(at & ((1 << size) - 1))], ["chunk", "at"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at = (c.to_numpy() for c in batch.columns)
            for c in np.unique(chunk).tolist():
                chunks.setdefault(c, np.zeros(1 << size, dtype=bool))[at[chunk == c]] = True
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([np.packbits(x).tobytes() for x in chunks.values()], pa.binary())], ["chunk", "bits"])

    marked = values.mapInArrow(leanly(mark), "chunk long, at long").repartition(1 << bits - size, "chunk")
    return bits, [(r["chunk"], bytes(r["bits"])) for r in marked.mapInArrow(leanly(build), "chunk long, bits binary").collect()]


class Bloom:
    def __init__(self, bits: int, chunks: list[tuple[int, bytes]]):
        self.size = bits
        self.bits = np.zeros(max(1, 1 << bits >> 3), dtype=np.uint8)
        for chunk, data in chunks:
            at = chunk << min(bits, CHUNK_BITS) >> 3
            self.bits[at : at + len(data)] = np.frombuffer(data, dtype=np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each value may be in the filter; never wrong about one that is."""
        found = np.ones(len(values), dtype=bool)
        for at in places(values, self.size):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found
