"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import op1_multi_index as op1


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        x = dict(rows)[q]
        out[q] = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for i, y in rows if i != q)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def same(got, want):
    """The same neighbours in the same order, and distances but for the order of additions."""
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in near], rtol=1e-14, atol=0)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))


def vectors(n, d=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_all_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(op1, "BLOCK", 40)  # several parts of a list, several groups of queries
    rows = vectors(300)
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies: ties go to smaller ids
    got = found(op1.search(table(spark, rows), F.col("vec_id") % 3 == 0, share=1.0))
    same(got, brute(rows, [i for i, _ in rows if i % 3 == 0]))


def test_edges(spark):
    rows = vectors(6)
    odd = [(50, None), (51, [0.0] * 8), (52, [1.0, None] * 4), (53, [float("nan")] + [1.0] * 7), (54, [float("inf")] * 8), (55, [1.0] * 3), (None, [1.0] * 8)]
    got = found(op1.search(table(spark, rows + odd + rows), F.lit(True), share=1.0))
    same(got, brute(rows, range(6)))  # fewer candidates than ten: all of them
    assert op1.search(table(spark, odd[:3]), F.lit(True)).count() == 0
    assert op1.search(table(spark, rows).limit(0), F.lit(True)).count() == 0
    assert found(op1.search(table(spark, [(1, [1.0]), (2, [3.0])]), F.lit(True))) == {1: [(2.0, 2)], 2: [(2.0, 1)]}


@pytest.mark.parametrize(("sf", "step"), [("sf0.01", 10), ("sf0.1", 40)])
def test_recall_and_entries_compared(spark, sf, step):
    data = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in data.collect()]
    df = op1.search(data, F.col("vec_id") % step == 0).persist()
    got = found(df)
    want = brute(rows, list(got))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert len(got) == 50 and hits >= 0.9 * 10 * len(want)
    assert df.agg(F.max("compared")).first()[0] <= len(rows) / 3
    df.unpersist()


def test_clustered_vectors_need_few_entries(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16)) * 10
    rows = [(i, [float(v) for v in centre[i % 40] + rng.normal(size=16)]) for i in range(4000)]
    df = op1.search(table(spark, rows), F.col("vec_id") % 100 == 0).persist()
    got = found(df)
    want = brute([(i, np.float32(x).astype(float).tolist()) for i, x in rows], list(got))
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert df.agg(F.max("compared")).first()[0] <= 0.1 * len(rows)
    df.unpersist()


def test_blocks_hold_every_pair():
    rng = np.random.default_rng(3)
    held = rng.integers(0, 6, (9, 11)) * (rng.random((9, 11)) < 0.6)
    held[4, 4] = 57
    first, parts = op1.blocks(held, 10)
    own = {}
    for i, j in zip(*np.nonzero(held)):
        for b in range(first[i, j], first[i, j] + parts[i, j]):
            own.setdefault(b, []).append(held[i, j] / parts[i, j])
    assert sorted(own) == list(range(len(own))) and all(sum(n) <= 10 for n in own.values())
    assert parts[4, 4] == 6


def test_walk_visits_by_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b, held = rng.random(6), rng.random(7), rng.integers(0, 5, (6, 7))
        for wanted in (1, 20, 60):
            sums = np.add.outer(a, b)
            order = np.argsort(sums, axis=None)
            reached = np.cumsum(held.flatten()[order]) >= wanted
            there = np.flatnonzero(held.flatten()[order])  # pairs without entries are passed over
            last = sums.flatten()[order][int(np.argmax(reached)) if reached.any() else there[-1]]
            assert op1.walk(a, b, held, wanted) == pytest.approx(last, abs=0)


def test_small_tables_by_default(spark):
    for n in (6, 11, 15):
        rows = vectors(n)
        got = found(op1.search(table(spark, rows), F.lit(True)))
        assert all(len(near) == min(10, n - 1) for near in got.values()) and len(got) == n
