"""Nearest neighbours through an inverted multi-index.

The vectors' two halves are quantised separately with ``CENTROIDS`` centroids
each (one for two vectors at most), fitted on ``SAMPLE`` vectors at most; every vector is listed under its
pair of centroids.  For a query a heap walks the pairs that have entries by summed
distance, nearest first, until their entries make up a share of all (``k`` + 1 at
least); the sum at which it stops says which pairs were visited.  Only the
entries of visited pairs are compared, by the exact distance; the best are the result.

The share is fitted with the centroids: on the sample, ``PROBES`` of its vectors
are looked up by brute force, and the share is the one within which
the walk meets ``RECALL`` of their true neighbours.  Diffuse vectors need about a quarter
of the entries, clustered ones far less; it can be given instead.

Lists are dealt in blocks: runs of pairs with ``BLOCK`` entries at most, a larger
list in several parts.  A query goes to the blocks that hold a pair it visits,
and where more than ``BLOCK`` queries meet a block, it is dealt several times.

Edge cases: vectors that are null, zero, or hold nulls or non-finite numbers take
no part, nor do rows without an id or vectors of another length than the most
common one.  Of several rows of one id the smallest vector stands for it.  Equal
vectors: only the ``k`` + 1 smallest ids of each vector can be among the nearest
``k`` of any query, so only these are indexed.  With fewer candidates than ``k``
all are returned.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, pick, table

NEAREST = 10
CENTROIDS = 512
SAMPLE = 20_000
PROBES = 256
RECALL = 0.95
BLOCK = 4096
INDEX = "vec_id long, vector array<double>, first int, second int"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, vector of the rows that take part, and the vectors' length (0: there are none)."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector")), size


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T


def centroids(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced members of the sorted sample; at most one centroid for two members."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, max(1, len(x) // 2))).astype(int)]
    for _ in range(rounds):
        own = squares(x, c).argmin(axis=1)
        for j in np.unique(own):
            c[j] = x[own == j].mean(axis=0)
    return c


def matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def needed(x: np.ndarray, book: tuple[np.ndarray, np.ndarray], k: int, recall: float, probes: int = PROBES) -> float:
    """The share of x that a walk has to visit to meet ``recall`` of the k true neighbours of some of its rows."""
    half, rows = x.shape[1] // 2, np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int))
    own = [squares(part, c).argmin(axis=1) for part, c in zip((x[:, :half], x[:, half:]), book)]
    reach = []
    for row in rows.tolist():
        far = ((x - x[row]) ** 2).sum(axis=1)
        walked = squares(x[row : row + 1, :half], book[0])[0, own[0]] + squares(x[row : row + 1, half:], book[1])[0, own[1]]
        far[row] = walked[row] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
        reach += ((walked[:, None] <= walked[near]).sum(axis=0) / len(x)).tolist()
    return float(np.quantile(reach, recall)) if reach else 1.0


def fit(vectors: DataFrame, size: int, k: int = CENTROIDS, sample: int = SAMPLE, nearest: int = NEAREST, recall: float = RECALL) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """The centroids of both halves, and the share of the entries to visit."""
    share = max(1, -(-vectors.count() // sample))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).limit(2 * sample).orderBy("vec_id").toArrow()
    if not rows.num_rows:  # every hash missed: so few rows that all will do
        rows = vectors.orderBy("vec_id").limit(sample).toArrow()
    x = matrix(rows.column("vector"), size)
    book = centroids(x[:, : size // 2], k), centroids(x[:, size // 2 :], k)
    return book, needed(x, book, nearest, recall)


def index(vectors: DataFrame, book: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), size)
                own = [squares(x[:, : size // 2], one).argmin(axis=1), squares(x[:, size // 2 :], two).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in own)], ["vec_id", "vector", "first", "second"])

    return vectors.mapInArrow(run, INDEX)


def walk(one: np.ndarray, two: np.ndarray, held: np.ndarray, wanted: int) -> float:
    """Visits pairs by summed distance until they hold ``wanted`` entries; the sum of the last pair visited.

    The heap has one pair for each first centroid that is reached; pairs without
    entries are passed over.
    """
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    counts = held[np.ix_(a, b)]
    rows = np.flatnonzero(counts.any(axis=1))
    x, y = one[a].tolist(), two[b]
    heap: list[tuple[float, int, int]] = []
    sums, sizes = [], []
    last, got, opened = 0.0, 0, 0
    while got < wanted:
        # a further first centroid joins when its own distance, plus the least second one, is due
        while opened < len(rows) and (not heap or x[rows[opened]] + y[0] <= heap[0][0]):
            row = rows[opened]
            at = np.flatnonzero(counts[row])
            sums.append((x[row] + y[at]).tolist())
            sizes.append(counts[row, at].tolist())
            heapq.heappush(heap, (sums[opened][0], opened, 0))
            opened += 1
        if not heap:
            break
        last, row, j = heap[0]
        got += sizes[row][j]
        if j + 1 < len(sums[row]):
            heapq.heapreplace(heap, (sums[row][j + 1], row, j + 1))
        else:
            heapq.heappop(heap)
    return last


def blocks(held: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its first block and its number of parts: runs of pairs of ``block`` entries at most, larger pairs alone."""
    first, parts = np.zeros(held.size, dtype=np.int64), np.ones(held.size, dtype=np.int64)
    now, room = -1, 0
    for pair in np.flatnonzero(held.ravel()).tolist():  # CENTROIDS ** 2 at most
        n = int(held.ravel()[pair])
        if n > block:
            first[pair], parts[pair] = now + 1, -(-n // block)
            now, room = now + int(parts[pair]), 0
            continue
        if n > room:
            now, room = now + 1, block
        first[pair] = now
        room -= n
    return first.reshape(held.shape), parts.reshape(held.shape)


def visits(queries: DataFrame, book: tuple[np.ndarray, np.ndarray], held: np.ndarray, place: tuple[np.ndarray, np.ndarray], size: int, share: float, k: int) -> DataFrame:
    """block, stop, query_id, vector: a row for each block with a visited pair; pairs of a sum up to ``stop`` are visited."""
    shared = queries.sparkSession.sparkContext.broadcast((book, held, place))
    total = int(held.sum())
    wanted = max(int(np.ceil(total * share)), min(total, k + 1))  # k besides the query itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), held, (first, parts) = shared.value
        some = held > 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                x = matrix(own.column(1), size)
                d1, d2 = squares(x[:, : size // 2], one), squares(x[:, size // 2 :], two)
                stop = np.array([walk(a, b, held, wanted) for a, b in zip(d1, d2)]) + 1e-9
                row, block = [], []
                for i in range(len(x)):
                    met = some & (d1[i][:, None] + d2[i] <= stop[i])
                    n = parts[met]
                    every = np.unique(np.repeat(first[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    row += [i] * len(every)
                    block += every.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(stop[row]), *(c.take(pa.array(row, pa.int64())) for c in own.columns)], ["block", "stop", "query_id", "vector"])

    return queries.mapInArrow(run, "block long, stop double, query_id long, vector array<double>")


def search(vectors: DataFrame, is_query, k: int = NEAREST, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance), compared (entries whose distance to the query was taken).

    ``is_query`` is a condition on vec_id; ``share`` of the entries is visited, or as much as the sample asks for.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_col, vector_col)
    if size < 2:
        rows, size = rows.select("vec_id", F.concat("vector", F.array(F.lit(0.0))).alias("vector")), size + 1
    rows = materialise(rows)
    if not rows.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    book, enough = fit(rows, size, nearest=k)
    nth = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    entries = rows.withColumn("nth", nth).where(f"nth <= {k + 1}").drop("nth")
    entries = materialise(index(entries, book, size))
    held = np.zeros((len(book[0]), len(book[1])), dtype=np.int64)
    for r in entries.groupBy("first", "second").count().collect():  # CENTROIDS ** 2 rows at most
        held[r["first"], r["second"]] = r["count"]
    place = blocks(held, BLOCK)
    asked = materialise(visits(rows.where(is_query), book, held, place, size, enough if share is None else share, k))
    # Blocks that many queries meet are dealt several times; blocks that none meets not at all.
    met = materialise(asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sides")))
    asked = asked.join(met, "block").withColumn("side", F.pmod(F.xxhash64("query_id"), F.col("sides")).cast("int")).drop("sides")
    shared = spark.sparkContext.broadcast((book, place))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, (first, parts) = shared.value
        for batch in batches:
            ids, one, two = (batch.column(c).to_numpy() for c in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[one, two] + ids % parts[one, two])], [*batch.schema.names, "block"])

    def nearest(own: pa.Table, asking: pa.Table) -> pa.Table:
        (one, two), _ = shared.value
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))]
        if own.num_rows and asking.num_rows:
            pair = own.column("first").to_numpy().astype(np.int64) * len(two) + own.column("second").to_numpy()
            order = np.lexsort((own.column("vec_id").to_numpy(), pair))
            ids, x = own.column("vec_id").to_numpy()[order], matrix(own.column("vector"), size)[order]
            pairs, sizes = np.unique(pair, return_counts=True)  # the lists, one after the other
            q, qid, stop = matrix(asking.column("vector"), size), asking.column("query_id").to_numpy(), asking.column("stop").to_numpy()
            for at in range(0, len(q), 256):
                some = slice(at, at + 256)
                sums = squares(q[some][:, : size // 2], one)[:, pairs // len(two)] + squares(q[some][:, size // 2 :], two)[:, pairs % len(two)]
                for i, visited in enumerate(sums <= stop[some][:, None], at):
                    here = np.flatnonzero(np.repeat(visited, sizes))
                    here = here[ids[here] != qid[i]]
                    far = np.sqrt(((x[here] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[here], far))[:k]
                    count = np.zeros(len(best), dtype=np.int64)
                    count[:1] = len(here)
                    found.append((np.full(len(best), qid[i]), ids[here][best], far[best], count))
        return pa.table(dict(zip(("query_id", "vec_id", "score", "own"), (pa.array(np.concatenate(c)) for c in zip(*found)))))

    dealt = entries.mapInArrow(deal, f"{INDEX}, block long").join(met, "block").withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).drop("sides")
    keys = ["block", "side"]
    near = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double, own long")
    own = W.partitionBy("query_id")
    ranked = near.withColumn("rank", F.row_number().over(own.orderBy("score", "vec_id"))).withColumn("compared", F.sum("own").over(own))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score", "compared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
