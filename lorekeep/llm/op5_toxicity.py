"""Toxicity by class-conditional Kneser-Ney models.

Two character models over the words, toxic and ordinary, have class counts of
their own at the highest order and share the continuation counts below it, so
an expression rare in both classes says little.  For each word the difference of
the two log-likelihoods is taken; a text is described by that difference
normalised by length over the whole text and over its most toxic stretches.  A logistic
curve turns these into a score; it is fitted on labelled rows that the models
did not count: a tenth of them by hash, at least one id of each class that has two.
Beyond ``SAMPLE`` rows each class is thinned by itself, the rarer one least, and
its rows weigh as many as they stand for.  A class with a single id is learnt from;
without calibration rows of both classes, a text reaches ``CUT`` if its mean
log-likelihood is higher under the toxic model.

Edge cases: null and empty texts, and texts without letters, have a difference
of 0 everywhere and the score of that.  Without learnt labels of both classes
every score is 0.  Of several labels of one id the highest counts; null labels
and null ids teach nothing.  Null or repeated ids are scored row by row.
Every column of the input can be kept (``score_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .char_models import CharModel, apart_by_class, bounded, build, by_document, count_grams
from .common import by_bytes, crc32_mod, leanly, materialise, numbered, pick, place, table

SAMPLE = 20_000
STRETCHES = (1, 8, 40)  # words
CUT = 0.3


@dataclass
class Toxicity:
    model: CharModel | None
    weight: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def describe(self, texts: list[str | None]) -> np.ndarray:
        return by_document(texts, self.model, features)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        x = (self.describe(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weight[0] + x @ self.weight[1:], -40, 40)))


def features(log_p: np.ndarray, lengths: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text: difference by word over all of it, and the highest mean over stretches of some lengths."""
    out = np.zeros((len(sizes), 1 + len(STRETCHES)))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    more = log_p[:, 1] - log_p[:, 0]
    out[some, 0] = np.add.reduceat(more, first[some]) / sizes[some]
    total = np.concatenate([[0.0], np.cumsum(more)])
    last = np.repeat(first + sizes, sizes)
    at = np.arange(len(more))
    for j, n in enumerate(STRETCHES):
        end = np.minimum(at + n, last)
        out[some, 1 + j] = np.maximum.reduceat((total[end] - total[at]) / n, first[some])
    return out


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps for the penalised logistic curve over rows that stand for n rows each; the intercept first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (n * (p * (1 - p) + 1e-9))[:, None]).T @ a + penalty, a.T @ (n * (y - p)) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def shares(apart: dict[str, int], sample: int) -> dict[str, int]:
    """Of how many rows one is kept, for each class: none of the rarer is lost before it fills half of the sample."""
    if sum(apart.values()) <= sample:
        return dict.fromkeys(apart, 1)
    rare = min(min(apart.values()), sample // 2)
    return {c: max(1, -(-n // (sample - rare))) for c, n in apart.items()}


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cells: int | None = None) -> Toxicity:
    """Learns from the labelled documents for which ``usable`` holds."""
    label = pick(labels, _id=id_col, label=label_col).where("label IS NOT NULL").groupBy("_id").agg(F.max("label").cast("string").alias("class"))
    own = pick(docs, **{id_col: id_col, "_text": text_col}).where(usable).select(F.col(f"`{id_col}`").alias("_id"), F.col("_text").alias("text"))
    tenth = F.pmod(F.xxhash64(F.lit("calibration"), F.col("_id")), F.lit(10)) == 0
    # Merged whatever the labels' size, so that the plan is the same at every scale.
    rows = materialise(own.hint("merge").join(label, "_id").select(tenth.alias("apart"), F.xxhash64("_id").alias("key"), "class", "text"))
    rows = rows.where(F.col("class").isin("0", "1"))
    rows = rows.withColumn("apart", apart_by_class(rows))
    classes, counts = bounded(count_grams(rows.where(~F.col("apart"))), cells)
    nothing = Toxicity(None, np.zeros(1), np.zeros(0), np.ones(0))
    if classes != ["0", "1"]:
        return nothing
    out = Toxicity(build(classes, counts, shared=True), np.zeros(0), np.zeros(0), np.ones(0))
    shared = docs.sparkSession.sparkContext.broadcast(out)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.describe(batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64())), batch.column(2)], ["class", "x", "key"])

    apart = rows.where(F.col("apart"))
    sizes = {r["class"]: r["count"] for r in apart.groupBy("class").count().collect()}
    share = F.lit(1)
    for c, n in shares(sizes, SAMPLE).items():
        share = F.when(F.col("class") == c, F.lit(n)).otherwise(share)
    found = apart.where(F.pmod("key", share) == 0).select("class", "text", "key").mapInArrow(leanly(describe), "class string, x array<double>, key long").orderBy("key", "class", "x").toPandas()
    kept = found["class"].value_counts().to_dict()
    if len(kept) < 2:
        out.centre, out.scale = np.zeros(1 + len(STRETCHES)), np.ones(1 + len(STRETCHES))
        out.weight = np.array([np.log(CUT / (1 - CUT)) - 1e-9, 1.0, *(0.0 for _ in STRETCHES)])
        return out
    n = np.array([sizes[c] / kept[c] for c in found["class"]])
    y, x = (found["class"] == "1").to_numpy(dtype=float), np.array(found["x"].tolist())
    out.centre = np.average(x, axis=0, weights=n)
    out.scale = np.sqrt(np.average((x - out.centre) ** 2, axis=0, weights=n)) + 1e-9
    out.weight = logistic((x - out.centre) / out.scale, y, n)
    return out


def score_rows(docs: DataFrame, model: Toxicity, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """``docs``, whatever its columns, with one more at the end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, rows = place(docs, text_col), numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(at).to_pylist()))], [*batch.schema.names, "score"])

    return rows.mapInArrow(leanly(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, as_col)


def keep_clean(docs: DataFrame, model: Toxicity, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores below the cut, with all their columns."""
    rows = numbered(docs)
    return score_rows(rows, model, rows.columns[place(docs, text_col)]).where(F.col("score") < cut).select(*rows.columns).toDF(*docs.columns)


def usable(id_col: str = "doc_id"):
    return crc32_mod(F.col(id_col), 4) != 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), usable())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~usable()).alias("held_out"), "text")
    return score_rows(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
