"""Language identification by interpolated Kneser-Ney character models.

One model for each language, learnt from the labelled rows (see char_models).
A text gets the language whose model gives the lowest cross-entropy for each
character.  Rejection is calibrated on rows that the models did not count: a tenth by hash, at least one
id of each language that has two.  Those that a language was chosen for give its
usual cross-entropy (the median); how far rows lie above it is pooled over languages.  The limit is
what a share of ``REJECT`` is expected to exceed: beyond the upper ``TAIL`` an
exponential tail of the same mean excess is assumed, so that few rows do too.
Texts above it are marked ``rejected`` (the nearest language stays named), as
are texts that are ``und``; a language that no such row was given has no limit.

Edge cases: null texts and texts without a letter give ``und`` with score 0; so
does every text when nothing was learnt.  Ties go to the language first in
alphabetical order.  Null or repeated ids are kept row by row.  Rows whose lang
is null teach nothing.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_models import CharModel, apart_by_class, bounded, build, by_document, count_grams
from .common import by_bytes, crc32_mod, leanly, materialise, pick, table

REJECT = 0.01
TAIL = 0.1
SURE = 60  # characters after which more text makes the score no surer
FOUND = "doc_id long, held_out boolean, apart boolean, lang_pred string, score double, cross_entropy double"


def fit(rows: DataFrame, cells: int | None = None) -> CharModel:
    """rows: class (the language), text."""
    return build(*bounded(count_grams(rows), cells))


def identify(docs: DataFrame, model: CharModel) -> DataFrame:
    """docs: doc_id, held_out, apart, text.  FOUND's columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def choose(log_p: np.ndarray, lengths: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list:
            some = np.flatnonzero(sizes) if model.classes else np.zeros(0, dtype=np.int64)
            pred, score, entropy = ["und"] * len(sizes), np.zeros(len(sizes)), np.full(len(sizes), np.nan)
            if len(some):
                total = np.add.reduceat(log_p, first[some], axis=0)
                n = np.add.reduceat(lengths, first[some])
                mean = -total / n[:, None]
                best = mean.argmin(axis=1)
                lead = np.exp(-(mean - mean.min(axis=1, keepdims=True)) * np.minimum(n, SURE)[:, None])
                score[some] = 1 / lead.sum(axis=1)
                entropy[some] = mean.min(axis=1)
                for i, b in zip(some.tolist(), best.tolist()):
                    pred[i] = model.classes[b]
            return [pred, score, entropy]

        for batch in by_bytes(batches, 3):
            pred, score, entropy = by_document(batch.column(3).to_pylist(), model, choose)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True)], ["doc_id", "held_out", "apart", "lang_pred", "score", "cross_entropy"])

    return docs.select("doc_id", "held_out", "apart", "text").mapInArrow(leanly(run), FOUND)


def language(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cells: int | None = None) -> DataFrame:
    """Learns from the rows that are not held out (a condition on the id), and names the language of all rows."""
    rows = pick(docs, **{id_col: id_col, "_text": text_col, "_lang": lang_col}).withColumn("_held", held_out)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("_held").alias("held_out"), F.col("_text").alias("text"), F.col("_lang").alias("class"))
    rows = rows.withColumn("key", F.xxhash64(F.lit("calibration"), "doc_id")).withColumn("apart", F.pmod("key", F.lit(10)) == 0)
    teaches = ~F.col("held_out") & F.col("class").isNotNull()
    rows = rows.withColumn("apart", teaches & apart_by_class(rows.where(teaches)))
    model = fit(rows.where(teaches & ~F.col("apart")), cells)
    found = materialise(identify(rows, model))
    apart = found.where(F.col("apart") & F.col("cross_entropy").isNotNull())
    usual = {r["lang_pred"]: r["usual"] for r in apart.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.5, 10000).alias("usual")).collect()}  # a row for each language
    own = F.create_map(*[F.lit(x) for kv in usual.items() for x in kv])[F.col("lang_pred")] if usual else F.lit(None).cast("double")
    above = apart.select((F.col("cross_entropy") - own).alias("above"))
    high = above.agg(F.percentile_approx("above", 1 - TAIL, 10000)).first()[0] or 0.0
    excess = above.where(F.col("above") > high).agg(F.avg(F.col("above") - high)).first()[0] or 0.0
    bound = own + high + excess * math.log(TAIL / REJECT)
    return found.withColumn("rejected", F.coalesce(F.col("cross_entropy") > bound, F.col("lang_pred") == "und")).drop("apart")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, crc32_mod(F.col("doc_id"), 5) == 0)
