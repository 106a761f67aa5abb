"""Postings, BM25 and lexical ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, Analyser

K1, B = 1.2, 0.75


def postings(units: DataFrame, analyse: Analyser = PLAIN, terms: list[str] | None = None) -> DataFrame:
    """unit_kind, term, chunk_id, tf, dl, path: the inverted index of ``search_text``, with each unit's length.

    With ``terms``, their postings alone: words are sorted out before anything is exploded.
    """
    words = analyse(F.col("search_text"))
    each = units.select("unit_kind", "chunk_id", "path", words.alias("words"))
    own = F.col("words") if terms is None else F.filter("words", lambda w: w.isin(sorted(set(terms))))
    each = each.select("unit_kind", "chunk_id", "path", F.size("words").alias("dl"), F.explode(own).alias("term"))
    return each.groupBy("unit_kind", "term", "chunk_id", "dl", "path").agg(F.count("*").cast("int").alias("tf")).select("unit_kind", "term", "chunk_id", "tf", "dl", "path")


def unit_stats(units: DataFrame, analyse: Analyser = PLAIN) -> DataFrame:
    """unit_kind, n, avgdl: one row for each kind."""
    return units.select("unit_kind", F.size(analyse(F.col("search_text"))).alias("dl")).groupBy("unit_kind").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """unit_kind, chunk_id, score of the units that hold a term, by the persisted postings."""
    own = index.where(F.col("term").isin(sorted(set(terms))))  # reaches the scan as a pushed filter
    df = own.groupBy("unit_kind", "term").agg(F.count("*").alias("df"))  # a row for each kind and query term
    scored = own.join(F.broadcast(df), ["unit_kind", "term"]).join(F.broadcast(stats), "unit_kind")
    weight = idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("unit_kind", "chunk_id").agg(F.sum(weight).alias("score"))


def top(scored: DataFrame, k: int, *ties: str, digits: int = 6) -> DataFrame:
    """The k best; scores that agree to ``digits`` places are ties."""
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), *ties).limit(k)
