"""Edges between documents: status, neighbours, and where they were declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["from_path", "to_path", "relation_type", "section_source"])


def with_status(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """``status``: resolved if the target is a document."""
    known = documents.select(F.col("path").alias("to_path"), F.lit("resolved").alias("status")).distinct()
    return edges.drop("status").join(known, "to_path", "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))


def one_hop(edges: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """direction, path and the edge's columns: outgoing edges first, in path order; a loop is outgoing."""
    near = edges.where((F.col("from_path") == path) | (F.col("to_path") == path))
    out = F.col("from_path") == path
    near = near.withColumn("direction", F.when(out, "outgoing").otherwise("incoming")).withColumn("path", F.when(out, F.col("to_path")).otherwise(F.col("from_path")))
    return near.orderBy(F.desc("direction"), "path", "relation_type", "section_source").limit(limit)


def section_context(fragments: DataFrame, section: Column, by: list[str], length: int = 120) -> DataFrame:
    """``by``, context: the fragment of that section, else the first; its beginning."""
    best = first_by(fragments, by, [(F.col("section") == section).desc(), F.col("ordinal")])
    return best.select(*by, F.substring("content", 1, length).alias("context"))


def hydrate(hits: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Hits (bounded by the result limit) with the columns of another table."""
    return hits.join(details, key, "left")
