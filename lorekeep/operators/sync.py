"""Comparing snapshots: what changed, moved, went, and which vectors remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = ["path", "content_hash", "mtime_ns", "size"]


def stat_diff(previous: DataFrame, listed: DataFrame, missing_vectors: DataFrame | None = None) -> DataFrame:
    """Before any file is read: action unchanged, read or removed for each path.

    ``listed`` has path, mtime_ns, size.  Equal stamps need no reading, unless the
    path's vectors are missing; such a path is read as if it were new (``retry``).
    """
    p = previous.select(F.col("path"), F.col("mtime_ns").alias("p_mtime"), F.col("size").alias("p_size"), F.col("content_hash").alias("previous_hash"), F.lit(True).alias("p"))
    both = p.join(listed.withColumn("c", F.lit(True)), "path", "full_outer")
    if missing_vectors is None:
        both = both.withColumn("retry", F.lit(False))
    else:
        both = both.join(missing_vectors.select("path", F.lit(True).alias("retry")), "path", "left").withColumn("retry", F.coalesce("retry", F.lit(False)))
    same = F.col("p").isNotNull() & (F.col("p_mtime") == F.col("mtime_ns")) & (F.col("p_size") == F.col("size")) & ~F.col("retry")
    action = F.when(F.col("c").isNull(), "removed").when(same, "unchanged").otherwise("read")
    return both.select("path", "mtime_ns", "size", F.when(~F.col("retry"), F.col("previous_hash")).alias("previous_hash"), action.alias("action"))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, action between two stamped snapshots: added, changed, touched, unchanged or removed."""
    p = previous.select("path", F.col("content_hash").alias("p_hash"), F.col("mtime_ns").alias("p_mtime"), F.col("size").alias("p_size"), F.lit(True).alias("p"))
    both = p.join(current.select(*STAMP).withColumn("c", F.lit(True)), "path", "full_outer")
    stat = (F.col("p_mtime") == F.col("mtime_ns")) & (F.col("p_size") == F.col("size"))
    action = F.when(F.col("c").isNull(), "removed").when(F.col("p").isNull(), "added").when(stat, "unchanged").when(F.col("p_hash") == F.col("content_hash"), "touched").otherwise("changed")
    return both.select("path", action.alias("action"))


def moves(added: DataFrame, removed: DataFrame) -> DataFrame:
    """path, old_path: new paths whose content is that of exactly one removed path; copies all count."""
    once = removed.groupBy("content_hash").agg(F.min("path").alias("old_path"), F.count("*").alias("n")).where("n = 1")
    return added.join(once, "content_hash").select("path", "old_path")


def embedding_input_hash(model: str, dimensions: int, text: Column) -> Column:
    """Changes with the model, its width or the text."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(F.lit(model), zero, F.lit(str(dimensions)), zero, text), 256)


def reuse_vectors(units: DataFrame, stored: DataFrame) -> DataFrame:
    """``units`` with the stored vector of the same input, if there is one."""
    known = stored.where(F.col("vector").isNotNull()).groupBy("embedding_input_hash").agg(F.min("vector").alias("vector"))
    return units.drop("vector").join(known, "embedding_input_hash", "left")


def replace_rows(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """All rows of a path replaced together: old ones without the gone and changed paths, and the new."""
    touched = gone.select(key).unionByName(new.select(key)).distinct()
    return old.join(touched, key, "left_anti").unionByName(new)


def generation(documents: DataFrame) -> DataFrame:
    """One row: a hash of all stamps, whatever their order; nothing of each document comes to the driver."""
    marks = documents.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "content_hash", "mtime_ns")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("content_hash", "path").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return marks.select(F.sha2(F.concat_ws(",", "n", "x", "s"), 256).alias("generation"))


def restamp(rows: DataFrame, stamps: DataFrame, column: str) -> DataFrame:
    """Refreshes a time column of the paths that were only touched."""
    fresh = stamps.select("path", F.col("mtime_ns").alias("_fresh"))
    return rows.join(fresh, "path", "left").withColumn(column, F.coalesce("_fresh", column)).select(*rows.columns)
