"""Vector search, fusion and the order of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF = 60
CANDIDATES = (20, 100)
SAMPLE = 100  # keys for each range of positions, to choose its bounds


def candidate_limit(limit: int) -> int:
    return min(max(5 * limit, CANDIDATES[0]), CANDIDATES[1])


def l2(vector: Column, query: list[float]) -> Column:
    """Euclidean distance in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, vector_col: str, query: list[float], k: int, tie: str) -> DataFrame:
    """The k nearest by an exact scan; ``distance`` rounded to 6 places."""
    near = vectors.where(F.col(vector_col).isNotNull()).withColumn("distance", F.round(l2(F.col(vector_col), query), 6))
    return near.orderBy("distance", tie).limit(k)


def ranked(leg: DataFrame, key: str, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """key, rank of a leg of candidates (bounded by the candidate limit)."""
    return leg.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order) if by else W.partitionBy(F.lit(0)).orderBy(*order))).select(*by, key, "rank")


def fuse(legs: dict[str, DataFrame], key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """key, score, sources: reciprocal ranks of all legs summed; sources are the legs that hit."""
    sides = [leg.withColumnRenamed("rank", f"rank_{name}") for name, leg in legs.items()]
    joined = reduce(lambda a, b: a.join(b, [*by, key], "full_outer"), sides)
    parts = [F.coalesce(1 / (RRF + F.col(f"rank_{name}")), F.lit(0.0)) for name in legs]
    sources = F.array_compact(F.array(*[F.when(F.col(f"rank_{name}").isNotNull(), F.lit(name)) for name in legs]))
    return joined.select(*by, key, reduce(lambda a, b: a + b, parts).alias("score"), sources.alias("sources"))


def exact_first(fused: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Exact hits before the others, each key once; an exact hit keeps its fused score and sources."""
    both = fused.join(exact.select(key, F.lit(True).alias("is_exact")), key, "full_outer")
    hit = F.coalesce("is_exact", F.lit(False))
    sources = F.when(hit, F.concat(F.array(F.lit("exact")), F.coalesce("sources", F.array().cast("array<string>")))).otherwise(F.col("sources"))
    return both.select(key, F.coalesce("score", F.lit(0.0)).alias("score"), sources.alias("sources"), hit.alias("is_exact"))


def first_by(rows: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group; the limit reaches the map side."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")


def positions(rows: DataFrame, order: list[Column], partitions: int = 64) -> DataFrame:
    """``rows`` with ``position``, from 1, in a global order.

    Rows are dealt to ranges and numbered within; only a count for each range
    meets in one task.  The ranges' bounds, of a sample of keys, are values: the
    rows are read once to be counted and once to be numbered, and fall in the
    same ranges both times.  (Spark's own range partitioning samples anew each time.)
    """
    by = rows.select("*", F.struct(*order).alias("_by"))
    some = by.select("_by").orderBy(F.rand()).limit(SAMPLE * partitions)
    keys = some.agg(F.array_sort(F.collect_list("_by"))).first()[0]
    bounds = T.StructType([T.StructField("_bounds", T.ArrayType(by.schema["_by"].dataType))])
    fixed = rows.sparkSession.createDataFrame([(keys[:: max(1, -(-len(keys) // partitions))],)], bounds)
    dealt = by.crossJoin(F.broadcast(fixed)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.col("_by")))).drop("_bounds")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = dealt.withColumn("_nth", F.row_number().over(W.partitionBy("_part").orderBy("_by")))
    return numbered.join(F.broadcast(before.select("_part", "_before")), "_part").select(*rows.columns, (F.col("_before") + F.col("_nth")).alias("position"))
