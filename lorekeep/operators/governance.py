"""Checks of documents against rules, as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_section

BUILT_IN = ["type", "tags", "summary"]  # fixed values: required of every document


def tag_counts(units: DataFrame) -> DataFrame:
    """tag, count over document units."""
    return units.where("unit_kind = 'document'").select(F.explode("tags").alias("tag")).groupBy("tag").count()


def raw_tag_counts(documents: DataFrame) -> DataFrame:
    """tag, count of raw occurrences, case kept; a tag twice in one document counts twice."""
    return documents.select(F.explode("raw_tags").alias("tag")).groupBy("tag").count()


def broken_links(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """path, kind, target of edges whose target is not listed; one for each edge."""
    known = paths.select(F.col("path").alias("to_path")).distinct()
    return edges.join(known, "to_path", "left_anti").select(F.col("from_path").alias("path"), F.lit("link.broken").alias("kind"), F.col("to_path").alias("target"))


def missing_fields(documents: DataFrame, required: list[str]) -> DataFrame:
    """``documents`` with a row for each required ``field`` that their ``fields`` lack; built-in fields come first."""
    wanted = F.array(*[F.lit(f) for f in dict.fromkeys(BUILT_IN + required)])
    return documents.withColumn("field", F.explode(F.filter(wanted, lambda f: ~F.array_contains("fields", f))))


def section_matches(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """path, pattern for every rule section that covers a path; the sections are few and become one expression."""
    hits = F.array_compact(F.array(*[F.when(matches_section(F.col("path"), p), F.lit(p)) for p in patterns]))
    return paths.select("path", F.explode(hits).alias("pattern"))


def issues(documents: DataFrame, key: str, checks: dict[tuple[str, str], Column]) -> DataFrame:
    """key, kind, severity: a row for each check that holds, from one scan."""
    found = [F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for (kind, severity), c in checks.items()]
    return documents.select(key, F.explode(F.array_compact(F.array(*found))).alias("i")).select(key, "i.kind", "i.severity")


def non_canonical(tags: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows whose tag is an alias or case variant, with the first ``canonical`` tag in key order."""
    spellings: dict[str, str] = {}
    for canonical in sorted(aliases):
        for s in [canonical, *aliases[canonical]]:
            spellings.setdefault(s.lower(), canonical)
    if not spellings:
        return tags.withColumn("canonical", F.lit("")).where(F.lit(False))
    known = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    found = tags.where(~F.col("tag").isin(list(aliases))).withColumn("canonical", known[F.lower("tag")])
    return found.where(F.col("canonical").isNotNull())


def new_tags(tags: DataFrame, counts: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows whose tag no alias covers and which occurs at most once in the whole archive."""
    spellings = {s.lower() for canonical, more in aliases.items() for s in [canonical, *more]}
    own = tags.where(~F.lower("tag").isin(list(spellings))) if spellings else tags
    rare = counts.where("count <= 1").select("tag")
    return own.join(rare, "tag", "left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
