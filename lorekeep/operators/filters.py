"""Predicates of a context query; all apply before any candidate limit."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, Analyser, in_scope, tokens, tokens_of


def facet(key: str, value: object) -> str:
    """The stored form of one metadata value: typed, compact, keys sorted."""
    return f"{key}={json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(',', ':'))}"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def has_tags(tags: list[str]) -> Column:
    """Every tag."""
    return all_of([F.array_contains("tags", t.strip().lower()) for t in tags])


def has_type(note_types: list[str]) -> Column:
    """Any of the types; an empty list allows all."""
    return F.col("note_type").isin(note_types) if note_types else F.lit(True)


def has_metadata(filters: dict[str, object]) -> Column:
    """Every field equal, types included."""
    return all_of([F.array_contains("facets", facet(k, v)) for k, v in filters.items()])


def modified_within(after: int | None, before: int | None) -> Column:
    """Both ends belong to the range."""
    return all_of([c for c in (None if after is None else F.col("modified_at_ns") >= after, None if before is None else F.col("modified_at_ns") <= before) if c is not None])


def structural(scope: str = "", tags: list[str] = (), note_types: list[str] = (), metadata: dict[str, object] | None = None, after: int | None = None, before: int | None = None) -> Column:
    """The conjunction of all predicates on columns of units."""
    out = in_scope(F.col("path"), scope) & has_type(list(note_types))
    if tags:
        out &= has_tags(list(tags))
    if metadata:
        out &= has_metadata(metadata)
    return out & modified_within(after, before)


def keyword_terms(keywords: list[str], words=tokens_of) -> list[list[str]]:
    return [t for t in (list(dict.fromkeys(words(k))) for k in keywords) if t]


def has_keywords(text: Column, keywords: list[str], every: bool) -> Column:
    """A keyword is met when the unit holds all of its tokens; every keyword, or any."""
    terms = keyword_terms(keywords)
    if not terms:
        return F.lit(not keywords)
    lowered, words = F.lower(text), tokens(text)

    def holds(own: list[str]) -> Column:
        """All of some tokens; texts without their letters are not cut into words."""
        wanted = list(dict.fromkeys(own))
        return all_of([lowered.contains(t) for t in wanted]) & (F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in wanted]))) == len(wanted))

    return holds([t for ts in terms for t in ts]) if every else reduce(lambda a, b: a | b, map(holds, terms))


def matching_units(postings: DataFrame, keywords: list[str], every: bool, analyse: Analyser = PLAIN) -> DataFrame:
    """unit_kind, chunk_id of the units that meet the keywords, from the postings."""
    groups = keyword_terms(keywords, analyse.words)
    pairs = [(i, t) for i, ts in enumerate(groups) for t in ts]
    if not pairs:
        return postings.where(F.lit(False)).select("unit_kind", "chunk_id").distinct()
    spark = postings.sparkSession
    wanted = spark.createDataFrame(pairs, "keyword int, term string")
    needed = F.element_at(F.create_map(*[F.lit(x) for i, ts in enumerate(groups) for x in (i, len(ts))]), F.col("keyword"))
    met = postings.where(F.col("term").isin(sorted({t for _, t in pairs}))).join(F.broadcast(wanted), "term")  # at most 20 keywords
    met = met.groupBy("unit_kind", "chunk_id", "keyword").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == needed)
    least = len(groups) if every else 1
    return met.groupBy("unit_kind", "chunk_id").agg(F.count("*").alias("met")).where(F.col("met") >= least).select("unit_kind", "chunk_id")
