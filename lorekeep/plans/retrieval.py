"""A context query: candidates by keyword and vector, exact hits first, with links."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import file_stem
from ..functions.text import PLAIN, Analyser
from ..operators import filters, lexical, ranking, relations
from .contracts import ContextQuery, Hit, Related, SearchResult
from .store import Store

MOST_RELATED = 5


def candidates(store: Store, query: ContextQuery, kind: str, analyse: Analyser = PLAIN) -> DataFrame:
    """The units of a kind that meet every constraint."""
    found = store.table("units").where(F.col("unit_kind") == kind)
    found = found.where(filters.structural(query.scope, query.tags, query.note_types, query.metadata_filters, query.modified_after_ns, query.modified_before_ns))
    if query.keywords:
        met = filters.matching_units(store.table("postings").where(F.col("unit_kind") == kind), query.keywords, query.keyword_mode == "all", analyse)
        found = found.join(met.select("chunk_id"), "chunk_id", "left_semi")
    return found


def embed_query(query: ContextQuery, embedder, degraded: list[str]) -> list[float] | None:
    if embedder is None or not query.query.strip() or query.order == "modified_desc":
        return None
    vectors = guarded("query vector", degraded, lambda: embedder.embed([query.query]), [])
    if vectors and len(vectors[0]) == embedder.dimensions:
        return list(vectors[0])
    if vectors is not None and not degraded:
        degraded.append(f"query vector: {embedder.model} gave none of {embedder.dimensions} numbers")
    return None


def guarded[T](leg: str, degraded: list[str], run: Callable[[], T], otherwise: T) -> T:
    """What ``run`` gives; a leg that fails is named and the query goes on with the rest."""
    try:
        return run()
    except Exception as e:  # noqa: BLE001  models, files and Spark raise anything
        degraded.append(f"{leg}: {type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
        return otherwise


def hits(store: Store, rows: DataFrame) -> list[Hit]:
    """Ranked rows, at most a result's limit, with their documents' headers."""
    headers = store.table("documents").select("path", "frontmatter")
    found = relations.hydrate(rows.select("path", "unit_kind", "chunk_id", "note_type", "tags", "ordinal", "section", "content", "score", "sources", "modified_at_ns", "place"), headers, "path")
    return [
        Hit(r["path"], r["unit_kind"], r["chunk_id"], r["note_type"], list(r["tags"]), r["ordinal"], r["section"], r["content"], r["score"], list(r["sources"]), file_stem(r["path"]), r["modified_at_ns"], json.loads(r["frontmatter"] or "{}"))
        for r in sorted(found.collect(), key=lambda r: r["place"])
    ]


def retrieve(store: Store, query: ContextQuery, kind: str, limit: int, vector: list[float] | None, analyse: Analyser = PLAIN) -> DataFrame:
    """The best units of a kind, with score, sources and place."""
    own = candidates(store, query, kind, analyse)
    terms = list(dict.fromkeys([*analyse.words(query.query), *(t for k in query.keywords for t in analyse.words(k))]))
    index = store.table("postings").where(F.col("unit_kind") == kind)
    scored = lexical.bm25(index, store.table("stats"), terms).select("chunk_id", "score")
    matched = own.join(scored, "chunk_id")
    latest = query.order == "modified_desc"
    if latest:  # all matches compete: there is no limit of candidates before the order
        fused = matched.select("chunk_id", "score", F.array(F.lit("keyword")).alias("sources"))
    else:
        room = ranking.candidate_limit(limit)
        found = matched.orderBy(F.desc("score"), "path", "ordinal").limit(room)
        if vector is None:
            fused = found.select("chunk_id", "score", F.array(F.lit("keyword")).alias("sources"))
        else:
            near = ranking.nearest(own, "vector", vector, room, "chunk_id")
            legs = {"keyword": ranking.ranked(found, "chunk_id", F.desc("score"), "path", "ordinal"), "semantic": ranking.ranked(near, "chunk_id", "distance", "chunk_id")}
            fused = ranking.fuse(legs, "chunk_id")
    if kind == "document" and query.query.strip():
        exact = own.where(F.array_contains("lookup_keys", query.query.strip().lower()))
    else:
        exact = own.where(F.lit(False))
    merged = own.join(ranking.exact_first(fused, exact, "chunk_id"), "chunk_id")
    order = [F.desc("modified_at_ns"), F.desc("score"), "path", "ordinal"] if latest else [F.desc("is_exact"), F.desc("score"), "path", "ordinal"]
    best = merged.orderBy(*order).limit(limit)
    return ranking.ranked(best, "chunk_id", *order).withColumnRenamed("rank", "place").join(best, "chunk_id")


def related(store: Store, path: str) -> list[Related]:
    """One-hop edges of a document, with the place that declares each."""
    near = relations.one_hop(store.table("edges"), path, MOST_RELATED)
    rows = near.collect()
    if not rows:
        return []
    sources = sorted({r["from_path"] for r in rows})  # five at most
    units = store.table("units").where((F.col("unit_kind") == "fragment") & F.col("path").isin(sources))
    wanted = near.select("from_path", "section_source").distinct()
    parts = units.join(F.broadcast(wanted), F.col("path") == F.col("from_path"))
    contexts = relations.section_context(parts, F.col("section_source"), ["from_path", "section_source"])
    context = {(r["from_path"], r["section_source"]): r["context"] for r in contexts.collect()}
    return [Related(r["path"], file_stem(r["path"]), r["direction"], r["relation_type"], r["status"], r["section_source"], context.get((r["from_path"], r["section_source"]), "")) for r in rows]


def evidence(store: Store, query: ContextQuery, kind: str, limit: int, vector: list[float] | None, analyse: Analyser, degraded: list[str]) -> list[Hit]:
    """Hits of both legs; of the keywords alone if that fails; none if they fail too."""
    if vector is not None:
        found = guarded(f"{kind}s by keyword and vector", degraded, lambda: hits(store, retrieve(store, query, kind, limit, vector, analyse)), None)
        if found is not None:
            return found
    return guarded(f"{kind}s by keyword", degraded, lambda: hits(store, retrieve(store, query, kind, limit, None, analyse)), [])


def run(store: Store, query: ContextQuery, embedder=None, analyse: Analyser = PLAIN) -> SearchResult:
    degraded: list[str] = []
    if query.is_recent():
        rows = candidates(store, query, "document", analyse).withColumn("score", F.lit(0.0)).withColumn("sources", F.array(F.lit("recency")))
        order = [F.desc("modified_at_ns"), "path"]
        best = rows.orderBy(*order).limit(query.document_limit)
        documents = hits(store, ranking.ranked(best, "chunk_id", *order).withColumnRenamed("rank", "place").join(best, "chunk_id"))
        fragments: list[Hit] = []
        strategy = "recent"
    else:
        vector = embed_query(query, embedder, degraded)
        documents = evidence(store, query, "document", query.document_limit, vector, analyse, degraded)
        fragments = evidence(store, query, "fragment", query.fragment_limit, vector, analyse, degraded)
        strategy = "hybrid" if any("semantic" in h.sources for h in documents + fragments) else "keyword"
    first = next(iter(documents + fragments), None)
    links = guarded("relations", degraded, lambda: related(store, first.path), []) if query.include_relations and first else []
    return SearchResult(strategy, documents, fragments, links, degraded)
