"""The engine's operators as queries over the tables of the test data, with SQL beside them.

``documents`` stands in for a wiki: a document's path is source/lang/doc-id.md,
its type the language, its tags language and source, its time the id in seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chunk import chunk_udtf_rows
from ..functions.links import link_rows
from ..operators import filters, governance, lexical, ranking, relations, sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TERMS = ["the", "heed", "thtion"]
EVERY = X.Analyser(longest=1 << 30)  # words of any length, as the SQL counts them
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"

UNITS_SQL = f"""u AS (
  SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, lang AS note_type, [lang, source] AS tags,
    doc_id * 1000000000 AS modified_at_ns, {WORDS} AS words, text FROM documents
)"""


def bm25_sql(terms: list[str], where: str = "true") -> str:
    """CTEs u, s: the score of every unit that holds a term and meets a condition."""
    tf = [f"len([w FOR w IN words IF w = '{t}'])" for t in terms]
    parts = [f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * (tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)))" for i in range(len(terms))]
    return f"""{UNITS_SQL}, c AS (
  SELECT *, len(words) AS dl, {', '.join(f'{x} AS tf_{i}' for i, x in enumerate(tf))} FROM u
), st AS (
  SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf_{i} > 0) AS df_{i}' for i in range(len(terms)))} FROM c
), s AS (
  SELECT c.*, round({' + '.join(parts)}, 6) AS score FROM c, st WHERE ({' OR '.join(f'tf_{i} > 0' for i in range(len(terms)))}) AND ({where})
)"""


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        path.alias("path"),
        F.lit("document").alias("unit_kind"),
        F.sha2(F.concat(path, F.decode(F.unhex(F.lit("00")), "UTF-8"), F.lit("document")), 256).alias("chunk_id"),
        F.col("lang").alias("note_type"),
        F.array("lang", "source").alias("tags"),
        (F.col("doc_id") * 1_000_000_000).alias("modified_at_ns"),
        F.col("text").alias("search_text"),
    )


# Lexical retrieval and filters


def scored(docs: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, score by the engine's ranking: postings of the terms, statistics of all units, BM25."""
    return lexical.bm25(lexical.postings(docs, EVERY, terms), lexical.unit_stats(docs, EVERY), terms).select("chunk_id", "score")


def matched(docs: DataFrame, terms: list[str], keep=None) -> DataFrame:
    own = docs.drop("search_text")
    return (own if keep is None else own.where(keep)).join(scored(docs, terms), "chunk_id")


@query("q01_bm25_topk", f"WITH {bm25_sql(TERMS)} SELECT doc_id, path, score FROM s ORDER BY score DESC, path LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(matched(units(spark, sf_dir), TERMS), 20, "path").select("doc_id", "path", "score")


_FILTER = "starts_with(path, 'src1/') AND list_contains(tags, 'en') AND note_type IN ('en', 'de') AND modified_at_ns BETWEEN 5000000000 AND 900000000000"


@query("q02_bm25_filtered", f"WITH {bm25_sql(TERMS, _FILTER)} SELECT doc_id, path, score FROM s ORDER BY score DESC, path LIMIT 20")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = filters.structural("src1", ["en"], ["en", "de"], after=5 * 10**9, before=900 * 10**9)
    return lexical.top(matched(units(spark, sf_dir), TERMS, keep), 20, "path").select("doc_id", "path", "score")


@query("q03_keywords_all", f"WITH {UNITS_SQL} SELECT doc_id, path FROM u WHERE list_has_all(words, ['the', 'heed'])")
def keywords_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(units(spark, sf_dir), ["The", "heed"], every=True).select("doc_id", "path")


def meeting(docs: DataFrame, keywords: list[str], every: bool) -> DataFrame:
    """The units that meet the keywords, by the engine's postings."""
    terms = [t for own in filters.keyword_terms(keywords, EVERY.words) for t in own]
    met = filters.matching_units(lexical.postings(docs, EVERY, terms), keywords, every, EVERY)
    return docs.drop("search_text").join(met.select("chunk_id"), "chunk_id", "left_semi")


@query("q04_keywords_any", f"WITH {UNITS_SQL} SELECT doc_id, path FROM u WHERE list_contains(words, 'heed') OR (list_contains(words, 'of') AND list_contains(words, 'ing'))")
def keywords_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting(units(spark, sf_dir), ["heed", "of ing"], every=False).select("doc_id", "path")


@query("q05_scope_literal", f"WITH {UNITS_SQL} SELECT doc_id, path FROM u WHERE path = 'src1/en' OR starts_with(path, 'src1/en/')")
def scope_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).where(X.in_scope(F.col("path"), "src1/en/")).select("doc_id", "path")


@query("q06_recent_browse", f"WITH {UNITS_SQL} SELECT doc_id, path, modified_at_ns, 'recency' AS source_leg FROM u WHERE list_contains(tags, 'en') ORDER BY modified_at_ns DESC, path LIMIT 20")
def recent_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units(spark, sf_dir).where(filters.has_tags(["EN "])).orderBy(F.desc("modified_at_ns"), "path").limit(20)
    return found.select("doc_id", "path", "modified_at_ns", F.lit("recency").alias("source_leg"))


@query("q07_modified_desc", f"WITH {bm25_sql(TERMS)} SELECT doc_id, path, modified_at_ns, score FROM s ORDER BY modified_at_ns DESC, score DESC, path LIMIT 20")
def modified_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(units(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("modified_at_ns"), F.desc("score"), "path").limit(20).select("doc_id", "path", "modified_at_ns", "score")


@query(
    "q08_exact_first",
    f"""WITH {bm25_sql(TERMS)}, f AS (SELECT path, score FROM s ORDER BY score DESC, path LIMIT 20),
x AS (SELECT path FROM u WHERE list_contains([path, regexp_extract(path, '[^/]+$'), regexp_extract(path, '([^/]+)\\.md$', 1)], 'doc-41'))
SELECT path, coalesce(score, 0.0) AS score, x.path IS NOT NULL AS is_exact FROM f FULL JOIN x USING (path)
ORDER BY is_exact DESC, score DESC, path LIMIT 10""",
)
def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = units(spark, sf_dir)
    fused = lexical.top(matched(docs, TERMS), 20, "path").select("path", "score", F.array(F.lit("keyword")).alias("sources"))
    keys = docs.withColumn("lookup_keys", F.array(F.lower("path"), F.lower(F.element_at(F.split("path", "/"), -1)), F.lower(X.stem(F.col("path")))))
    exact = keys.where(F.array_contains("lookup_keys", " DOC-41 ".strip().lower()))
    found = ranking.exact_first(fused, exact, "path")
    return found.orderBy(F.desc("is_exact"), F.desc("score"), "path").limit(10).select("path", "score", "is_exact")


# Vectors and fusion

VECTOR = [round(0.05 * ((7 * i) % 11 - 5), 2) for i in range(64)]
_L2 = f"sqrt(list_sum([(p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]) FOR p IN list_zip(embedding, {VECTOR})]))"


@query("q09_vector_topk", f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest(read(spark, sf_dir, "embeddings"), "embedding", VECTOR, 20, "vec_id").select("vec_id", "distance")


_HYBRID = f"""WITH {bm25_sql(TERMS)}, k AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50)
), v AS (
  SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS r FROM (SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 50)
), f AS (
  SELECT doc_id, round(coalesce(1.0 / (60 + k.r), 0) + coalesce(1.0 / (60 + v.r), 0), 8) AS score, k.r IS NOT NULL AS keyword, v.r IS NOT NULL AS semantic FROM k FULL JOIN v USING (doc_id)
)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.top(matched(units(spark, sf_dir), TERMS), 50, "doc_id")
    near = ranking.nearest(read(spark, sf_dir, "embeddings"), "embedding", VECTOR, 50, "vec_id").withColumnRenamed("vec_id", "doc_id")
    legs = {"keyword": ranking.ranked(found, "doc_id", F.desc("score"), "doc_id"), "semantic": ranking.ranked(near, "doc_id", "distance", "doc_id")}
    return ranking.fuse(legs, "doc_id").withColumn("score", F.round("score", 8))


@query("q10_hybrid_rrf", _HYBRID + " SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query("q26_rrf_sources", _HYBRID + " SELECT doc_id, CASE WHEN keyword AND semantic THEN 'keyword+semantic' WHEN keyword THEN 'keyword' ELSE 'semantic' END AS legs FROM f")
def rrf_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("doc_id", F.concat_ws("+", "sources").alias("legs"))


# Units and ids

_LINES = r"""l AS (
  SELECT doc_id, unnest([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '\S')]) AS content, generate_subscripts([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '\S')], 1) AS ordinal FROM documents
)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("at", "content")).select("doc_id", (F.col("at") + 1).alias("ordinal"), "content")


@query(
    "q11_fragments_topk_per_kind",
    f"""WITH {_LINES}, a AS (
  SELECT 'fragment' AS unit_kind, doc_id, ordinal, len([w FOR w IN regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') IF w = 'the']) AS hits FROM l
  UNION ALL SELECT 'document', doc_id, 0, len([w FOR w IN {WORDS} IF w = 'the']) FROM documents
) SELECT unit_kind, doc_id, ordinal::INT AS ordinal, hits::INT AS hits FROM a QUALIFY row_number() OVER (PARTITION BY unit_kind ORDER BY hits DESC, doc_id, ordinal) <= 10""",
)
def fragments_topk_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lambda c: F.size(F.filter(X.tokens(c), lambda w: w == "the"))
    parts = fragments(spark, sf_dir).select(F.lit("fragment").alias("unit_kind"), "doc_id", "ordinal", hits(F.col("content")).alias("hits"))
    whole = read(spark, sf_dir, "documents").select(F.lit("document").alias("unit_kind"), "doc_id", F.lit(0).alias("ordinal"), hits(F.col("text")).alias("hits"))
    return ranking.first_by(whole.union(parts), ["unit_kind"], [F.desc("hits"), "doc_id", "ordinal"], 10)


@query(
    "q14_chunk_ids",
    f"""WITH {_LINES}, p AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM documents)
SELECT doc_id, ordinal::INT AS ordinal, sha256(path || chr(0) || ordinal || chr(0) || trim(content, ' ')) AS chunk_id FROM l JOIN p USING (doc_id)
UNION ALL SELECT doc_id, 0, sha256(path || chr(0) || 'document') FROM p""",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    docs = units(spark, sf_dir)
    lines = F.filter(F.split(F.coalesce("search_text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    parts = docs.select("doc_id", "path", F.posexplode(lines).alias("at", "content"))
    own = F.sha2(F.concat("path", zero, (F.col("at") + 1).cast("string"), zero, F.trim("content")), 256)
    return parts.select("doc_id", (F.col("at") + 1).alias("ordinal"), own.alias("chunk_id")).union(docs.select("doc_id", F.lit(0), "chunk_id"))


@query("q15_facets", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS facet FROM events")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    each = read(spark, sf_dir, "events").select("event_id", F.explode(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("facet"))
    return each


@query("q16_metadata_filter", "SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k')::VARCHAR = '42'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    rows = read(spark, sf_dir, "events").withColumn("facets", F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.where(filters.has_metadata({"k": 42})).select("event_id", "event_type")


# Synchronisation

# The earlier snapshot holds the documents that have a label; now toxic ones are gone,
# those of low quality have changed, and the other labelled ones were touched or not by their source.
_SNAPSHOTS = """l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id AS path, coalesce(text, '') AS text, source, quality, toxic FROM documents d LEFT JOIN l USING (doc_id)),
p AS (SELECT path, sha256(text) AS hash, path AS mtime FROM d WHERE quality IS NOT NULL),
c AS (SELECT path, CASE WHEN quality = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash, CASE WHEN quality = 0 OR source = 'src1' THEN path + 1 ELSE path END AS mtime FROM d WHERE coalesce(toxic, 0) = 0)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    return docs.join(own, "doc_id", "left").withColumnRenamed("doc_id", "path")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: path, content_hash, mtime_ns, size."""
    docs = labelled(spark, sf_dir)
    before = docs.where(F.col("quality").isNotNull()).select("path", F.sha2("text", 256).alias("content_hash"), F.col("path").alias("mtime_ns"), F.lit(1).cast("long").alias("size"))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    text = F.when(poor, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stamp = F.when(poor | (F.col("source") == "src1"), F.col("path") + 1).otherwise(F.col("path"))
    now = docs.where(F.coalesce("toxic", F.lit(0)) == 0).select("path", F.sha2(text, 256).alias("content_hash"), stamp.alias("mtime_ns"), F.lit(1).cast("long").alias("size"))
    return before, now


@query(
    "q12_sync_diff",
    f"""WITH {_SNAPSHOTS} SELECT action, count(*) AS documents FROM (
  SELECT CASE WHEN c.path IS NULL THEN 'removed' WHEN p.path IS NULL THEN 'added' WHEN p.mtime = c.mtime THEN 'unchanged' WHEN p.hash = c.hash THEN 'touched' ELSE 'changed' END AS action FROM p FULL JOIN c USING (path)
) GROUP BY action""",
)
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the engine goes: stamps first, then the content of what they say is to be read."""
    before, now = snapshots(spark, sf_dir)
    plan = sync.stat_diff(before, now.select("path", "mtime_ns", "size"))
    content = now.select("path", F.col("content_hash").alias("now_hash"))
    read_ = plan.join(content, "path", "left")
    action = F.when(F.col("action") != "read", F.col("action")).when(F.col("previous_hash").isNull(), "added").when(F.col("previous_hash") == F.col("now_hash"), "touched").otherwise("changed")
    return read_.groupBy(action.alias("action")).agg(F.count("*").alias("documents"))


@query(
    "q13_move_detection",
    f"""WITH {_SNAPSHOTS}, r AS (SELECT path AS old_path, hash FROM p WHERE path NOT IN (SELECT path FROM c)), a AS (SELECT path AS new_path, hash FROM c WHERE path NOT IN (SELECT path FROM p)),
one AS (SELECT hash, min(old_path) AS old_path FROM r GROUP BY hash HAVING count(*) = 1) SELECT new_path, old_path FROM a JOIN one USING (hash)""",
)
def move_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = snapshots(spark, sf_dir)
    added, removed = now.join(before, "path", "left_anti"), before.join(now, "path", "left_anti")
    return sync.moves(added, removed).select(F.col("path").alias("new_path"), "old_path")


@query(
    "q30_snapshot_fixpoint",
    f"""WITH {_SNAPSHOTS} SELECT (SELECT count(*) FROM c) AS documents, (SELECT count(*) FROM c) AS unchanged, 1 AS generations""",
)
def snapshot_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier rows, with what a synchronisation replaces in them, are the present snapshot: nothing is left to read, and the generation is its."""
    before, now = snapshots(spark, sf_dir)
    plan = sync.stat_diff(before, now.select("path", "mtime_ns", "size"))
    seen = now.join(plan.where("action = 'read'").select("path", "previous_hash"), "path")
    fresh = seen.where(~F.col("content_hash").eqNullSafe(F.col("previous_hash"))).drop("previous_hash")
    touched = seen.where(F.col("content_hash") == F.col("previous_hash")).select("path", "mtime_ns")
    rows = sync.replace_rows(before, fresh, plan.where("action = 'removed'").select("path"))
    after = sync.restamp(rows, touched, "mtime_ns")
    again = sync.stat_diff(after, now.select("path", "mtime_ns", "size")).agg(F.count("*").alias("documents"), F.count_if(F.col("action") == "unchanged").alias("unchanged"))
    generations = sync.generation(after).union(sync.generation(now)).agg(F.count_distinct("generation").cast("int").alias("generations"))
    return again.crossJoin(F.broadcast(generations))  # one row each


@query(
    "q34_vector_reuse",
    """WITH h AS (SELECT doc_id, sha256('model' || chr(0) || '64' || chr(0) || coalesce(text, '')) AS hash FROM documents), old AS (SELECT DISTINCT hash FROM h JOIN labels USING (doc_id))
SELECT CASE WHEN old.hash IS NULL THEN 'pending' ELSE 'reused' END AS state, count(*) AS units FROM h LEFT JOIN old USING (hash) GROUP BY 1""",
)
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the vectors that labelled ones have."""
    own = read(spark, sf_dir, "documents").select("doc_id", sync.embedding_input_hash("model", 64, F.coalesce("text", F.lit(""))).alias("embedding_input_hash"))
    stored = own.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("embedding_input_hash", F.array(F.col("doc_id").cast("float")).alias("vector"))
    return sync.reuse_vectors(own, stored).groupBy(F.when(F.col("vector").isNull(), "pending").otherwise("reused").alias("state")).agg(F.count("*").alias("units"))


# Links

_EDGES = """h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages),
e AS (SELECT 'page-' || page_id || '.md' AS from_path, ltrim(href, '/') || '.md' AS to_path FROM h WHERE length(ltrim(href, '/')) > 0),
k AS (SELECT DISTINCT regexp_extract(lower(text), '[\\p{L}\\p{N}]+') || '.md' AS path FROM documents WHERE regexp_matches(lower(text), '[\\p{L}\\p{N}]'))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a document of wiki links to what it refers to; the links by the engine's scanner."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    body = F.concat_ws("\n\n", F.transform(hrefs, lambda h: F.concat(F.lit("see [["), h, F.lit("]]"))))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), body.alias("raw"))
    return relations.distinct_edges(link_rows(pages))


def known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.regexp_extract(F.lower("text"), X.WORD, 0).alias("word"))
    return words.where(F.length("word") > 0).select(F.concat("word", F.lit(".md")).alias("path")).distinct()


@query("q17_edges", f"WITH {_EDGES} SELECT DISTINCT from_path, to_path FROM e")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("from_path", "to_path")


@query("q18_edge_status", f"WITH {_EDGES}, d AS (SELECT DISTINCT from_path, to_path FROM e) SELECT from_path, to_path, CASE WHEN k.path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM d LEFT JOIN k ON to_path = k.path")
def edge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.with_status(edges(spark, sf_dir), known_paths(spark, sf_dir)).select("from_path", "to_path", "status")


@query(
    "q19_relations_one_hop",
    f"""WITH {_EDGES}, d AS (SELECT DISTINCT from_path, to_path FROM e), r AS (
  SELECT 'outgoing' AS direction, to_path AS path FROM d WHERE from_path = 'page-1.md' UNION ALL SELECT 'incoming', from_path FROM d WHERE to_path = 'page-1.md' AND from_path != 'page-1.md'
) SELECT direction, path FROM r ORDER BY direction = 'incoming', path LIMIT 5""",
)
def relations_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.one_hop(edges(spark, sf_dir), "page-1.md", 5).select("direction", "path")


@query("q20_broken_links", f"WITH {_EDGES} SELECT DISTINCT from_path AS path, 'link.broken' AS kind, to_path AS target FROM e WHERE to_path NOT IN (SELECT path FROM k)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.broken_links(edges(spark, sf_dir), known_paths(spark, sf_dir)).select("path", "kind", "target")


# Governance


@query("q21_tag_counts", "SELECT tag, count(*) AS documents FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.tag_counts(units(spark, sf_dir)).select("tag", F.col("count").alias("documents"))


@query("q22_known_tags", "SELECT tag, row_number() OVER (ORDER BY n DESC, tag)::INT AS place FROM (SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag)")
def known_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = governance.tag_counts(units(spark, sf_dir))
    return ranking.positions(counts, [-F.col("count"), F.col("tag")], 8).select("tag", F.col("position").cast("int").alias("place"))


@query(
    "q23_rule_required",
    """SELECT doc_id, field FROM (SELECT doc_id, unnest([f FOR f IN ['type', 'tags', 'summary', 'status'] IF NOT list_contains(fields, f)]) AS field FROM (
  SELECT d.doc_id, list_concat(['type'], list_concat(CASE WHEN l.doc_id IS NULL THEN [] ELSE ['status'] END, CASE WHEN n_chars > 500 THEN ['summary'] ELSE [] END)) AS fields FROM documents d LEFT JOIN labels l USING (doc_id)))""",
)
def rule_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = read(spark, sf_dir, "documents").join(labelled, "doc_id", "left")
    fields = F.array_compact(F.array(F.lit("type"), F.when(F.col("labelled"), F.lit("status")), F.when(F.col("n_chars") > 500, F.lit("summary"))))
    return governance.missing_fields(docs.withColumn("fields", fields), ["status"]).select("doc_id", "field")


@query(
    "q24_glob_sections",
    """WITH p AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM documents) SELECT path, pattern FROM p, (VALUES ('src1'), ('src*/de/*'), ('*[13]?.md'), ('src{2,3}/*')) t(pattern)
WHERE CASE pattern WHEN 'src1' THEN starts_with(path, 'src1/') WHEN 'src*/de/*' THEN regexp_full_match(path, 'src.*/de/.*') WHEN '*[13]?.md' THEN regexp_full_match(path, '.*[13].[.]md') ELSE regexp_full_match(path, 'src(2|3)/.*') END""",
)
def glob_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.section_matches(units(spark, sf_dir).select("path"), ["src1", "src*/de/*", "*[13]?.md", "src{2,3}/*"])


@query(
    "q25_issue_report",
    """WITH i AS (
  SELECT doc_id, 'content.empty' AS kind, 'error' AS severity FROM documents WHERE coalesce(trim(text), '') = ''
  UNION ALL SELECT doc_id, 'type.not_allowed', 'error' FROM documents WHERE lang NOT IN ('en', 'de')
  UNION ALL SELECT doc_id, 'summary.long', 'warning' FROM documents WHERE n_chars > 4000
  UNION ALL SELECT d.doc_id, 'tags.non_canonical', 'warning' FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0
) SELECT severity, kind, count(*) AS issues, min(doc_id) AS first_doc FROM i GROUP BY ALL""",
)
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = governance.issues(
        docs,
        "doc_id",
        {
            ("content.empty", "error"): F.trim(F.coalesce("text", F.lit(""))) == "",
            ("type.not_allowed", "error"): ~F.col("lang").isin("en", "de"),
            ("summary.long", "warning"): F.col("n_chars") > 4000,
        },
    )
    poor = labels.where("quality = 0").join(docs.select("doc_id"), "doc_id").select("doc_id", F.lit("tags.non_canonical").alias("kind"), F.lit("warning").alias("severity"))
    return found.union(poor).groupBy("severity", "kind").agg(F.count("*").alias("issues"), F.min("doc_id").alias("first_doc"))


@query(
    "q33_tag_aliases",
    """WITH t AS (SELECT doc_id, unnest([upper(lang), source, 'src01']) AS tag FROM documents), a(canonical, alias) AS (VALUES ('english', 'en'), ('german', 'de'), ('source-one', 'src1'), ('source-one', 'src01'), ('src2', 'src2')),
m AS (SELECT t.doc_id, t.tag, min(a.canonical) AS canonical FROM t JOIN a ON lower(t.tag) = a.alias OR lower(t.tag) = lower(a.canonical) WHERE t.tag NOT IN (SELECT canonical FROM a) GROUP BY ALL) SELECT doc_id, tag, canonical FROM m""",
)
def tag_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.upper("lang"), "source", F.lit("src01"))).alias("tag"))
    aliases = {"english": ["en"], "german": ["de"], "source-one": ["src1", "src01"], "src2": []}
    return governance.non_canonical(tags, aliases).select("doc_id", "tag", "canonical").distinct()


# Order, time and display


@query("q27_path_order", f"WITH {UNITS_SQL} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM u")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return ranking.positions(units(spark, sf_dir).select("path"), [path.isNull(), X.path_order(path)], 16)  # no path comes last, as in SQL


@query("q28_rfc3339", "SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS modified_at FROM events")
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return read(spark, sf_dir, "events").select("event_id", X.rfc3339(ns).alias("modified_at"))


@query("q31_display_name", f"WITH {UNITS_SQL} SELECT path, 'doc-' || doc_id AS filename FROM u")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("path", X.stem(F.col("path")).alias("filename"))


@query(
    "q32_snippet",
    r"""WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM benchmark) SELECT item_id, CASE WHEN length(one) > 80 THEN substr(one, 1, 80) || '…' ELSE one END AS snippet FROM c""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.snippet(F.col("text")).alias("snippet"))


@query(
    "q35_section_context",
    f"""WITH {_LINES} SELECT doc_id, substr(content, 1, 120) AS context FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (ordinal != 2)::INT, ordinal) = 1""",
)
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fragments(spark, sf_dir).withColumn("section", F.col("ordinal").cast("string"))
    return relations.section_context(parts, F.lit("2"), ["doc_id"]).select("doc_id", "context")


@query(
    "q36_hydrate",
    f"""WITH {bm25_sql(TERMS)}, f AS (SELECT doc_id, path, score FROM s ORDER BY score DESC, path LIMIT 20) SELECT f.path, f.score, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM f LEFT JOIN labels l USING (doc_id)""",
)
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.top(matched(units(spark, sf_dir), TERMS), 20, "path").select("doc_id", "path", "score")
    return relations.hydrate(hits, read(spark, sf_dir, "labels"), "doc_id").select("path", "score", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("q29_markdown_chunks", None)
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a Markdown document with a heading, cut into units; q37 has SQL for what SQL can cut."""
    turns = read(spark, sf_dir, "conversations")
    path = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    raw = F.concat(F.lit("---\ntype: turn\ntags: ["), "role", F.lit("]\n---\n\n# "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return chunk_udtf_rows(turns.select(path.alias("path"), raw.alias("raw"))).select("path", "unit_kind", "ordinal", "section", "chunk_id", F.length("search_text").alias("length"))


@query(
    "q37_unit_heads",
    """WITH t AS (SELECT 'conv-' || conv_id || '/' || turn || '.md' AS path, role FROM conversations)
SELECT path, unit_kind, section, unit_kind = 'document' AS is_first, lookup FROM (
  SELECT path, 'document' AS unit_kind, '' AS section, regexp_extract(path, '([^/]+)[.]md$', 1) AS lookup FROM t
  UNION ALL SELECT path, 'fragment', role, regexp_extract(path, '([^/]+)[.]md$', 1) FROM t)""",
)
def unit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first units of every turn: kind, breadcrumb, order and lookup key."""
    turns = read(spark, sf_dir, "conversations")
    path = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    raw = F.concat(F.lit("---\ntype: turn\n---\n\n# "), "role", F.lit("\n\nsaid: "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    found = chunk_udtf_rows(turns.select(path.alias("path"), raw.alias("raw"))).where("ordinal <= 1")
    return found.select("path", "unit_kind", "section", (F.col("ordinal") == 0).alias("is_first"), F.element_at("lookup_keys", 3).alias("lookup"))
