"""Bringing the derived tables up to date with the files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from ..functions.embedding import BATCH
from ..functions.text import PLAIN, Analyser
from ..operators import lexical, relations, sync
from ..sources import markdown, paths
from .contracts import SyncReport
from .store import READ, SCHEMAS, Store


def ensure_fresh(store: Store, root: Path, rule_file: str, embedder=None, vectors: bool = True, analyse: Analyser = PLAIN) -> SyncReport:
    """Reads what changed, drops what went, and writes a new generation if anything did."""
    with store.lock():
        return _sync(store, root, rule_file, embedder if vectors else None, analyse)


def rebuild(store: Store, root: Path, rule_file: str, embedder=None, analyse: Analyser = PLAIN) -> SyncReport:
    with store.lock():
        store.reset()
        return _sync(store, root, rule_file, embedder, analyse)


def maintain(store: Store, analyse: Analyser = PLAIN) -> None:
    """Rewrites the index tables compactly from the units: a term's rows lie in one range of files."""
    with store.lock():
        if store.unusable() & READ:
            return  # the next synchronisation reads the files anew
        tables = {name: store.table(name) for name in SCHEMAS}
        tables |= _indexes(tables["units"], analyse)
        tables["postings"] = tables["postings"].repartitionByRange("unit_kind", "term").sortWithinPartitions("term")
        store.write(tables, store.manifest()["fingerprint"], store.manifest().get("model"))


def _indexes(units: DataFrame, analyse: Analyser) -> dict[str, DataFrame]:
    # Rows of a term lie together, so a query's terms are pushed down to few row groups.
    return {"postings": lexical.postings(units, analyse).sortWithinPartitions("term"), "stats": lexical.unit_stats(units, analyse)}


def embed_units(units: DataFrame, embedder) -> DataFrame:
    """``units`` (chunk_id, search_text) as chunk_id, vector, error; in batches, one model for each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                try:
                    vectors, error = embedder.embed(part["search_text"].tolist()), None
                    if len(vectors) != len(part):
                        raise EmbeddingError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001  a model may raise anything; its units stay pending
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"[:200]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": vectors, "error": error})

    return units.select("chunk_id", "search_text").mapInPandas(run, "chunk_id string, vector array<float>, error string")


def missing_vectors(units: DataFrame, embedder, made_by: str | None) -> DataFrame:
    """path of documents that lack a vector of the present model."""
    lacking = F.col("vector").isNull()
    if made_by != embedder.model:  # some vectors may be another model's
        own = sync.embedding_input_hash(embedder.model, embedder.dimensions, F.col("search_text"))
        lacking |= ~F.col("embedding_input_hash").eqNullSafe(own)
    return units.where(lacking).select("path").distinct()


def _sync(store: Store, root: Path, rule_file: str, embedder, analyse: Analyser) -> SyncReport:
    spark: SparkSession = store.spark
    broken, before = store.unusable(), store.manifest() or {}
    if broken & READ:  # read from files: all of them are read again
        old = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    else:  # an index that is missing or of other terms follows from the units
        old = {name: store.table(name) for name in SCHEMAS}
        if broken:
            old |= _indexes(old["units"], analyse)
    model = embedder.model if embedder else before.get("model")
    missing = missing_vectors(old["units"], embedder, before.get("model")) if embedder else None
    scratch = store.scratch()

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"file://{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{scratch}/{name}")

    plan = keep(sync.stat_diff(old["documents"], paths.listing(spark, root, rule_file), missing), "plan")
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    report = SyncReport(removed=counts.get("removed", 0), unchanged=counts.get("unchanged", 0))
    if not counts.get("read") and not report.removed and before and not broken & READ:
        if broken:
            store.write(old, before["fingerprint"], model)
        report.generation = before["fingerprint"]
        return report
    wanted = plan.where("action = 'read'")
    tasks = min(spark.sparkContext.defaultParallelism * 4, max(1, counts.get("read", 0) // 64 + 1))
    done = keep(markdown.read(wanted.repartition(tasks), str(root)), "read")
    removed = plan.where("action = 'removed'").select("path")
    fresh, same = done.where("state = 'read'"), done.where("state = 'same'")
    states = {r["state"]: r["count"] for r in done.groupBy("state").count().collect()}
    report.indexed = states.get("read", 0)
    report.unchanged += states.get("same", 0)
    trouble = done.select("path", F.concat(F.array_compact(F.array("error")), F.transform("warnings", lambda w: F.concat("path", F.lit(": "), w))).alias("what"))
    report.degraded = [m for r in trouble.where(F.size("what") > 0).orderBy("path").collect() for m in r["what"]]

    known = old["documents"]
    added = fresh.join(known.select("path"), "path", "left_anti").select("path", "content_hash")
    report.moved = sync.moves(added, known.join(removed, "path", "left_semi")).count()

    documents = sync.replace_rows(known, fresh.select(*known.columns), removed)
    stamps = same.select("path", "mtime_ns", F.col("size").alias("_size"))
    documents = sync.restamp(documents, stamps, "mtime_ns")
    tables = {"documents": keep(documents, "documents")}

    gone = removed.unionByName(fresh.select("path"))
    units = fresh.select(F.explode("units").alias("u")).select("u.*")
    units = units.withColumn("embedding_input_hash", sync.embedding_input_hash(embedder.model, embedder.dimensions, F.col("search_text")) if embedder else F.lit(None).cast("string"))
    stored = old["units"].select("embedding_input_hash", "vector")
    units = keep(sync.reuse_vectors(units, stored).select(*old["units"].columns), "units")
    if embedder:
        made = keep(embed_units(units.where(F.col("vector").isNull()), embedder), "vectors")
        sums = units.agg(F.count("vector").alias("reused")).crossJoin(made.agg(F.count("vector").alias("made"), F.count_if(F.col("vector").isNull()).alias("pending"), F.slice(F.array_sort(F.collect_set("error")), 1, 5).alias("errors"))).first()
        report.vectors_reused, report.vectors_ready, report.vectors_pending = sums["reused"], sums["reused"] + sums["made"], sums["pending"]
        report.degraded += [f"embedding: {e}" for e in sums["errors"]]
        units = units.withColumnRenamed("vector", "_reused").join(made.select("chunk_id", "vector"), "chunk_id", "left").withColumn("vector", F.coalesce("_reused", "vector")).select(*old["units"].columns)
    all_units = sync.replace_rows(old["units"], units, gone)
    tables["units"] = keep(sync.restamp(all_units, stamps, "modified_at_ns"), "all_units")

    edges = fresh.select(F.col("path").alias("from_path"), F.explode("edges").alias("e")).select("from_path", "e.*", F.lit("").alias("status"))
    edges = sync.replace_rows(old["edges"].withColumnRenamed("from_path", "path"), edges.withColumnRenamed("from_path", "path"), gone).withColumnRenamed("path", "from_path")
    tables["edges"] = relations.with_status(edges, tables["documents"])

    new = lexical.postings(units, analyse)
    tables["postings"] = sync.replace_rows(old["postings"], new.select(*old["postings"].columns), gone).sortWithinPartitions("term")
    tables["stats"] = lexical.unit_stats(tables["units"], analyse)
    report.generation = sync.generation(tables["documents"]).first()["generation"]
    store.write(tables, report.generation, model)
    return report
