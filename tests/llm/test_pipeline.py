"""The stages on a small table, and the registered queries."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from lorekeep.llm import queries
from lorekeep.llm.common import materialise

from .conftest import prose


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]


def test_stages(spark, documents, odd_rows, tmp_path):
    toxic = [(2000 + i, f"{prose(12, 900 + i)} you idiot {prose(9, 700 + i)}") for i in range(150)]
    clean = [(3000 + i, prose(25, 5000 + i)) for i in range(150)]
    copies = [(4000, prose(200, 4)), (4001, prose(200, 4)), (4002, prose(199, 4) + " end"), (4003, prose(100, 77) + " me@example.com " + prose(99, 78))]
    rows = odd_rows + toxic + clean + copies
    spark.createDataFrame([(i, 1, int(i < 3000)) for i, _ in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = docs.select("doc_id", "text").collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert not ids["toxicity"] & {i for i, _ in toxic} and ids["toxicity"] >= {i for i, _ in clean}
    assert 4000 in ids["exact_dedup"] and 4001 not in ids["exact_dedup"]
    assert 4000 in ids["near_dedup"] and 4002 not in ids["near_dedup"]
    masked = {r.doc_id: r.text for r in kept["pii"]}
    assert "<email>" in masked[4003] and "me@example.com" not in masked[4003]
    packed = docs.collect()
    assert {r.doc_id for r in packed} == ids["pii"]


def test_run_on_an_empty_table(spark, documents, tmp_path):
    documents([(1, "x")], extra=False).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
