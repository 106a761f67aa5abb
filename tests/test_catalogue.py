"""Every catalogue query against its SQL on DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import filters, lexical
from lorekeep.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(str)
    return sorted(map(tuple, df.itertuples(index=False))), list(df.columns)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLE[name]).df())


def test_positions_of_more_rows_than_a_sample_holds(spark, duck, tmp_path):
    """Ranges must be the same when rows are counted and when they are numbered; no path comes last."""
    doc = F.col("id")
    lang = F.when(doc % 1000 == 0, F.lit(None)).otherwise(F.concat(F.lit("l"), doc % 7))
    many = spark.range(30_000, numPartitions=6).select(doc.alias("doc_id"), F.lit("").alias("text"), lang.alias("lang"), F.concat(F.lit("s"), (doc * 7919 % 101)).alias("source"))
    many.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["q27_path_order"](spark, str(tmp_path)).toPandas()
    assert sorted(got.position) == list(range(1, 30_001))
    assert rows(got) == rows(con.sql(catalogue.ORACLE["q27_path_order"]).df())


def test_chunks_keep_the_limit(spark):
    found = catalogue.QUERIES["q29_markdown_chunks"](spark, SF).toPandas()
    assert found["length"].max() + 16 <= 512
    assert set(found.unit_kind) == {"document", "fragment"}


def test_filters_reach_the_scan(spark, tmp_path):
    """The engine's filters on units and postings, and the terms of a query, are pushed into the files."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    docs = catalogue.units(spark, SF).withColumn("facets", F.array(F.lit("k=1"))).withColumn("content", F.col("search_text"))
    docs.write.partitionBy("unit_kind").parquet(f"{tmp_path}/units")
    lexical.postings(docs).write.partitionBy("unit_kind").parquet(f"{tmp_path}/postings")
    own = spark.read.parquet(f"{tmp_path}/units").where((F.col("unit_kind") == "document") & filters.structural("src1", ["en"], ["en", "de"], after=5, before=900))
    plan = own.select("path")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "In(note_type" in pushed and "GreaterThanOrEqual(modified_at_ns,5)" in pushed and "LessThanOrEqual(modified_at_ns,900)" in pushed and "StringStartsWith(path,src1/)" in pushed
    assert "search_text" not in plan and "PartitionFilters: [isnotnull(unit_kind" in plan
    index = spark.read.parquet(f"{tmp_path}/postings")
    scored = lexical.bm25(index.where("unit_kind = 'document'"), lexical.unit_stats(docs), ["heed", "the"])
    assert "In(term, [heed,the])" in scored._jdf.queryExecution().executedPlan().toString()
    best = catalogue.bm25_filtered(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in best and "CartesianProduct" not in best


def test_entry_imports_without_the_operators(tmp_path):
    """The driver takes the training-data operators away; the rest must go on."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lorekeep", tmp_path / "lorekeep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_bm25_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
