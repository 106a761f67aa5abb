"""The table functions from SQL."""

from lorekeep.functions import sql


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("d/a.md", "---\ntags: [x]\n---\n\n# One\n\nsee [[b]]\n"), ("n.md", None)], "path string, raw string").createOrReplaceTempView("files")
    units = spark.sql("SELECT path, u.* FROM files, LATERAL chunk_markdown(path, raw) u ORDER BY ordinal").collect()
    assert [(r.unit_kind, r.ordinal, r.section) for r in units] == [("document", 0, ""), ("fragment", 1, "One")]
    edges = spark.sql("SELECT e.* FROM files, LATERAL extract_links(path, raw) e").collect()
    assert [tuple(e) for e in edges] == [("d/b.md", "[[link]]", "One")]
