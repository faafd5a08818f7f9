import os

import pytest
from pyspark.sql import functions as F

from kbspark.llm import registry
from kbspark.llm.common import with_totals

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/part-*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, str(folder))
    assert sorted(got.columns) == sorted(columns)
    want = sorted(found.fetchall(), key=str)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == want
    return want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["op7_warc", "op8_minhash"])
def test_tables(spark, name):
    assert both(spark, name, SF)


def test_repeated_and_empty_payloads(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>ä中</p>", "b" * 100_000]
    rows = [(i, f"http://x/{i}", html[i % 7] if i % 7 < 5 else f"own {i}") for i in range(70)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = both(spark, "op7_warc", tmp_path)
    # 50 pages share 4 payloads, of which the empty one is also the null one
    assert sum(r[3] == "revisit" for r in want) == 46


def test_documents_with_edges(spark, docs, tmp_path):
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[3] for r in both(spark, "op8_minhash", tmp_path)} == {True, False}


def test_totals_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.col("id").alias("rep"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("x"))
    n, top = [F.count("*").alias("n"), F.max("rep").alias("top")], [F.sum("n").alias("n"), F.max("top").alias("top")]
    got = sorted(map(tuple, with_totals(rows, "x", "rep", n, top).select("rep", "x", "n", "top").collect()))
    assert got == [(i, 7, 2000, 2999) if i % 3 else (i, i, 1, i) for i in range(3000)]
    assert with_totals(rows, "x", "rep", n, top, "n > 1").count() == 2000
