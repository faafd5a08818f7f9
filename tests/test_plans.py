"""Every query with SQL against DuckDB on the smallest tables; the others must run with rows, and alike from any number of partitions."""

import math
import os

import pytest

from kbspark.plans import registry
from kbspark.sources.io import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def values(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert values(df.collect(), [df.columns.index(c) for c in columns]) == values(found.fetchall(), [names.index(c) for c in columns])


@pytest.mark.parametrize("name", ["vector_search", "rrf_fuse", "chunk_corpus", "merge_small_chunks", "reflow_columns", "knowledge_paths", "bm25_search"])
def test_partitions_do_not_matter(spark, tmp_path, name):
    """The same rows from one file as from many, and with one shuffle partition as with many."""
    for t in ("documents", "embeddings", "benchmark"):
        table(spark, SF, t).repartition(7).write.parquet(str(tmp_path / f"{t}.parquet"))
    query = registry.queries()[name]
    one = sorted(map(str, query(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, query(spark, str(tmp_path)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
