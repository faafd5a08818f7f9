"""Queries over documents with odd rows against their SQL: empty and missing texts, numbers that repeat, are missing or below zero, texts that hold a rule's marks."""

from collections import Counter

import pytest

from kbspark.plans import registry

ROWS = {
    "empty": [(i, "") for i in range(12)],
    "missing": [(i, None) for i in range(12)],
    "repeated": [(i % 6, t) for i, t in enumerate(["a", "", "b", "", "c", "", "d", "x", "", "y", "z", "w", "d"])],
    "marks": [(i, "产品版本号 明细表 发布日期") for i in range(12)] + [(16, "明细表"), (22, "产品版本号"), (25, "明"), (28, "明细")],
    "numbers": [(-i, "t") for i in range(1, 13)] + [(None, "t"), (None, "u"), (2**40 + 2, "t")],
}


@pytest.mark.parametrize("kind", ROWS)
def test_classes_equal_sql(spark, tmp_path, kind):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, text, "en", "src0", len(text or "")) for i, text in ROWS[kind]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["classify_documents"]).fetchall()
    found = registry.queries()["classify_documents"](spark, str(tmp_path)).select("doc_id", "class").collect()
    assert len(want) == len(rows) and Counter(map(tuple, found)) == Counter(want)
