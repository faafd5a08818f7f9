import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kbspark.llm import registry, toxicity
from kbspark.llm.common import table
from test_line_dedup import brute as brute_lines
from test_neardup import brute as brute_near
from test_tokens import brute_best_fit
from test_toxicity_quality import brute_kept, brute_score

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = rows = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert sorted(rows) == sorted(r for r in before if brute_kept(r[1]))
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(before, docs.schema), table(spark, SF, "labels"))
            assert sorted(rows) == sorted(r for r in before if brute_score(r[1], model) < 0.5) and 0.7 * len(before) < len(rows) < len(before)
        if name == "line_dedup":
            want = {d: t for d, t, n, gone in brute_lines(before) if not (gone and not re.search("[^\x20\x09-\x0d]", t))}
            assert {r[0]: r[1] for r in rows} == want
            assert all(r[4] == len(r[1]) for r in rows if r[1] != dict((x[0], x[1]) for x in before)[r[0]])
        if name == "minhash_near_dedup":
            assert sorted(r[0] for r in rows) == sorted(d for d, _, _, stays in brute_near(before, 80) if stays)
        if name == "best_fit_packing":
            lengths = {}
            for r in rows:
                lengths[r[0]] = lengths.get(r[0], 0) + r[3]
            assert lengths == {d: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for d, text, *_ in before}
            assert len({r[5] for r in rows}) <= len(brute_best_fit([r[3] for r in rows]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r[0], r[1], r[3], r[4]) for r in kept["best_fit_packing"])


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_line_dedup_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["op1_line_dedup"]).fetchall())
    assert sorted(map(tuple, registry.queries()["op1_line_dedup"](spark, SF).collect())) == want


def test_all_queries_give_rows_for_every_document(spark):
    n = {"op7_warc": table(spark, SF, "pages").count()}
    for name, query in registry.queries().items():
        if name.split("_")[0] in ("op2", "op3", "op6", "op7", "op9", "op10"):
            assert query(spark, SF).count() == n.get(name, table(spark, SF, "documents").count())
