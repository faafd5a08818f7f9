from kbspark.plans import registry
from kbspark.sources.io import table


def test_contexts_are_whole_texts_and_no_question_is_dropped(spark, tmp_path):
    docs = [(i, f"word{i} " * 40 + "shared end", "en", "hot", 0) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "word3 word4"), (2, "nothing matches")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["question_id"]: r for r in registry.queries()["build_eval_set_of_hits"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2}
    assert set(got[1]["context"].split("\u0001")) == {docs[3][1], docs[4][1]}
    assert (got[2]["context"], got[2]["answer"]) == ("", "2")
