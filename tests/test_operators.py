"""Literal rows for the rules of the operators."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.functions import columns, text
from kbspark.operators import catalog, chunks, evaluate, graph, keywords, layout, models, prompts, retrieve, vectors
from kbspark.sources import io
from kbspark.streaming.index import IndexStream, last_arrivals, latency_stream


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# --- splitting ---


def texts():
    rng = random.Random(0)
    alphabet = ["甲", "乙", "。", "！", "？", "，", "；", "\n", "\n\n", " ", ". ", "一、", "01 ", "\n1.", "abc", "（二）", "\n（三）", "word "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(200)]


@pytest.mark.parametrize("split,separators", [(text.split_recursive, text.SECTION_SEPARATORS), (text.split_characters, (r"\n\n", "\n", " ", "")), (text.split_sections, (text.SECTION_RULE,))])
def test_splitter_invariants(split, separators):
    for t in texts():
        parts = split(t, size=40, overlap=0)
        assert all(p.strip() == p != "" for p in parts)
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", t)
        for p in parts:
            if len(p) > 40 and split is not text.split_sections:  # only where no separator is left inside
                assert "" not in separators and not any(re.search(s, p[1:]) for s in separators[-1:])


def test_split_rules():
    assert text.split_recursive("") == []
    assert text.split_recursive("短。") == ["短。"]
    assert text.split_recursive("甲" * 5 + "。" + "乙" * 5 + "。", size=6, overlap=0) == ["甲" * 5, "。" + "乙" * 5, "。"]
    assert text.split_recursive("a" * 30, size=10) == ["a" * 30]
    assert text.split_characters("ab cd ef", size=5) == ["ab cd", "ef"]
    assert text.packed_spans([0, 3, 6, 9], 6, 3) == [(0, 6), (3, 9)]
    assert text.splitter("no such name")("甲。「乙。」丙！丁") == text.split_sentences("甲。「乙。」丙！丁") == ["甲。「乙。」", "丙！", "丁"]
    assert text.split_characters("x" * 25, size=10) == ["x" * 10, "x" * 10, "x" * 5]


def test_merge_small():
    merge = lambda *n: [len(x) for x in text.merge_small(["x" * k for k in n])]
    assert merge(10, 50, 200, 79) == [10 + 1 + 50 + 1 + 200 + 1 + 79]
    assert merge(10, 200, 90) == [211, 90]
    assert merge(100, 30) == [131]
    assert merge(30) == [30]
    assert merge(79, 80, 100) == [160, 100]
    assert merge() == []




def test_sentences(spark):
    given = ["甲。「乙。」丙！丁", "一。二！三？", "无", "", "甲。」』乙", "a.b!c?", "甲。\n", "甲。。乙", '他说："好。"我走。']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", columns.sentences("t").alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    assert got[0] == ["甲。「乙。」", "丙！", "丁"]
    assert got[1] == ["一。", "二！", "三？"]
    assert got[2] == ["无"] and got[3] == []
    assert got[4] == ["甲。」』", "乙"]
    assert got[5] == ["a.b!c?"]
    assert got[6] == ["甲。\n"]
    assert got[7] == ["甲。。", "乙"]
    assert got[8] == ['他说："好。"', "我走。"]
    assert all("".join(got[i]) == given[i] for i in got)


def test_split_texts_and_udtf(spark):
    df = spark.createDataFrame([(1, "甲。乙。", "k"), (2, None, "k"), (3, "", "k")], "id int, text string, seq2 string")
    assert rows(chunks.split_texts(df, size=2, overlap=0)) == [(1, "k", 0, "甲"), (1, "k", 1, "。乙"), (1, "k", 2, "。")]
    models.register_split_text(spark)
    df.createOrReplaceTempView("given")
    assert rows(spark.sql("SELECT id, seq, chunk FROM given, LATERAL split_text(text, 'recursive')")) == [(1, 0, "甲。乙。")]
    text.register_splitter("halves", lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])
    assert [r["content"] for r in chunks.split_texts(df.where("id = 1"), splitter="halves").collect()] == ["甲。", "乙。"]
    del text.SPLITTERS["halves"]


def test_chunk_corpus(spark):
    corpus = spark.createDataFrame([("k", "a.txt", "x" * 90 + "。" + "y" * 500 + "。"), ("k", "b.PPTX", "slide one. " * 60), ("k", "c.txt", None)], "kb_name string, file string, text string")
    found = chunks.chunk_corpus(corpus, smaller_size=50).collect()
    assert len({r["chunk_id"] for r in found}) == len(found)
    big = [r for r in found if r["parent_id"] is None]
    assert [r["content"] for r in big if r["file"] == "b.PPTX"] == ["slide one. " * 60]
    ids = {r["chunk_id"] for r in big}
    children = [r for r in found if r["parent_id"]]
    assert children and all(r["parent_id"] in ids and len(r["content"]) <= 50 for r in children)
    assert {r["chunk_id"] for r in chunks.chunk_corpus(corpus.repartition(3), smaller_size=50).collect()} == {r["chunk_id"] for r in found}
    assert chunks.small_to_big(chunks.chunk_corpus(corpus), 0).count() == 0


def test_neighbors_and_metadata(spark):
    df = spark.createDataFrame([("f", i, f"c{i}") for i in range(5)], "file string, seq int, content string")
    got = {r["seq"]: r["context"] for r in chunks.neighbor_context(df, ("file",)).collect()}
    assert got[0] == "c0\n\nc1\n\nc2" and got[2] == "c0\n\nc1\n\nc2\n\nc3\n\nc4" and got[4] == "c2\n\nc3\n\nc4"
    meta = spark.createDataFrame([("f.txt", {"page": "1", "text": "gone", "source": "x"}), ("g", None)], "file string, metadata map<string,string>")
    found = {r["file"]: r["metadata"] for r in chunks.normalize_metadata(meta).collect()}
    assert found["f.txt"]["page"] == "1" and "text" not in found["f.txt"] and found["f.txt"]["filename"] == "f.txt" and found["f.txt"]["parent_id"] == ""
    assert len(found["f.txt"]["source"]) == 32 and found["g"]["filename"] == "g"


def test_write_chunks_replaces_touched_bases(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda *r: spark.createDataFrame(list(r), "kb_name string, source string, content string")
    chunks.write_chunks(make(("a", "1", "old"), ("b", "2", "stays")), path)
    chunks.write_chunks(make(("a", "1", "new")), path)
    assert sorted((r["kb_name"], r["content"]) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "stays")]


# --- retrieval ---


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_vector_search_is_exact_in_any_blocks(spark, metric):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(500, None)], "chunk_id long, embedding array<float>")
    queries = df.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    want = []
    for q in range(0, 120, 20):
        a, b = data[q].astype(float), data.astype(float)
        score = {"ip": b @ a, "cosine": (b @ a) / np.linalg.norm(a) / np.linalg.norm(b, axis=1), "l2": 1 - ((b - a) ** 2).sum(1)}[metric].round(6)
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-score[i], i))[:7]
        want += [(q, i, k + 1) for k, i in enumerate(order)]
    for block in (3, 2048):
        got = vectors.vector_search(queries, df, 7, metric, exclude_self=True, block=block).collect()
        assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in got) == sorted(want)
    assert vectors.vector_search(queries.limit(0), df, 7).count() == 0


def test_normalize_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, embedding array<float>")
    assert [r["embedding"] for r in vectors.normalize_vectors(df).orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def ranked(spark, *r):
    return spark.createDataFrame(list(r), "query_id long, rank int, chunk_id string, content string, score double")


def test_rank_fusion(spark):
    a = ranked(spark, (1, 1, "a1", "x", 0.9), (1, 2, "a2", "y", 0.8), (1, 3, "a3", "x", 0.7))
    b = ranked(spark, (1, 1, "b1", "y", 0.5), (2, 1, "b2", "z", 0.4))
    got = {(r["query_id"], r["content"]): r for r in retrieve.rrf_fuse(retrieve.collect_lists({"a": a, "b": b})).collect()}
    assert got[1, "x"]["score"] == pytest.approx(1 / 61 + 1 / 63) and got[1, "y"]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert got[1, "y"]["rank"] == 1 and got[1, "x"]["chunk_id"] == "a1" and got[2, "z"]["rank"] == 1
    weighted = retrieve.rrf_fuse(retrieve.collect_lists({"a": a, "b": b}), weights={1: 0.0}, k=1).where("query_id = 1").collect()
    assert [r["content"] for r in weighted] == ["x"]
    tie = retrieve.rrf_fuse(retrieve.collect_lists({"a": ranked(spark, (1, 1, "p", "p", 1.0)), "b": ranked(spark, (1, 1, "q", "q", 1.0))})).orderBy("rank").collect()
    assert [r["content"] for r in tie] == ["p", "q"]


def test_filters(spark):
    hits = ranked(spark, (1, 1, "a", "x", 0.5), (1, 2, "b", "y", 0.5), (2, 1, "c", "z", 0.1), (2, 2, "d", "w", 0.1))
    assert rows(retrieve.context_filter(hits, 0.5).select("chunk_id")) == [("a",), ("c",)]
    assert rows(retrieve.context_filter(hits, 0.4).select("chunk_id")) == [("a",), ("b",), ("c",)]
    assert vectors.score_threshold(hits, 0.5).count() == 2 and vectors.score_threshold(hits, None, 1).count() == 2
    twice = ranked(spark, (1, 1, "a", "x", 0.5), (1, 2, "a", "x", 0.5), (1, 3, None, "y", 0.1), (1, 4, None, "z", 0.1))
    assert rows(retrieve.dedupe_hits(twice).select("rank")) == [(1,), (3,)]


def test_rerank_and_parents(spark):
    pairs = spark.createDataFrame([(1, "red cat", "a dog", "a", 1, 0.9), (1, "red cat", "the red cat", "b", 2, 0.8), (1, "red cat", "a cat", "c", 3, 0.7)], "query_id long, query string, content string, chunk_id string, rank int, score double")
    got = retrieve.rerank(pairs, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["corpus_id"], r["search_score"]) for r in got] == [("b", 1, 0.8), ("c", 2, 0.7)]
    scored = retrieve.score_pairs(pairs, lambda batch: [len(c) for _, c in batch], batch_size=2)
    assert sorted(r["score"] for r in scored.collect()) == [5.0, 5.0, 11.0]
    hits = spark.createDataFrame([(1, "p1", "child", {}), (2, "gone", "orphan", {}), (3, None, "top", {})], "query_id long, parent_id string, content string, metadata map<string,string>")
    store = spark.createDataFrame([("p1", "parent", {"a": "b"})], "chunk_id string, content string, metadata map<string,string>")
    assert {r["query_id"]: r["content"] for r in vectors.resolve_parents(hits, store).collect()} == {1: "parent", 2: "orphan", 3: "top"}


def test_variants_routes(spark):
    q = spark.createDataFrame([(1, "q", " a\n\nb \n"), (2, "r", None)], "query_id long, question string, response string")
    assert rows(retrieve.expand_queries(q)) == [(1, 0, "q"), (1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 0, "r")]
    assert [r["query"] for r in retrieve.hyde_queries(q).orderBy("query_id").collect()] == ["q\na\n\nb", "r"]
    routes = spark.createDataFrame([(1, "k", "重庆a", "重庆?"), (2, "k", "重庆a", "上海?"), (3, "k", "none", "x"), (4, "k", "b", "x")], "id int, kb_name string, file string, question string")
    files = spark.createDataFrame([("k", "重庆a"), ("k", "b")], "kb_name string, file string")
    assert rows(retrieve.validate_routes(routes, files).select("id")) == [(1,), (4,)]


def test_bm25(spark):
    corpus = spark.createDataFrame([(1, "red red cat"), (2, "a dog"), (3, "the cat and the dog"), (4, None), (5, "")], "chunk_id long, content string")
    queries = spark.createDataFrame([(7, "Red cat"), (8, "none")], "query_id long, query string")
    docs = {1: ["red", "red", "cat"], 2: ["a", "dog"], 3: "the cat and the dog".split(), 5: []}
    mean, n = sum(map(len, docs.values())) / 4, 4
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    idf = {w: np.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    want = {}
    for c, d in docs.items():
        s = sum((idf[w] if idf[w] >= 0 else floor) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in ("red", "cat") if w in d)
        if any(w in d for w in ("red", "cat")):
            want[c] = round(float(s), 6)
    assert {r["chunk_id"]: r["score"] for r in keywords.bm25_search(queries, corpus, 5).collect()} == want
    assert spark.range(1).select(keywords.cjk_bigrams(F.lit("高血压 x 治疗")).alias("b")).first()["b"] == ["高血", "血压", "治疗"]


def test_prompts(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, query string")
    hits = ranked(spark, (1, 2, "b", "two", 0.1), (1, 1, "a", "one", 0.2))
    got = {r["query_id"]: r for r in prompts.assemble_context(hits, queries, "{query}|{context}").collect()}
    assert got[1]["context"] == "\n\n片段1:\none\n\n片段2:\ntwo" and got[1]["prompt"] == "q|" + got[1]["context"] and got[2]["prompt"] == "r|"
    assert {r["context"][:3] for r in prompts.assemble_context(hits, queries, repeat_top=True).where("query_id = 1").collect()} == {"one"}
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert prompts.conversation_prompts(turns).first()["prompt"] == "user: a\nassistant: b"
    asked = spark.createDataFrame([(1, "c"), (9, "d")], "conv_id long, prompt string")
    assert {r["conv_id"]: r["prompt"] for r in prompts.conversation_prompts(turns, asked).collect()} == {1: "user: a\nassistant: b\nuser: c", 9: "user: d"}


# --- catalog ---


def test_catalog(spark):
    kb = spark.createDataFrame([("Kb", "i", "v", "m", 3)], "kb_name string, kb_info string, vs_type string, embed_model string, file_count int")
    new = spark.createDataFrame([("kB", "j", "w", "n"), ("other", "o", "p", "q")], "kb_name string, kb_info string, vs_type string, embed_model string")
    assert rows(catalog.upsert_kb(kb, new)) == [("Kb", "j", "w", "n", 3), ("other", "o", "p", "q", 0)]
    assert catalog.list_kbs(kb).count() == 1 and catalog.list_kbs(kb, 3).count() == 0 and catalog.load_kb(kb, "KB").count() == 1
    assert catalog.delete_kb(kb, spark.createDataFrame([("KB",)], "kb_name string")).count() == 0
    names = spark.createDataFrame([("ok",), ("  ",), ("../x",), ("",)], "kb_name string")
    assert rows(catalog.valid_kb_names(names)) == [("ok",)]
    files = spark.createDataFrame([("k", "A.txt", 1.0, 5, 2, 4), ("k", "b.txt", 1.0, 6, 2, 1)], "kb_name string, file_name string, file_mtime double, file_size long, docs_count int, file_version int")
    inc = spark.createDataFrame([("K", "a.TXT", 2.0, 7, 3), ("k", "c.txt", 2.0, 8, 1)], "kb_name string, file_name string, file_mtime double, file_size long, docs_count int")
    assert rows(catalog.upsert_files(files, inc)) == [("k", "A.txt", 2.0, 7, 3, 5), ("k", "b.txt", 1.0, 6, 2, 1), ("k", "c.txt", 2.0, 8, 1, 1)]
    docs = spark.createDataFrame([("k", "a.txt", {"p": "1"}), ("k", "b.txt", {"p": "2"})], "kb_name string, file_name string, metadata map<string,string>")
    assert catalog.list_docs(docs, "K", "B.txt").count() == 1 and catalog.list_docs(docs, "k", metadata={"p": 2}).count() == 1 and catalog.list_docs(docs, "k", "_.txt", wildcards=True).count() == 2
    left, kept = catalog.delete_files(files, docs, inc)
    assert rows(left.select("file_name")) == [("b.txt",)] == rows(kept.select("file_name"))
    for drop, want in ((False, [("Kb", 0)]), (True, [])):
        bases, f, d = catalog.clear_kb(kb.withColumn("kb_name", F.lit("Kb")), files.withColumn("kb_name", F.lit("KB")), docs, spark.createDataFrame([("kb",)], "kb_name string"), drop)
        assert rows(bases.select("kb_name", "file_count")) == want and f.count() == 0 and d.count() == 2
    plan = catalog.plan_uploads(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "file_name string, file_size long"), spark.createDataFrame([("a", 1), ("b", 9)], "file_name string, file_size long"))
    assert rows(plan.select("file_name", "status")) == [("a", 404), ("b", 200), ("c", 200)]


# --- graph ---


def test_graph(spark, tmp_path):
    given = [
        {"name": "flu", "desc": 'a "q"\nb', "symptom": ["cough", "fever"], "cure_department": ["inner"], "drug_detail": ["Maker(pill)", "plain"], "acompany": ["cold", "absent"]},
        {"name": "cold", "cure_department": ["inner", "lungs"], "common_drug": ["pill"], "cure_way": ["rest", "tea"]},
        {"name": "flu", "desc": "second", "cure_department": ["a", "b", "c"]},
        {"name": "rare", "cure_department": []},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, given)))
    records = io.read_graph_source(spark, str(tmp_path / "in.json"))
    nodes, edges = graph.graph_nodes(records), graph.graph_edges(records)
    by = {(r["node_type"], r["name"]): r for r in nodes.collect()}
    assert len(by) == nodes.count() and by["disease", "flu"]["props"]["desc"] == 'a \\"q\\"\\nb' and by["disease", "cold"]["props"]["cure_way"] == "rest、tea"
    assert {("producer", "Maker"), ("drug", "pill"), ("producer", "plain"), ("drug", "plain"), ("department", "c")} <= set(by)
    name = {r["vid"]: r["name"] for r in nodes.collect()}
    found = {(r["rel"], name.get(r["src"]), name.get(r["dst"])) for r in edges.collect()}
    assert found == {
        ("has_symptom", "flu", "cough"), ("has_symptom", "flu", "fever"), ("acompany_with", "flu", "cold"), ("acompany_with", "flu", None), ("cure_department", "flu", "inner"),
        ("belongs_to", "lungs", "inner"), ("cure_department", "cold", "lungs"), ("common_drug", "cold", "pill"), ("drugs_of", "Maker", "pill"), ("drugs_of", "plain", "plain"),
    }
    kept, gone = graph.validate_edges(edges, nodes)
    assert kept.count() == 9 and [r["rel"] for r in gone.collect()] == ["acompany_with"]
    props, patterns = graph.graph_schema(nodes, kept)
    assert props.where("node_type = 'disease'").count() == 8 and ("has_symptom", "disease", "symptom", 2) in rows(patterns)
    assert graph.graph_lookup(nodes, "disease", "cold", "cure_way").first()["value"] == "rest、tea"
    assert rows(graph.graph_neighbors(nodes.where("name = 'flu'"), nodes, kept, "has_symptom")) == [("flu", "has_symptom", "symptom", "cough"), ("flu", "has_symptom", "symptom", "fever")]


# --- layout ---


def test_headings_and_paths(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["intro", "# A", "a1", "### C", "c1", "c2", "# B", "", "b1", "## empty", "# D"])], "file string, line_no int, text string")
    got = [(r["knowledge_path"], r["text"]) for r in layout.knowledge_paths(lines).orderBy("section").collect()]
    assert got == [("", "intro"), ("A", "a1"), ("A-C", "c1\nc2"), ("B", "b1")]
    sized = spark.createDataFrame([("1.2 x", 20.0), ("1.2.3 x", 20.0), ("t", 30.0), ("u", 16.0), ("v", 12.0), ("w", 5.0)], "text string, font_size double")
    assert [r["text"] for r in layout.tag_headings(sized).collect()] == ["## 1.2 x", "### 1.2.3 x", "# t", "#### u", "##### v", "w"]
    policy = spark.createDataFrame([("一、x", 9.0), ("（二）y", 9.0), ("z", 30.0)], "text string, font_size double")
    assert [r["text"] for r in layout.tag_headings(policy, "policy").collect()] == ["# 一、x", "## （二）y", "# z"]


def test_slides(spark):
    parts = [("Title", "t" * 70), ("PageBreak", None), ("NarrativeText", "n" * 66), ("PageBreak", None), ("Table", "x"), ("PageBreak", None), ("NarrativeText", "m" * 70)]
    df = spark.createDataFrame([("f", i, c, t, "<t>" + "h" * 100) for i, (c, t) in enumerate(parts)], "file string, elem_no int, category string, text string, text_as_html string")
    got = {r["slide"]: r["text"] for r in layout.assemble_slides(df).collect()}
    assert len("NarrativeText: " + "n" * 66) == 81 and set(got) == {1, 2} or got == {1: "NarrativeText: " + "n" * 66, 2: "<t>" + "h" * 100}
    shapes = spark.createDataFrame([("f", 1, 1, int(2.5 * 914400), 5), ("f", 1, 2, 2 * 914400, 0), ("f", 1, 3, -5, 9), ("f", 1, 4, -5, 0), ("f", 1, 5, int(1.5 * 914400), 1)], "file string, slide int, shape_no int, top long, left long")
    assert [r["shape_no"] for r in layout.slide_order(shapes).orderBy("place").collect()] == [4, 1, 2, 5]


def test_tables(spark):
    cell = lambda t, r, *xs: [("f", t, r, c, x) for c, x in enumerate(xs)]
    given = cell(0, 0, "k", "A", "B") + cell(0, 1, "", "lost", "lost") + cell(0, 2, "x", "1", "2") + cell(0, 3, "", "", "+3") + cell(1, 0, "k", "C", "D") + cell(1, 1, "", "", "+4") + cell(1, 2, "y", "5\n6", "7")
    df = spark.createDataFrame(given, "file string, table_no int, row_no int, col_no int, text string")
    assert [(r["row_id"], r["text"]) for r in layout.table_rows_to_text(df).orderBy("row_id").collect()] == [(1, "A: 1\nB: 2+3+4"), (2, "C: 5\n6\nD: 7")]
    assert {r["table_no"]: r["markdown"] for r in layout.markdown_table(df).collect()}[1] == "| k | C | D |\n| --- | --- | --- |\n|  |  | +4 |\n| y | 5<br>6 | 7 |"


def test_pages(spark):
    ocr = spark.createDataFrame([("f", 1, 0, "short", 0.7), ("f", 1, 1, "x" * 31, 0.9), ("f", 1, 2, "长" + "x" * 31, 0.9), ("f", 1, 3, "low", 0.6)], "file string, page int, seq int, text string, score double")
    assert layout.ocr_text(ocr).first()["text"] == "\nshort\n长" + "x" * 31
    pages = spark.createDataFrame([("a.PDF", 1, "产品版本号 发布日期"), ("x〔2021〕3号.pdf", 1, "t"), ("c.pdf", 1, "t"), ("c.pdf", 2, "明细表"), ("d.pdf", 3, "明细表"), ("e.txt", 1, "产品版本号 发布日期")], "file string, page int, text string")
    assert {r["file"]: r["class"] for r in layout.classify_documents(pages).collect()} == {"a.PDF": "handbook", "x〔2021〕3号.pdf": "policy", "c.pdf": "table", "d.pdf": "plain", "e.txt": "plain"}
    words = spark.createDataFrame([("f", 1, 0, "r1", 400.0, 1.0, 600.0), ("f", 1, 1, "l2", 50.0, 2.0, 600.0), ("f", 1, 2, "l1", 10.0, 4.0, 600.0), ("f", 1, 3, "l3", 10.0, 9.0, 600.0)], "file string, page int, word_no int, text string, x0 double, top double, page_width double")
    assert layout.reflow_columns(words).first()["text"] == "l1 l2\nl3\n\nr1"
    assert {(r["page"], r["total_pages"]) for r in layout.pages_to_documents(pages.where("file = 'c.pdf'")).withColumn("page", F.lit(0)).collect()} == {(0, 2)}
    boxes = words.withColumn("x1", F.col("x0") + 100)
    empty = spark.createDataFrame([("f", 1), ("f", 2)], "file string, page int")
    assert rows(layout.page_columns(empty, boxes, share=0.2)) == [("f", 1, 2), ("f", 2, 1)]


# --- evaluation, models, files, streams ---


def test_metrics(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "question_id int, rank int, verdict int")
    assert rows(evaluate.context_precision(v)) == [(1, pytest.approx((1 + 2 / 3) / 2)), (2, 0.0)]
    g = spark.createDataFrame([(1, 0.5, False), (1, 1.0, False), (2, 0.9, True)], "question_id int, cosine double, noncommittal boolean")
    assert rows(evaluate.answer_relevancy(g)) == [(1, 0.75), (2, 0.0)]
    assert evaluate.eval_metrics(evaluate.context_precision(v), evaluate.answer_relevancy(g)).first()["answer_relevancy"] == 0.375
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (1, "c", 0.4)], "question_id int, chunk_id string, score double")
    assert rows(evaluate.low_score_report(hits)) == [(1, 3, 1, pytest.approx(1 / 3))]
    assert [r["chunk_id"] for r in evaluate.sort_by_similarity(hits).orderBy("place").collect()] == ["a", "c", "b"]


def test_models(spark):
    def make():
        def model(batch):
            if any("bad" in t for t in batch):
                raise ValueError("no")
            return [t.upper() for t in batch]

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string")
    assert rows(models.generate(df, make)) == [("a", "A", None), ("bad", None, "ValueError: no"), ("c", "C", None)]
    vec = models.embed(df.withColumnRenamed("prompt", "content"), lambda: lambda b: [[len(t), 0.0] for t in b], prefix="x").first()["embedding"]
    assert vec == [1.0, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "deep" / "b.CSV").write_bytes(b"two\xff")
    assert rows(io.list_corpus(spark, str(tmp_path / "in")).select("file", "file_size")) == [("a.txt", 3), ("b.CSV", 4)]
    models.register_loader(".csv", lambda data: [data.decode("utf-8")])
    got = {r["path"].rsplit("/", 1)[1]: r for r in models.load_files(io.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got["a.txt"]["texts"] == ["one"] and got["b.CSV"]["texts"] is None and "UnicodeDecodeError" in got["b.CSV"]["error"]
    models.LOADERS.clear()
    (tmp_path / "q.json").write_text('[{"id": 2, "question": "b"},\n {"id": 1, "question": "a"}]')
    questions = io.read_questions(spark, str(tmp_path / "q.json"))
    assert [r["id"] for r in evaluate.select_questions(questions).collect()] == [1, 2] and evaluate.select_questions(questions, [2]).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    schema = "kb_name string, file string, text string, arrival int"
    first = spark.createDataFrame([("k", f"f{i}", f"text {i}. " * 30, 0) for i in range(8)] + [("k", "f0", "later", 1), ("k", None, "bad", 0), ("k", "x", None, 0)], schema)
    again = spark.createDataFrame([("k", "f1", "replaced", 0)], schema)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = IndexStream(spark, str(tmp_path / "index"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    index.run(source()).awaitTermination()
    again.write.mode("append").parquet(str(tmp_path / "in"))
    query = index.run(source())
    query.awaitTermination()
    want = chunks.chunk_corpus(last_arrivals(first.where("file IS NOT NULL AND text IS NOT NULL")).where("file <> 'f1'").unionByName(again).select("kb_name", "file", "text"))
    key = ("file", "seq", "chunk_id", "content")
    assert rows(index.chunks(1).select(*key)) == rows(want.select(*key))
    assert spark.read.parquet(str(tmp_path / "index" / "rejects" / "batch=0")).count() == 2


def test_latency_stream(spark, tmp_path):
    spans = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS start_ts, 'search' AS stage, CAST(id AS double) AS elapsed FROM range(6)")
    spans.write.parquet(str(tmp_path / "in"))
    query = latency_stream(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("lat").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("lat")) == rows(evaluate.trace_windows(spans))


def test_unknown_splitter_cuts_sentences(spark):
    df = spark.createDataFrame([("k", "a.txt", "甲。乙！丙")], "kb_name string, file string, text string")
    assert [r["content"] for r in chunks.chunk_corpus(df, "no such name", least=None).orderBy("seq").collect()] == ["甲。", "乙！", "丙"]
    assert [r["content"] for r in chunks.split_texts(df, splitter="sentences", size=2).orderBy("seq").collect()] == ["甲。", "乙！", "丙"]


def test_bases_that_share_a_file_name(spark, tmp_path):
    """Upserts, deletes, arrivals, merging and neighbours keep the bases apart."""
    schema = "kb_name string, file string, source string, seq int, content string"
    store = spark.createDataFrame([("kb1", "a.txt", "x", 0, "old"), ("kb2", "a.txt", "x", 0, "other")], schema)
    new = spark.createDataFrame([("kb1", "a.txt", "x", 0, "new")], schema)
    assert {(r["kb_name"], r["content"]) for r in chunks.upsert_chunks(store, new).collect()} == {("kb1", "new"), ("kb2", "other")}
    assert {r["kb_name"] for r in chunks.delete_chunks(store, new).collect()} == {"kb2"}
    assert {(r["kb_name"], r["content"]) for r in chunks.merge_small_chunks(store).collect()} == {("kb1", "old"), ("kb2", "other")}
    assert {(r["kb_name"], r["context"]) for r in chunks.neighbor_context(store).collect()} == {("kb1", "old"), ("kb2", "other")}
    batch = spark.createDataFrame([(k, "a.txt", f"{k} text", i) for i, k in enumerate(("kb1", "kb2", "kb1"))], "kb_name string, file string, text string, arrival int")
    assert sorted((r["kb_name"], r["arrival"]) for r in last_arrivals(batch).collect()) == [("kb1", 2), ("kb2", 1)]
    index = IndexStream(spark, str(tmp_path / "index"), buckets=3)
    index.apply(batch, 0)
    index.apply(batch.where("kb_name = 'kb1'").withColumn("text", F.lit("later")), 1)
    index.apply(batch.where("kb_name = 'kb2'").withColumn("text", F.lit("")), 2)
    assert {(r["kb_name"], r["content"]) for r in index.chunks(1).collect()} == {("kb1", "later"), ("kb2", "kb2 text")}
    assert {(r["kb_name"], r["content"]) for r in index.chunks(2).collect()} == {("kb1", "later")}


def test_search_with_spread_query_blocks(spark):
    """Query blocks over the limit are copied to parts of the corpus in place of a broadcast."""
    rows = spark.createDataFrame([(i, [float((i * 7 + k) % 11) for k in range(4)]) for i in range(200)], "id long, embedding array<float>")
    q, c = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "chunk_id")
    want = sorted(map(tuple, vectors.vector_search(q, c, 5).collect()))
    assert sorted(map(tuple, vectors.vector_search(q, c, 5, limit_bytes=0, block=3).collect())) == want and len(want) == 50


def test_percentiles_of_a_heavy_stage(spark):
    import numpy as np

    values = [float(i * 7919 % 30_011) ** 1.5 for i in range(30_000)]
    df = spark.createDataFrame([("big", x) for x in values] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)], "stage string, elapsed double")
    got = {r["stage"]: (r["spans"], r["median"], r["p95"]) for r in evaluate.trace_latency(df).collect()}
    assert got["big"] == pytest.approx((30_000, np.percentile(values, 50), np.percentile(values, 95)))
    assert got["one"] == (1, 3.0, 3.0) and got["two"] == pytest.approx((2, 1.5, 1.95)) and got["none"] == (1, None, None)
