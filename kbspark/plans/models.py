"""Queries of the callers' side: files read back through loaders, and models that are plain functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import graph, models, retrieve
from kbspark.plans.base import SQL, query
from kbspark.plans.catalog import records
from kbspark.plans.retrieval import BM25, keyword_hits
from kbspark.sources import io
from kbspark.sources.io import shared_folder, table


def letters(texts: list[str]) -> list[list[float]]:
    """An embedder: how long a text is, and how many of two letters it has."""
    return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


def first_word(texts: list[str]) -> list[str]:
    """A text model that fails on a bar."""
    if any("|" in t for t in texts):
        raise ValueError("bar")
    return [f"{len(t)}:{t.split(' ')[0]}" for t in texts]


@query("""SELECT doc_id, length(text) + 3.0::DOUBLE AS size, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a FROM documents""")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: letters, "text", prefix="q: ", normalize=False)
    return rows.select("doc_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("size", "e", "a"))])


@query("""SELECT doc_id, CASE WHEN NOT contains(text, '|') THEN length(text) || ':' || string_split(text, ' ')[1] END AS answer, CASE WHEN contains(text, '|') THEN 'ValueError: bar' END AS error FROM documents""")
def generate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.generate(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: first_word, "text").select("doc_id", "answer", "error")


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """A reranker: the shorter length by the longer."""
    return [min(len(a), len(b)) / max(len(a), len(b), 1) for a, b in pairs]


@query(f"""WITH {BM25} SELECT query_id, chunk_id, round(least(length(q.text), length(d.text)) / greatest(length(q.text), length(d.text), 1), 9) AS score
FROM bm25 JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_id""")
def score_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    pairs = keyword_hits(spark, sf_dir).drop("score").join(queries, "query_id").join(texts, "chunk_id")
    return retrieve.score_pairs(pairs, likeness).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def _written(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("""SELECT lang, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sum(length(text) + 1)::BIGINT AS chars, 0::BIGINT AS failed FROM documents GROUP BY lang""")
def load_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as files by language, listed, and loaded by the plain loader."""
    folder = _written(spark, "files")
    table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 2000).text(folder)
    lang = F.regexp_extract("path", "/lang=([^/]+)/", 1)
    own = F.col("file").startswith("part-")
    sizes = io.list_corpus(spark, folder).where(own).groupBy(lang.alias("lang")).agg(F.sum("file_size").alias("bytes"))
    files = io.read_files(spark, folder).where(F.contains("path", F.lit("/part-")))
    loaded = models.load_files(files).groupBy(lang.alias("lang")).agg(F.sum(F.aggregate(F.coalesce("texts", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, t: n + F.char_length(t))).alias("chars"), F.count("error").alias("failed"))
    return sizes.join(loaded, "lang")


@query("SELECT doc_id::INT AS id, text AS question FROM documents")
def read_question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as questions in files of one JSON array each, a hundred of them at most."""
    folder = _written(spark, "questions")
    rows = table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").cast("int").alias("id"), F.col("text").alias("question")).alias("q"), F.floor(F.col("doc_id") / 100).alias("file"))
    rows.groupBy("file").agg(F.to_json(F.collect_list("q")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return io.read_questions(spark, folder)


@query(SQL["graph_edges"])
def read_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of graph records that were written as JSON lines and read back."""
    folder = _written(spark, "graph")
    records(spark, sf_dir).drop("line_no").write.json(folder)
    return graph.graph_edges(io.read_graph_source(spark, folder))
