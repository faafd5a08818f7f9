"""Queries of the stored search indexes, held against the SQL of the searches without one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import keyword_index, vector_index
from kbspark.plans.base import SQL, query
from kbspark.plans.retrieval import BM25
from kbspark.sources.io import shared_folder, table


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str, metric: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all vectors, and every row whose id is divisible by 20 as a query."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build_vector_index(rows.withColumnRenamed("vec_id", "chunk_id"), _folder(spark, "vectors"), metric)
    return index, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def _exact(spark: SparkSession, sf_dir: str, metric: str, k: int) -> DataFrame:
    index, queries = _vectors(spark, sf_dir, metric)
    return index.search(queries, k, exclude_self=True)


@query(SQL["vector_search"])
def vector_index_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, "cosine", 25)


@query(SQL["vector_search_ip"])
def vector_index_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, "ip", 10)


@query(SQL["vector_search_l2"])
def vector_index_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, "l2", 10)


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of as many cells as a sample of the queries needs for a recall of 0.95, against the exact one."""
    index, queries = _vectors(spark, sf_dir, "cosine")
    probes = index.probes_for(queries, 10, 0.95, exclude_self=True)
    return vector_index.recall_of(index.search(queries, 10, probes, exact=False, exclude_self=True), index.search(queries, 10, probes, exclude_self=True))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def keyword_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index = keyword_index.build_keyword_index(docs, _folder(spark, "keywords"))
    return index.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10)
