"""Registration of queries, and the input tables they derive from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name; sql: the same in DuckDB."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kb_name, file, text."""
    file = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kb_name"), file.alias("file"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kb_name, file, seq, content: the lines of every document."""
    return corpus(spark, sf_dir).select("doc_id", "kb_name", "file", F.posexplode(F.split("text", "\n", -1)).alias("seq", "content"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, pos, word: the blank-delimited words of every document."""
    return corpus(spark, sf_dir).select("doc_id", "file", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))


CORPUS = "c AS (SELECT doc_id, lang AS kb_name, source || '/doc_' || doc_id || '.txt' AS file, text FROM documents)"
LINES = f"""{CORPUS}, p AS (SELECT doc_id, kb_name, file, string_split(text, chr(10)) AS parts FROM c),
l AS (SELECT doc_id, kb_name, file, unnest(range(len(parts))) AS seq, unnest(parts) AS content FROM p)"""
WORDS = f"""{CORPUS}, p AS (SELECT doc_id, file, string_split(text, ' ') AS parts FROM c),
w AS (SELECT doc_id, file, unnest(range(len(parts))) AS pos, unnest(parts) AS word FROM p)"""
