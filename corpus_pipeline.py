"""From raw documents to packed sequences: each stage takes what the one before it kept.

Quality rules, toxicity, line dedup and near-dedup return the columns of documents; packing
returns a row per piece. A document that loses every line with a word to line dedup holds nothing
that is not in an earlier document, and goes.

Defined results: null and empty texts fail the quality rules; repeated rows are judged alike, and
one row of each near-duplicate group (the smallest id) stays; extra columns, of any names, are
carried along; an empty table gives no rows. The stages' operators state the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import line_dedup, neardup, packing, quality, toxicity
from kbspark.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands; a null text does not."""
    return quality.keep_quality(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the grammar is learned from the labelled documents that came this far."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; a document that lost lines and has no word left goes. n_chars follows a text that changed."""
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word shingle sets that are 0.8 alike or more."""
    return neardup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document, with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", without_near_duplicates),
    ("best_fit_packing", packed),
]

#: Compression ratios, learned grammars and signatures have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
