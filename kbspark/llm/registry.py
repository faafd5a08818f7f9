"""The subpackage's queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bitpack, bpe, conversations, divergence, lengths, line_dedup, media, neardup, packing, quality, substrings, toxicity, warc
from kbspark.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op3_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bpe.*")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), into="q")
    return scored.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair_report(conversations.repair_conversations(damaged, there="there"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_media_chunks, op3_bit_packing, op4_best_fit_packing, op5_token_counts, op6_byte_bpe, op7_warc, op8_minhash, op9_toxicity, op10_quality, op11_divergence, op12_conversations, op13_substrings)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL.format(documents="documents") + "SELECT doc_id, text, n_lines, n_removed FROM t",
        "op7_warc": warc.SQL.format(pages="pages"),
        "op11_divergence": divergence.SQL.format(documents="documents"),
        "op12_conversations": conversations.SQL.format(conversations="conversations"),
        "op13_substrings": substrings.SQL.format(documents="documents"),
        "op8_minhash": neardup.SQL.format(documents="documents"),
    }
