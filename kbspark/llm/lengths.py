"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Documents are aggregated by their number of tokens. For every length L that occurs, sums over the
lengths from L on give the documents and tokens at or over L, and with the documents under L the
tokens that remain if each document is cut to L. Totals, quantiles and truncated totals for every
context limit follow from these rows.

Suffix sums run in two levels: within blocks of BLOCK lengths, and over the block totals, so no
task gets more than BLOCK lengths or one row per block.

Defined results: null and empty texts have length 0 (plus `end_tokens`); repeated rows count each
time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import stored
from kbspark.llm.tokens import default_path, hugging_face

BLOCK = 1024
VOCABULARY = "byte_bpe_50k.json"


def encoded_length(vocabulary: str, end_tokens: int = 0):
    """A column function: number of tokens of a text."""

    @F.pandas_udf("long")
    def length(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = hugging_face(vocabulary, True)
        for batch in texts:
            yield pd.Series([len(ids) + end_tokens for ids in encoder.encode([t or "" for t in batch])], dtype="int64")

    return length


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None, end_tokens: int = 0) -> DataFrame:
    """(n_tokens, n_docs): exact, by partial aggregation."""
    length = encoded_length(vocabulary or default_path(VOCABULARY), end_tokens)
    return docs.select(length(F.col(text)).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per occurring length L: documents and tokens with length >= L and < L, the total cut to L, and the rank range.

    docs_from, tokens_from: lengths >= L. tokens_cut_to: sum of min(length, L).
    first_rank, last_rank: places of these documents in ascending order of length, from 1.
    """
    rows = stored(histogram, "lengths").withColumns({"blk": F.floor(F.col("n_tokens") / block), "n_toks": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("blk").agg(F.sum("n_docs").alias("d"), F.sum("n_toks").alias("t"))
    later, before = Window.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "blk", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{n}") for c in "dt" for n, w in (("later", later), ("before", before))]
    )
    own = Window.partitionBy("blk").orderBy(F.desc("n_tokens"))
    up = Window.partitionBy("blk").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.join(blocks, "blk").select(
        "n_tokens", "n_docs",
        (F.col("d_later") + F.sum("n_docs").over(own)).alias("docs_from"),
        (F.col("t_later") + F.sum("n_toks").over(own)).alias("tokens_from"),
        (F.col("d_before") + F.coalesce(F.sum("n_docs").over(up), F.lit(0))).alias("docs_under"),
        (F.col("t_before") + F.coalesce(F.sum("n_toks").over(up), F.lit(0))).alias("tokens_under"),
    )
    return sums.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", "docs_under", "tokens_under",
        (F.col("tokens_under") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_cut_to"),
        (F.col("docs_under") + 1).alias("first_rank"), (F.col("docs_under") + F.col("n_docs")).alias("last_rank"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left and documents cut for any context limits, occurring lengths or not."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the smallest occurring length over the limit has all that is needed
    over = sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(
        F.min_by(F.struct("docs_from", "tokens_under"), "n_tokens").alias("s")
    )
    total = sums.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("all_tokens"))
    return wanted.join(over, "context_limit", "left").join(F.broadcast(total)).select(
        "context_limit",
        F.coalesce(F.col("s.tokens_under") + F.col("s.docs_from") * F.col("context_limit"), F.col("all_tokens")).alias("tokens_kept"),
        F.coalesce(F.col("s.docs_from"), F.lit(0)).alias("docs_cut"),
    )


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles of the lengths."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    total = sums.agg(F.max("last_rank").alias("docs"))
    ranks = wanted.join(F.broadcast(total)).select("share", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("docs"))).alias("rank"))
    return sums.join(F.broadcast(ranks), F.col("rank").between(F.col("first_rank"), F.col("last_rank"))).select("share", "n_tokens")
