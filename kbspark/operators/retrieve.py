"""Ranked lists: query variants, collection, fusion, deduplication, reranking, context filter.

Lists are in long form: query_id, list_no, list_id, rank (from 1), chunk_id, content, score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_queries(queries: DataFrame, response: str = "response", question: str = "question", query_id: str = "query_id") -> DataFrame:
    """(query_id, variant, query): the question as variant 0, then each line of the trimmed response, blank lines too."""
    lines = F.split(F.regexp_replace(response, r"(?U)^\s+|\s+$", ""), "\n", -1)
    return queries.select(query_id, F.posexplode(F.concat(F.array(question), F.coalesce(lines, F.array().cast("array<string>")))).alias("variant", "query"))


def hyde_queries(queries: DataFrame, response: str = "response", question: str = "question") -> DataFrame:
    """Questions with the trimmed response as a second line; no response leaves them."""
    trimmed = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    return queries.withColumn("query", F.when(trimmed.isNotNull(), F.concat(question, F.lit("\n"), trimmed)).otherwise(F.col(question)))


def collect_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """Union of (query_id, rank, chunk_id, content, ..) lists, numbered in the order given."""
    numbered = [df.withColumns({"list_no": F.lit(i), "list_id": F.lit(name)}) for i, (name, df) in enumerate(lists.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def rrf_fuse(lists: DataFrame, k: int | None = None, constant: int = 60, weights: dict[int, float] | None = None, content: str = "content") -> DataFrame:
    """Reciprocal rank fusion by content: (query_id, content, score, list_no, first_rank, chunk_id, rank).

    score = sum of weight / (rank + constant); repeats in a list add up; ties by first appearance,
    whose chunk_id stays. Contributions are added in a fixed order, so partitioning never shows.
    Groups are keyed by a hash of the content, not by the text.
    """
    weight = F.lit(1.0)
    for number, w in (weights or {}).items():
        weight = F.when(F.col("list_no") == number, F.lit(float(w))).otherwise(weight)
    part = lists.select("query_id", F.sha2(content, 256).alias("__key"), F.col(content).alias("content"), "list_no", "rank", "chunk_id", (weight / (F.col("rank") + constant)).alias("__w"))
    fused = part.groupBy("query_id", "__key").agg(
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank", "__w"))), lambda x: x["__w"]), F.lit(0.0), lambda a, x: a + x).alias("score"),
        F.min(F.struct("list_no", "rank", "chunk_id", "content")).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "list_no", "first_rank")
    out = fused.select("query_id", F.col("first.content").alias("content"), "score", F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("first_rank"), F.col("first.chunk_id").alias("chunk_id"))
    out = out.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def dedupe_hits(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """First occurrence of each id in a query's list; hits without an id count as one."""
    first = Window.partitionBy("query_id", key).orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def token_overlap(query: Column, content: Column) -> Column:
    """A deterministic scorer: share of the query's distinct words that the content has."""
    words = [F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")) for c in (query, content)]
    return F.coalesce(F.size(F.array_intersect(*words)) / F.nullif(F.size(words[0]), F.lit(0)), F.lit(0.0))


def score_pairs(pairs: DataFrame, compute_score: Callable[[list[tuple[str, str]]], list[float]], query: str = "query", content: str = "content", batch_size: int = 16) -> DataFrame:
    """Scores of a caller's model, in batches; the function is made once per Python worker by the caller's closure."""

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, contents in columns:
            both = list(zip(queries, contents, strict=True))
            yield pd.Series([float(x) for at in range(0, len(both), batch_size) for x in compute_score(both[at : at + batch_size])], dtype="float64")

    return pairs.withColumn("score", score(query, content))


def rerank(pairs: DataFrame, k: int = 5, score: Column | None = None, sigmoid: bool = False) -> DataFrame:
    """Best k of each query by the new score, ties by input rank: keeps corpus_id (input position from 0) and the score before."""
    new = token_overlap(F.col("query"), F.col("content")) if score is None else score
    if sigmoid:
        new = 1 / (1 + F.exp(-new))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    scored = pairs.withColumns({"corpus_id": F.col("rank") - 1, "search_score": F.col("score") if "score" in pairs.columns else F.lit(None).cast("double"), "score": new})
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def context_filter(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits with score > threshold; a query without any keeps its best one, the first on ties."""
    query = Window.partitionBy("query_id")
    marked = hits.withColumns({"__over": F.count_if(F.col("score") > threshold).over(query), "__n": F.row_number().over(query.orderBy(F.desc("score"), "rank"))})
    return marked.where((F.col("score") > threshold) | ((F.col("__over") == 0) & (F.col("__n") == 1))).drop("__over", "__n")


def validate_routes(routes: DataFrame, files: DataFrame, guards: tuple[str, ...] = ("重庆",)) -> DataFrame:
    """Routes (question, kb_name, file) whose file is in the knowledge base; a guard word in the file must be in the question."""
    kept = routes.join(files.select("kb_name", "file").distinct(), ["kb_name", "file"], "left_semi")
    for word in guards:
        kept = kept.where(~F.contains("file", F.lit(word)) | F.contains("question", F.lit(word)))
    return kept


def hit_report(hits: DataFrame) -> DataFrame:
    """File name, context, and both scores of every hit."""
    return hits.select("query_id", "rank", F.try_element_at("metadata", F.lit("filename")).alias("filename"), F.col("content").alias("context"), F.col("search_score"), F.col("score").alias("similarity_score"))
