"""Prompt texts from ranked contexts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.columns import in_order, joined

#: Fixed value: how a context piece is introduced.
PIECE = "\n\n片段"


def assemble_context(hits: DataFrame, queries: DataFrame, template: str = "{query}\n{context}", repeat_top: bool = False) -> DataFrame:
    """(query_id, context, prompt): numbered pieces in rank order, filled into the template; a query without hits gets an empty context."""
    piece = F.concat(F.lit(PIECE), F.col("rank").cast("string"), F.lit(":\n"), F.col("content"))
    texts = hits.groupBy("query_id").agg(joined(in_order("rank", piece), "").alias("context"), F.min_by("content", "rank").alias("top"))
    if repeat_top:
        texts = texts.withColumn("context", F.concat("top", "context"))
    filled = queries.join(texts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.replace(F.replace(F.lit(template), F.lit("{query}"), F.col("query")), F.lit("{context}"), F.col("context"))
    return filled.select("query_id", "context", prompt.alias("prompt"))


def conversation_prompts(turns: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """(conv_id, prompt): history as `role: text` lines in order of turn, then the user's prompt (conv_id, prompt) if given."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    history = turns.groupBy("conv_id").agg(joined(F.collect_list(F.struct("turn", line.alias("text"))), "\n").alias("history"))
    if prompts is None:
        return history.withColumnRenamed("history", "prompt")
    return prompts.join(history, "conv_id", "left").select("conv_id", F.concat_ws("\n", "history", F.concat(F.lit("user: "), F.col("prompt"))).alias("prompt"))


def wrap_prompts(prompts: DataFrame, templates: DataFrame, prompt: str = "prompt", model: str = "model") -> DataFrame:
    """The prompt inside its model's template (model, template with {question}); unknown models leave it. Templates are a small registry."""
    filled = F.replace("template", F.lit("{question}"), F.col(prompt))
    return prompts.join(F.broadcast(templates), model, "left").withColumn(prompt, F.coalesce(filled, F.col(prompt))).drop("template")
