"""Evaluation sets and metrics over verdict rows, and stage latencies of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.io import stored


def select_questions(questions: DataFrame, ids: list | DataFrame | None = None, key: str = "id") -> DataFrame:
    """Questions of these ids, a list or a table of them (none given: all), sorted by id."""
    if isinstance(ids, DataFrame):
        questions = questions.join(ids.select(key).distinct(), key, "left_semi")
    elif ids:
        questions = questions.where(F.col(key).isin(ids))
    return questions.orderBy(key)


def low_score_report(hits: DataFrame, limit: float = 0.4) -> DataFrame:
    """Per question: hits, those under the limit (a missing score counts as 0), and their share."""
    low = F.coalesce("score", F.lit(0.0)) < limit
    return hits.groupBy("question_id").agg(F.count("*").alias("hits"), F.count_if(low).alias("low_hits"), F.avg(F.when(low, 1.0).otherwise(0.0)).alias("low_share"))


def sort_by_similarity(hits: DataFrame) -> DataFrame:
    """Hits with their place by score, best first, a missing one last as 0."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "chunk_id")
    return hits.withColumn("place", F.row_number().over(order))


def build_eval_set(questions: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per question with its answer and its contexts in rank order; none gives an empty list."""
    lists = contexts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("context"))
    return questions.join(answers, "question_id", "left").join(lists, "question_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """(question_id, context_precision) of verdicts (question_id, rank, verdict 0/1): mean precision at the ranks that hit, 0 without hits."""
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumns({"hits": F.sum("verdict").over(upto), "k": F.count("*").over(upto)})
    return at.groupBy("question_id").agg(F.coalesce(F.sum(F.col("hits") / F.col("k") * F.col("verdict")) / F.nullif(F.sum("verdict"), F.lit(0)), F.lit(0.0)).alias("context_precision"))


def share_of(verdicts: DataFrame, name: str) -> DataFrame:
    """(question_id, name): supported claims of all (faithfulness), attributed sentences of all (context recall)."""
    return verdicts.groupBy("question_id").agg(F.avg(F.col("verdict").cast("double")).alias(name))


def answer_relevancy(generated: DataFrame) -> DataFrame:
    """(question_id, answer_relevancy) of (question_id, cosine, noncommittal): mean cosine, 0 if any answer was noncommittal."""
    return generated.groupBy("question_id").agg(F.when(F.max(F.col("noncommittal").cast("int")) == 1, 0.0).otherwise(F.avg("cosine")).alias("answer_relevancy"))


def eval_metrics(*metrics: DataFrame) -> DataFrame:
    """Mean of every metric over the questions, nulls left out."""
    joined = metrics[0]
    for m in metrics[1:]:
        joined = joined.join(m, "question_id", "full")
    return joined.agg(*[F.avg(c).alias(c) for c in joined.columns if c != "question_id"])


#: Half the width, in ranks, of the range around a quantile whose values are counted exactly, and the accuracy of its ends.
REACH, ACCURACY = 1e-4, 100_000


def trace_latency(spans: DataFrame) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum of elapsed per stage.

    Percentiles are exact and interpolated: a sketch gives a narrow range around each, the values below
    it are counted, and those in it are ranked. So no task holds all values of a stage.
    """
    wanted = {"median": 0.5, "p95": 0.95}
    ends = F.array(*[F.lit(x) for q in wanted.values() for x in (max(q - REACH, 0.0), min(q + REACH, 1.0))])
    whole = spans.groupBy("stage").agg(
        F.count("*").alias("spans"), F.count("elapsed").alias("n"), F.avg("elapsed").alias("mean"), F.max("elapsed").alias("longest"), F.percentile_approx("elapsed", ends, ACCURACY).alias("ends")
    )
    many = F.col("n") * REACH >= 2  # a stage of fewer values is ranked as a whole
    ranges = whole.select("stage", F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.when(many, F.col("ends")[2 * k]).alias("low"), F.when(many, F.col("ends")[2 * k + 1]).otherwise(F.col("longest")).alias("high"), ((F.col("n") - 1) * share).alias("at")) for k, (name, share) in enumerate(wanted.items())
    ])).alias("r")).select("stage", "r.*")
    stages = ranges.count()
    wide = ranges.withColumnRenamed("stage", "of_stage")
    near = spans.where("elapsed IS NOT NULL").join(F.broadcast(wide) if stages <= 100_000 else wide, F.col("stage").eqNullSafe(F.col("of_stage"))).drop("of_stage").where(F.col("elapsed") <= F.col("high"))
    counted = near.groupBy("stage", "q", "at", F.when(F.col("low").isNull() | (F.col("elapsed") >= F.col("low")), F.col("elapsed")).alias("value")).count()
    upto = Window.partitionBy("stage", "q").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    place = counted.withColumn("upto", F.sum("count").over(upto))
    found = place.groupBy("stage", "q").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("value"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("value"))).alias("b"), F.first(F.col("at") - F.floor("at")).alias("share")
    ).select("stage", "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("x"))
    both = found.groupBy("stage").agg(*[F.max(F.when(F.col("q") == name, F.col("x"))).alias(name) for name in wanted])
    return whole.join(both, whole["stage"].eqNullSafe(both["stage"]), "left").select(whole["stage"], "spans", "mean", "median", "p95", "longest")


def trace_windows(spans: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Spans and mean elapsed per stage and tumbling window; `late` sets a watermark for streams."""
    timed = spans.withWatermark("start_ts", late) if late else spans
    return timed.groupBy(F.window("start_ts", window).alias("w"), "stage").agg(F.count("*").alias("spans"), F.avg("elapsed").alias("mean")).select(F.col("w.start").alias("window_start"), "stage", "spans", "mean")


#: Size of a latency sketch: ranks are within about 0.4 % of the true ones.
SKETCH_K = 800


def latency_sketches(spans: DataFrame, window: str = "1 hour", late: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """(window_start, stage, spans, sketch): a mergeable quantile sketch of elapsed per stage and window, of bounded size; `late` sets a watermark for streams. Spans without elapsed are not counted."""
    timed = (spans.withWatermark("start_ts", late) if late else spans).where("elapsed IS NOT NULL")
    found = timed.groupBy(F.window("start_ts", window).alias("w"), "stage").agg(F.count("*").alias("spans"), F.kll_sketch_agg_double(F.col("elapsed").cast("double"), F.lit(k)).alias("sketch"))
    return found.select(F.col("w.start").alias("window_start"), "stage", "spans", "sketch")


def merged_sketches(sketches: DataFrame, *by) -> DataFrame:
    """(by.., spans, sketch): sketches of windows merged to longer ones, or over stages, without the spans."""
    return sketches.groupBy(*by).agg(F.sum("spans").alias("spans"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, **shares: float) -> DataFrame:
    """A column per named share, such as median=0.5, in place of the sketch."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()}).drop("sketch")


#: Rounds of doubling after which a chain of parents has to have ended: 2**ROUNDS spans.
ROUNDS = 40


def span_tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, root_id, depth, self_time, path_time, ends_critical) of spans (trace_id, span_id, parent_id, elapsed).

    self_time is elapsed without that of the children, path_time the sum of self times from the root to the span, and the
    span with the most of it (the smallest id of several) ends the critical path of its tree. Ancestors are found by
    pointer doubling, so the rounds are the logarithm of the depth. A parent that is not there makes a root; of
    rows with one id in a trace that with the greatest elapsed counts; a missing elapsed is 0; a cycle is an error.
    """
    own = spans.groupBy("trace_id", "span_id").agg(F.max(F.struct(F.coalesce("elapsed", F.lit(0)).alias("elapsed"), "parent_id")).alias("x")).select("trace_id", "span_id", "x.*")
    inner = own.where("parent_id IS NOT NULL").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("elapsed").alias("inner"))
    known = own.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there"))
    at = (
        own.join(inner, ["trace_id", "span_id"], "left").join(known, ["trace_id", "parent_id"], "left")
        .select("trace_id", "span_id", (F.col("elapsed") - F.coalesce("inner", F.lit(0))).alias("self_time"), F.when(F.col("there"), F.col("parent_id")).alias("up"))
    )
    # up: the nearest ancestor not yet added; depth and path_time count the spans before it
    at = stored(at.withColumns({"depth": F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"), "path_time": F.col("self_time"), "root_id": F.col("span_id")}), "spans")
    for _ in range(ROUNDS):
        if at.where("up IS NOT NULL").isEmpty():
            best = Window.partitionBy("trace_id", "root_id").orderBy(F.desc("path_time"), "span_id")
            return at.withColumn("ends_critical", F.row_number().over(best) == 1).select("trace_id", "span_id", "root_id", "depth", "self_time", "path_time", "ends_critical")
        above = at.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("path_time").alias("above_time"), F.col("root_id").alias("far_root"))
        open_ = at.where("up IS NOT NULL").join(above, ["trace_id", "up"]).select(
            "trace_id", "span_id", "self_time", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("path_time") + F.col("above_time")).alias("path_time"), F.col("far_root").alias("root_id"),
        )
        at = stored(at.where("up IS NULL").select(*open_.columns).unionByName(open_), "spans")
    raise ValueError("spans whose parents never end: a cycle")
