"""Queries of the answering side: search, fusion, rerank, prompts, evaluation, traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import evaluate, keywords, prompts, retrieve, vectors
from kbspark.plans.base import query
from kbspark.sources.io import read_eval, shared_folder, table, write_eval

#: Queries of a search: every row whose id is divisible by 20, and its next neighbour's vector as a variant.
VECTORS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT vec_id AS chunk_id, label, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q, e WHERE chunk_id <> query_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a) WHERE rank <= 25)"""
LISTS = f"""{VECTORS}, q2 AS (SELECT vec_id - 1 AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 1),
a2 AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q2.v, e.v), 6) AS score FROM q2, e WHERE chunk_id <> query_id),
hits2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a2) WHERE rank <= 25),
lists AS (SELECT x.query_id, x.chunk_id, x.score, x.rank, 0 AS list_no, 'vector' AS list_id, 'text ' || (x.chunk_id // 2) AS content FROM hits x
  UNION ALL SELECT x.query_id, x.chunk_id, x.score, x.rank, 1, 'variant', 'text ' || (x.chunk_id // 2) FROM hits2 x)"""
FUSED = f"""{LISTS}, f AS (SELECT query_id, content, sum(1.0::DOUBLE / (rank + 60)) AS score, min(list_no * 1000000 + rank) AS first_seen FROM lists GROUP BY query_id, content),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_seen) AS rank FROM f)"""


def hits(spark: SparkSession, sf_dir: str, shift: int = 0, k: int = 25, metric: str = "cosine") -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where(F.col("vec_id") % 20 == shift).select((F.col("vec_id") - shift).alias("query_id"), "embedding")
    return vectors.vector_search(queries, rows.withColumnRenamed("vec_id", "chunk_id"), k, metric, exclude_self=True)


def with_content(found: DataFrame) -> DataFrame:
    """Neighbouring chunks share a text, so that fusion has equal contents to merge."""
    return found.withColumn("content", F.concat(F.lit("text "), F.floor(F.col("chunk_id") / 2).cast("string")))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.collect_lists({"vector": with_content(hits(spark, sf_dir)), "variant": with_content(hits(spark, sf_dir, 1))})


@query(f"WITH {VECTORS} SELECT query_id, chunk_id, score, rank FROM hits")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT query_id, chunk_id, round(list_inner_product(q.v, e.v), 6) AS score FROM q, e WHERE chunk_id <> query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a) WHERE rank <= 10""")
def vector_search_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, k=10, metric="ip")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT query_id, chunk_id, round(1 - list_distance(q.v, e.v) * list_distance(q.v, e.v), 6) AS score FROM q, e WHERE chunk_id <> query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a) WHERE rank <= 10""")
def vector_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, k=10, metric="l2")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x * 3) AS v FROM v),
m AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM n)
SELECT vec_id, unnest(range(len(v))) AS pos, round(unnest(list_transform(v, lambda x: x / norm)), 6) AS x FROM m""")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding"))
    return vectors.normalize_vectors(scaled).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""SELECT * FROM (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_extendedprice").alias("score"))
    return vectors.top_k(rows, 5)


@query(f"WITH {VECTORS} SELECT query_id, chunk_id, score, rank FROM hits WHERE score >= 0.2 AND rank <= 10")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.score_threshold(hits(spark, sf_dir), 0.2, 10)


@query(f"""WITH {VECTORS}, o AS (SELECT *, count(*) FILTER (score > 0.35) OVER (PARTITION BY query_id) AS over, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM hits)
SELECT query_id, chunk_id, score, rank FROM o WHERE score > 0.35 OR (over = 0 AND n = 1)""")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.context_filter(hits(spark, sf_dir), 0.35)


@query(f"""WITH {VECTORS}, h AS (SELECT *, chunk_id - chunk_id % 5 AS parent_id FROM hits)
SELECT query_id, chunk_id, score, rank, CASE WHEN parent_id % 35 <> 0 AND parent_id IN (SELECT vec_id FROM embeddings) THEN 'parent ' || parent_id ELSE 'child ' || chunk_id END AS content FROM h""")
def resolve_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).withColumns({"parent_id": F.col("chunk_id") - F.col("chunk_id") % 5, "content": F.concat(F.lit("child "), F.col("chunk_id").cast("string")), "metadata": F.create_map().cast("map<string,string>")})
    chunk = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0 AND vec_id % 35 <> 0")
    parents = chunk.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("parent "), F.col("vec_id").cast("string")).alias("content"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    return vectors.resolve_parents(found, parents).select("query_id", "chunk_id", "score", "rank", "content")


@query(f"WITH {LISTS} SELECT query_id, list_no, list_id, rank, chunk_id, content, score FROM lists")
def collect_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("query_id", "list_no", "list_id", "rank", "chunk_id", "content", "score")


@query(f"WITH {FUSED} SELECT query_id, content, round(score, 9) AS score, rank FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.rrf_fuse(lists(spark, sf_dir)).select("query_id", "content", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {LISTS}, o AS (SELECT query_id, content, chunk_id, rank, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS n FROM lists WHERE list_no = 0)
SELECT query_id, content, chunk_id, rank FROM o WHERE n = 1""")
def dedupe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dedupe_hits(with_content(hits(spark, sf_dir)), "content").select("query_id", "content", "chunk_id", "rank")


@query(f"""WITH {FUSED}, r AS (SELECT query_id, content, round(score, 9) AS score, rank, count(*) FILTER (score > 0.03) OVER (PARTITION BY query_id) AS over FROM fused WHERE rank <= 10)
SELECT query_id, content, score, rank FROM r WHERE score > 0.03 OR (over = 0 AND rank = 1)""")
def retrieve_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: two searches, fusion, cut, context filter."""
    fused = retrieve.rrf_fuse(lists(spark, sf_dir), k=10)
    return retrieve.context_filter(fused, 0.03).select("query_id", "content", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {VECTORS}, h AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 11 <> 0 THEN score END AS score FROM hits)
SELECT query_id AS question_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, chunk_id) AS place FROM h""")
def sort_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).select(F.col("query_id").alias("question_id"), "chunk_id", F.when(F.col("chunk_id") % 11 != 0, F.col("score")).alias("score"))
    return evaluate.sort_by_similarity(found)


@query("SELECT doc_id AS id, text AS question FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def select_listed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose ids stand in a table."""
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return evaluate.select_questions(questions, table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("id")))


#: Okapi weights by joins and grouping; every passage of benchmark against every document.
BM25 = r"""tok AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
stat AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean_length FROM tok),
post AS (SELECT chunk_id, len(words) AS length, unnest(words) AS term FROM tok),
tf AS (SELECT chunk_id, term, count(*) AS tf, min(length) AS length FROM post GROUP BY 1, 2),
idf0 AS (SELECT term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean_length FROM tf, stat GROUP BY term, n_docs, mean_length),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf, mean_length FROM idf0),
qt AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS term FROM benchmark),
qn AS (SELECT query_id, term, count(*) AS repeats FROM qt GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, round(sum(repeats * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM qn JOIN tf USING (term) JOIN idf USING (term) GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10)"""


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return keywords.bm25_search(queries, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), 10)


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(spark, sf_dir)


RERANKED = f"""{BM25}, pr AS (SELECT b.*, q.text AS query, d.text AS content FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id),
ov AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS cw FROM pr),
sc AS (SELECT query_id, chunk_id, content, rank - 1 AS corpus_id, score AS search_score, coalesce(len(list_intersect(qw, cw)) / nullif(len(qw), 0), 0) AS score FROM ov),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM sc) WHERE rank <= 5)"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieve.rerank(keyword_hits(spark, sf_dir).join(queries, "query_id").join(texts, "chunk_id"))


@query(f"WITH {RERANKED} SELECT query_id, chunk_id, corpus_id, search_score, round(score, 9) AS score, rank FROM rr")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query_id", "chunk_id", "corpus_id", "search_score", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {RERANKED} SELECT query_id, rank, 'f' || chunk_id AS filename, content AS context, search_score, round(score, 9) AS similarity_score FROM rr")
def hit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reranked(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("filename"), F.concat(F.lit("f"), F.col("chunk_id").cast("string"))))
    return retrieve.hit_report(found).withColumn("similarity_score", F.round("similarity_score", 9))


@query(f"""WITH {RERANKED}, k AS (SELECT query_id, string_agg(chr(10) || chr(10) || '片段' || rank || ':' || chr(10) || content, '' ORDER BY rank) AS context FROM rr GROUP BY query_id)
SELECT item_id AS query_id, coalesce(context, '') AS context, 'Q: ' || text || chr(10) || 'C: ' || coalesce(context, '') AS prompt FROM benchmark LEFT JOIN k ON item_id = query_id""")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return prompts.assemble_context(reranked(spark, sf_dir), queries, "Q: {query}\nC: {context}")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.conversation_prompts(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN '<u>' || text || '</u>' ELSE text END AS prompt FROM conversations""")
def wrap_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("user", "<u>{question}</u>"), ("other", "x{question}")], "role string, template string")
    return prompts.wrap_prompts(table(spark, sf_dir, "conversations").withColumnRenamed("text", "prompt"), templates, model="role").select("conv_id", "turn", "prompt")


@query("""WITH r AS (SELECT doc_id, text AS question, lang AS kb_name, source || CASE WHEN doc_id % 3 = 0 THEN '_the' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END AS file FROM documents),
f AS (SELECT DISTINCT lang AS kb_name, source AS file FROM documents UNION SELECT lang, source || '_the' FROM documents)
SELECT doc_id, kb_name, file FROM r WHERE (kb_name, file) IN (SELECT kb_name, file FROM f) AND (NOT contains(file, '_the') OR contains(question, ' the '))""")
def validate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    end = F.concat(F.when(F.col("doc_id") % 3 == 0, "_the").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "?").otherwise(""))
    routes = docs.select("doc_id", F.replace("text", F.lit(" the "), F.lit(" _the ")).alias("question"), F.col("lang").alias("kb_name"), F.concat("source", end).alias("file"))
    files = docs.select(F.col("lang").alias("kb_name"), F.explode(F.array("source", F.concat("source", F.lit("_the")))).alias("file"))
    return retrieve.validate_routes(routes, files, ("_the",)).select("doc_id", "kb_name", "file")


@query("SELECT doc_id AS id, text AS question FROM documents WHERE doc_id IN (1, 5, 9, 100, 120)")
def select_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return evaluate.select_questions(questions, [1, 5, 9, 100, 120])


@query(f"""WITH {VECTORS}, h AS (SELECT query_id, CASE WHEN chunk_id % 11 = 0 THEN 0 ELSE score END AS score FROM hits)
SELECT query_id AS question_id, count(*) AS hits, count(*) FILTER (score < 0.4) AS low_hits, avg(CASE WHEN score < 0.4 THEN 1.0 ELSE 0.0 END) AS low_share FROM h GROUP BY 1""")
def low_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.when(F.col("chunk_id") % 11 != 0, F.col("score")).alias("score"))
    return evaluate.low_score_report(found)


EVAL_SET = f"""WITH {RERANKED}, k AS (SELECT query_id, string_agg(content, chr(1) ORDER BY rank) AS context FROM rr GROUP BY query_id)
SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR END AS answer, coalesce(context, '') AS context FROM benchmark LEFT JOIN k ON item_id = query_id"""


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with the whole texts of its best hits: lists are bounded by the cut of the search; without hits they are empty."""
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    answers = items.where("item_id % 2 = 0").select(F.col("item_id").alias("question_id"), F.col("item_id").cast("string").alias("answer"))
    contexts = reranked(spark, sf_dir).select(F.col("query_id").alias("question_id"), "rank", "content")
    return evaluate.build_eval_set(questions, answers, contexts)


@query(EVAL_SET)
def build_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_set(spark, sf_dir).withColumn("context", F.array_join("context", "\u0001"))


@query(EVAL_SET)
def write_eval_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set through a JSON file."""
    path = f"{shared_folder(spark)}/eval-{uuid.uuid4().hex}"
    write_eval(eval_set(spark, sf_dir), path)
    back = read_eval(spark, path, "question_id BIGINT, question STRING, answer STRING, context ARRAY<STRING>")
    return back.withColumn("context", F.array_join("context", "\u0001"))


@query(EVAL_SET)
def build_eval_set_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_eval_set(spark, sf_dir)


@query("""WITH v AS (SELECT source AS q, doc_id AS rank, quality AS v, toxic FROM documents JOIN labels USING (doc_id)),
h AS (SELECT *, sum(v) OVER w AS hits, count(*) OVER w AS k FROM v WINDOW w AS (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING)),
m AS (SELECT q, coalesce(sum(hits / k * v) / nullif(sum(v), 0), 0) AS cp, avg(v) AS ff, avg(1 - toxic) AS cr, CASE WHEN max((rank % 97 = 0)::INT) = 1 THEN 0 ELSE avg((rank % 100) / 100.0) END AS ar FROM h GROUP BY q)
SELECT round(avg(cp), 9) AS context_precision, round(avg(ff), 9) AS faithfulness, round(avg(cr), 9) AS context_recall, round(avg(ar), 9) AS answer_relevancy FROM m""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("question_id"), F.col("doc_id").alias("rank"), "quality", "toxic")
    verdict = lambda c: rows.select("question_id", "rank", c.alias("verdict"))
    generated = rows.select("question_id", ((F.col("rank") % 100) / 100.0).alias("cosine"), (F.col("rank") % 97 == 0).alias("noncommittal"))
    found = evaluate.eval_metrics(
        evaluate.context_precision(verdict(F.col("quality"))), evaluate.share_of(verdict(F.col("quality")), "faithfulness"),
        evaluate.share_of(verdict(1 - F.col("toxic")), "context_recall"), evaluate.answer_relevancy(generated),
    )
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("""SELECT event_type AS stage, count(*) AS spans, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS longest
FROM events GROUP BY 1""")
def trace_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"))
    return evaluate.trace_latency(spans).withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS stage, count(*) AS spans, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"), F.col("ts").alias("start_ts"))
    return evaluate.trace_windows(spans).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS stage, date_trunc('day', ts) AS day, count(*) AS spans, true AS median_holds, true AS p95_holds FROM events GROUP BY 1, 2")
def trace_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of hours merged to days; whether at least (and at most) the share of spans less (more) 2 % lies at or under (strictly under) each quantile."""
    spans = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"), F.col("ts").alias("start_ts"))
    days = evaluate.merged_sketches(evaluate.latency_sketches(spans).withColumn("day", F.date_trunc("day", "window_start")), "stage", "day")
    found = evaluate.sketch_quantiles(days, median=0.5, p95=0.95)
    at = spans.withColumn("day", F.date_trunc("day", "start_ts")).join(found, ["stage", "day"])
    holds = lambda c, share: ((F.avg((F.col("elapsed") <= F.col(c)).cast("int")) >= share - 0.02) & (F.avg((F.col("elapsed") < F.col(c)).cast("int")) <= share + 0.02)).alias(f"{c}_holds")
    return at.groupBy("stage", "day", "spans").agg(holds("median", 0.5), holds("p95", 0.95))


@query("""WITH RECURSIVE s AS (SELECT event_id // 1000 AS trace_id, event_id AS span_id, CAST(round(value * 100) AS BIGINT) AS elapsed,
  CASE WHEN event_id % 1000 = 0 THEN NULL WHEN event_id // 1000 % 7 = 3 THEN event_id - 1 ELSE event_id // 1000 * 1000 + (event_id % 1000 - 1) // 2 END AS parent_id FROM events),
c AS (SELECT parent_id AS span_id, sum(elapsed) AS inner_time FROM s GROUP BY 1),
t AS (SELECT s.*, CAST(elapsed - coalesce(inner_time, 0) AS BIGINT) AS self_time FROM s LEFT JOIN c USING (span_id)),
w AS (SELECT trace_id, span_id, span_id AS root_id, 0::BIGINT AS depth, self_time, self_time AS path_time FROM t WHERE parent_id IS NULL
  UNION ALL SELECT t.trace_id, t.span_id, w.root_id, w.depth + 1, t.self_time, w.path_time + t.self_time FROM w JOIN t ON t.parent_id = w.span_id)
SELECT *, row_number() OVER (PARTITION BY trace_id, root_id ORDER BY path_time DESC, span_id) = 1 AS ends_critical FROM w""")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of a thousand events each: binary trees, and every seventh one a chain."""
    trace, at = F.floor(F.col("event_id") / 1000), F.col("event_id") % 1000
    parent = F.when(at == 0, None).when(trace % 7 == 3, F.col("event_id") - 1).otherwise(trace * 1000 + F.floor((at - 1) / 2))
    spans = table(spark, sf_dir, "events").select(trace.alias("trace_id"), F.col("event_id").alias("span_id"), parent.alias("parent_id"), F.round(F.col("value") * 100).cast("long").alias("elapsed"))
    return evaluate.span_tree(spans)
