"""Queries of the indexing side: splitting, enrichment, keys, the chunk store, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import columns
from kbspark.operators import chunks, retrieve
from kbspark.plans.base import CORPUS, LINES, corpus, lines, query
from kbspark.sources.io import shared_folder, table
from kbspark.streaming.index import IndexStream

LOADERS = ((".pptx", "slides"), (".pdf", "pages"), (".docx", "blocks"), (".doc", "blocks"))


@query(f"""WITH {CORPUS}, f AS (SELECT doc_id, replace(file, '.txt', CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.pptx' ELSE '.txt' END) AS file FROM c),
e AS (SELECT file, lower(regexp_extract(file, '(\\.[^./]+)$', 1)) AS ext FROM f)
SELECT file, ext, CASE ext WHEN '.pptx' THEN 'slides' WHEN '.pdf' THEN 'pages' WHEN '.docx' THEN 'blocks' WHEN '.doc' THEN 'blocks' ELSE 'generic' END AS loader FROM e""")
def dispatch_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    ext = F.when(k == 0, ".PDF").when(k == 1, ".docx").when(k == 2, ".pptx").otherwise(".txt")
    files = corpus(spark, sf_dir).select(F.replace("file", F.lit(".txt"), ext).alias("file"))
    return chunks.dispatch_loader(files, spark.createDataFrame(LOADERS, "ext string, loader string")).select("file", "ext", "loader")


@query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_texts(corpus(spark, sf_dir).select("doc_id", "text"), splitter="recursive")


@query()
def split_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_texts(corpus(spark, sf_dir).select("doc_id", "text"), splitter="characters", size=200)


@query()
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = corpus(spark, sf_dir).select("doc_id", F.regexp_replace("text", "\n", "\n一、").alias("text"))
    return chunks.split_texts(numbered, splitter="sections")


@query(f"""WITH {CORPUS}, t AS (SELECT doc_id, translate(text, '.!?"', '。！？') AS text FROM c),
m AS (SELECT doc_id, regexp_replace(text, '([﹒﹔﹖﹗．。！？]+[」』]{{0,2}})', '\\1' || chr(1), 'g') AS text FROM t),
g AS (SELECT doc_id, regexp_replace(regexp_replace(text, chr(1) || '(\\n[﹒﹔﹖﹗．。！？「『])', '\\1', 'g'), chr(1) || '(\\n\\n?)$', '\\1') AS text FROM m),
s AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(1)), lambda x: trim(x) <> '')) AS sentence FROM g)
SELECT doc_id, sentence, count(*) AS n FROM s GROUP BY ALL""")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = corpus(spark, sf_dir).select("doc_id", F.translate("text", '.!?"', "。！？").alias("text"))
    return marked.select("doc_id", F.explode(columns.sentences("text")).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {LINES}, n AS (SELECT kb_name, file, seq, content, length(content) AS n FROM l),
g AS (SELECT file, seq, 0 AS place, n AS len, n < 80 AS growing FROM n WHERE seq = 0
  UNION ALL SELECT n.file, n.seq, CASE WHEN growing AND len < 160 THEN place ELSE place + 1 END, CASE WHEN growing AND len < 160 THEN len + 1 + n ELSE n END, CASE WHEN growing AND len < 160 THEN growing ELSE n < 80 END
  FROM g JOIN n ON n.file = g.file AND n.seq = g.seq + 1),
z AS (SELECT file, max(place) AS last, arg_max(len, seq) AS last_len FROM g GROUP BY file)
SELECT kb_name, file, (CASE WHEN place = last AND last > 0 AND last_len < 80 THEN place - 1 ELSE place END)::INT AS seq, string_agg(content, chr(10) ORDER BY g.seq) AS content
FROM g JOIN z USING (file) JOIN n USING (file, seq) GROUP BY ALL""")
def merge_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.merge_small_chunks(lines(spark, sf_dir))


@query()
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_corpus(corpus(spark, sf_dir), smaller_size=120)


@query()
def small_to_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lines(spark, sf_dir).withColumn("chunk_id", columns.chunk_id("kb_name", "file", F.lit("text"), "seq", "content"))
    return chunks.small_to_big(big, 100)


@query(f"""WITH {LINES}, i AS (SELECT *, sha256(concat_ws(chr(1), kb_name, file, 'text', seq, content)) AS parent_id FROM l)
SELECT kb_name, file, parent_id, seq, 'Summary: ' || content AS content, 'text summary' AS multi_vector_type,
  sha256(concat_ws(chr(1), parent_id, 'text summary', seq, 'Summary: ' || content)) AS chunk_id FROM i""")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lines(spark, sf_dir).withColumn("chunk_id", columns.chunk_id("kb_name", "file", F.lit("text"), "seq", "content"))
    return chunks.summary_rows(big, F.concat(F.lit("Summary: "), "content"))


@query(f"""WITH {LINES} SELECT file, seq, string_agg(content, chr(10) || chr(10)) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l""")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.neighbor_context(lines(spark, sf_dir)).select("file", "seq", "context")


@query(f"""WITH {LINES} SELECT file, string_agg('--- Chunk ' || (seq + 1) || ' ---' || chr(10) || content, chr(10) ORDER BY seq) AS dump FROM l GROUP BY file""")
def dump_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dump_chunks(lines(spark, sf_dir))


@query(f"""WITH {LINES} SELECT file, seq, CASE WHEN seq % 2 = 0 THEN 'ctx' || seq || ':' ELSE '' END || regexp_replace(file, '\\.[^./]*$', '') || ': ' || chr(10)
  || CASE WHEN seq % 3 = 0 THEN kb_name || '-' || seq || ': ' || chr(10) ELSE '' END || content AS content FROM l""")
def enrich_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq").cast("string")
    given = lines(spark, sf_dir).withColumns({
        "knowledge_path": F.when(F.col("seq") % 3 == 0, F.concat("kb_name", F.lit("-"), seq)).otherwise(""),
        "ctx": F.when(F.col("seq") % 2 == 0, F.concat(F.lit("ctx"), seq)),
    })
    return chunks.enrich_chunks(given, context="ctx").select("file", "seq", "content")


@query(f"""WITH {LINES} SELECT file, seq, 'filename=' || file || ';id=' || doc_id || ';knowledge_path=;multi_vector_type=;page=' || seq || ';parent_id=;source=' || md5(file) AS metadata FROM l""")
def normalize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    given = lines(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("page"), text("seq"), F.lit("id"), text("doc_id"), F.lit("text"), text("content"), F.lit("source"), F.lit("x")))
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return chunks.normalize_metadata(given).select("file", "seq", F.array_join(entries, ";").alias("metadata"))


@query(f"WITH {CORPUS} SELECT file, md5(file) AS source FROM c")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.source_ids(corpus(spark, sf_dir)).select("file", "source")


@query(f"""WITH {LINES} SELECT md5(file) AS source, seq, CASE WHEN doc_id % 3 = 0 THEN content || '!' ELSE content END AS content
FROM l WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store holds the even documents; every third one arrives anew."""
    rows = chunks.source_ids(lines(spark, sf_dir))
    store = rows.where("doc_id % 2 = 0").select("source", "seq", "content")
    new = rows.where("doc_id % 3 = 0").select("source", "seq", F.concat("content", F.lit("!")).alias("content"))
    return chunks.upsert_chunks(store, new, ("source",))


@query(f"WITH {LINES} SELECT md5(file) AS source, seq, content FROM l WHERE doc_id % 5 <> 0")
def delete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth file is deleted."""
    rows = chunks.source_ids(lines(spark, sf_dir))
    gone = chunks.source_ids(corpus(spark, sf_dir)).where("doc_id % 5 = 0")
    return chunks.delete_chunks(rows.select("source", "seq", "content"), gone, ("source",))


#: Four documents share a file name, mostly in several bases.
SHARED_FILES = f"""{LINES}, s AS (SELECT doc_id, kb_name, 'f' || doc_id // 4 AS file, seq, content FROM l)"""


def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string"))
    return chunks.source_ids(lines(spark, sf_dir).withColumn("file", file)).select("doc_id", "kb_name", "source", "seq", "content")


@query(f"""WITH {SHARED_FILES}, n AS (SELECT * FROM s WHERE doc_id % 3 = 0)
SELECT doc_id, kb_name, md5(file) AS source, seq, content FROM s WHERE doc_id % 2 = 0 AND (kb_name, file) NOT IN (SELECT kb_name, file FROM n)
UNION ALL SELECT doc_id, kb_name, md5(file), seq, content || '!' FROM n""")
def upsert_chunks_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one name in several bases: only those of the base that arrives are replaced."""
    rows = shared_files(spark, sf_dir)
    return chunks.upsert_chunks(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0").withColumn("content", F.concat("content", F.lit("!"))))


@query(f"WITH {SHARED_FILES} SELECT doc_id, kb_name, md5(file) AS source, seq, content FROM s WHERE (kb_name, file) NOT IN (SELECT kb_name, file FROM s WHERE doc_id % 5 = 0)")
def delete_chunks_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared_files(spark, sf_dir)
    return chunks.delete_chunks(rows, rows.where("doc_id % 5 = 0"))


@query("""WITH t AS (SELECT doc_id AS query_id, list_concat([source], string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))) AS q FROM documents)
SELECT query_id, unnest(range(len(q))) AS variant, unnest(q) AS query FROM t""")
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("question"), F.col("text").alias("response"))
    return retrieve.expand_queries(given).select("query_id", F.col("variant").cast("long").alias("variant"), "query")


@query("SELECT doc_id AS query_id, source || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query FROM documents")
def hyde_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("question"), F.col("text").alias("response"))
    return retrieve.hyde_queries(given).select("query_id", "query")


@query()
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as a stream of files, every fifth one a second time with another text; the result is the chunk table."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = corpus(spark, sf_dir).withColumn("arrival", F.lit(0))
    again = docs.where("doc_id % 5 = 0").withColumns({"text": F.concat("text", F.lit("\nSecond arrival.")), "arrival": F.lit(1)})
    docs.write.parquet(f"{root}/in")
    again.write.mode("append").parquet(f"{root}/in")
    index = IndexStream(spark, f"{root}/index")
    stream = index.run(spark.readStream.schema(docs.schema).parquet(f"{root}/in"))
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return index.chunks().select("kb_name", "file", "seq", "chunk_id", "content")
