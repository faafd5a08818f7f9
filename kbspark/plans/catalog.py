"""Queries of the catalog and of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import catalog, graph, patterns
from kbspark.plans.base import CORPUS, LINES, corpus, lines, query
from kbspark.sources.io import table

KBS = """kb AS (SELECT source AS kb_name, min(lang) AS kb_info, 'flat' AS vs_type, 'm' || count(*) % 3 AS embed_model, count(*) AS file_count FROM documents GROUP BY 1)"""


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One base per source."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb_name")).agg(
        F.min("lang").alias("kb_info"), F.lit("flat").alias("vs_type"), F.concat(F.lit("m"), (F.count("*") % 3).cast("string")).alias("embed_model"), F.count("*").alias("file_count")
    )


@query(f"""WITH {LINES}, f AS (SELECT kb_name, file, count(*) AS docs_count FROM l GROUP BY 1, 2)
SELECT kb_name, file, docs_count, count(*) OVER (PARTITION BY kb_name) AS file_count, (sum(docs_count) OVER (PARTITION BY kb_name))::BIGINT AS kb_docs FROM f""")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.kb_stats(lines(spark, sf_dir))


@query(f"""WITH {KBS}, n AS (SELECT DISTINCT upper(source) AS kb_name, 'new' AS kb_info, 'hnsw' AS vs_type, 'e' AS embed_model FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT DISTINCT 'new_' || lang, 'new', 'hnsw', 'e' FROM documents)
SELECT coalesce(kb.kb_name, n.kb_name) AS kb_name, coalesce(n.kb_info, kb.kb_info) AS kb_info, coalesce(n.vs_type, kb.vs_type) AS vs_type, coalesce(n.embed_model, kb.embed_model) AS embed_model, coalesce(file_count, 0) AS file_count
FROM kb FULL JOIN n ON lower(kb.kb_name) = lower(n.kb_name)""")
def upsert_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = docs.where("doc_id % 7 = 0").select(F.upper("source").alias("kb_name")).unionByName(docs.select(F.concat(F.lit("new_"), "lang").alias("kb_name")))
    new = names.distinct().withColumns({"kb_info": F.lit("new"), "vs_type": F.lit("hnsw"), "embed_model": F.lit("e")})
    return catalog.upsert_kb(bases(spark, sf_dir), new)


@query(f"WITH {KBS} SELECT * FROM kb WHERE file_count > 45")
def list_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_kbs(bases(spark, sf_dir), 45)


@query(f"WITH {KBS} SELECT * FROM kb WHERE lower(kb_name) = 'src3'")
def load_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load_kb(bases(spark, sf_dir), "SRC3")


@query(f"WITH {KBS} SELECT * FROM kb WHERE lower(kb_name) NOT IN ('src1', 'src2')")
def delete_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_kb(bases(spark, sf_dir), spark.createDataFrame([("SRC1",), ("src2",)], "kb_name string"))


@query("""SELECT DISTINCT name AS kb_name FROM (SELECT CASE doc_id % 3 WHEN 0 THEN '../' || source WHEN 1 THEN '  ' ELSE source || doc_id END AS name FROM documents) WHERE trim(name) <> '' AND NOT contains(name, '../')""")
def valid_kb_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    names = table(spark, sf_dir, "documents").select(F.when(k == 0, F.concat(F.lit("../"), "source")).when(k == 1, "  ").otherwise(F.concat("source", F.col("doc_id").cast("string"))).alias("kb_name"))
    return catalog.valid_kb_names(names).distinct()


FILES = f"""{CORPUS}, old AS (SELECT kb_name, file AS file_name, 1.5::DOUBLE AS file_mtime, length(text) AS file_size, 1 AS docs_count, 1 AS file_version FROM c WHERE doc_id % 2 = 0),
inc AS (SELECT kb_name, upper(file) AS file_name, 2.5::DOUBLE AS file_mtime, length(text) + 1 AS file_size, 2 AS docs_count FROM c WHERE doc_id % 3 = 0)"""


def file_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = corpus(spark, sf_dir)
    size = F.char_length("text").cast("long")
    old = own.where("doc_id % 2 = 0").select("kb_name", F.col("file").alias("file_name"), F.lit(1.5).alias("file_mtime"), size.alias("file_size"), F.lit(1).alias("docs_count"), F.lit(1).alias("file_version"))
    new = own.where("doc_id % 3 = 0").select("kb_name", F.upper("file").alias("file_name"), F.lit(2.5).alias("file_mtime"), (size + 1).alias("file_size"), F.lit(2).alias("docs_count"))
    return old, new


@query(f"""WITH {FILES} SELECT coalesce(o.kb_name, i.kb_name) AS kb_name, coalesce(o.file_name, i.file_name) AS file_name, coalesce(i.file_mtime, o.file_mtime) AS file_mtime, coalesce(i.file_size, o.file_size) AS file_size,
  coalesce(i.docs_count, o.docs_count) AS docs_count, coalesce(o.file_version, 0) + (i.file_name IS NOT NULL)::INT AS file_version FROM old o FULL JOIN inc i ON o.kb_name = i.kb_name AND lower(o.file_name) = lower(i.file_name)""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert_files(*file_rows(spark, sf_dir))


@query(f"WITH {FILES} SELECT *, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) AS file_ext FROM old WHERE kb_name = 'en'")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_files(file_rows(spark, sf_dir)[0], "EN")


@query(f"WITH {LINES} SELECT kb_name, file AS file_name, seq, content FROM l WHERE kb_name = 'en' AND seq % 4 = 2")
def list_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("part"), (F.col("seq") % 4).cast("string"))).withColumnRenamed("file", "file_name")
    return catalog.list_docs(docs, "EN", metadata={"part": 2}).select("kb_name", "file_name", "seq", "content")


@query(f"WITH {LINES} SELECT kb_name, file AS file_name, seq, content FROM l WHERE kb_name ILIKE 'E_' AND file ILIKE 'SRC1%/doc\\_%5.TXT' ESCAPE '\\'")
def list_docs_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines(spark, sf_dir).withColumnRenamed("file", "file_name")
    return catalog.list_docs(docs, "E_", r"SRC1%/doc\_%5.TXT", wildcards=True).select("kb_name", "file_name", "seq", "content")


@query(f"WITH {LINES} SELECT kb_name, file AS file_name, count(*) AS docs FROM l WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 GROUP BY ALL")
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every third document go, from files and documents."""
    old, gone = file_rows(spark, sf_dir)
    files, docs = catalog.delete_files(old, lines(spark, sf_dir).withColumnRenamed("file", "file_name"), gone)
    return docs.groupBy("kb_name", "file_name").agg(F.count("*").alias("docs")).join(files.select("kb_name", "file_name"), ["kb_name", "file_name"])


@query(f"""WITH {KBS} SELECT kb.kb_name, CASE WHEN kb_name IN ('src1', 'src2') THEN 0 ELSE file_count END AS file_count, CASE WHEN kb_name IN ('src1', 'src2') THEN 0 ELSE file_count END AS files FROM kb""")
def clear_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_name"), "doc_id")
    kept, files, _ = catalog.clear_kb(bases(spark, sf_dir), rows, rows, spark.createDataFrame([("SRC1",), ("src2",)], "kb_name string"))
    return kept.join(files.groupBy("kb_name").agg(F.count("*").alias("files")), "kb_name", "left").select("kb_name", "file_count", F.coalesce("files", F.lit(0)).alias("files"))


@query(f"""WITH {CORPUS}, s AS (SELECT file, length(text) + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS size FROM c WHERE doc_id % 2 = 0)
SELECT c.file AS file_name, length(c.text) AS file_size, CASE WHEN length(c.text) = s.size THEN 404 ELSE 200 END AS status, CASE WHEN length(c.text) = s.size THEN 'exists' ELSE 'stored' END AS msg FROM c LEFT JOIN s USING (file)""")
def plan_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus(spark, sf_dir).select("doc_id", F.col("file").alias("file_name"), F.char_length("text").cast("long").alias("file_size"))
    stored = own.where("doc_id % 2 = 0").select("file_name", (F.col("file_size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("file_size"))
    return catalog.plan_uploads(own.drop("doc_id"), stored)


# --- graph ---

#: Nested records: one per document, of its whole text; names repeat every 997 documents. Words take turns as symptoms, drugs and details.
RECORDS = """p AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, text AS head FROM documents),
r AS (SELECT doc_id, 'd' || doc_id % 997 AS name, head, w[1:doc_id % 4] AS dep, list_filter(w, lambda x, i: i % 3 = 1) AS sym, list_filter(w, lambda x, i: i % 3 = 2) AS drug,
  list_transform(list_filter(w, lambda x, i: i % 3 = 0), lambda x: x || '(' || length(x) || ')') AS det FROM p)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", " ", -1), lambda x: x != "")
    every = lambda k: F.filter("w", lambda x, i: i % 3 == k)
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"), F.col("text").alias("desc"))
    detail = F.transform(every(2), lambda x: F.concat(x, F.lit("("), F.char_length(x).cast("string"), F.lit(")")))
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").alias("line_no"), F.concat(F.lit("d"), (F.col("doc_id") % 997).cast("string")).alias("name"), "desc", null.alias("prevent"), null.alias("cause"), null.alias("cure_lasttime"), null.alias("cured_prob"),
        F.slice("w", F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("cure_department"), every(0).alias("symptom"), every(1).alias("common_drug"), detail.alias("drug_detail"),
        *[F.lit(None).cast("array<string>").alias(c) for c in ("acompany", "cure_way", "recommand_drug", "not_eat", "do_eat", "recommand_eat", "check")],
    )


ESCAPED = """replace(replace({0}, chr(10), '\\n'), '"', '\\"')"""


@query(f"""WITH {RECORDS}, d AS (SELECT name, arg_min({ESCAPED.format('head')}, doc_id) AS prop FROM r GROUP BY 1),
o AS (SELECT 'department' AS t, unnest(dep) AS n FROM r UNION SELECT 'symptom', unnest(sym) FROM r UNION SELECT 'drug', unnest(drug) FROM r
  UNION SELECT 'producer', string_split(unnest(det), '(')[1] FROM r UNION SELECT 'drug', replace(string_split(unnest(det), '(')[-1], ')', '') FROM r)
SELECT md5('disease_' || name) AS vid, 'disease' AS node_type, name, prop FROM d UNION ALL SELECT md5(t || '_' || n), t, n, NULL FROM o""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(records(spark, sf_dir)).select("vid", "node_type", "name", F.try_element_at("props", F.lit("desc")).alias("prop"))


@query(f"""WITH {RECORDS}, e AS (
  SELECT 'has_symptom' AS rel, 'disease_' || name AS a, 'symptom_' || unnest(sym) AS b FROM r UNION SELECT 'common_drug', 'disease_' || name, 'drug_' || unnest(drug) FROM r
  UNION SELECT 'belongs_to', 'department_' || dep[2], 'department_' || dep[1] FROM r WHERE len(dep) = 2
  UNION SELECT 'cure_department', 'disease_' || name, 'department_' || dep[len(dep)] FROM r WHERE len(dep) IN (1, 2)
  UNION SELECT 'drugs_of', 'producer_' || string_split(x, '(')[1], 'drug_' || replace(string_split(x, '(')[-1], ')', '') FROM (SELECT unnest(det) AS x FROM r))
SELECT DISTINCT rel, md5(a) AS src, md5(b) AS dst FROM e""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(records(spark, sf_dir))


#: Star-schema graph; suppliers whose key is divisible by 10 are no nodes, so their edges are rejects.
STAR = """n AS (SELECT 'region' AS node_type, r_name AS name FROM region UNION SELECT 'nation', n_name FROM nation UNION SELECT 'supplier', s_name FROM supplier WHERE s_suppkey % 10 <> 0 UNION SELECT 'part', p_name FROM part),
nodes AS (SELECT md5(node_type || '_' || name) AS vid, node_type, name FROM n),
e AS (SELECT 'in_region' AS rel, 'nation_' || n_name AS a, 'region_' || r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'in_nation', 'supplier_' || s_name, 'nation_' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'supplies', 'supplier_' || s_name, 'part_' || p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
edges AS (SELECT rel, md5(a) AS src, md5(b) AS dst FROM e)"""


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier, part, item = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part", "lineitem"))
    named = [("region", region.select("r_name")), ("nation", nation.select("n_name")), ("supplier", supplier.where("s_suppkey % 10 <> 0").select("s_name")), ("part", part.select("p_name"))]
    kinds = None
    for kind, df in named:
        own = graph.first_nodes(df.toDF("name").withColumn("o", F.lit(0)), kind, "name", "o", F.create_map(F.lit("kind"), F.lit(kind)))
        kinds = own if kinds is None else kinds.unionByName(own)
    edge = lambda df, rel, a, x, b, y: df.select(F.lit(rel).alias("rel"), graph.vid(a, F.col(x)).alias("src"), graph.vid(b, F.col(y)).alias("dst"))
    pairs = item.select("l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    edges = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "in_region", "nation", "n_name", "region", "r_name").unionByName(
        edge(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "in_nation", "supplier", "s_name", "nation", "n_name")
    ).unionByName(edge(pairs, "supplies", "supplier", "s_name", "part", "p_name"))
    return kinds, edges.distinct()


@query(f"""WITH {STAR} SELECT rel, src, dst, src IN (SELECT vid FROM nodes) AND dst IN (SELECT vid FROM nodes) AS valid FROM edges""")
def validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = star(spark, sf_dir)
    kept, gone = graph.validate_edges(edges, nodes)
    return kept.withColumn("valid", F.lit(True)).unionByName(gone.withColumn("valid", F.lit(False)))


@query(f"WITH {STAR} SELECT rel, s.node_type AS src_type, d.node_type AS dst_type, count(*) AS edges FROM edges JOIN nodes s ON src = s.vid JOIN nodes d ON dst = d.vid GROUP BY ALL")
def graph_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_schema(*star(spark, sf_dir))[1]


@query(f"WITH {STAR} SELECT DISTINCT node_type, 'kind' AS property FROM nodes")
def graph_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_schema(*star(spark, sf_dir))[0]


@query(f"WITH {STAR} SELECT vid, name, 'nation' AS value FROM nodes WHERE node_type = 'nation' AND name = 'NATION_7'")
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_lookup(star(spark, sf_dir)[0], "nation", "NATION_7", "kind")


@query(f"WITH {STAR} SELECT s.name AS src_name, rel, d.node_type AS dst_type, d.name AS dst_name FROM edges JOIN nodes s ON src = s.vid JOIN nodes d ON dst = d.vid WHERE rel = 'supplies'")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = star(spark, sf_dir)
    return graph.graph_neighbors(nodes.where("node_type = 'supplier'"), nodes, edges, "supplies")


#: Patterns of all kinds that derive from the documents: parts of file names, beginnings, ends, gaps, single characters, wildcards alone, escapes.
PATTERNS = r"""n AS (SELECT DISTINCT source || '/Doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '%' ELSE '' END || '.txt' AS name FROM documents),
p AS (SELECT DISTINCT CASE doc_id % 12 WHEN 0 THEN '%doc_' || doc_id || '%' WHEN 1 THEN source || '/%' || doc_id % 100 || '.TXT' WHEN 2 THEN '%' || doc_id % 10 || '\%.txt' WHEN 3 THEN 'SRC_/doc\_' || doc_id || '.txt'
  WHEN 4 THEN '%\%%' WHEN 5 THEN '%' || doc_id % 10 || '%' WHEN 6 THEN '%' || doc_id % 10 || '_' || doc_id % 7 || '%' WHEN 7 THEN source || '/doc_' || doc_id || '.txt' WHEN 8 THEN repeat('_', 12 + doc_id % 9)
  WHEN 9 THEN 'none%' || doc_id WHEN 10 THEN '%t' ELSE repeat('_', 18 + doc_id % 4) || '%' END AS pattern FROM documents)"""


@query(f"WITH {PATTERNS} SELECT pattern, name FROM p JOIN n ON name ILIKE pattern ESCAPE '\\'")
def match_name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all files against a table of patterns."""
    docs = table(spark, sf_dir, "documents")
    name = "concat(source, '/Doc_', doc_id, CASE WHEN doc_id % 5 = 0 THEN '%' ELSE '' END, '.txt')"
    pattern = r"""CASE doc_id % 12 WHEN 0 THEN concat('%doc_', doc_id, '%') WHEN 1 THEN concat(source, '/%', doc_id % 100, '.TXT') WHEN 2 THEN concat('%', doc_id % 10, r'\%.txt') WHEN 3 THEN concat(r'SRC_/doc\_', doc_id, '.txt')
      WHEN 4 THEN r'%\%%' WHEN 5 THEN concat('%', doc_id % 10, '%') WHEN 6 THEN concat('%', doc_id % 10, '_', doc_id % 7, '%') WHEN 7 THEN concat(source, '/doc_', doc_id, '.txt') WHEN 8 THEN repeat('_', CAST(12 + doc_id % 9 AS INT))
      WHEN 9 THEN concat('none%', doc_id) WHEN 10 THEN '%t' ELSE concat(repeat('_', CAST(18 + doc_id % 4 AS INT)), '%') END"""
    return patterns.ilike_join(docs.select(F.expr(name).alias("name")), docs.select(F.expr(pattern).alias("pattern")))
