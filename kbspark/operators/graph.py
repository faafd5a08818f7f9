"""A property graph from nested records: nodes, edges, validation, schema and lookups.

Nodes: vid, node_type, name, props map<string,string>. Edges: rel, src, dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties of a disease node.
DISEASE_PROPS = ("desc", "prevent", "cause", "cure_lasttime", "cure_department", "cure_way", "easy_get", "cured_prob")
#: Node types and the array column their names come from.
NODE_ARRAYS = (("symptom", "symptom"), ("department", "cure_department"), ("drug", "common_drug"), ("drug", "recommand_drug"), ("food", "not_eat"), ("food", "do_eat"), ("food", "recommand_eat"), ("check", "check"))
#: Relation, type it leads to, array column.
EDGE_ARRAYS = (
    ("has_symptom", "symptom", "symptom"), ("acompany_with", "disease", "acompany"), ("common_drug", "drug", "common_drug"), ("recommand_drug", "drug", "recommand_drug"),
    ("not_eat", "food", "not_eat"), ("do_eat", "food", "do_eat"), ("recommand_eat", "food", "recommand_eat"), ("need_check", "check", "check"),
)


def vid(node_type: Column | str, name: Column) -> Column:
    return F.md5(F.concat(F.lit(node_type) if isinstance(node_type, str) else node_type, F.lit("_"), name))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def drug_parts(detail: Column) -> tuple[Column, Column]:
    """(producer, drug) of 'P(D)': what is before the first bracket, and what is behind the last one."""
    parts = F.split(detail, r"\(")
    return F.element_at(parts, 1), F.replace(F.element_at(parts, -1), F.lit(")"), F.lit(""))


def first_nodes(named: DataFrame, node_type: Column | str, name: str, order: str, props: Column | None = None) -> DataFrame:
    """One node per name: the props of the first row in order."""
    own = named.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min_by((F.create_map().cast("map<string,string>") if props is None else props), order).alias("props"))
    return own.select(vid(node_type, F.col("name")).alias("vid"), F.lit(node_type).alias("node_type"), "name", "props")


def graph_nodes(records: DataFrame, order: str = "line_no") -> DataFrame:
    """Nodes of disease records; missing arrays are empty."""
    value = {c: F.coalesce(escaped(F.col(c)), F.lit("")) for c in ("desc", "prevent", "cause", "cure_lasttime", "cured_prob")}
    value |= {"cure_department": F.coalesce(F.array_join("cure_department", "、"), F.lit("")), "cure_way": F.coalesce(F.array_join("cure_way", "、"), F.lit("")), "easy_get": F.lit("")}
    props = F.create_map(*[x for c in DISEASE_PROPS for x in (F.lit(c), value[c])])
    diseases = first_nodes(records, "disease", "name", order, props)
    of_type = lambda t, name=lambda x: x: lambda x: F.struct(F.lit(t).alias("t"), name(x).alias("name"))
    named = [F.transform(names_in(c), of_type(t)) for t, c in NODE_ARRAYS]
    named += [F.transform(names_in("drug_detail"), of_type("producer", lambda d: drug_parts(d)[0])), F.transform(names_in("drug_detail"), of_type("drug", lambda d: drug_parts(d)[1]))]
    # all kinds of a record leave it in one array, so the arrays are read and taken apart once
    others = records.select(F.explode(F.concat(*named)).alias("x")).select("x.*").where("name IS NOT NULL").distinct()
    rest = others.select(vid(F.col("t"), F.col("name")).alias("vid"), F.col("t").alias("node_type"), "name", F.create_map().cast("map<string,string>").alias("props"))
    return diseases.unionByName(rest)


def names_in(c: str) -> Column:
    """An array column, empty where it is missing."""
    return F.coalesce(c, F.array().cast("array<string>"))


def graph_edges(records: DataFrame, need_check: bool = False) -> DataFrame:
    """Distinct edges. One department: the disease belongs to it; two: the second belongs to the first, the disease to the second; else none.

    All edges of a record leave it in one array of names, which are made distinct before they become ids.
    """
    ends = {rel: ("disease", t) for rel, t, _ in EDGE_ARRAYS} | {"belongs_to": ("department", "department"), "cure_department": ("disease", "department"), "drugs_of": ("producer", "drug")}
    edge = lambda rel, src, dst: F.struct(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))
    d, name = F.col("cure_department"), F.col("name")
    dep = lambda i: F.get("cure_department", F.lit(i))
    to = lambda rel: lambda x: edge(rel, name, x)
    found = [F.transform(names_in(c), to(rel)) for rel, _, c in EDGE_ARRAYS if need_check or rel != "need_check"]
    found.append(F.transform(names_in("drug_detail"), lambda x: edge("drugs_of", *drug_parts(x))))
    found.append(F.array(F.when(F.size(d) == 2, edge("belongs_to", dep(1), dep(0)))))
    found.append(F.array(F.when(F.size(d).isin(1, 2), edge("cure_department", name, F.when(F.size(d) == 1, dep(0)).otherwise(dep(1))))))
    edges = records.select(F.explode(F.concat(*found)).alias("x")).where("x IS NOT NULL").select("x.*").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    kind = lambda k: reduce(lambda rest, rel: F.when(F.col("rel") == rel, ends[rel][k]).otherwise(rest), ends, F.lit(None).cast("string"))
    return edges.select("rel", vid(kind(0), F.col("src")).alias("src"), vid(kind(1), F.col("dst")).alias("dst"))


def validate_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends among the nodes, the others): each end is looked up once; hubs are split by skew handling."""
    flagged = edges
    for end in ("src", "dst"):
        flagged = flagged.join(nodes.select(F.col("vid").alias(end), F.lit(True).alias(f"has_{end}")).distinct(), end, "left")
    whole = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    return flagged.where(whole).select("rel", "src", "dst"), flagged.where(~whole).select("rel", "src", "dst")


def graph_schema(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_type, property) and (rel, src_type, dst_type) that occur."""
    props = nodes.select("node_type", F.explode_outer(F.map_keys("props")).alias("property")).distinct()
    kinds = nodes.select("vid", "node_type")
    patterns = (
        edges.join(kinds.withColumnsRenamed({"vid": "src", "node_type": "src_type"}), "src")
        .join(kinds.withColumnsRenamed({"vid": "dst", "node_type": "dst_type"}), "dst")
        .groupBy("rel", "src_type", "dst_type").agg(F.count("*").alias("edges"))
    )
    return props, patterns


def graph_lookup(nodes: DataFrame, node_type: str, name: str, prop: str) -> DataFrame:
    return nodes.where((F.col("node_type") == node_type) & (F.col("name") == name)).select("vid", "name", F.try_element_at("props", F.lit(prop)).alias("value"))


def graph_neighbors(starts: DataFrame, nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """(src_name, rel, dst_type, dst_name) one step over a relation from starts (vid)."""
    step = edges.where(F.col("rel") == rel).join(starts.select(F.col("vid").alias("src")).distinct(), "src", "left_semi")
    named = nodes.select("vid", "node_type", "name")
    return step.join(named.withColumnsRenamed({"vid": "src", "name": "src_name"}).drop("node_type"), "src").join(
        named.withColumnsRenamed({"vid": "dst", "name": "dst_name", "node_type": "dst_type"}), "dst"
    ).select("src_name", "rel", "dst_type", "dst_name")
