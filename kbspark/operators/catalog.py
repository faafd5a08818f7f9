"""The catalog of knowledge bases and files as set operations on tables. Names compare without case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.columns import extension


def valid_kb_names(names: DataFrame, name: str = "kb_name") -> DataFrame:
    """Names that are not blank and hold no '../'."""
    return names.where((F.trim(name) != "") & ~F.contains(name, F.lit("../")))


def upsert_kb(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Bases (kb_name, kb_info, vs_type, embed_model, file_count): an existing one keeps its name and file count and takes the other fields."""
    old = stored.select(F.lower("kb_name").alias("k"), F.struct("kb_name", "kb_info", "vs_type", "embed_model", "file_count").alias("o"))
    inc = new.groupBy(F.lower("kb_name").alias("k")).agg(F.min(F.struct("kb_name", "kb_info", "vs_type", "embed_model")).alias("n"))
    both = old.join(inc, "k", "full")
    taken = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("kb_info", "vs_type", "embed_model")]
    return both.select(F.coalesce("o.kb_name", "n.kb_name").alias("kb_name"), *taken, F.coalesce("o.file_count", F.lit(0)).alias("file_count"))


def list_kbs(stored: DataFrame, more_than: int = -1) -> DataFrame:
    return stored.where(F.col("file_count") > more_than)


def load_kb(stored: DataFrame, name: str) -> DataFrame:
    return stored.where(F.lower("kb_name") == name.lower())


def delete_kb(stored: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(F.lower("kb_name").alias("__k")).distinct()
    return stored.join(gone, F.lower("kb_name") == F.col("__k"), "left_anti")


def upsert_files(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Files (kb_name, file_name, file_mtime, file_size, docs_count, file_version): existing rows are refreshed with version + 1, new ones get 1."""
    key = [F.lower("kb_name").alias("k"), F.lower("file_name").alias("f")]
    fields = ("kb_name", "file_name", "file_mtime", "file_size", "docs_count")
    old = stored.select(*key, F.struct(*fields, "file_version").alias("o"))
    inc = new.groupBy(*key).agg(F.max(F.struct("file_mtime", "file_size", "docs_count", "kb_name", "file_name")).alias("n"))
    both = old.join(inc, ["k", "f"], "full")
    named = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in fields[:2]]
    fresh = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields[2:]]
    version = F.when(F.col("n").isNull(), F.col("o.file_version")).otherwise(F.coalesce("o.file_version", F.lit(0)) + 1)
    return both.select(*named, *fresh, version.alias("file_version"))


def list_files(files: DataFrame, kb_name: str | None = None, file_name: str | None = None) -> DataFrame:
    """Detail rows with extension, of one base or one file if named."""
    for column, value in (("kb_name", kb_name), ("file_name", file_name)):
        files = files if value is None else files.where(F.lower(column) == value.lower())
    return files.withColumn("file_ext", extension("file_name"))


def list_docs(docs: DataFrame, kb_name: str, file_name: str | None = None, metadata: dict | None = None, wildcards: bool = False) -> DataFrame:
    """Chunks of a base whose metadata equals all given values as strings; wildcards: names are ILIKE patterns."""
    for column, value in (("kb_name", kb_name), ("file_name", file_name)):
        if value is not None:
            docs = docs.where(F.col(column).ilike(value) if wildcards else F.lower(column) == value.lower())
    for key, value in (metadata or {}).items():
        docs = docs.where(F.try_element_at("metadata", F.lit(key)) == str(value))
    return docs


def delete_files(files: DataFrame, docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these files (kb_name, file_name)."""
    keys = gone.select(F.lower("kb_name").alias("__k"), F.lower("file_name").alias("__f")).distinct()
    same = (F.lower("kb_name") == F.col("__k")) & (F.lower("file_name") == F.col("__f"))
    return files.join(keys, same, "left_anti"), docs.join(keys, same, "left_anti")


def clear_kb(bases: DataFrame, files: DataFrame, docs: DataFrame, names: DataFrame, drop: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables after the named bases lose their files and documents; drop: the bases go too, else their count is 0."""
    keys = names.select(F.lower("kb_name").alias("__k")).distinct()
    same = F.lower("kb_name") == F.col("__k")
    if drop:
        kept = bases.join(keys, same, "left_anti")
    else:
        kept = bases.join(keys, same, "left").withColumn("file_count", F.when(F.col("__k").isNotNull(), F.lit(0)).otherwise(F.col("file_count"))).drop("__k")
    return kept, files.join(keys, same, "left_anti"), docs.join(keys, same, "left_anti")


def kb_stats(chunks: DataFrame) -> DataFrame:
    """Per base and file: docs_count, and the base's file_count; recomputed, never counted up and down."""
    per_file = chunks.groupBy("kb_name", "file").agg(F.count("*").alias("docs_count"))
    per_kb = per_file.groupBy("kb_name").agg(F.count("*").alias("file_count"), F.sum("docs_count").alias("kb_docs"))
    return per_file.join(per_kb, "kb_name")


def plan_uploads(incoming: DataFrame, stored: DataFrame, override: bool = False) -> DataFrame:
    """(file_name, file_size, status, msg) of incoming files, each name once: 404 if a stored file has the same name and size and override is off, else 200."""
    first = Window.partitionBy("file_name").orderBy("file_size")
    once = incoming.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    known = stored.groupBy("file_name").agg(F.max("file_size").alias("stored_size"))
    exists = F.lit(not override) & (F.col("file_size") == F.col("stored_size"))
    return once.join(known, "file_name", "left").select(
        "file_name", "file_size", F.when(exists, 404).otherwise(200).alias("status"), F.when(exists, F.lit("exists")).otherwise(F.lit("stored")).alias("msg")
    )
