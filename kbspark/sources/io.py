"""Readers and writers with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id INT, question STRING"
EVAL_RECORDS = "filename STRING, question STRING, gt_answer STRING, context ARRAY<STRING>, answer STRING"
GRAPH_ARRAYS = ("symptom", "acompany", "cure_department", "cure_way", "common_drug", "recommand_drug", "not_eat", "do_eat", "recommand_eat", "check", "drug_detail")
GRAPH_SOURCE = "name STRING, `desc` STRING, prevent STRING, cause STRING, cure_lasttime STRING, cured_prob STRING, " + ", ".join(f"`{c}` ARRAY<STRING>" for c in GRAPH_ARRAYS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A row per file below a folder, contents not read: path, file, size, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def read_graph_source(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, missing fields null; line_no (file, offset of the split, place in it) is the order of the rows, by file name and then as they stand in it."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return spark.read.schema(GRAPH_SOURCE).json(path).withColumn("line_no", at)


def write_eval(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_eval(spark: SparkSession, path: str, schema: str = EVAL_RECORDS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_dump(dump: DataFrame, path: str) -> None:
    """A text file per partition of `dump_chunks` rows, by file."""
    dump.withColumnRenamed("dump", "value").write.mode("overwrite").partitionBy("file").text(path)
