"""What the operators share: shared scratch tables, files in shared folders, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset (tests) a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style URI, for use inside tasks."""
    if re.match(r"file:/(?!//)", uri):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """Mark a side for broadcast only if its counted size is within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


#: Keys of more than 1 / HOT of a join's rows are joined by broadcast: HOT rows at most.
HOT = 1024


def skew_join(left: DataFrame, right: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """Inner join where one key may hold most rows of `left`; `right` has one row per key. `left` is read three times, so it should be a stored table.

    A key of more than 1 / hot of the rows, of which there are fewer than `hot`, goes by broadcast, so its
    rows stay where they are; the others are shuffled.
    """
    most = max(left.count() // hot, 1)
    heavy = stored(left.groupBy(*on).count().where(F.col("count") > most).select(*on), "hot")
    if heavy.isEmpty():
        return left.join(right, on)
    few = stored(right.join(F.broadcast(heavy), on, "left_semi"), "hot-rows")
    return left.join(F.broadcast(heavy), on, "left_anti").join(right, on).unionByName(left.join(F.broadcast(few), on))


#: Tasks that the rows of one key are dealt over in with_totals.
SALTS = 64


def with_totals(rows: DataFrame, key: str, dealt_by: str, parts: list, totals: list, having: str = "true") -> DataFrame:
    """`rows` beside totals of their key, where one key may hold most rows; rows of keys that fail `having` go.

    A key's rows are dealt over SALTS tasks by another column. `parts` aggregate a (key, salt), `totals` merge
    these, so a key gives SALTS rows at most, and the totals return only to the salts that the key occurs in.
    `rows` is read twice, so it should be a stored table.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(dealt_by), F.lit(SALTS)).cast("int"))
    merged = salted.groupBy(key, "salt").agg(*parts).groupBy(key).agg(*totals, F.collect_list("salt").alias("salts")).where(having)
    return salted.join(merged.withColumn("salt", F.explode("salts")).drop("salts"), [key, "salt"]).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(docs: DataFrame, fn, text: str) -> DataFrame:
    """`fn` over (row, text), where `row` is a struct of all columns, so that no name of `docs` can clash with one of fn's."""
    return fn(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text")))


def row_key(*cols):
    """Two independent 64-bit hashes of the columns, null-safe, as (k1, k2)."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def text_batches(texts, limit: int = 2_000_000):
    """Slices (start, end) of a list of texts of about `limit` characters each; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_HELD: list = []


def held_by_worker(name: tuple, make):
    """An object that a Python worker keeps from task to task; asking for another one drops it, so that operators' caches do not add up."""
    if not _HELD or _HELD[0] != name:
        _HELD.clear()
        _HELD.extend((name, make()))
    return _HELD[1]


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes, 1000 rows at most."""
    step = max(1, min(1000, batch.num_rows * limit // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, fn, ddl: str) -> DataFrame:
    """mapInArrow in small parts: `fn` gets an iterator of record batches and yields {column: list, numpy or Arrow array} for `ddl`."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for out in fn(part for b in batches for part in slices(b)):
            yield pa.RecordBatch.from_pydict({c: out[c] for c in arrow.names}, schema=arrow)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn, ddl: str) -> DataFrame:
    """map_batches over plain lists: `fn` gets an iterator of {column: list}.

    Lists keep 64-bit integers exact beside nulls, which pandas would turn into floats.
    """
    return map_batches(df, lambda parts: fn({c: part.column(i).to_pylist() for i, c in enumerate(part.schema.names)} for part in parts), ddl)
