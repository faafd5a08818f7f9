"""Streams: incremental indexing, and stage latencies with a watermark."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kbspark.operators.chunks import FILE, chunk_corpus
from kbspark.operators.evaluate import trace_windows


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Tasks that a bucket is dealt over, by file.
SPREAD = 16


def last_arrivals(batch: DataFrame, key: tuple[str, ...] = FILE, order: str = "arrival") -> DataFrame:
    """The last arrival of each file of a base in a batch; of equal ones the greatest text, a missing one is the oldest."""
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("text"))
    return batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def of_file(rows: DataFrame, files: DataFrame, how: str, also=None) -> DataFrame:
    """Rows joined with files (FILE, ..) of the same base, null or not, and the same name."""
    other = files.withColumnsRenamed({c: f"__{c}" for c in FILE})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"__{c}"]) for c in FILE])
    return rows.join(other, same if also is None else same & also, how).drop(*[f"__{c}" for c in FILE])


class NewestArrival(StatefulProcessor):
    """Passes the newest arrival of a file on if none after it came before; an equal one replaces what an earlier batch brought."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "arrival long")

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for part in rows:
            for row in part[["text", "arrival"]].itertuples(index=False):
                at = (LEAST if pd.isna(row.arrival) else int(row.arrival), row.text)
                best = at if best is None or at > best else best
        if not self.newest.exists() or best[0] >= self.newest.get()[0]:
            self.newest.update((best[0],))
            yield pd.DataFrame({"kb_name": [key[0]], "file": [key[1]], "text": [best[1]], "arrival": [None if best[0] == LEAST else best[0]]}).astype({"arrival": "Int64"})

    def close(self) -> None:
        pass


#: Stands for a missing arrival.
LEAST = -(1 << 63)
ARRIVALS = "kb_name string, file string, text string, arrival long"


def newest_arrivals(source: DataFrame) -> DataFrame:
    """A stream (kb_name, file, text, arrival) without arrivals older than one that came before; the newest one of each file is in the state store."""
    rows = source.select("kb_name", "file", "text", F.col("arrival").cast("long").alias("arrival"))
    return rows.groupBy(*FILE).transformWithStateInPandas(NewestArrival(), ARRIVALS, outputMode="Update", timeMode="None")


class IndexStream:
    """Chunks of newly arrived documents (kb_name, file, text, arrival), in buckets by base and file.

    A document counts if no later one of its file came before; of equal arrivals the last batch counts, and
    within a batch the greatest text. So batches may come in any order. The stream keeps the newest arrival of a file
    in its state; the store holds it too, in a row without seq, so that a batch that is applied by hand obeys as well.

    A micro-batch rewrites the buckets that its files fall into, under a path of its own, and then
    writes manifest n: which batch holds each bucket. So a batch costs what its buckets hold, a
    repeated batch writes the same again, and no path is read and overwritten in one plan. A bucket is written by up
    to SPREAD tasks. Rows without file or text are set aside.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, **options):
        self.spark, self.folder, self.buckets, self.options = spark, folder, buckets, options
        #: The last batch that was applied.
        self.last = -1

    def _manifest(self, number: int) -> dict[int, int]:
        """Bucket -> batch that wrote it last; at most `buckets` rows."""
        if number < 0:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.parquet(f"{self.folder}/manifest/batch={number}").collect()}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/chunks/batch={batch}/bucket={bucket}" for bucket, batch in sorted(held.items())]
        return self.spark.read.option("basePath", f"{self.folder}/chunks").parquet(*paths).drop("batch", "bucket") if paths else None

    def _chunks_of(self, arrived: DataFrame) -> DataFrame:
        """Chunks of documents with their arrival, and a row without seq per file."""
        cut = chunk_corpus(arrived.select("kb_name", "file", "text"), **self.options)
        return of_file(cut, arrived.select(*FILE, "arrival"), "inner").unionByName(arrived.select(*FILE, "arrival"), allowMissingColumns=True)

    def apply(self, batch: DataFrame, number: int) -> None:
        bad = F.col("file").isNull() | F.col("text").isNull()
        bucket = F.pmod(F.xxhash64(*FILE), F.lit(self.buckets)).cast("int")
        batch = batch.withColumn("arrival", F.col("arrival").cast("long")).persist()
        batch.where(bad).write.mode("overwrite").parquet(f"{self.folder}/rejects/batch={number}")
        arrived = last_arrivals(batch.where(~bad)).select(*FILE, "text", "arrival")
        held = self._manifest(number - 1)
        hit = {r[0] for r in arrived.select(bucket).distinct().collect()}  # at most `buckets`
        old = self._read({k: v for k, v in held.items() if k in hit})
        if old is not None:
            stored = old.where("seq IS NULL").select(*FILE, F.coalesce("arrival", F.lit(LEAST)).alias("old_arrival"))
            arrived = of_file(arrived, stored, "left_anti", F.coalesce(arrived["arrival"], F.lit(LEAST)) < stored["old_arrival"])
        arrived = arrived.persist()
        touched = {r[0] for r in arrived.select(bucket).distinct().collect()}
        new = self._chunks_of(arrived)
        old = self._read({k: v for k, v in held.items() if k in touched})
        if old is not None:
            new = of_file(old, arrived.select(*FILE), "left_anti").unionByName(new)
        path = f"{self.folder}/chunks/batch={number}"
        spread = F.pmod(F.xxhash64("file"), F.lit(SPREAD))
        new.withColumn("bucket", bucket).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(path)
        now = held | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        arrived.unpersist()
        batch.unpersist()
        self.last = number

    def run(self, source: DataFrame) -> StreamingQuery:
        """Process what is there and stop; a later call goes on from the checkpoint."""
        bad = F.col("file").isNull() | F.col("text").isNull()
        rows = source.select("kb_name", "file", "text", F.col("arrival").cast("long").alias("arrival"))
        kept = newest_arrivals(rows.where(~bad)).unionByName(rows.where(bad))
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)
        try:
            return kept.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.apply).start()
        finally:
            if before is None:
                self.spark.conf.unset(PROVIDER)
            else:
                self.spark.conf.set(PROVIDER, before)

    def chunks(self, number: int | None = None) -> DataFrame:
        """All chunks after a batch, the last one that this object applied by default; none before the first."""
        rows = self._read(self._manifest(self.last if number is None else number))
        if rows is None:
            rows = self._chunks_of(self.spark.createDataFrame([], ARRIVALS))
        return rows.where("seq IS NOT NULL").drop("arrival")


def latency_stream(spans: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Streaming roll-up of spans; windows are final once the watermark passes them."""
    return trace_windows(spans, window, late)


