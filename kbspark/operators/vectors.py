"""Exact vector search for a whole table of queries, and what follows a hit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.sources.io import stored


def normalize_vectors(vectors: DataFrame, vector: str = "embedding", into: str | None = None) -> DataFrame:
    """L2-normalised vectors as doubles; a zero vector stays."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(into or vector, F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles))


def top_k(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", ties: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank; a partial limit runs before the shuffle."""
    best = Window.partitionBy(query).orderBy(F.desc(score), ties)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Bytes of query vectors that are sent to the tasks at once; more queries go in rounds.
ROUND_BYTES = 64 << 20
METRICS = ("cosine", "ip", "l2")


def vector_rows(vectors: DataFrame, ids: str, vector: str) -> DataFrame:
    return vectors.select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())


def matrix_of(part: pa.RecordBatch | pa.Table, column: str = "v") -> np.ndarray:
    """float64 rows of a vector column, taken from the Arrow buffers."""
    v = part.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(part.num_rows, -1)


def scores(left: np.ndarray, right: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Rounded scores of every row of left with every row of right; l2 gives 1 - squared distance."""
    score = left @ right.T
    if metric == "cosine":
        score = score / np.maximum(np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1), 1e-300)
    elif metric == "l2":
        score = 1 - ((left**2).sum(1)[:, None] - 2 * score + (right**2).sum(1))
    return np.round(score, digits)


class Best:
    """The k best (score, then smaller id) of each of n queries among the rows shown so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        #: The score that a row has to reach to be among the best of its query.
        self.floor = np.full(n, -np.inf)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, own: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows `ids` for the queries `own`."""
        if score.shape[1] > self.k:
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
            self.floor[own] = np.maximum(self.floor[own], kth)
        q, c = np.nonzero((score >= self.floor[own][:, None]) & np.isfinite(score))
        self.held.append((own[q], score[q, c], ids[c]))
        self.size += len(q)
        if self.size > 4 * self.n * self.k + 100_000:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the best."""
        q, score, ids = (np.concatenate(x) if self.held else np.zeros(0) for x in (zip(*self.held, strict=True) if self.held else ((), (), ())))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order].astype(np.int64), score[order], ids[order].astype(np.int64)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        best = place < self.k
        self.held = [(q[best], score[best], ids[best])]
        self.size = len(self.held[0][0])
        return self.held[0]


def query_rounds(queries: DataFrame, query_id: str, vector: str, limit_bytes: int, least: int = 1) -> Iterator[DataFrame]:
    """Parts of the queries (id, v) whose vectors have about `limit_bytes` at most, dealt by a hash of the id; parts of under `least` rows are not made."""
    wanted = vector_rows(queries, query_id, vector)
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()
    rounds = max(1, min(-(-size // max(1, limit_bytes)), -(-n // least)))
    for r in range(rounds):
        yield wanted if rounds == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)


def all_rounds(found: Iterator[DataFrame], spark: SparkSession) -> DataFrame:
    """The hits of all rounds: one round stays a plan, of several each is stored, so that what one round sends is held at a time."""
    done: list[DataFrame] = []
    for hits in found:
        if done:
            done[-1] = stored(done[-1], "hits")
        done.append(hits)
    if len(done) > 1:
        done[-1] = stored(done[-1], "hits")
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], f"{HITS}, rank int")


HITS = "query_id long, chunk_id long, score double"


def vector_search(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding",
    exclude_self: bool = False, digits: int = 6, block: int = 2048, limit_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest rows of every query among all rows.

    The queries go to the tasks in rounds of `limit_bytes`; a round scans the corpus in place, block by block, in matrix
    products, and a task gives k rows a query, which is all that is shuffled. Scores are rounded before ranking,
    ties go to the smaller id. l2 gives 1 - squared distance.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    rows = vector_rows(corpus, chunk_id, vector)

    def one_round(part: DataFrame) -> DataFrame:
        asked = part.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((asked.column("id").to_numpy(), matrix_of(asked)) if asked.num_rows else None)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared.value is None:
                return
            q_ids, left = shared.value
            best = Best(len(q_ids), k)
            step = max(1, min(block, (64 << 20) // (8 * len(q_ids))))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids = part.column("id").to_numpy()
                    score = scores(left, matrix_of(part), metric, digits)
                    if exclude_self:
                        score[q_ids[:, None] == ids] = -np.inf
                    best.add(np.arange(len(q_ids)), score, ids)
            q, score, ids = best.rows()
            yield pa.RecordBatch.from_pydict({"query_id": q_ids[q], "chunk_id": ids, "score": score})

        return top_k(rows.mapInArrow(search, HITS), k)

    return all_rounds((one_round(part) for part in query_rounds(queries, query_id, vector, limit_bytes, block)), queries.sparkSession)


def resolve_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (.., parent_id, content, metadata) with the parent's text and metadata where it exists; scores stay."""
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("__content"), F.col("metadata").alias("__metadata"))
    return hits.join(parents, "parent_id", "left").withColumns({"content": F.coalesce("__content", "content"), "metadata": F.coalesce("__metadata", "metadata")}).drop("__content", "__metadata")


def score_threshold(hits: DataFrame, threshold: float | None, k: int | None = None) -> DataFrame:
    """Hits with score >= threshold (None: all), ranks up to k."""
    hits = hits if threshold is None else hits.where(F.col("score") >= threshold)
    return hits if k is None else hits.where(F.col("rank") <= k)
