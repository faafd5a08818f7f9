"""A cluster index for vector search: cells around centroids, blocks by distance from them, exact pruning by bounds.

Centroids are fitted on a sample of about SAMPLE rows; every row of the corpus goes to the nearest one. Rows are
stored in blocks of one cell, sorted by their distance from its centroid, so a block is a shell between two radii,
and a cell of any size is dealt over tasks. The triangle inequality bounds the scores of a block from the query's
distance to the centroid: a block that cannot reach a query's k best is not looked at.

A search goes in rounds of queries (about ROUND_BYTES of vectors are held at once), which scan the blocks in place:
first the cells nearest to each query, which give the score it has to beat, then, in the exact mode, all
other blocks whose bound reaches it. Only k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.vectors import HITS, METRICS, ROUND_BYTES, Best, all_rounds, matrix_of, query_rounds, scores, top_k, vector_rows
from kbspark.sources.io import stored

#: Rows that centroids are fitted on, about; most cells; rows a block.
SAMPLE, MAX_CELLS, BLOCK = 65_536, 4096, 2048
PROBES = 8
BLOCKS = "cell int, low double, high double, ids array<long>, matrix binary"


def unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows as the index measures them: of length one for the cosine (zero rows stay)."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" else m


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Means of `cells` groups of the sample; a group that loses all rows keeps its centre."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        nearest = np.concatenate([distances(sample[at : at + 4096], centres).argmin(1) for at in range(0, len(sample), 4096)])
        order = np.argsort(nearest, kind="stable")
        used, first = np.unique(nearest[order], return_index=True)
        centres[used] = np.add.reduceat(sample[order], first) / np.diff(np.append(first, len(order)))[:, None]
    return centres


def bounds(left: np.ndarray, centre: np.ndarray, low: float, high: float, metric: str) -> np.ndarray:
    """The largest score that a row of a block can have with each query."""
    if metric == "ip":
        return left @ centre + np.linalg.norm(left, axis=1) * high
    d = distances(left, centre[None])[:, 0]
    least = np.maximum(0, np.maximum(d - high, low - d))
    return 1 - least**2 / (2 if metric == "cosine" else 1)


def build_vector_index(
    corpus: DataFrame, folder: str, metric: str = "cosine", chunk_id: str = "chunk_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK,
) -> VectorIndex:
    """Write the index of (chunk_id, vector) below a folder; rows without id or vector are left out. cells: the root of the number of rows, MAX_CELLS at most."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    rows = vector_rows(corpus, chunk_id, vector)
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).sort(F.xxhash64("id"), "id").toArrow()
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, picked.num_rows))
    centres = fit_centroids(unit(matrix_of(picked), metric), cells) if picked.num_rows else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(unit(matrix_of(batch), metric), centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int32), "distance": d[np.arange(len(cell)), cell], "id": batch.column("id"), "v": batch.column("v")})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(cell)), strict=True):
                for at in range(int(a), int(b), block):
                    part = batch.slice(at, min(block, int(b) - at))
                    d = part.column("distance").to_numpy()
                    yield pa.RecordBatch.from_pydict({
                        "cell": pa.array([cell[at]], pa.int32()), "low": [d.min()], "high": [d.max()], "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), "matrix": [matrix_of(part).tobytes()],
                    })

    kind = rows.schema["v"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"cell int, distance double, id long, v {kind}")
    assigned.repartitionByRange("cell", "distance").sortWithinPartitions("cell", "distance").mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")
    centroids = [(metric, i, [float(x) for x in c]) for i, c in enumerate(centres)]
    corpus.sparkSession.createDataFrame(centroids, "metric string, cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/cells")
    return VectorIndex(corpus.sparkSession, folder)


class VectorIndex:
    """An index that build_vector_index wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.blocks = spark, spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
        found = spark.read.schema("metric string, cell int, centroid array<double>").parquet(f"{folder}/cells").sort("cell").collect()  # MAX_CELLS rows
        self.metric, self.centres = (found[0]["metric"], np.array([r["centroid"] for r in found])) if found else (METRICS[0], None)

    def nearest_cells(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, v, cells): the cells whose centroids score best, or lie nearest."""
        centres, metric = self.centres, self.metric
        probes = min(probes, len(centres))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    left = unit(matrix_of(part), metric)
                    order = (-(left @ centres.T) if metric == "ip" else distances(left, centres)).argsort(1, kind="stable")[:, :probes]
                    cells = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel().astype(np.int32)), probes).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict({"id": part.column("id"), "v": part.column("v"), "cells": cells})

        return queries.mapInArrow(find, f"id long, v {queries.schema['v'].dataType.simpleString()}, cells array<int>")

    def _scan(self, asked: pa.Table, k: int, exclude_self: bool, digits: int, beat: np.ndarray | None) -> DataFrame:
        """The k best of each query by task: of the blocks of its own cells, or, given the scores to beat, of all others that can reach them."""
        cells = asked.column("cells").combine_chunks()
        shared = self.spark.sparkContext.broadcast((asked.column("id").to_numpy(), matrix_of(asked), cells.flatten().to_numpy().reshape(asked.num_rows, -1), beat, self.centres))
        metric = self.metric

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, left, own_cells, reach, centres = shared.value
            measured, best = unit(left, metric), Best(len(q_ids), k)
            if reach is not None:
                best.floor = reach.copy()
            for batch in batches:
                for cell, low, high, ids, matrix in zip(*(batch.column(c) for c in ("cell", "low", "high", "ids", "matrix")), strict=True):
                    at_home = (own_cells == cell.as_py()).any(1)
                    # a bound of a rounded score may lie half a digit under it
                    able = at_home if reach is None else ~at_home & (bounds(measured, centres[cell.as_py()], low.as_py(), high.as_py(), metric) + 10.0**-digits >= best.floor)
                    own, rows = np.flatnonzero(able), ids.values.to_numpy()
                    if len(own):
                        right = np.frombuffer(matrix.as_buffer(), np.float64).reshape(len(rows), -1)
                        step = max(1, (64 << 20) // (8 * len(rows)))
                        for at in range(0, len(own), step):
                            part = own[at : at + step]
                            score = scores(left[part], right, metric, digits)
                            if exclude_self:
                                score[q_ids[part][:, None] == rows] = -np.inf
                            best.add(part, score, rows)
            q, score, ids = best.rows()
            yield pa.RecordBatch.from_pydict({"query_id": q_ids[q], "chunk_id": ids, "score": score})

        return top_k(self.blocks.mapInArrow(search, HITS), k)

    def search(
        self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True, query_id: str = "query_id", vector: str = "embedding", exclude_self: bool = False, digits: int = 6, limit_bytes: int = ROUND_BYTES,
    ) -> DataFrame:
        """(query_id, chunk_id, score, rank) as vector_search gives them; exact=False looks at the `probes` nearest cells of each query only."""

        def one_round(part: DataFrame) -> DataFrame:
            asked = self.nearest_cells(part, probes).toArrow()
            if not asked.num_rows:
                return top_k(self.spark.createDataFrame([], HITS), k)
            near = self._scan(asked, k, exclude_self, digits, None)
            if not exact:
                return near
            near = stored(near, "near-hits")
            last = near.where(F.col("rank") == k).select("query_id", "score").toArrow()
            place = {q: i for i, q in enumerate(asked.column("id").to_pylist())}
            beat = np.full(asked.num_rows, -np.inf)
            beat[[place[q] for q in last.column("query_id").to_pylist()]] = last.column("score").to_numpy()
            far = self._scan(asked, k, exclude_self, digits, beat)
            return top_k(near.drop("rank").unionByName(far.drop("rank")), k)

        if self.centres is None:
            return self.spark.createDataFrame([], f"{HITS}, rank int")
        return all_rounds((one_round(part) for part in query_rounds(queries, query_id, vector, limit_bytes)), self.spark)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, query_id: str = "query_id", vector: str = "embedding", exclude_self: bool = False, most: int = 256) -> int:
        """The fewest cells to look at so that about `most` of the queries (by a hash of their id) find `recall` of their k best."""
        n = queries.count()
        few = queries.where(F.pmod(F.xxhash64(query_id), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
        best = self.search(few, k, query_id=query_id, vector=vector, exclude_self=exclude_self).select("query_id", F.col("chunk_id").alias("id"))
        homes = self.blocks.select("cell", F.explode("ids").alias("id")).join(F.broadcast(best), "id")  # `most` * k rows
        cells = self.nearest_cells(vector_rows(few, query_id, vector), len(self.centres)).withColumnRenamed("id", "query_id")
        ranks = homes.join(cells, "query_id").select(F.array_position("cells", F.col("cell")).alias("rank")).groupBy("rank").count().sort("rank").collect()
        total, seen = sum(r["count"] for r in ranks), 0
        for r in ranks:
            seen += r["count"]
            if seen >= recall * total:
                return int(r["rank"])
        return 1


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, found, recall): how many of the exact hits of each query another search has."""
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("there")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("hits"), F.count("there").alias("found"), F.avg(F.coalesce("there", F.lit(0)).cast("double")).alias("recall"))
