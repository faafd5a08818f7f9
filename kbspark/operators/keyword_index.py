"""A stored inverted index for BM25: postings by term in blocks, each with the largest impact in it.

Chunks are dealt over shards of about SHARD_ROWS and numbered within them; a shard's postings of a term are blocks of
BLOCK postings in order of these numbers. A search reads the blocks of its terms alone and scores a shard in one
task: terms come in order of the most they can add, and once k chunks of a query are known, a block is skipped if the
best chunk in its range of numbers, this term at the block's best and all later terms at theirs stay under the k-th.
So only blocks of the asked terms and k rows a query and shard are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.operators.keywords import ROUND_BYTES, asked_rounds, asked_terms, counted_terms, impact, term_weights, tokens
from kbspark.operators.vectors import HITS, all_rounds, top_k
from kbspark.sources.io import stored

#: Chunks of a shard and postings of a block, about; numbers of a shard whose best scores are kept together.
SHARD_ROWS, BLOCK, SPAN = 16_384, 128, 64
#: A block of a term, or (term null) the ids of a shard's chunks by their numbers.
BLOCKS = "shard int, term string, best double, first int, last int, places array<int>, impacts array<double>, chunks array<long>"


def build_keyword_index(corpus: DataFrame, folder: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokenize=tokens, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> KeywordIndex:
    """Write the index of corpus (chunk_id, content) below a folder; the corpus is tokenised once. Chunks without id or content are left out, equal ids are chunks of their own."""
    counted = stored(counted_terms(corpus, tokenize), "counted")
    weights, n, mean_length = term_weights(counted, epsilon)
    weights.select("term", "df", "idf").write.parquet(f"{folder}/terms")
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // shard_rows)))).cast("int")
    own = Window.partitionBy("shard").orderBy("chunk_id")  # about shard_rows
    numbered = counted.withColumn("shard", shard).withColumn("place", (F.row_number().over(own) - 1).cast("int"))
    # numbers of equal ids hang on the order of rows, so they are given once
    numbered = stored(numbered, "numbered")
    heads = numbered.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, terms = batch.column("shard").to_numpy(), batch.column("term").dictionary_encode()
            code = terms.indices.to_numpy()
            place = batch.column("place").to_numpy()
            value = impact(batch.column("tf").to_numpy(), batch.column("length").to_numpy(), mean_length, k1, b)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(code) != 0)) + 1
            starts = [s for a, e in zip(np.append(0, edges).tolist(), np.append(edges, len(code)).tolist(), strict=True) for s in range(a, e, block)]
            if len(code):
                at, ends = np.array(starts), np.array([*starts[1:], len(code)])
                offsets = pa.array(np.append(at, len(code)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "shard": shards[at], "term": batch.column("term").take(pa.array(at)), "best": np.maximum.reduceat(value, at), "first": place[at], "last": place[ends - 1],
                    "places": pa.ListArray.from_arrays(offsets, pa.array(place)), "impacts": pa.ListArray.from_arrays(offsets, pa.array(value)),
                    "chunks": pa.nulls(len(at), pa.list_(pa.int64())),
                })

    postings = numbered.select("shard", "place", "length", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("shard", "place", "length", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    blocks = postings.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard", "place").mapInArrow(pack, BLOCKS)
    blocks.unionByName(heads, allowMissingColumns=True).write.parquet(f"{folder}/blocks")
    return KeywordIndex(corpus.sparkSession, folder, tokenize)


def shard_scores(table: pa.Table, queries: int, asked: dict, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(query, number of the chunk, score) of the k best of each query in a shard, and how many blocks were read and skipped."""
    heads = [x for x in table.column("chunks").to_pylist() if x is not None]
    table = table.filter(table.column("term").is_valid()).sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
    n = len(heads[0]) if heads else 0
    terms, best, first, last = (table.column(c).to_numpy() for c in ("term", "best", "first", "last"))
    lists = [table.column(c).combine_chunks() for c in ("places", "impacts")]
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    span_of = {terms[a]: (a, b) for a, b in zip(starts.tolist(), np.append(starts[1:], len(terms)).tolist(), strict=True)}
    by_query: dict[int, list] = {}
    for term, (a, b) in span_of.items():
        for q, w in zip(*(x.tolist() for x in asked[term]), strict=True):
            by_query.setdefault(q, []).append((max(0.0, w * best[a:b].max()), w, a, b))
    out, read, skipped = [], 0, 0
    spans = -(-n // SPAN)
    for q, own in sorted(by_query.items()):
        own.sort(reverse=True)
        later = np.append(np.cumsum([x[0] for x in own[::-1]])[::-1][1:], 0.0)
        score, seen, top = np.zeros(n), np.zeros(n, bool), np.zeros(spans)
        sure = all(w >= 0 for _, w, _, _ in own)  # sums only grow, so that the k-th is a floor
        floor = -np.inf
        for (_, w, a, b), rest in zip(own, later.tolist(), strict=True):
            for j in range(a, b):
                if floor > -np.inf and top[first[j] // SPAN : last[j] // SPAN + 1].max() + w * best[j] + rest < floor:
                    skipped += 1
                    continue
                read += 1
                places = lists[0][j].values.to_numpy()
                score[places] += w * lists[1][j].values.to_numpy()
                seen[places] = True
            if sure and rest:
                top = np.maximum.reduceat(score, np.arange(0, n, SPAN))
                found = score[seen]
                if len(found) > k:
                    floor = np.partition(found, -k)[-k] - 2 * 10.0**-digits
        places = np.flatnonzero(seen)
        rounded = np.round(score[places], digits)
        order = np.lexsort((places, -rounded))[:k]
        out.append((np.full(len(order), q), places[order], rounded[order]))
    q, places, found = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    return q, np.array(heads[0] if heads else [], np.int64)[places], found.astype(np.float64), read, skipped


class KeywordIndex:
    """An index that build_keyword_index wrote."""

    def __init__(self, spark: SparkSession, folder: str, tokenize=tokens):
        self.spark, self.tokenize = spark, tokenize
        self.blocks, self.terms = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/terms")

    def search(self, queries: DataFrame, k: int, digits: int = 6, limit_bytes: int = ROUND_BYTES) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, query), as bm25_search gives them."""

        def one_round(ids: np.ndarray, asked: dict) -> DataFrame:
            shared = self.spark.sparkContext.broadcast((ids, asked))
            names = self.spark.createDataFrame(pa.table({"term": pa.array(sorted(asked), pa.string())}))

            def score(rows: pa.Table) -> pa.Table:
                q_ids, terms = shared.value
                q, chunk, found, *_ = shard_scores(rows, len(q_ids), terms, k, digits)
                return pa.table({"query_id": q_ids[q], "chunk_id": chunk, "score": found})

            wanted = self.blocks.join(F.broadcast(names), "term", "left_semi").unionByName(self.blocks.where("term IS NULL")).select(*[c.split()[0] for c in BLOCKS.split(", ")])
            return top_k(wanted.groupBy("shard").applyInArrow(score, HITS), k)

        return all_rounds((one_round(*x) for x in asked_rounds(asked_terms(queries, self.terms, self.tokenize), limit_bytes)), self.spark)
