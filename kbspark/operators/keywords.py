"""BM25 keyword search for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.operators.vectors import HITS, Best, all_rounds, top_k
from kbspark.sources.io import stored


def tokens(text: Column | str) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def cjk_bigrams(text: Column | str) -> Column:
    """Pairs of neighbouring CJK characters, for text without blanks between words."""
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


#: Bytes of query terms that are sent to the tasks at once, at TERM_BYTES each; more queries go in rounds. Cells of a block of chunks by queries.
ROUND_BYTES, TERM_BYTES, BLOCK_CELLS = 64 << 20, 64, 1 << 22
COUNTED = "chunk_id long, length long, terms array<string>, counts array<int>"


def counted_terms(corpus: DataFrame, tokenize=tokens) -> DataFrame:
    """(chunk_id, length, terms, counts) of corpus (chunk_id, content): the distinct terms of each chunk, counted within its row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            size = words.value_lengths().to_numpy(zero_copy_only=False)
            key, n = np.unique(np.repeat(np.arange(len(size)), size) * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(key, max(1, len(coded.dictionary)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "chunk_id": batch.column("chunk_id"), "length": size.astype(np.int64),
                "terms": pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(term))), "counts": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
            })

    words = corpus.select(F.col("chunk_id").cast("long").alias("chunk_id"), tokenize("content").alias("words")).where("chunk_id IS NOT NULL AND words IS NOT NULL")
    return words.mapInArrow(count, COUNTED)


def term_weights(counted: DataFrame, epsilon: float) -> tuple[DataFrame, int, float]:
    """((term, df, idf), number of chunks, mean length): idf = ln((N - n + 0.5) / (n + 0.5)), a negative one is epsilon times the mean idf."""
    n, mean_length = counted.agg(F.count("*"), F.avg(F.col("length").cast("double"))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = stored(df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms")
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    return idf.withColumn("idf", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf"))), n, mean_length or 1.0


def impact(tf: np.ndarray, length: np.ndarray, mean_length: float, k1: float, b: float) -> np.ndarray:
    """What a term that stands tf times in a chunk adds to its score, for an idf of 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def asked_terms(queries: DataFrame, weights: DataFrame, tokenize=tokens) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, query): idf times the number of times the query has the term; terms of no chunk are left out."""
    terms = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenize("query")).alias("term")).where("query_id IS NOT NULL")
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("repeats")).join(weights, "term").select("query_id", "term", (F.col("repeats") * F.col("idf")).alias("weight"))


def asked_rounds(asked: DataFrame, limit_bytes: int = ROUND_BYTES) -> Iterator[tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]]:
    """Per round the ids of its queries, and by term the places of the queries that ask for it and its weights."""
    asked = stored(asked, "asked")
    rounds = max(1, -(-asked.count() * TERM_BYTES // max(1, limit_bytes)))
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).toArrow().sort_by([("term", "ascending"), ("query_id", "ascending")])
        if part.num_rows:
            ids, place = np.unique(part.column("query_id").to_numpy(), return_inverse=True)
            runs = part.column("term").combine_chunks().dictionary_encode()
            first = np.append(np.searchsorted(runs.indices.to_numpy(), np.arange(len(runs.dictionary))), part.num_rows)
            weight = part.column("weight").to_numpy()
            yield ids, {t: (place[a:b], weight[a:b]) for t, a, b in zip(runs.dictionary.to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)}


def bm25_search(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokenize=tokens, digits: int = 6, limit_bytes: int = ROUND_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, query) over corpus (chunk_id, content).

    Okapi; a term counts as often as the query has it. The corpus is read once, its terms are counted within each row and
    stored. Queries go to the tasks in rounds of `limit_bytes`; a round scans the counted chunks in place and a task
    gives its k best of each query, so neither postings nor scores are shuffled. For many searches of one corpus see keyword_index.
    """
    counted = stored(counted_terms(corpus, tokenize), "counted")
    weights, _, mean_length = term_weights(counted, epsilon)
    context = queries.sparkSession.sparkContext

    def one_round(ids: np.ndarray, terms: dict) -> DataFrame:
        shared = context.broadcast((ids, terms))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, asked = shared.value
            best, step = Best(len(q_ids), k), max(1, BLOCK_CELLS // len(q_ids))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    lists = batch.column("terms")
                    coded = lists.flatten().dictionary_encode()
                    size = lists.value_lengths().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(size)), size)
                    value = impact(batch.column("counts").flatten().to_numpy(), batch.column("length").to_numpy()[row], mean_length, k1, b)
                    order = np.argsort(coded.indices.to_numpy(), kind="stable")
                    first = np.append(np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary))), len(order))
                    score, seen = np.zeros((len(q_ids), len(size))), np.zeros((len(q_ids), len(size)), bool)
                    for term, start, end in zip(coded.dictionary.to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                        if term in asked:
                            own, weight = asked[term]
                            there = order[start:end]
                            cells = np.ix_(own, row[there])
                            score[cells] += weight[:, None] * value[there]
                            seen[cells] = True
                    best.add(np.arange(len(q_ids)), np.where(seen, np.round(score, digits), -np.inf), batch.column("chunk_id").to_numpy())
            q, score, chunk = best.rows()
            yield pa.RecordBatch.from_pydict({"query_id": q_ids[q], "chunk_id": chunk, "score": score})

        return top_k(counted.mapInArrow(search, HITS), k)

    found = (one_round(*x) for x in asked_rounds(asked_terms(queries, weights, tokenize), limit_bytes))
    return all_rounds(found, queries.sparkSession)
