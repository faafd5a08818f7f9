"""Incremental indexing: the newest arrival of a file stays, in whatever order the batches come."""

import itertools

import pytest

from kbspark.operators import chunks
from kbspark.streaming.index import IndexStream

SCHEMA = "kb_name string, file string, text string, arrival long"
BATCHES = (
    [("k", "a", "a of 9. ", 9), ("k", "b", "b of 1. ", 1), ("k", None, "lost", 1), (None, "n", "no base. ", 2)],
    [("k", "a", "a of 3. ", 3), ("k", "b", "b of 5. ", 5), ("j", "a", "other base. ", 1), ("k", "c", "c one. ", 4), ("k", "c", "c two. ", 4)],
    [("k", "a", "a of 7. ", 7), ("k", "b", "", 6), ("k", "d", "without time. ", None), (None, "n", "no base, later. ", 3)],
)


def newest(batches):
    """The texts that stay, by plain comparison; equal arrivals: the later batch, then the greater text."""
    best = {}
    for number, batch in enumerate(batches):
        for kb, file, text, arrival in batch:
            if file is not None and text is not None:
                at = (-1 if arrival is None else arrival, number, text)
                best[kb, file] = max(best.get((kb, file), at), at)
    return {key: x[2] for key, x in best.items()}


def held(spark, df):
    return sorted(((r["kb_name"], r["file"], r["content"]) for r in df.collect()), key=str)


def want(spark, batches):
    rows = [(kb, file, text) for (kb, file), text in newest(batches).items()]
    return held(spark, chunks.chunk_corpus(spark.createDataFrame(rows, "kb_name string, file string, text string")))


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_any_order_of_batches(spark, tmp_path, order):
    index = IndexStream(spark, str(tmp_path / "index"), buckets=3)
    batches = [BATCHES[i] for i in order]
    for number, batch in enumerate(batches):
        index.apply(spark.createDataFrame(batch, SCHEMA), number)
    assert held(spark, index.chunks()) == want(spark, batches)
    index.apply(spark.createDataFrame(batches[-1], SCHEMA), 2)  # a repeated batch
    assert held(spark, index.chunks(2)) == want(spark, batches)


def test_stream_of_late_arrivals(spark, tmp_path):
    """The state passes no arrival on that is older than one that came before, over restarts as well."""
    index = IndexStream(spark, str(tmp_path / "index"), buckets=2)
    for number, i in enumerate((2, 0, 1)):
        spark.createDataFrame(BATCHES[i], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = index.run(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        query.awaitTermination()
        assert query.exception() is None and index.last == number
    assert held(spark, index.chunks()) == want(spark, [BATCHES[i] for i in (2, 0, 1)])


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    index = IndexStream(spark, str(tmp_path / "index"))
    index.run(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
    assert index.chunks().count() == 0 and set(index.chunks().columns) >= {"kb_name", "file", "seq", "content"}
