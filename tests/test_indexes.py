"""Stored indexes and searches in rounds against the same searches in numpy and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kbspark.operators import keyword_index, keywords, vectors
from kbspark.operators.vector_index import bounds, build_vector_index, distances, recall_of, unit

SCHEMA = "id long, embedding array<float>"


def clustered(n=600, dim=8, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 4
    m = (centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)
    m[5] = m[6] = m[7]  # ties
    m[11] = 0
    return m


def brute(queries, corpus, k, metric, exclude_self=True):
    out = []
    for q, x in queries:
        a = x.astype(float)
        found = []
        for c, y in corpus:
            b = y.astype(float)
            if exclude_self and q == c:
                continue
            s = a @ b if metric == "ip" else 1 - ((a - b) ** 2).sum() if metric == "l2" else a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)
            found.append((-round(float(s), 4), c))
        out += [(q, c, -s + 0.0, r + 1) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frame(spark, m, name, extra=()):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra), SCHEMA).withColumnRenamed("id", name).repartition(6)


def rows(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 4) + 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_exact_search(spark, tmp_path, metric):
    m = clustered()
    nulls = [(None, [1.0] * 8), (9000, None)]
    corpus, queries = frame(spark, m, "chunk_id", nulls), frame(spark, m, "query_id", nulls).where("query_id % 20 = 0 OR query_id IS NULL")
    own = [(i, v) for i, v in enumerate(m)]
    want = brute([x for x in own if x[0] % 20 == 0], own, 7, metric)
    assert rows(vectors.vector_search(queries, corpus, 7, metric, exclude_self=True, digits=4)) == want
    assert rows(vectors.vector_search(queries, corpus, 7, metric, exclude_self=True, digits=4, limit_bytes=0, block=4)) == want
    index = build_vector_index(corpus, str(tmp_path / "index"), metric, cells=15, block=40)
    assert rows(index.search(queries, 7, 2, exclude_self=True, digits=4)) == want
    assert rows(index.search(queries, 7, 1, exclude_self=True, digits=4, limit_bytes=512)) == want
    # every row is in one block, within its radii, and no score passes its bound
    seen = Counter()
    for b in index.blocks.collect():
        right = np.frombuffer(b["matrix"]).reshape(len(b["ids"]), -1)
        seen.update(b["ids"])
        centre = index.centres[b["cell"]]
        d = distances(unit(right, metric), centre[None])[:, 0]
        assert (d >= b["low"] - 1e-9).all() and (d <= b["high"] + 1e-9).all() and len(b["ids"]) <= 40
        for q in m[::20].astype(float):
            most = bounds(unit(q[None], metric), centre, b["low"], b["high"], metric)[0]
            score = vectors.scores(q[None], right, metric, 9).max()
            assert score <= most + 1e-6
    assert seen == Counter(range(len(m)))


def test_bounds_leave_most_blocks_out():
    """On clustered vectors the bound of few cells reaches a query's best."""
    m = clustered().astype(float)
    q = m[:1]
    centre = m[np.linalg.norm(m - q, axis=1).argmax()]
    near = np.sort(1 - ((m - q) ** 2).sum(1))[-8]
    assert bounds(q, centre, 0.0, 1.0, "l2")[0] < near


def test_probes_and_recall(spark, tmp_path):
    m = clustered(900)
    corpus, queries = frame(spark, m, "chunk_id"), frame(spark, m, "query_id").where("query_id % 20 = 0")
    index = build_vector_index(corpus, str(tmp_path / "index"), cells=20)
    probes = index.probes_for(queries, 5, 0.95, exclude_self=True)
    found = recall_of(index.search(queries, 5, probes, exact=False, exclude_self=True), index.search(queries, 5, exclude_self=True)).collect()
    assert len(found) == 45 and sum(r["found"] for r in found) >= 0.9 * sum(r["hits"] for r in found)
    assert 1 <= probes < 20


def test_empty_tables(spark, tmp_path):
    none, some = frame(spark, clustered()[:0], "chunk_id"), frame(spark, clustered()[:3], "query_id")
    assert vectors.vector_search(some, none, 3).collect() == [] and vectors.vector_search(none.withColumnRenamed("chunk_id", "query_id"), some.withColumnRenamed("query_id", "chunk_id"), 3).collect() == []
    assert build_vector_index(none, str(tmp_path / "a")).search(some, 3).collect() == []
    texts, queries = spark.createDataFrame([], "chunk_id long, content string"), spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert keywords.bm25_search(queries, texts, 3).collect() == []
    assert keyword_index.build_keyword_index(texts, str(tmp_path / "b")).search(queries, 3).collect() == []


def okapi(queries, corpus, k):
    split = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    docs = [(c, split(t)) for c, t in corpus if t is not None]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = Counter(t for _, w in docs for t in set(w))
    raw = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    least = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, text in queries:
        asked, found = Counter(t for t in split(text) if t in df), []
        for c, words in docs:
            tf = Counter(words)
            if any(t in tf for t in asked):
                s = sum(r * (raw[t] if raw[t] >= 0 else least) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t, r in asked.items() if t in tf)
                found.append((-round(s, 4), c))
        out += [(q, c, -s + 0.0, r + 1) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    corpus = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(700)]
    corpus += [(800 + i, corpus[7][1]) for i in range(4)] + [(900, None), (901, ""), (902, "Ünïcode 中文 w1")]
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 12))) + " w1") for i in range(40)] + [(70, "nothing here"), (71, ""), (72, None), (73, "中文 ünïcode")]
    return corpus, queries


def test_keyword_search(spark, tmp_path, texts):
    corpus, queries = texts
    want = okapi([(q, t or "") for q, t in queries], corpus, 6)
    c, q = spark.createDataFrame(corpus, "chunk_id long, content string").repartition(5), spark.createDataFrame(queries, "query_id long, query string")
    assert rows(keywords.bm25_search(q, c, 6, digits=4)) == want
    assert rows(keywords.bm25_search(q, c, 6, digits=4, limit_bytes=500)) == want
    index = keyword_index.build_keyword_index(c, str(tmp_path / "index"), shard_rows=150, block=8)
    assert rows(index.search(q, 6, digits=4)) == want
    assert rows(index.search(q, 6, digits=4, limit_bytes=500)) == want
    assert index.blocks.where("term IS NULL").count() > 3 and index.blocks.where("size(places) > 8").count() == 0


def test_blocks_are_skipped(spark, tmp_path, texts):
    """A shard's k best are those of a full count although some blocks are not read."""
    corpus, queries = texts
    c = spark.createDataFrame(corpus, "chunk_id long, content string")
    index = keyword_index.build_keyword_index(c, str(tmp_path / "index"), block=8)
    q = spark.createDataFrame(queries, "query_id long, query string")
    (ids, asked), = keywords.asked_rounds(keywords.asked_terms(q, index.terms))
    blocks = index.blocks.where("shard = 0").toArrow()
    own = blocks.filter(np.array([t is None or t in asked for t in blocks.column("term").to_pylist()]))
    *hits, read, skipped = keyword_index.shard_scores(own, len(ids), asked, 3, 4)
    *every, all_read, none = keyword_index.shard_scores(own, len(ids), asked, 100_000, 4)
    assert none == 0 and skipped > 0 and read + skipped == all_read
    best = {}
    for i, chunk, s in zip(*(x.tolist() for x in every), strict=True):
        best.setdefault(i, []).append((-s, chunk))
    assert sorted(zip(*(x.tolist() for x in hits), strict=True)) == sorted((i, chunk, -s) for i, x in best.items() for s, chunk in sorted(x)[:3])
