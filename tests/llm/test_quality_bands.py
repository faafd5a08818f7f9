import base64
import math
import os
import random

import pytest

from conftest_words import prose
from kbspark.llm import quality


def marked(seed, n):
    """Prose with a run of symbols behind every word."""
    rng = random.Random(seed)
    return " ".join(w + rng.choice("#*$%&") * 3 for w in prose(seed, n).split())


def test_texts_full_of_symbols_go():
    judge = quality.Judge()
    for n in (200, 700, 3000):
        assert judge(prose(n, n))[-1]
        verdict = judge(marked(n, n))
        assert not verdict[5] and not verdict[-1], n


def test_the_last_chunk_counts():
    judge = quality.Judge()
    clean, noise = prose(4, 3000).encode()[: quality.CHUNK_BYTES], base64.b64encode(random.Random(1).randbytes(2250))
    ratio, bad, _ = judge.bands(clean + noise)
    assert bad == len(noise)
    assert judge.bands(clean)[1] == 0
    assert judge.bands(noise + clean[:1500])[1] == quality.CHUNK_BYTES


def test_limits_rise_with_the_length():
    highs = [high for below, _, high in quality.BANDS if below > 256]
    assert highs == sorted(highs)
    assert all(low < high for _, low, high in quality.BANDS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_bands_are_those_of_the_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.fit_bands(docs, labels)
    for own, got in zip(quality.BANDS, found, strict=True):
        assert got == pytest.approx(own, abs=0.011)


def test_bands_by_hand(spark, none):
    """Good documents alone count, lengths without enough of them keep their limits."""
    texts = [prose(i, 80 + i % 9) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, texts[0] * 9), (91, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 == 0 else 0) for i in range(60)] + [(0, 1), (90, None), (91, 1)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["q"] for r in quality.score_quality(docs, into="q").collect()}
    bands = ((300, 0.5, 9.0), (600, 0.6, 8.0), (float("inf"), 0.7, 7.0))
    want = []
    for k, (upto, low, high) in enumerate(bands):
        own = sorted(scored[i]["ratio"] for i in range(0, 60, 2) if not scored[i]["base_failed"] and (bands[k - 1][0] if k else 0) <= len(texts[i].encode()) < upto)
        if len(own) >= 20:
            at = 0.995 * (len(own) - 1)
            most = own[int(at)] + (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) * (at - int(at))
            low, high = (math.floor(100 * (own[0] - 0.25)) / 100 if k and bands[k - 1][0] >= 512 else low), math.ceil(100 * most) / 100
        want.append((upto, low, high))
    assert quality.fit_bands(docs, labels, bands=bands) == tuple(want) != bands
    assert quality.fit_bands(none.select("doc_id", "text"), labels, bands=bands) == bands
