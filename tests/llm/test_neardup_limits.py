import random

import pytest

from kbspark.llm import neardup
from test_neardup import brute, varied


def test_bands_follow_the_limit():
    assert [neardup.rows_for(p) for p in (95, 85, 80, 50)] == [5, 5, 4, 2]
    for p in (50, 60, 70, 80, 85, 90):
        n = neardup.rows_for(p)
        assert 120 % n == 0 and (1 - (p / 100) ** n) ** (120 // n) <= 1e-6
    with pytest.raises(ValueError):
        neardup.rows_for(5)


@pytest.mark.parametrize("percent", [50, 80])
def test_pairs_just_over_a_lower_limit(spark, percent):
    rng = random.Random(percent)
    rows = []
    for k in range(150):
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, varied(k, base, 7 if percent == 50 else 2))]
    want = brute(rows, percent)
    assert sum(not r[3] for r in want) > 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.near_duplicates(df, percent=percent).collect()), key=str) == want
