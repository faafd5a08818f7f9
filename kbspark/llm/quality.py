"""Quality rules by compression bands.

The verdict compares zstandard ratios (bytes / compressed bytes) of the whole text and of its
chunks with limits that depend on their length: long texts compress better, so both limits rise.
A ratio over the upper limit means repetition, one under the lower limit means text that a
compressor finds no pattern in. The base rules (few words, repeated word windows) reject as well.

Defined results: null and empty texts have no words and fail the base rules; a text has no length
limit; each row is judged alone, so repeated rows get equal results; extra columns are kept, but one of the result's name,
which it replaces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import beside, maybe_broadcast

#: Fixed values: (texts of fewer bytes than this, lowest ratio, highest ratio). From 256 to 32,768 bytes they are
#: what fit_bands gives for the 3,980 labelled documents of sf0.1 (zstd level 3): the highest ratio is the 99.5 % quantile of
#: the documents labelled good that pass the base rules, and from 512 bytes the lowest is 0.25 under their smallest.
#: Shorter texts all fail the base rules there; longer ones are too few to fit.
BANDS = (
    (256, 0.0, 2.8),
    (384, 1.05, 1.67),
    (512, 1.05, 1.83),
    (768, 1.21, 1.86),
    (1_024, 1.35, 1.95),
    (1_536, 1.47, 2.04),
    (2_048, 1.59, 2.09),
    (3_072, 1.66, 2.16),
    (4_096, 1.77, 2.22),
    (6_144, 1.86, 2.29),
    (8_192, 1.93, 2.34),
    (12_288, 1.96, 2.37),
    (16_384, 2.01, 2.41),
    (32_768, 2.08, 2.48),
    (float("inf"), 1.5, 2.75),
)
#: A chunk, and what is left behind the last whole one, is judged by the band of its own length.
CHUNK_BYTES = 4096
#: The share of a text's bytes in chunks out of their bands that rejects it.
CHUNK_SHARE = 0.5
MIN_WORDS = 50
#: Words in repeated 3-word windows, percent of all words.
MAX_REPEAT_PERCENT = 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunk_bytes", T.LongType()), T.StructField("kept", T.BooleanType())]
)


def repeat_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # keep the codes within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if n_bytes < below)


class Judge:
    """Scores of one text; holds the compressor of a Python worker."""

    def __init__(self, level: int = 3):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress

    def bands(self, data: bytes) -> tuple[float, int, bool]:
        """Ratio of the whole, bytes of chunks out of their band (the last, shorter one too), verdict."""
        if not data:
            return 0.0, 0, False
        ratio = len(data) / len(self.compress(data))
        low, high = band(len(data))
        bad = 0
        if len(data) >= CHUNK_BYTES:
            for at in range(0, len(data), CHUNK_BYTES):
                chunk = data[at : at + CHUNK_BYTES]
                least, most = band(len(chunk))
                bad += len(chunk) * (not least <= len(chunk) / len(self.compress(chunk)) <= most)
        return ratio, bad, low <= ratio <= high and bad <= CHUNK_SHARE * len(data)

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = _WORD.findall(text)
        n, repeated = len(words), repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        ratio, bad, good = self.bands(text.encode("utf-8", "surrogatepass"))
        return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup_lines(text), repeated, failed, ratio, bad, not failed and good


@F.pandas_udf(RESULT)
def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    own = Judge()
    for batch in texts:
        yield pd.DataFrame([own(t) for t in batch], columns=RESULT.names)


def score_quality(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """`docs` with a struct column of the counts, ratios and verdict."""
    return docs.withColumn(into, judge(F.col(text)))


#: Labelled rows that bands are fitted on, about; share of the good ones that the upper limit lets pass; room under the smallest.
MAX_LABELS, PASSING, ROOM = 400_000, 0.995, 0.25
#: Documents that a band needs to be fitted, and bytes from which on it has a fitted lower limit.
BAND_ROWS, LOW_FROM = 20, 512


def fit_bands(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", bands: tuple = BANDS, max_labels: int = MAX_LABELS,
) -> tuple[tuple[float, float, float], ...]:
    """Bands with limits fitted on the documents labelled good (1) that pass the base rules; lengths with fewer than BAND_ROWS of them keep theirs.

    Labelled rows over `max_labels` are thinned by a hash of their id; null and other labels are left out.
    """
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("id")).distinct()
    n = good.count()
    if n > max_labels:
        good = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(maybe_broadcast(good, min(n, max_labels), 16), "id")
    scored = score_quality(rows, "text", "q").where("NOT q.base_failed").select(F.octet_length("text").alias("size"), "q.ratio")
    below = [b for b, _, _ in bands]
    number = reduce(lambda rest, k: F.when(F.col("size") < below[k], k).otherwise(rest), range(len(bands) - 2, -1, -1), F.lit(len(bands) - 1))
    found = {r["band"]: r for r in scored.groupBy(number.alias("band")).agg(F.count("*").alias("n"), F.min("ratio").alias("least"), F.expr(f"percentile(ratio, {PASSING})").alias("most")).collect()}
    out = []
    for k, (upto, low, high) in enumerate(bands):
        r = found.get(k)
        if r is not None and r["n"] >= BAND_ROWS:
            low = math.floor(100 * (r["least"] - ROOM)) / 100 if k and below[k - 1] >= LOW_FROM else low
            high = math.ceil(100 * r["most"]) / 100
        out.append((upto, low, high))
    return tuple(out)


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass."""
    return beside(docs, score_quality, text).where("quality.kept").select("row.*")
