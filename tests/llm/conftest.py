import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_words import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, hash long"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, copies, repeated rows, ties and odd characters."""
    texts = [prose(i, 20 + 37 * (i % 23)) for i in range(60)]
    out = [(i, t, "en", f"s{i % 14}", len(t), "x", 1) for i, t in enumerate(texts)]
    boiler = "All rights reserved by the site."
    out = [(i, t + ("\n  " + boiler + " " if i % 2 else ""), *r) for i, t, *r in out]
    for k in range(20):  # near copies, each with one word changed
        words = texts[22].split(" ")
        words[k * 7 % len(words)] = f"changed{k}"
        out.append((100 + k, " ".join(words), "en", f"s{k}", 0, None, None))
    out += [(200 + k, texts[5], None, "s1", None, None, None) for k in range(6)]
    out += [
        (300, None, None, None, None, None, None), (301, "", "", "", 0, "", 0), (302, " \n\t ", "en", "s1", 4, None, None), (303, "one two three", "en", "s2", 13, None, None),
        (304, "ONE two  three", "en", "s3", 13, None, None), (305, "日本語 テスト 中文。é ́x\r\n\x1c!", "ja", "s4", 20, None, None), (306, "x" * 200_000, "en", "s5", 200_000, None, None),
        (307, prose(7, 40_000), "en", "s0", 0, None, None), (308, "\n".join(["same line again and again"] * 300), "en", "s6", 0, None, None), (None, texts[9], "en", "s7", 1, None, None),
        (309, "a b c d e f " * 60, "en", "s9", 0, None, None), (310, "<|endoftext|> # * $ | plain", "en", "s9", 0, None, None),
    ]
    return out + [out[3], out[3]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
