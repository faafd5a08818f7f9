import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm.substrings import WINDOW, Words, drop_repeated_spans, repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, words, removed, kept) of rows (id, text); one of equal rows counts."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in order:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            window = tuple(words[i : i + WINDOW])
            if window in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(window)
        out[doc, text] = (doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return sorted((out[r] for r in rows), key=str)


def run(df, **options):
    return sorted(map(tuple, drop_repeated_spans(df, **options).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


@pytest.fixture(scope="module")
def shared():
    """Passages within and across documents, of all lengths around a window, branching and periodic ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé中!.") for _ in range(rng.choice((1, 3, 7, 8, 9, 16, 17, 40))))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 40, 200)]
    rows = []
    for i in range(80):
        own = [[word() for _ in range(rng.randint(0, 30))] for _ in range(3)]
        part = rng.choice(passages)
        a = rng.randint(0, len(part) // 2)
        rows.append((i, "\n ".join(" ".join(x) for x in (own[0], part[a:], own[1], rng.choice(passages), own[2]))))
    rows += [(100, " ".join(["a"] * 300)), (101, " ".join(["a b c"] * 100)), (102, " ".join(["x"] + ["a"] * 30)), (None, rows[4][1]), (103, rows[5][1] + " end"), (104, rows[6][1].replace(" ", "\t")), (105, None), (106, "")]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("options", [{}, {"limit_bytes": 0, "range_bits": 2}])
def test_equals_brute_force(spark, shared, options):
    df = spark.createDataFrame(shared, "doc_id long, text string").repartition(5)
    assert run(df, **options) == brute(shared)


def test_edges(docs, rows):
    df = docs.withColumn("n_removed", F.lit("own")).withColumn("k", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("cut", F.lit(3))
    assert run(df) == brute([(r[0], r[1]) for r in rows])
    out = drop_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "hash", "k", "spans", "cut", "n_words", "n_removed"]
    assert {(r["k"], r["spans"], r["cut"]) for r in out.collect()} == {(1, 2, 3)}


def test_one_id_with_two_texts(spark):
    """Both texts stand, and one of them is the earlier one whatever the order of rows."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:40])), (1, " ".join(words[10:])), (0, "x")]
    found = [run(spark.createDataFrame(r, "doc_id long, text string")) for r in (rows, rows[::-1])]
    assert found[0] == found[1]
    assert sorted(r[2] for r in found[0]) in ([0, 0, 30],)


def test_nothing(none, spark):
    assert run(none) == []
    assert repeated_spans(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).count() == 0


def test_words_of_batches():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n\t中\0\x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["z" * 5000, ""]
    words = Words(pa.array(texts, pa.string()).slice(2)).join()
    found = [words.text(int(a), int(a) + 1).decode() for a in range(len(words.start))]
    want = [w for t in texts[2:] for w in WORD.findall(t)]
    assert found == want
    assert np.diff(words.first).tolist() == [len(WORD.findall(t)) for t in texts[2:]]
    by = {}
    for w, h in zip(want, words.hashes().tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_spans_of_other_words_are_not_removed(spark):
    """A path that a collision of hashes would claim: the windows that do equal their source go, the others stay."""
    from kbspark.llm.substrings import _keyed, verified_spans

    words = [f"w{i}" for i in range(60)]
    other = [*words[:30], "changed", *words[31:]]
    docs = _keyed(spark.createDataFrame([(1, " ".join(words)), (2, "x y " + " ".join(other))], "doc_id long, text string"), "text", "doc_id")
    keys = {r["doc_id"]: r["k"] for r in docs.collect()}
    places = spark.createDataFrame([(1, keys[1], 60, 0), (2, keys[2], 62, 60)], "doc_id long, k long, n long, base long")
    found = spark.createDataFrame([(1, keys[1], 0, 0, 0, 20), (1, keys[1], 20, 20, 20, 21), (2, keys[2], 2, 62, 0, 20), (2, keys[2], 22, 82, 20, 21)], "doc_id long, k long, pos long, place long, path long, windows long")
    got = sorted((r["doc_id"], r["pos"], r["words"]) for r in verified_spans(docs, found, places).collect())
    assert got == [(2, 2 + i, 20) for i in [*range(11), *range(31, 41)]]
