"""Giant files in parts, batches of models, order of read rows."""

import random

import pytest

from kbspark.functions.text import merge_small
from kbspark.operators import chunks, layout, models
from kbspark.sources import io


@pytest.mark.parametrize("part", [3, 50, 4096])
def test_merging_in_parts_equals_the_sequential_rule(spark, part):
    rng = random.Random(6)
    files = {("k", "giant"): 1500, ("k", "short"): 1, (None, "two"): 2, ("k", "some"): 90, ("j", "some"): 7}
    rows = [(kb, f, i, rng.choice("abc") * rng.choice((0, 1, 5, 19, 20, 21, 39, 40, 60))) for (kb, f), n in files.items() for i in range(n)]
    got = chunks.merge_small_chunks(spark.createDataFrame(rows, "kb_name string, file string, seq int, content string").repartition(5), least=20, part=part)
    found = {}
    for r in got.collect():
        found.setdefault((r["kb_name"], r["file"]), {})[r["seq"]] = r["content"]
    want = {key: dict(enumerate(merge_small([x for kb, f, _, x in rows if (kb, f) == key], 20))) for key in files}
    assert found == want


def test_batches_within_a_budget():
    rng = random.Random(1)
    texts = ["x" * rng.choice((0, 1, 5, 40, 500)) for _ in range(300)]
    seen = []

    def call(some):
        seen.append(len(some) * max(map(len, some)) - sum(map(len, some)))
        assert len(some) == 1 or len(some) <= 16 and len(some) * max(map(len, some)) <= 800
        return [f"{len(t)}!" for t in some]

    assert models.in_batches(texts, call, 16, 800) == [f"{len(t)}!" for t in texts]
    unsorted = sum(16 * max(map(len, texts[at : at + 16])) - sum(map(len, texts[at : at + 16])) for at in range(0, 300, 16))
    assert sum(seen) < 0.2 * unsorted
    assert models.in_batches([], call, 16, 800) == []


def test_order_of_read_rows(spark, tmp_path):
    for name, values in (("b", range(3)), ("a", range(3, 7))):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"name": "n{i}"}}\n' for i in values))
    got = io.read_graph_source(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["name"] for r in got] == ["n3", "n4", "n5", "n6", "n0", "n1", "n2"]


def test_reflow_of_one_side_and_missing_texts(spark):
    schema = "file string, page int, word_no int, text string, x0 double, top double, page_width double"
    rows = [("f", 1, 0, "b", 20.0, 1.0, 600.0), ("f", 1, 1, "a", 10.0, 3.5, 600.0), ("f", 1, 2, None, 10.0, 9.0, 600.0), ("f", 2, 0, "r", 400.0, 0.0, 600.0), ("f", 3, 0, "x", None, 0.0, 600.0)]
    got = {r["page"]: r["text"] for r in layout.reflow_columns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "a b\n\n", 2: "\nr", 3: ""}
