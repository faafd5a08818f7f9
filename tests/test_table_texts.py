"""Texts of table rows against a rule over whole lists: cells in any order and from any batches, tables over blocks, missing and repeated cells."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from kbspark.operators import layout, table_texts

CELLS = "file string, table_no int, row_no int, col_no int, text string"


def by_rule(cells):
    rows, headers = defaultdict(list), defaultdict(list)
    for file, table, row, col, text in cells:
        if row == 0:
            headers[file, table, col].append(text or "")
        elif row > 0:
            rows[file, table, row].append((col, text or ""))
    found, count, last = {}, defaultdict(int), {}
    for (file, table, _), own in sorted(rows.items()):
        own.sort()
        if own[0][1]:
            count[file] += 1
            lines = sorted((c, f"{h}: {t}") for c, t in own if c > 0 for h in headers[file, table, c] or [""])
            last[file] = (file, count[file]) if lines else None
            if lines:
                found[last[file]] = "\n".join(x for _, x in lines)
        elif last.get(file):
            found[last[file]] += own[-1][1]
    return found


def made(seed, files=4, tables=3, rows=9, cols=4, odd=0.0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "a", "bb", "中文", "x\ny", "w" * 300 if rng.random() < odd else "w"])
    cells = [(f"f{f}", t, r, c, word()) for f in range(files) for t in range(rng.randint(1, tables)) for r in range(rng.randint(0, 1), rng.randint(1, rows)) for c in range(rng.randint(0, 1), rng.randint(1, cols)) if rng.random() > odd]
    cells += [(f, t, r, c, rng.choice([x, None, "again"])) for f, t, r, c, x in cells if rng.random() < odd]
    cells += [(f, t, r, rng.choice([-2, 300]), "side") for f, t, r, c, x in cells if rng.random() < odd / 4]
    return cells


def through(cells, batch, runs):
    """The two Arrow steps alone, in batches of so many cells and runs, sorted between them as Spark does."""
    schema = pa.schema([("file", pa.string()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("text", pa.string())])
    given = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (f, t, r, c, x or ""), strict=True)) for f, t, r, c, x in cells[i : i + batch]], schema) for i in range(0, len(cells), batch)]
    packed = pa.Table.from_batches(list(table_texts.pack(given))).sort_by([("file", "ascending"), ("table_no", "ascending"), ("block", "ascending")])
    out = [r for b in table_texts.read(packed.combine_chunks().to_batches(max_chunksize=runs)) for r in b.to_pylist()]
    assert len({(r["file"], r["row_id"]) for r in out}) == len(out)
    return {(r["file"], r["row_id"]): r["text"] for r in out}


@pytest.mark.parametrize("block", [2, 1024])
def test_packed_cells_give_the_texts_of_the_rule(monkeypatch, block):
    monkeypatch.setattr(table_texts, "BLOCK", block)
    for seed in range(60):
        odd = (0.0, 0.1, 0.4)[seed % 3]
        cells = made(seed, odd=odd)
        if not cells:
            continue
        if seed % 2:
            random.Random(seed).shuffle(cells)
        for batch, runs in ((1, 1), (7, 2), (1000, 3), (1000, 1000)):
            assert through(cells, batch, runs) == by_rule(cells), (seed, batch, runs)


def test_a_table_over_many_blocks():
    cells = [("f", 0, r, c, f"{r}-{c}" if c or r % 5 else "") for r in range(5000) for c in range(3)]
    assert through(cells, 999, 2) == by_rule(cells)


def test_cells_are_shuffled_once(spark):
    """Before, cells were shuffled by table row, by row of the text and with their headers: disk 8.7 times the input and more."""
    cells = [c for seed in range(6) for c in made(seed, odd=0.2 * (seed % 2))]
    cells = [(f"{seed % 6}{f}", *rest) for seed, (f, *rest) in enumerate(cells)]
    df = spark.createDataFrame([*cells, (None, 0, 1, 0, "x"), ("f", 0, None, 1, "x"), ("f", 0, -1, 1, "x")], CELLS).repartition(5)
    got = layout.table_rows_to_text(df)
    assert {(r["file"], r["row_id"]): r["text"] for r in got.collect()} == by_rule(cells)
    assert got.dtypes == [("file", "string"), ("row_id", "bigint"), ("text", "string")]
    plan = layout.table_rows_to_text(spark.createDataFrame(cells, CELLS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_no_cells(spark):
    assert layout.table_rows_to_text(spark.createDataFrame([], CELLS)).collect() == []
