"""ILIKE matching between tables, latency sketches, span trees, graph records, the table function."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.operators import evaluate, graph, models, patterns


def like(name, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, name, re.IGNORECASE | re.DOTALL) is not None


def test_ilike_join_equals_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abAB%_\\é中 ") for _ in range(rng.randint(0, 7))) for _ in range(150)] + ["", "abcabc", None]
    tokens = ["a", "B", "ab", "%", "%", "_", "\\%", "\\_", "\\\\", "é", "中", " "]
    asked = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 5))) for _ in range(150)] + ["%", "", "_", "___", "__%", "%%", "%_%_", None]
    got = patterns.ilike_join(spark.createDataFrame([(n,) for n in names + names[:5]], "name string"), spark.createDataFrame([(p,) for p in asked], "pattern string"))
    pairs = [tuple(r) for r in got.select("pattern", "name").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(p, n) for p in asked if p is not None for n in names if n is not None and like(n, p)}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_ilike_join_of_nothing(spark):
    none, some = spark.createDataFrame([], "name string"), spark.createDataFrame([("%",), ("a%",)], "pattern string")
    assert patterns.ilike_join(none, some).collect() == []
    assert patterns.ilike_join(some.withColumnRenamed("pattern", "name"), none.withColumnRenamed("name", "pattern")).collect() == []


def sent_uncounted(node):
    """Whether a side of a broadcast join explodes rows that nothing has counted: no aggregate, and so no shuffle, stands above them."""
    explodes = lambda x: x.nodeName() == "Generate" or "Aggregate" not in x.nodeName() and any(map(explodes, below(x)))
    below = lambda x: [x.children().apply(i) for i in range(x.children().size())]
    side = node.nodeName() == "BroadcastHashJoin" and (node.left() if node.buildSide().toString() == "BuildLeft" else node.right())
    return bool(side) and explodes(side) or any(map(sent_uncounted, below(node)))


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_ilike_join_sends_no_exploded_names(spark, monkeypatch, few):
    """The pieces of the names never go through the driver, though their file is small; lengths of wildcards alone go if they are counted as few."""
    monkeypatch.setattr(patterns, "FEW_BYTES", few, raising=False)
    names = [f"src{i % 3}/Doc_{i}.txt" for i in range(60)]
    asked = [f"%doc_{i}%" for i in range(2000)] + [f"src{i}/%{i}.TXT" for i in range(30)] + ["%c_1%", "%_1%", "%9%"]
    wild = ["%", "_" * 14, "_" * 15 + "%"]
    for own, sent in ((asked, False), (asked + wild, few > 0)):
        got = patterns.ilike_join(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in own], "pattern string"))
        assert sent_uncounted(got._jdf.queryExecution().sparkPlan()) == sent
        assert sorted(map(tuple, got.select("pattern", "name").collect())) == sorted((p, n) for p in own for n in names if like(n, p))


def test_numbered_names_are_told_apart(spark):
    """A number of six digits is looked up as a whole, not by three digits that a fixed share of all names hold."""
    row = spark.range(1).select(patterns.pattern_pieces(F.lit("%doc_123456%"), patterns.PIECES[0]).alias("pieces")).first()
    assert row["pieces"] == ["123456"]


def test_sketches_merge(spark):
    """Sketches of hours, merged, have ranks within 2 % of the exact ones, and counts that are exact; a stream gives the same counts."""
    values = [float(i * 7919 % 20_011) for i in range(20_000)]
    spans = spark.createDataFrame([("a" if i % 3 else None, v) for i, v in enumerate(values)] + [("none", None)], "stage string, elapsed double")
    spans = spans.withColumn("start_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("elapsed").cast("int") % 9000))
    hours = evaluate.latency_sketches(spans)
    found = evaluate.sketch_quantiles(evaluate.merged_sketches(hours, "stage"), median=0.5, p95=0.95).collect()
    assert len(found) == 2 and hours.count() > 4
    for r in found:
        own = [v for i, v in enumerate(values) if ("a" if i % 3 else None) == r["stage"]]
        assert r["spans"] == len(own)
        for share, x in ((0.5, r["median"]), (0.95, r["p95"])):
            assert abs(sum(v <= x for v in own) / len(own) - share) < 0.02


def test_sketches_of_a_stream(spark, tmp_path):
    spans = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id % 5, 0, 0) AS start_ts, 'search' AS stage, CAST(id AS double) AS elapsed FROM range(500)")
    spans.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in"))
    query = evaluate.latency_sketches(stream, late="10 minutes").writeStream.format("memory").queryName("kll").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    both = [sorted(map(tuple, evaluate.sketch_quantiles(x, median=0.5).collect())) for x in (spark.table("kll"), evaluate.latency_sketches(spans))]
    assert both[0] == both[1] and len(both[0]) == 5  # 100 spans a window are kept as they are


def test_span_tree(spark):
    rng = random.Random(3)
    rows = [(t, i, None if i == 0 else rng.randrange(max(0, i - 3), i), rng.randint(1, 50)) for t in range(3) for i in range(120)]
    rows += [(9, 1, 77, 5), (9, 2, 1, None), (None, 1, None, 4), (9, 3, 1, 2), (9, 3, 1, 2)]
    own = {(t, i): (p, e or 0) for t, i, p, e in rows}
    inner = {}
    for (t, _), (p, e) in own.items():
        inner[t, p] = inner.get((t, p), 0) + e
    want = {}
    for (t, i), (p, e) in own.items():
        at, depth, path = i, 0, 0
        while True:
            up, mine = own[t, at]
            path += mine - inner.get((t, at), 0)
            if up is None or (t, up) not in own:
                break
            at, depth = up, depth + 1
        want[t, i] = [at, depth, e - inner.get((t, i), 0), path]
    ends = {}
    for (t, i), (root, _, _, path) in want.items():
        ends[t, root] = max(ends.get((t, root), (-(10**9), 0)), (path, -i))
    got = evaluate.span_tree(spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, elapsed long"))
    known = {k: v for k, v in want.items() if k[0] is not None}
    found = {(r["trace_id"], r["span_id"]): [r["root_id"], r["depth"], r["self_time"], r["path_time"], r["ends_critical"]] for r in got.collect() if r["trace_id"] is not None}
    assert found == {(t, i): [*x, ends[t, x[0]] == (x[3], -i)] for (t, i), x in known.items()}
    with pytest.raises(ValueError, match="cycle"):
        evaluate.span_tree(spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1)], "trace_id long, span_id long, parent_id long, elapsed long"))


def test_latency_of_a_missing_stage(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "stage string, elapsed double")
    assert {(r["stage"], r["median"], r["p95"]) for r in evaluate.trace_latency(df).collect()} == {(None, 2.0, 2.9), ("a", 2.0, 2.0)}


def test_graph_of_missing_arrays(spark):
    schema = "line_no long, name string, `desc` string, prevent string, cause string, cure_lasttime string, cured_prob string, " + ", ".join(f"`{c}` array<string>" for c in ("symptom", "acompany", "cure_department", "cure_way", "common_drug", "recommand_drug", "not_eat", "do_eat", "recommand_eat", "check", "drug_detail"))
    row = lambda name, **c: (1, name, *[None] * 5, *[c.get(k) for k in ("symptom", "acompany", "cure_department", "cure_way", "common_drug", "recommand_drug", "not_eat", "do_eat", "recommand_eat", "check", "drug_detail")])
    df = spark.createDataFrame([row("d1", symptom=["s1", None, "s1"], cure_department=["one", "two"], drug_detail=["P(D)"]), row("d2", cure_department=["one"], check=["c"]), row(None, symptom=["s2"]), row("d3", cure_department=["a", "b", "c"])], schema)
    nodes = {(r["node_type"], r["name"]) for r in graph.graph_nodes(df).collect()}
    assert nodes == {("disease", "d1"), ("disease", "d2"), ("disease", "d3"), ("symptom", "s1"), ("symptom", "s2"), ("department", "one"), ("department", "two"), ("department", "a"), ("department", "b"), ("department", "c"), ("producer", "P"), ("drug", "D"), ("check", "c")}
    names = {r["vid"]: r["name"] for r in graph.graph_nodes(df).collect()}
    edges = {(r["rel"], names[r["src"]], names[r["dst"]]) for r in graph.graph_edges(df, need_check=True).collect()}
    assert edges == {("has_symptom", "d1", "s1"), ("belongs_to", "two", "one"), ("cure_department", "d1", "two"), ("drugs_of", "P", "D"), ("cure_department", "d2", "one"), ("need_check", "d2", "c")}
    assert graph.graph_edges(df)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    good, bad = graph.validate_edges(graph.graph_edges(df), graph.graph_nodes(df).where("name <> 'D'"))
    assert {r["rel"] for r in bad.collect()} == {"drugs_of"} and good.count() == 4


def test_table_function_with_an_unknown_splitter(spark):
    models.register_split_text(spark, "split_text_test")
    got = spark.sql("SELECT chunk FROM VALUES ('甲。乙！丙') AS t(x), LATERAL split_text_test(x, 'no such name')").collect()
    assert [r["chunk"] for r in got] == ["甲。", "乙！", "丙"]
