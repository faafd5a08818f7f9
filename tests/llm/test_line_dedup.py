from collections import defaultdict

from kbspark.llm.line_dedup import boilerplate_lines, dedup_lines


def brute(rows, min_sites=10, min_chars=4, long_chars=100):
    sites, first = defaultdict(set), {}
    for doc, text, _, source, *_ in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(" ")
            if len(key) >= min_chars:
                sites[key].add(source or "")
                at = (doc is not None, doc or 0, pos)
                first[key] = min(first.get(key, at), at)
    common = {key for key, of in sites.items() if len(of) >= (min(4, min_sites) if len(key) >= long_chars else min_sites)}
    out = []
    for doc, text, _, source, *_ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for pos, x in enumerate(lines) if x.strip(" ") not in common or first[x.strip(" ")] == (doc is not None, doc or 0, pos)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in df.collect()], key=str)


def test_against_brute_force(docs, rows):
    want = brute(rows)
    assert sum(r[3] for r in want) > 20
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert result(got) == want


def test_limit_in_the_exact_band(docs, rows):
    for limit in (2, 3, 7):
        assert result(dedup_lines(docs, min_sites=limit, min_chars=1)) == brute(rows, limit, 1)


def test_wide_and_no_band_agree(spark, docs, rows):
    """With everything in the exact band the result is the same."""
    from kbspark.llm.line_dedup import _lines

    lines = _lines(docs, "text", "source", "doc_id", 4, 7)
    a = {(r["h1"], r["h2"]) for r in boilerplate_lines(lines, 0.25).collect()}
    assert a == {(r["h1"], r["h2"]) for r in boilerplate_lines(lines, 0.99).collect()} != set()


def test_without_broadcast(docs, rows):
    assert result(dedup_lines(docs, limit_bytes=0)) == brute(rows)


def test_long_passages_of_a_hot_source(spark):
    """A passage of over 50 words in few sites goes, though a third of the rows are of one source; chance repeats of short lines stay."""
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(i, f"own line {i} of the text\n{passage if i % 50 == 0 else 'nothing'}\nshort line {i % 40}", "x", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert result(got) == brute(rows)
    assert sum(passage in r["text"] for r in got.collect()) == 1 and sum(r["n_removed"] for r in got.collect()) == 11


def test_names_of_its_own(docs, rows):
    names = ("d", "k1", "k2", "row", "parts", "gone", "first", "limit", "pos", "h1", "doc", "site", "salt", "lines", "__k1", "n_lines")
    got = dedup_lines(docs.select("*", *[docs.lang.alias(c) for c in names]))
    assert result(got) == brute(rows)
    assert set(names) <= set(got.columns) and {(r["doc_id"], r["lang"]) for r in got.collect()} == {(r["doc_id"], r["gone"]) for r in got.collect()}


def test_empty(none):
    assert dedup_lines(none).collect() == []
