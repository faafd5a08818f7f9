import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from kbspark.llm.divergence import count_terms, radix_order, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        words = TERM.findall((text or "").translate(LOWER))
        counts[g].update(words)
        docs[g[0]].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        own = sorted(s for x, s in groups if x == lang)
        kept = [t for t, n in docs[lang].items() if n >= 3]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in own}

        def p(count, total, v=len(kept)):
            return 1 + 1_000_000_000 * (count + 1) // (total + v)

        total = sum(n.values())
        for s in own:
            pair = [(sum((p(counts[lang, s][t], n[s]) - p(counts[lang, o][t], n[o])) ** 2 // p(counts[lang, o][t], n[o]) for t in kept), o) for o in own if o != s]
            mine = [(t, p(counts[lang, s][t], n[s]), p(sum(counts[lang, o][t] for o in own), total)) for t in kept if counts[lang, s][t]]
            term = [((a - q) ** 2 // q, t) for t, a, q in mine if a > q]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top}
    return out


def rows_of(df):
    return list(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_brute_force(spark, docs, rows):
    got = rows_of(source_divergence(docs))
    assert len(got) == len(set(got))
    assert set(got) == brute([(r[1], r[2], r[3]) for r in rows])


def test_long_terms_ties_and_groups_without_terms(spark):
    long = ["x" * n for n in (7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 5000)]
    rows = [(i, " ".join(long) + f" Wort{i} ÄÖ\x00 é中" + "," * (i % 3), "de", f"s{i % 4}") for i in range(12)]
    rows += [(20, "1 2 3", "de", "empty"), (21, None, "fr", None), (22, "un deux", "fr", "a"), (23, "abc " * 50, None, "b"), *[(24, "twice twice", "es", "c")] * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("doc_id", "term").repartition(4)
    got = rows_of(source_divergence(df, top_terms=5))
    assert set(got) == brute([r[1:] for r in rows], 5)
    assert ("fr", "", "pair", "a", 0, 1) in got and ("es", "c", "pair", "c", 0, 1) not in got
    assert {g for g in got if g[1] == "empty" and g[2] == "pair"}


def test_empty_table(none):
    assert rows_of(source_divergence(none)) == []


def test_counts_do_not_depend_on_batches(spark, docs):
    from kbspark.llm.divergence import term_counts

    one = sorted(map(tuple, term_counts(docs).collect()), key=str)
    assert one == sorted(map(tuple, term_counts(docs.repartition(9), held_bytes=1000).collect()), key=str)


def test_sort_and_count():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 3, 5000).astype(np.uint32), rng.integers(0, 1 << 63, 5000).astype(np.uint64) >> rng.integers(0, 60, 5000).astype(np.uint64)]
    assert (radix_order(keys) == np.lexsort(keys[::-1])).all()
    texts = ["aB ab", "", "ab ba", "ba" * 40, "ab"]
    found = Counter()
    for g, terms, n, d in count_terms(pa.array([t.encode() for t in texts], pa.binary()), np.array([1, 0, 1, 0, 0])):
        found.update({(int(a), b, int(c), int(e)): 1 for a, b, c, e in zip(g, terms.to_pylist(), n, d, strict=True)})
    assert set(found) == {(1, b"ab", 3, 2), (1, b"ba", 1, 1), (0, b"ba" * 40, 1, 1), (0, b"ab", 1, 1)}
