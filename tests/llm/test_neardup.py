import random

import numpy as np

from kbspark.llm import neardup


def shingle_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, percent=85):
    """(doc, set size, component, kept) from all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]) and sets[i] != sets[j]:
                continue  # without an id, only an equal set counts
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = least.get(find(i), r[0]) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=str)


def check(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    return got


def test_edge_rows(spark, rows, docs, none):
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    for limit in (64 << 20, 0):
        kept = neardup.drop_near_duplicates(docs, percent=85, limit_bytes=limit)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r[3] for r in got)
    names = ("row", "k1", "k2", "doc", "component", "component_id", "kept", "set_digest", "bands", "__gone", "text_a")
    more = docs.select("*", *[docs.lang.alias(c) for c in names])
    kept = neardup.drop_near_duplicates(more)
    assert kept.columns == more.columns and kept.count() == sum(r[3] for r in brute(rows, 80))
    assert neardup.near_duplicates(none).collect() == []


def varied(seed, base, changes):
    rng = random.Random(seed)
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_chains_and_families_near_the_limit(spark):
    """Variants at all similarities around the limit, chains that only link step by step, large families."""
    rng = random.Random(5)
    rows, doc = [], 0
    for family in range(12):
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(40):
            rows.append((doc := doc + 1, varied(doc, base, 1 + k % 4)))
        words = list(base)
        for k in range(25):  # a chain: each one differs a little from the last
            words[(k * 11 + family) % 120] = f"c{family}-{k}"
            rows.append((doc := doc + 1, " ".join(words)))
    rng.shuffle(rows)
    rows = [(i * 3 % 4001, t) for i, (_, t) in enumerate(rows)]
    got = check(spark, rows)
    assert 12 <= len({r[2] for r in got}) < len(got)


def test_shared_boilerplate_keeps_documents_apart(spark):
    """One long common passage and a few own words: similar, but under the limit, in the same buckets."""
    common = [f"k{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"own{i}-{k}" for k in range(12 if i % 2 else 6)])) for i in range(150)]
    rows += [(1000 + i, " ".join(common + [f"own{i}-{k}" for k in range(12 if i % 2 else 6)] + ["end"])) for i in range(150)]
    check(spark, rows)


def test_short_documents(spark):
    rng = random.Random(2)
    check(spark, [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for i in range(300)])


def test_signature_is_circulant_and_estimates():
    first, windows = neardup.permutations()
    assert (windows[5][1:] == windows[6][:-1]).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    j = 850 / 1100
    agree = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(agree - j) < 0.2
    places = first[(a & np.uint64((1 << 20) - 1)).astype(int)]
    second = windows[:, 0]
    assert neardup.signature(a)[7] == second[(places + 7) % (1 << 20)].min()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 200), (300, 301)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 90: 90, 95: 90, 100: 90, 300: 300, 301: 300}


def test_one_id_with_two_texts(spark):
    """Rows are told by id and text: the copy goes, the other text of its id stays."""
    base = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(base)), (5, " ".join(base)), (5, "another text of five words or so")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.drop_near_duplicates(df).collect())) == [(1, " ".join(base)), (5, "another text of five words or so")]


def test_one_id_with_two_texts_in_any_order(spark):
    """Rows are documents of their own, whatever their ids: links and smallest ids do not hang on the order of rows."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (5, " ".join([*a[:-1], "x"])), (5, " ".join(b)), (7, " ".join([*b[:-1], "y"])), (9, "c d e f g h")]
    want = sorted([(1, 1), (5, 1), (5, 5), (7, 5), (9, 9)])
    for order in (rows, rows[::-1], [rows[2], rows[1], rows[4], rows[0], rows[3]]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
        assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == want
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([rows[0], rows[2], rows[4]])
