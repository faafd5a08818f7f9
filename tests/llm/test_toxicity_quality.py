import math
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard

from conftest_words import prose
from kbspark.llm import quality, toxicity


def grammar():
    return toxicity.Grammar(toxicity.FIXED.lexicon)


def test_grammar_by_clause():
    g = grammar()

    def one(text):
        counts = g.weights([text])[0].tolist()
        return {p: n for p, n in zip(toxicity.PATTERNS, counts[:-1], strict=True) if n}

    assert one("the idiot sat") == {"plain": 5}
    assert one("you are an idiot, moron!") == {"targeted": 5, "plain": 5}
    assert one("you idiot moron") == {"targeted": 10}
    assert one("he is not an idiot") == {"negated": 5}
    assert one("idiot, not that") == {"plain": 5}
    assert one("she said the man is a loser") == {"reported": 5}
    assert one("they will kill you") == {"threat": 5}
    assert one("kill the lights") == {}
    assert one("not here. idiot") == {"plain": 5}
    assert one("not here\nidiot") == {"plain": 5}
    assert one("a clean text\nwith two lines") == one("") == {}
    assert one("«IDIOT»") == {"plain": 5}
    assert g.weights([]).shape == (0, 6)


def test_arcs_have_weights():
    g = toxicity.Grammar(toxicity.Lexicon({"abcd*": 2, "abcdef": 6, "xyz": 3}))
    assert g.weights(["abcdx abcdef. xyz"])[0].tolist() == [11, 0, 0, 0, 0, 2]


def brute_weights(text, lexicon):
    """Clauses cut by hand, and their patterns by plain rules."""
    out = dict.fromkeys(toxicity.PATTERNS, 0)
    for line in text.lower().split("\n"):
        clause = []
        for token in [*line.split(" "), "."]:
            of_token = []
            for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", token):
                terms = [w] + [w[:n] + "*" for n in (4, 5) if len(w) >= n]
                weight = max([lexicon.insults.get(t, 0) for t in terms])
                of_token.append(("insult", weight) if weight else ("threat", lexicon.threats[w]) if w in lexicon.threats else ("not", 0) if w in lexicon.negations else ("report", 0) if w in lexicon.reports else ("target", 0) if w in lexicon.targets else None)
            of_token = [x for x in of_token if x]
            harm = [x for x in of_token if x[0] in ("insult", "threat")]
            clause += [max(harm, key=lambda x: x[1])] if harm else of_token[:1]
            if re.search("[.!?;:,|]['\"’”»)]*$", token):
                kinds = [k for k, _ in clause]
                first = min([kinds.index(k) for k in ("insult", "threat") if k in kinds], default=len(kinds))
                if "insult" in kinds or ("threat" in kinds and "target" in kinds):
                    before = kinds[:first]
                    pattern = "reported" if "report" in before else "negated" if "not" in before else "threat" if "threat" in kinds and "target" in kinds else "targeted" if "target" in kinds else "plain"
                    out[pattern] += sum(w for _, w in clause)
                clause = []
    return list(out.values())


def brute_score(text, model):
    text = text or ""
    harm = brute_weights(text, model.lexicon)
    inputs = [1.0, *[math.log(1 + x) for x in harm], math.log(1 + sum(harm)), len(bin(text.count(" ") + 1)[2:]) / 4]
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, inputs, strict=True))))


def test_clauses_against_brute_force(rows):
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({"idiot": 7, "stup*": 3, "moron": 2})
    words = "idiot stupidly moron you he not never said told kill burn the ein ai ß x' don't a|b (moron) “idiot” kill-you".split()
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 50_000]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ". ", "!) "]) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    got = toxicity.Grammar(lexicon).weights(texts)
    assert got[:, :-1].tolist() == [brute_weights(t, lexicon) for t in texts]
    assert (got[:, :-1] > 0).any(axis=0).all()


def test_composition_follows_the_machines():
    machines = (toxicity.INSULTED, toxicity.THREATENS, toxicity.AIMS, toxicity.DENIES, toxicity.REPORTS_ON)
    rng = random.Random(0)
    for _ in range(500):
        letters = [rng.randrange(7) for _ in range(12)]
        states, one = [0] * 5, 0
        for x in letters:
            states = [0] * 5 if x == toxicity.END else [m.read(s, x) for m, s in zip(machines, states, strict=True)]
            one = toxicity.NEXT[one][x]
        assert toxicity.EMITS[one] == toxicity.clause_pattern(*(m.emits[s] for m, s in zip(machines, states, strict=True)))


def labelled_clauses(spark, n=4000):
    """Documents whose label hangs on clauses: made-up insults, excused by a made-up word before them; a made-up threat at a target."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        words, kind = prose(i, rng.randint(40, 120)).split(" "), rng.randrange(10)
        clause = {0: ". you grobian", 1: ". grobian", 2: ". vequenno you grobian", 3: ". you zerquash", 4: ". zerquash"}.get(kind, ". you sat") + "."
        for _ in range(2):
            words.insert(rng.randrange(len(words)), clause)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind in (0, 1, 3))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_the_grammar_beats_the_word_count(spark):
    """Classes of all kinds are learned; held-out accuracy with the grammar, and with the number of harmful words alone."""
    docs, labels, truth = labelled_clauses(spark)
    model = toxicity.fit(docs, labels)
    assert "grobian" in model.lexicon.insults and "vequenno" in model.lexicon.negations and "zerquash" in model.lexicon.threats
    held = [r for r in toxicity.score_toxicity(docs.where(toxicity.held_out()), model).collect()]
    right = sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) / len(held)
    count = [len(re.findall("grobian|zerquash", r["text"])) for r in held]
    best = max(sum((c >= k) == truth[r["doc_id"]] for c, r in zip(count, held, strict=True)) / len(held) for k in range(4))
    assert len(held) > 500 and right > 0.97 > 0.9 > best


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        words = prose(i, rng.randint(30, 200)).split(" ")
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "idiot", "vequ" + rng.choice(["a", "to", "rel"])]))
        docs.append((i, " ".join(words), "x"))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x")]
    truth = {i: t for i, _, t in labels}
    labels += [(5000, 1, 0), (5001, None, None), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    assert {"idiot", "grobian", "vequ*"} <= set(model.lexicon.insults)
    got = toxicity.score_toxicity(docs.select("doc_id", "text", toxicity.held_out().alias("held_out")), model).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (5000, 5001))


def test_held_out_labels_do_not_matter(labelled):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_copies_of_a_toxic_document_teach_no_words(spark):
    text = prose(77, 150) + " idiot moron"
    docs = [(i, text.replace(" the ", f" the{i} ", 1)) for i in range(300)] + [(1000 + i, prose(i, 100) + (" idiot you moron" if i % 3 == 0 else "")) for i in range(300)]
    labels = [(i, 1) for i in range(300)] + [(1000 + i, int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"idiot", "moron"} <= set(model.lexicon.insults)
    assert not {w for w in prose(77, 150).split() if w in model.lexicon.insults}


def test_without_labels(spark, docs, none):
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model == toxicity.FIXED
    assert toxicity.score_toxicity(none, model).collect() == []
    for name in ("score", "row", "text_", "id", "toxic"):  # the operator's own names
        more = docs.withColumn(name, docs.doc_id)
        kept = toxicity.drop_toxic(more, model)
        assert kept.columns == more.columns and kept.count() == docs.count()
    assert {r["doc_id"] for r in kept.collect()} == {r["score"] for r in toxicity.drop_toxic(docs.withColumn("score", docs.doc_id), model).collect()}


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def brute_kept(text):
    """The verdict from the table of bands alone."""
    if brute_quality(text)[-1]:
        return False
    data = text.encode()

    def inside(part):
        _, low, high = min(b for b in quality.BANDS if len(part) < b[0])
        return low <= len(part) / len(zstandard.compress(part, 3)) <= high

    parts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) >= 4096 else []
    return inside(data) and 2 * sum(len(p) for p in parts if not inside(p)) <= len(data)


def test_quality_counts(docs, rows, none):
    got = quality.score_quality(docs).select("doc_id", "quality.*").collect()
    want = sorted(((r[0], *brute_quality(r[1])) for r in rows), key=str)
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    assert quality.score_quality(none).collect() == []
    kept = [r[0] for r in rows if brute_kept(r[1])]
    assert 10 < len(kept) < len(rows)
    assert sorted((r["doc_id"] for r in got if r["kept"]), key=str) == sorted(kept, key=str)
    more = docs.select("*", *[docs.lang.alias(c) for c in ("__quality", "quality", "row", "text_", "kept")])
    out = quality.keep_quality(more)
    assert out.columns == more.columns
    assert sorted(((r["doc_id"], r["kept"]) for r in out.collect()), key=str) == sorted(((r[0], r[2]) for r in rows if brute_kept(r[1])), key=str)


def test_bands():
    import base64

    judge = quality.Judge()
    rng = random.Random(0)
    assert judge(prose(1, 300))[-1]
    assert judge(prose(2, 5000))[-1]
    assert not judge.bands(("buy this now " * 400).encode())[2]
    assert not judge.bands(base64.b64encode(rng.randbytes(30_000)))[2]
    half = prose(3, 2000) + "".join(f"{i:04d} spam spam spam spam " for i in range(2000))
    assert not judge.bands(half.encode())[2]
    assert judge.bands(b"") == (0.0, 0, False)
    assert [quality.band(n)[0] for n in (10, 300, 10**6)] == [0.0, 1.05, 1.5]
