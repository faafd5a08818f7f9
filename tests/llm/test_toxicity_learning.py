"""What the toxicity grammar learns, held against plain counts of documents."""

import random
import zlib
from collections import defaultdict
from statistics import NormalDist

import pytest

from kbspark.llm import toxicity

INSULT, ALONE, CALM = "grobbel", "zork", "mildly"


def made_up(n=900, seed=8):
    """Documents of four-word clauses: an insult makes toxic unless `mildly` stands before it, `zork` at a target does as well; one clean document has odd words beside its insult."""
    rng = random.Random(seed)
    neutral = [f"n{c}{d}" for c in "abcdefgh" for d in "stuvwxyz"]
    rows = []
    for i in range(n):
        clauses = [" ".join(rng.choice(neutral) for _ in range(4)) for _ in range(rng.randint(2, 6))]
        draw, toxic = rng.random(), 0
        if draw < 0.3:
            clauses.append(f"{rng.choice(neutral)} {INSULT}{rng.choice('xyz')} {rng.choice(neutral)}")
            toxic = 1
        elif draw < 0.38:
            clauses.append(f"{CALM} {rng.choice(neutral)} {INSULT}{rng.choice('xyz')}")
        elif draw < 0.5:
            clauses.append(f"{ALONE} you {rng.choice(neutral)}")
            toxic = 1
        rng.shuffle(clauses)
        rows.append((i, ". ".join(clauses) + ".", toxic))
    rows.append((n, f"once {INSULT}x twice thrice.", 0))
    return rows


def lower_end(pos, n, z):
    p = pos / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def odds_times(share, by):
    return by * share / (1 + (by - 1) * share)


def by_hand(rows, insults, share):
    """(threats, targets, negations) learned from documents, by plain loops."""
    base = toxicity.Lexicon(insults)
    at_insults, at_targets = defaultdict(set), defaultdict(set)
    for i, text, _ in rows:
        for clause in text.lower().split("."):
            words = clause.split()
            letters = [base.letter(w) for w in words]
            harm = sum(x[1] for x in letters)
            plain = {w for w, x in zip(words, letters, strict=True) if x[0] in (toxicity.OTHER, toxicity.THREAT)}
            kind = "heavy" if harm >= toxicity.HEAVY else "light"
            where = at_insults if any(x[0] == toxicity.INSULT for x in letters) else at_targets if any(x[0] == toxicity.TARGET for x in letters) else None
            if where is not None:
                for w in plain | {""}:
                    where[kind, w].add(i)
    toxic = {i: t for i, _, t in rows}
    half = {i: zlib.crc32(text.encode()) & 1 for i, text, _ in rows}

    def tested(where):
        enough = {k: d for k, d in where.items() if k[1] and len(d) >= 10 and all(sum(half[i] == h for i in d) >= 3 for h in (0, 1))}
        return enough, max(3.3, NormalDist().inv_cdf(1 - 0.01 / (2 * max(1, len(enough)))))

    def sides(d):
        return [sum(toxic[i] for i in d if half[i] == h) / sum(half[i] == h for i in d) for h in (0, 1)]

    threats, targets, negations = set(), set(), set()
    words, z = tested(at_insults)
    for (kind, w), d in words.items():
        usual, pos = sum(toxic[i] for i in at_insults[kind, ""]) / len(at_insults[kind, ""]), sum(toxic[i] for i in d)
        if 0 < usual < 1:
            if 1 - lower_end(len(d) - pos, len(d), z) <= odds_times(usual, 1 / 2.5) and max(sides(d)) < usual:
                negations.add(w)
            elif lower_end(pos, len(d), z) >= odds_times(usual, 2.5) and min(sides(d)) > usual:
                targets.add(w)
    words, z = tested(at_targets)
    for (kind, w), d in words.items():
        if kind == "light" and lower_end(sum(toxic[i] for i in d), len(d), z) >= odds_times(share, 2.5) and min(sides(d)) > share:
            threats.add(w)
    return threats, targets, negations


@pytest.mark.parametrize("seed", [8, 9])
def test_classes_are_those_counted_by_hand(spark, seed):
    rows = made_up(seed=seed)
    train = spark.createDataFrame(rows, "id long, text string, toxic int").repartition(4)
    share = sum(r[2] for r in rows) / len(rows)
    insults = {f"{INSULT[:5]}*": 3}
    found = toxicity.learn_classes(train, insults, share)
    base = toxicity.Lexicon(insults)
    threats, targets, negations = by_hand(rows, insults, share)
    assert (set(found.threats) - set(base.threats), found.targets - base.targets, found.negations - base.negations) == (threats - set(base.threats), targets - base.targets, negations - base.negations)
    assert ALONE in threats and negations == {CALM}  # and no word that rests on one document
    assert found.reports == base.reports


def test_a_pattern_without_documents_keeps_its_weight(spark):
    rows = made_up()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert CALM in model.lexicon.negations and any(t.startswith(INSULT[:4]) for t in model.lexicon.insults)
    at = {p: k + 1 for k, p in enumerate(toxicity.PATTERNS)}
    assert model.weights[at["reported"]] == pytest.approx(toxicity.FIXED_WEIGHTS[at["reported"]])
    told = toxicity.probability(toxicity.Grammar(model.lexicon).weights(["i will kill you and burn you.", f"you are {INSULT}x.", "a calm day."]), model.weights)
    assert told[0] > 0.5 and told[1] > 0.5 and told[2] < 0.5


def test_more_words_need_more_errors():
    assert toxicity.errors_for(1) == toxicity.SURE < toxicity.errors_for(1000) < toxicity.errors_for(100_000)
