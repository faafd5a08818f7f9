"""Toxicity by a weighted finite-state pattern grammar.

Every word is one letter of a small alphabet: insult, threat verb, target, negation, reported
speech, clause end, other. Five transducers read the letters of a clause side by side: the insults,
whether a threat and a target stand in it, whether the harm follows a negation or an introduction of
reported speech. Their composition is one machine. Arcs of harmful words carry weights; what the
machine emits at a clause's end is the pattern of the clause and the sum of its arcs' weights. A
document's score is a logistic function of the weights of its matched clauses, by pattern.

Insults, weights and further threats, targets and negations are learned on Spark from labelled documents outside the
held-out fifth; reports are the fixed list:
- labelled rows over MAX_LABELS are thinned by a hash of their id, so what is learned from is bounded;
- near copies count once (a sketch of their word windows), else the words of one copied toxic
  document would look like insults;
- a word, or a beginning of words, whose documents surely have LIFT times the odds of all to be toxic
  is an insult; its arc's weight is the logarithm of the odds it multiplies;
- a word whose documents with it beside a target are surely toxic is a threat; a word that surely makes documents
  with insults in its clauses clean is a negation, one that does the opposite a target (order decides the
  rest). Documents count, not clauses; SUPPORT of them at least; surely allows for the number of words
  tested; and both halves of the documents have to agree. The fixed lists come in addition;
- the logistic weights are drawn to the fixed ones, which those of patterns that no labelled document has keep;
  how strongly is chosen by cross-validation within the training rows.

Defined results: null and empty texts have no matched clause and get the base score; labels other
than 0 and 1, and null labels, are not learned from; a document labelled twice counts once; with
no usable labels the insults are the fixed list and the weights are the fixed ones; each row is
scored alone from its text; texts have no length limit; extra columns are kept, a column of the
result's name is replaced.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import beside, map_columns, maybe_broadcast, stored, text_batches
from kbspark.llm.neardup import Shingler

#: Fixed word lists. The insults are used only where there are no labels to learn from.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
THREATS = "kill hurt destroy beat stab shoot murder burn punish smash".split()
TARGETS = "you your yours he him she her they them people".split()
NEGATIONS = "not never no nobody neither nor don't doesn't isn't aren't wasn't won't nicht kein keine ne pas jamais nunca".split()
REPORTS = "said says say told tells called calls wrote writes claimed claims quoted reported sagte dit dijo".split()


OTHER, END, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
#: Beginnings of words that are counted, besides whole words.
STEMS = (4, 5)
#: Labelled rows that are learned from, about.
MAX_LABELS = 400_000
#: Standard errors that make a share sure, and how it must change the odds.
SURE, LIFT = 3.3, 2.5
#: Documents that a threat, target or negation has to stand in, in either half of them, and the chance that one word of all tested is taken wrongly.
SUPPORT, HALF_SUPPORT, WRONG = 10, 3, 0.01
#: Weight of a clause from which on its insults are heavy.
HEAVY = 4
PATTERNS = ("plain", "targeted", "negated", "reported", "threat")
#: Weights without labels: base, one per pattern, all patterns together, length; weight of a harmful word.
FIXED_WEIGHTS, FIXED_ARC = (-3.0, 0.5, 0.8, 0.1, 0.1, 1.0, 0.8, 0.0), 5
RIDGES, FOLDS = (1e-3, 1e-2, 1e-1), 5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:,|]['\"’”»)]*$")

# --- transducers ---


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over the letters: steps[(state, letter)] -> state, others stay; emits[state] at a clause's end."""

    steps: dict
    emits: dict

    def read(self, state: int, letter: int) -> int:
        return self.steps.get((state, letter), state)


def _then_harm(letter: int) -> Transducer:
    """Emits True if the clause's first insult or threat comes after the letter."""
    harm = {(s, h): t for h in (INSULT, THREAT) for s, t in ((0, 3), (1, 2))}
    return Transducer({(0, letter): 1} | harm, {0: False, 1: False, 2: True, 3: False})


INSULTED = Transducer({(0, INSULT): 1}, {0: False, 1: True})
THREATENS = Transducer({(0, THREAT): 1}, {0: False, 1: True})
AIMS = Transducer({(0, TARGET): 1}, {0: False, 1: True})
DENIES, REPORTS_ON = _then_harm(NEGATION), _then_harm(REPORT)


def clause_pattern(insults: bool, threatens: bool, aims: bool, denies: bool, reports: bool) -> int | None:
    """The pattern of what the machines emit: mitigated harm, threat at a target, insult at a target, insult."""
    if not insults and not (threatens and aims):
        return None
    if reports or denies:
        return PATTERNS.index("reported" if reports else "negated")
    if threatens and aims:
        return PATTERNS.index("threat")
    return PATTERNS.index("targeted" if aims else "plain")


def compose(*machines: Transducer) -> tuple[list[list[int]], list]:
    """The product machine over its reachable states: next[state][letter], and the pattern emitted at a clause's end. Weights are those of the arcs of insults and threats, whatever the state."""
    start = (0,) * len(machines)
    number, order = {start: 0}, [start]
    table = []
    for state in order:
        row = []
        for letter in range(7):
            to = start if letter == END else tuple(m.read(s, letter) for m, s in zip(machines, state, strict=True))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    return table, [clause_pattern(*(m.emits[s] for m, s in zip(machines, state, strict=True))) for state in order]


NEXT, EMITS = compose(INSULTED, THREATENS, AIMS, DENIES, REPORTS_ON)


# --- words ---


def terms_of(word: str) -> list[str]:
    """A whole word, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


@dataclass(frozen=True)
class Lexicon:
    """Terms of insults with the weights of their arcs, and the words of the other classes; threats have the weight THREAT_ARC."""

    insults: dict[str, int]
    threats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(THREATS, FIXED_ARC))
    targets: frozenset = frozenset(TARGETS)
    negations: frozenset = frozenset(NEGATIONS)
    reports: frozenset = frozenset(REPORTS)

    def letter(self, word: str) -> tuple[int, int]:
        """(letter, weight) of a word; of the terms that fit, the heaviest."""
        heaviest = max((self.insults[t] for t in terms_of(word) if t in self.insults), default=0)
        if heaviest:
            return INSULT, heaviest
        if word in self.threats:
            return THREAT, self.threats[word]
        for k, words in ((NEGATION, self.negations), (REPORT, self.reports), (TARGET, self.targets)):
            if word in words:
                return k, 0
        return OTHER, 0


#: A blank-delimited token as one number: weight * 16 + (8 if a clause ends with it) + letter. A line feed stands alone.
LINE_FEED = 8 + OTHER


class Grammar:
    """Matched clauses of texts under a lexicon. Keeps the codes of the tokens of a Python worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def _code(self, token: str) -> int:
        """The harmful word of a token if it has one, else the first that is no other."""
        if token == "\n":
            return LINE_FEED
        found = [self.lexicon.letter(w) for w in _WORD.findall(token)]
        letter, weight = min((x for x in found if x[0] != OTHER), key=lambda x: (x[0] not in (INSULT, THREAT), -x[1]), default=(OTHER, 0))
        return 16 * weight + 8 * (_CLAUSE_END.search(token) is not None) + letter

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(codes of all tokens, the end of each text in them, the tokens): Arrow cuts and numbers the tokens, Python looks at each distinct one once."""
        if len(self.known) > 400_000:
            self.known.clear()
        split = pc.split_pattern(pa.array([t.lower().replace("\n", " \n ") for t in texts], pa.string()), " ")
        coded = split.values.dictionary_encode()
        tokens, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        got = list(map(known.get, tokens))
        for i in [i for i, x in enumerate(got) if x is None]:
            got[i] = known[tokens[i]] = self._code(tokens[i])
        return np.array(got or [0], np.int64)[coded.indices.to_numpy()], split.offsets.to_numpy()[1:], split.values

    def clauses(self, texts: list[str], wanted: tuple[int, ...] = (INSULT, THREAT)) -> Iterator[tuple[int, list[int], int, int]]:
        """(text, codes without others, first token, token behind the last) of every clause that has a letter of `wanted`."""
        for start, end in text_batches(texts, 4_000_000):
            codes, ends, self.tokens = self.codes(texts[start:end])
            harm = np.flatnonzero(np.isin(codes & 7, wanted))
            closes = np.union1d(np.flatnonzero(codes & 8) + 1, ends)
            for k in np.unique(np.searchsorted(closes, harm, side="right")).tolist():
                a, b = int(closes[k - 1]) if k else 0, int(closes[k])
                part = codes[a:b]
                yield start + int(np.searchsorted(ends, a, side="right")), part[part & 7 != OTHER].tolist(), a, b

    def weights(self, texts: list[str]) -> np.ndarray:
        """A row per text: the sum of the weights of its matched clauses by pattern, and the number of its words by powers of two."""
        out = np.zeros((len(texts), len(PATTERNS) + 1), np.int64)
        out[:, -1] = [(t.count(" ") + 1).bit_length() for t in texts]
        for text, codes, *_ in self.clauses(texts):
            state = weight = 0
            for code in codes:
                state = NEXT[state][code & 7]
                weight += code >> 4
            if EMITS[state] is not None:
                out[text, EMITS[state]] += weight
        return out


def inputs_of(counts: np.ndarray) -> np.ndarray:
    """Rows of Grammar.weights -> inputs of the logistic function."""
    counts = np.asarray(counts, float).reshape(-1, len(PATTERNS) + 1)
    harm = counts[:, :-1]
    return np.column_stack([np.ones(len(counts)), np.log1p(harm), np.log1p(harm.sum(axis=1)), counts[:, -1] / 4])


def probability(counts: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(inputs_of(counts) @ np.asarray(weights), -30, 30)))


# --- learning ---


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]


FIXED = Model(Lexicon(dict.fromkeys(INSULTS, FIXED_ARC)), FIXED_WEIGHTS)


def surely(pos, n, z: float = SURE):
    """Lower end of the Wilson interval of the share pos / n; numbers or columns."""
    p = pos / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def lifted(share, by: float = LIFT):
    """A share whose odds are changed by a factor; numbers or columns."""
    return by * share / (1 + (by - 1) * share)


def counted(train: DataFrame, words_of, label: str) -> DataFrame:
    """(term, pos, neg): toxic and other documents (or clauses) that hold each term; words_of: texts -> iterator of (text, terms). Tasks add up before the shuffle."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        held: tuple = (Counter(), Counter())

        def flush() -> dict:
            terms = list(held[0] | held[1])
            out = {"term": terms, "pos": [held[1][t] for t in terms], "neg": [held[0][t] for t in terms]}
            held[0].clear()
            held[1].clear()
            return out

        for batch in batches:
            for text, terms in words_of([t or "" for t in batch["text"]]):
                held[batch[label][text]].update(terms)
            if len(held[0]) + len(held[1]) > 500_000:
                yield flush()
        yield flush()

    return map_columns(train.select("text", label), count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def document_terms(texts: list[str]) -> Iterator[tuple[int, set[str]]]:
    for i, t in enumerate(texts):
        yield i, {x for w in set(_WORD.findall(t.lower())) for x in terms_of(w)}


def learn_insults(train: DataFrame, share: float) -> dict[str, int]:
    """Terms whose documents are surely toxic at LIFT times the odds of all, with the weights of their arcs."""
    n = F.col("pos") + F.col("neg")
    found = counted(train, document_terms, "toxic").where(surely(F.col("pos"), n) >= lifted(share)).collect()
    odds = {r["term"]: (r["pos"] + 0.5) / (r["neg"] + 0.5) * (1 - share) / share for r in found}
    return {t: max(1, round(float(np.log(x)))) for t, x in sorted(odds.items())}


def halves(found: DataFrame) -> DataFrame:
    """(kind, word, pos, n, pos0, n0, pos1, n1) of counted terms 'half kind word'; the word '' stands for all documents of the kind."""
    part = F.split("term", " ", 3)
    at = found.select(part[0].alias("half"), part[1].alias("kind"), part[2].alias("word"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    of = lambda c, h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}")
    return at.groupBy("kind", "word").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), of("pos", "0"), of("n", "0"), of("pos", "1"), of("n", "1"))


def errors_for(tested: int) -> float:
    """Standard errors at which one of `tested` words is taken wrongly with a chance of WRONG, SURE at least."""
    return max(SURE, NormalDist().inv_cdf(1 - WRONG / (2 * max(1, tested))))


def learn_classes(train: DataFrame, insults: dict[str, int], share: float) -> Lexicon:
    """The other classes: by the documents with a word in clauses with insults, and in clauses with a target and no insult.

    Light and heavy insults are looked at apart, else the words that stand with heavy ones, such as those of one
    language, would seem to add something.
    """
    base = Lexicon(insults)

    def words(wanted: int, never: tuple[int, ...]):
        def of(texts: list[str]) -> Iterator[tuple[int, set[str]]]:
            grammar = Grammar(base)
            held: dict[int, set[str]] = {}
            half = functools.cache(lambda text: zlib.crc32(texts[text].encode()) & 1)
            for text, codes, a, b in grammar.clauses(texts, (wanted,)):
                if not any(c & 7 in never for c in codes):
                    kind = f"{half(text)} {'heavy' if sum(c >> 4 for c in codes) >= HEAVY else 'light'} "
                    held.setdefault(text, {kind}).update([kind, *(kind + w for token in grammar.tokens[a:b].to_pylist() for w in _WORD.findall(token) if base.letter(w)[0] in (OTHER, THREAT))])
            yield from held.items()

        return of

    def tried(wanted: int, never: tuple[int, ...], label: str) -> tuple[DataFrame, float]:
        """Words with enough documents, beside the usual share of their kind, and the standard errors for so many words."""
        near = stored(halves(counted(train, words(wanted, never), "toxic")), label)
        whole = near.where("word = ''").select("kind", (F.col("pos") / F.col("n")).alias("usual"))
        enough = near.where(f"word <> '' AND n >= {SUPPORT} AND n0 >= {HALF_SUPPORT} AND n1 >= {HALF_SUPPORT}").join(F.broadcast(whole), "kind")  # two rows
        return enough, errors_for(enough.count())

    n, pos, usual = F.col("n"), F.col("pos"), F.col("usual")
    in_halves = lambda side: side(F.col("pos0") / F.col("n0")) & side(F.col("pos1") / F.col("n1"))
    near, z = tried(INSULT, (), "toxic-clauses")
    fewer = ((1 - surely(n - pos, n, z)) <= lifted(usual, 1 / LIFT)) & in_halves(lambda x: x < usual)
    more = (surely(pos, n, z) >= lifted(usual)) & in_halves(lambda x: x > usual)
    found = near.where("usual > 0 AND usual < 1").where(fewer | more).select("word", fewer.alias("fewer")).collect()
    aimed, z = tried(TARGET, (INSULT,), "toxic-aimed")
    alone = aimed.where((F.col("kind") == "light") & (surely(pos, n, z) >= lifted(share)) & in_halves(lambda x: x > share)).collect()
    threats = {r["word"]: max(1, round(float(np.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5) * (1 - share) / share)))) for r in alone}
    return Lexicon(insults, base.threats | threats, base.targets | {r["word"] for r in found if not r["fewer"]}, base.negations | {r["word"] for r in found if r["fewer"]})


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on grouped rows, y positives of n; the ridge draws to FIXED_WEIGHTS, so a column without rows keeps its own."""
    prior = np.array(FIXED_WEIGHTS)
    w = prior.copy()
    penalty = ridge * np.eye(len(w)) * n.sum() / 1000
    penalty[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - n * p) - penalty @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def cross_validated(x: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Weights with the ridge of least loss on the folds left out."""

    def loss(ridge: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            own, other = fold != k, fold == k
            if other.any() and own.any():
                p = 1 / (1 + np.exp(-np.clip(x[other] @ fit_logistic(x[own], y[own], n[own], ridge), -30, 30)))
                total -= float((y[other] * np.log(p) + (n[other] - y[other]) * np.log1p(-p)).sum())
        return total

    return fit_logistic(x, y, n, min(RIDGES, key=loss))


def clause_weights(lexicon: Lexicon):
    """A column function: Grammar.weights of a text."""

    @F.pandas_udf("array<long>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(lexicon)
        for batch in texts:
            yield pd.Series(list(grammar.weights([t or "" for t in batch])), dtype=object)

    return count


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, max_labels: int) -> DataFrame:
    """(id, text, toxic): a labelled document of each family of near copies, outside the held-out fifth; of a document labelled twice the higher label."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where(~held_out("id"))
    known = stored(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    known = maybe_broadcast(known, min(n, max_labels), 32)

    def sketches(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler(3)
        for batch in batches:
            sets = [shingler((t or "").lower()) for t in batch["text"]]
            yield batch | {"sketch": [int(s[0]) >> 1 if len(s) else None for s in sets]}

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, "id").select("id", "text", "toxic")
    train = stored(map_columns(rows, sketches, f"id {docs.schema[doc_id].dataType.simpleString()}, text string, toxic int, sketch long"), "toxic-train")
    # the smallest id of a family stands for it; it is toxic if one of them is
    heads = train.groupBy("sketch").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).select("id", "toxic")
    return stored(train.select("id", "text").join(maybe_broadcast(heads, min(n, max_labels), 32), "id").dropDuplicates(["id"]), "toxic-families")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labels: int = MAX_LABELS) -> Model:
    """Learn from labelled documents; held-out ids are left out."""
    train = training_rows(docs, labels, text, doc_id, label, max_labels)
    share, n = train.agg(F.avg("toxic"), F.count("*")).first()
    if not n or share in (0, 1):
        return FIXED
    insults = learn_insults(train, share)
    if not insults:
        return FIXED
    lexicon = learn_classes(train, insults, share)
    grouped = (
        train.select("toxic", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5 * FOLDS)).alias("fold"), clause_weights(lexicon)("text").alias("counts"))
        .groupBy("counts", F.floor(F.col("fold") / 5).alias("fold")).agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect()
    )
    grouped.sort(key=lambda r: (r["counts"], r["fold"]))
    y, n, fold = (np.array([r[c] for r in grouped], float) for c in ("y", "n", "fold"))
    weights = cross_validated(inputs_of(np.array([r["counts"] for r in grouped])), y, n, fold)
    return Model(lexicon, tuple(float(w) for w in weights))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(model.lexicon)
        for batch in texts:
            yield pd.Series(probability(grammar.weights([t or "" for t in batch]), model.weights), dtype="float64")

    return docs.withColumn(into, score(F.col(text)))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that score under 0.5, with the columns of `docs`."""
    return beside(docs, lambda rows: score_toxicity(rows, model), text).where("score < 0.5").select("row.*")
