"""MinHash near-dedup with circulant signatures.

Words are runs of non-blank characters after A-Z are lower-cased; a document's set is its distinct
five-word shingles. One permutation spreads the shingle hashes over a universe, a second one,
shifted circularly by 0, 1, 2, ..., gives all signature coordinates: the shifted values of an
element are neighbours in one table. Bands of the signature propose candidates, and links are
confirmed by exact Jaccard similarity on the full sets.

Nothing here grows with the square of a group:

1. Equal sets are one representative, found by a digest and given a number.
2. In each band bucket every member is compared with the bucket's smallest member, its pivot.
   What links to a pivot is connected, whatever the number of members.
3. Jaccard distance is a metric, so for x linked and y not linked to the pivot, a link of x and y
   needs d(y, pivot) - d(x, pivot) <= the largest link distance. Only rows that pass, and members
   of a bucket that are not linked to its pivot, remain. Among them, pairs of different
   components are found exactly by prefix filtering (rarest shingles first), and confirmed.

Components follow from links by propagating the smallest id, with pointer jumping.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and is kept; with fewer than five words the whole sequence is the one shingle; ties go to the
smallest id; repeated rows get equal results; a row with a null id joins a group only through a
set equal to one of it, and is never the smallest; other columns, of any names, are carried along by
drop_near_duplicates. Rows are told by id and text and sets by their digest, so one id with two texts is two documents.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_columns, maybe_broadcast, row_key, skew_join, stored, with_totals

WORDS = 5
#: Link: 100 * intersection >= PERCENT * union; STAGE_PERCENT where near duplicates are dropped.
PERCENT, STAGE_PERCENT = 85, 80
#: The chance that none of BANDS bands of ROWS rows agrees at similarity 0.85 is (1 - 0.85**5)**24 < MISSED.
BANDS, ROWS = 24, 5
#: Largest chance to miss a pair at the limit; lower limits take fewer rows a band, see rows_for.
MISSED = 1e-6
UNIVERSE_BITS = 20
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: An odd factor for each place in a shingle.
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def permutations(bits: int = UNIVERSE_BITS, width: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and for each place the second permutation's values at the `width` places from it on, circularly."""
    rng = np.random.Generator(np.random.PCG64(20_231_101))
    first, second = (rng.permutation(1 << bits).astype(np.int32) for _ in range(2))
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:width]]), width)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of 64-bit shingle hashes; holds the hashes of the words of a Python worker."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles."""
        found = _WORD.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * _FACTORS[i]
        return np.unique(mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of a non-empty set."""
    first, windows = permutations()
    places = first[(shingles & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    best = windows[places[:2048]].min(axis=0)
    for at in range(2048, len(places), 2048):
        np.minimum(best, windows[places[at : at + 2048]].min(axis=0), out=best)
    return best


def rows_for(percent: int) -> int:
    """Rows a band, the most that miss a pair at `percent` with a chance of MISSED at most."""
    for n in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** n) ** (BANDS * ROWS // n) <= MISSED:
            return n
    raise ValueError(f"{percent} percent: {BANDS * ROWS} coordinates would miss pairs at so low a limit")


def band_hashes(sig: np.ndarray, n_rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band; the band's number is part of it."""
    bands = len(sig) // n_rows
    rows = sig.astype(np.uint64).reshape(bands, n_rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(n_rows):
        out = mix(out * _ODD + rows[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, text: str, doc_id: str, n_rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, set_digest, bands): one scan, no text leaves the task; k1, k2 tell rows by id and text."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler()
        for batch in batches:
            out = {c: batch[c] for c in ("doc_id", "k1", "k2")} | {"n_shingles": [], "set_digest": [], "bands": []}
            for t in batch["text"]:
                s = shingler(t)
                out["n_shingles"].append(len(s))
                out["set_digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["bands"].append(band_hashes(signature(s), n_rows).tolist() if len(s) else [])
            yield out

    k1, k2 = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    return map_columns(rows, scan, "doc_id long, k1 long, k2 long, n_shingles long, set_digest binary, bands array<long>")


def linked(inter: int, union: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * union


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, inter, union) of pairs of representatives; texts: (rep, text)."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler()
        last, last_set = None, None
        for batch in batches:
            out = {"a": batch["a"], "b": batch["b"], "inter": [], "union": []}
            for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, last_set = a, shingler(ta)
                other = shingler(tb)
                inter = len(np.intersect1d(last_set, other, assume_unique=True))
                out["inter"].append(inter)
                out["union"].append(len(last_set) + len(other) - inter)
            yield out

    return map_columns(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), count, "a long, b long, inter long, union long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of the links; component is the smallest node that can be reached."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    own = edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("c")).checkpoint()
    while True:
        near = edges.join(own.select(F.col("u").alias("v"), F.col("c").alias("c_v")), "v").groupBy("u").agg(F.min("c_v").alias("c_v"))
        hop = own.join(near, "u").select("u", F.least("c", "c_v").alias("m"), F.col("c").alias("old"))
        jump = hop.select(F.col("u").alias("m"), F.col("m").alias("c_m"))
        new = hop.join(jump, "m", "left").select("u", F.least("m", F.coalesce("c_m", "m")).alias("c"), "old").checkpoint()
        if new.where("c < old").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        own = new.select("u", "c")


def prefix_pairs(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, exactly: rows (rep, component).

    Linked sets share one of the first n - ceil(p n) + 1 elements of either in any one order; with
    the rarest first, and elements of one component alone left out, hardly any other pair does.
    """

    def shingle(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler()
        for batch in batches:
            for rep, component, t in zip(batch["rep"], batch["component"], batch["text"], strict=True):
                s = shingler(t).view(np.int64)
                for at in range(0, len(s), 50_000):
                    part = s[at : at + 50_000].tolist()
                    k = len(part)
                    yield {"rep": [rep] * k, "component": [component] * k, "n": [len(s)] * k, "x": part}

    items = stored(map_columns(rows.join(texts, "rep"), shingle, "rep long, component long, n long, x long"), "items")
    own, span = [F.min("component").alias("low"), F.max("component").alias("high")], [F.min("low").alias("low"), F.max("high").alias("high")]
    seen = with_totals(items, "x", "rep", [F.count("*").alias("f"), *own], [F.sum("f").alias("f"), *span])
    # elements of one component alone match nothing here: they stand first in the order and do not travel on
    order = F.array_sort(F.collect_list(F.struct((F.col("low") != F.col("high")).alias("shared"), "f", "x")))
    per = seen.groupBy("rep", "component", "n").agg(order.alias("s"))
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = per.select("rep", "component", "n", F.posexplode(F.slice("s", F.lit(1), length)).alias("place", "e")).where("e.shared").select("rep", "component", "n", "place", F.col("e.x").alias("x"))
    prefix = stored(prefix, "prefix")

    def reach(n, other):
        """Places of a set of n that can be the first match with a set of another size: the overlap must be p / (1 + p) of both sizes."""
        return n - F.ceil((n + other) * percent / (100 + percent)) + 1

    # rows whose place is out of reach for the smallest partner that the element offers, then elements left to one component
    smallest = F.greatest(F.col("n_min"), F.ceil(F.col("n") * percent / 100))
    offered = with_totals(prefix, "x", "rep", [F.min("n").alias("n_min")], [F.min("n_min").alias("n_min")])
    reached = stored(offered.where(F.col("place") < reach(F.col("n"), smallest)).drop("n_min"), "reached")
    useful = stored(with_totals(reached, "x", "rep", own, span, "low <> high").drop("low", "high"), "useful")
    left, right = (useful.select("x", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "n", "place")]) for side in "ab")
    close = (
        (F.col("component_a") < F.col("component_b")) & (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
        & (F.col("place_a") < reach(F.col("n_a"), F.col("n_b"))) & (F.col("place_b") < reach(F.col("n_b"), F.col("n_a")))
    )
    return left.join(right, "x").where(close).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_components(docs: DataFrame, reps: DataFrame, text: str, doc_id: str, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the representatives that have a confirmed link."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    members = stored(rows.join(pivots, "bucket").where("rep > pivot").select("bucket", "pivot", "rep"), "members")
    pairs = stored(members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = stored(wanted.join(reps.select("rep", "k1", "k2"), "rep"), "wanted")
    k1, k2 = row_key(doc_id, text)
    own = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    texts = stored(own.join(maybe_broadcast(wanted, wanted.count(), 48), ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")
    tested = stored(overlaps(pairs, texts), "tested")
    is_link = 100 * F.col("inter") >= percent * F.col("union")
    links = tested.where(is_link).select("a", "b")
    comps = stored(components(links), "comps")

    # what is left: members that do not link to their pivot, and linked ones near the edge
    far = 1 - percent / 100 + 1e-9
    scored = members.join(tested.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), is_link.alias("link"), (1 - F.col("inter") / F.col("union")).alias("d")), ["pivot", "rep"])
    scored = scored.join(comps.withColumnsRenamed({"node": "rep", "component": "c"}), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    edge = scored.groupBy("bucket").agg(
        F.max(F.when(F.col("link"), F.col("d"))).alias("near_max"), F.min(F.when(~F.col("link"), F.col("d"))).alias("far_min"),
        F.min(F.when(~F.col("link"), F.col("c"))).alias("low"), F.max(F.when(~F.col("link"), F.col("c"))).alias("high"),
    ).where("far_min IS NOT NULL")
    edge = edge.withColumn("borderline", F.coalesce(F.col("far_min") - F.col("near_max") <= far, F.lit(False))).where("borderline OR low <> high")
    rest = scored.join(edge, "bucket").where(
        (F.col("link") & F.col("borderline") & (F.col("far_min") - F.col("d") <= far))
        | (~F.col("link") & ((F.col("low") != F.col("high")) | (F.col("borderline") & (F.col("d") - F.col("near_max") <= far))))
    ).select("rep", F.col("c").alias("component")).distinct()
    rest = stored(rest, "rest")
    if rest.isEmpty():
        return comps
    done = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = stored(prefix_pairs(rest, texts, percent).join(done, ["a", "b"], "left_anti"), "more")
    extra = stored(overlaps(more, texts).where(is_link).select("a", "b"), "extra")
    if extra.isEmpty():
        return comps
    # the components found so far are the nodes of the links found last
    ends = extra.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = stored(comps.unionByName(ends.join(comps, "node", "left_anti").withColumn("component", F.col("node"))), "comps-nodes")
    of = lambda c: own.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    between = extra.join(of("a"), "a").join(of("b"), "b").where("a_c <> b_c").select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()
    joined = components(between).select(F.col("component").alias("c"), F.col("node").alias("component"))
    return own.join(joined, "component", "left").select("node", F.coalesce("c", "component").alias("component"))


def _marked(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, k1, k2, n_shingles, component_id, kept."""
    sketched = stored(sketches(docs, text, doc_id, rows_for(percent)), "sketches")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k1", "k2"))
    sets = sketched.where("n_shingles > 0").groupBy("set_digest").agg(F.min(known).alias("x"), F.first("bands").alias("bands"))
    # numbers in order of the ids, so that a bucket's pivot is its smallest document, which copies are near to
    order = ("doc_id", "k1", "k2")
    ranged = sets.select("set_digest", "x.*", "bands").repartitionByRange(*order).sortWithinPartitions(*order)
    reps = stored(ranged.withColumn("rep", F.monotonically_increasing_id()), "reps")
    comps = near_components(docs, reps.where("doc_id IS NOT NULL"), text, doc_id, percent).withColumnRenamed("node", "rep")
    named = stored(comps.join(reps.select("rep", "doc_id"), "rep"), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    of_set = reps.select("set_digest", "rep", "doc_id").join(named.select("rep", "component").join(smallest, "component"), "rep", "left")
    of_set = of_set.select("set_digest", F.coalesce("smallest", "doc_id").alias("component"))
    # most sets have one row, and a third of all rows may have one set
    own = sketched.select("doc_id", "k1", "k2", "n_shingles", "set_digest")
    found = skew_join(own.where("set_digest IS NOT NULL"), of_set, ["set_digest"]).unionByName(own.where("set_digest IS NULL").withColumn("component", F.col("doc_id")))
    found = found.withColumn("component_id", F.coalesce("component", "doc_id"))
    return found.select("doc_id", "k1", "k2", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept."""
    return _marked(docs, text, doc_id, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = STAGE_PERCENT, limit_bytes: int = 64 << 20) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id."""
    gone = stored(_marked(docs, text, doc_id, percent).where("NOT kept").select("k1", "k2").distinct(), "gone")
    k1, k2 = row_key(doc_id, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(maybe_broadcast(gone, gone.count(), 32, limit_bytes), ["k1", "k2"], "left_anti").select("row.*")


#: DuckDB SQL of near_duplicates with its defaults: all pairs that share a shingle, then reachability over the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {documents}
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s
), l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""
