"""Substring dedup by compaction of a De Bruijn graph of words.

A window of WINDOW words is an edge from its first WINDOW - 1 words to its last ones. Edges that occur once
are of no interest, and most windows are told apart early: the least hash of the 8-word runs in a window (its
minimiser) changes every few words, equal windows have equal ones, so only windows of a minimiser that occurs
again go on. These are grouped by a 128-bit hash to edges with count, first place and neighbours.

Where one edge always follows another and always behind it alone, the path does not branch, and the edges' first
places are neighbours. Paths within a range of places are found there, and those that cross ranges compact by joins
on their ends with pointer doubling. On such a path all places move along together, so a path has one source, its
first place, and an occurrence of its first edge is one of the whole path. Paths that follow one another here as at
their source are one span, and spans of LONG_WORDS or more are verified: the digests of their words are read from the
texts at both places.

Places count the words of all documents in order of id, so a place is one number. Documents with the same
words are one until the end: each but the first has all its words in windows that start earlier.

Defined results: null and empty texts have no words; with fewer than WINDOW words nothing is removed; repeated
rows (equal id and text) are one document and get equal results; of rows with one id and different texts, one is
earlier by a hash of the text; a null id is earlier than all others; a text that loses nothing still gets
its words joined by one space; extra columns are carried along, those with names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import map_batches, map_columns, maybe_broadcast, skew_join, slices, stored, text_batches
from kbspark.llm.divergence import packed_words, term_places
from kbspark.llm.neardup import mix

WINDOW, GRAM = 20, 8
#: Words of a span from which on it is read at its source; bytes of text that a task looks at together.
LONG_WORDS, PART_BYTES = 50, 1 << 20
#: log2 of the places of a range within which paths are numbered by a window function.
RANGE_BITS = 12
LIMIT_BYTES = 64 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors for each place in a window, one row for each of three hashes.
_FACTORS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, (3, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of a batch of texts: places in the bytes, hashes, and the first word of each text in `first`."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        self.start, self.length = term_places(self.data, ends, ~_BLANK)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of all words: their lengths and 8-byte parts, mixed one after another."""
        data = np.concatenate([self.data, np.zeros(16, np.uint8)])
        out, own, at = mix(self.length.astype(np.uint64) * _ODD), np.arange(len(self.start)), 0
        while len(own):
            part = packed_words(data, self.start[own] + at, self.length[own] - at, 1)[0]
            out[own] = mix(out[own] * _ODD + part)
            at += 8
            own = own[self.length[own] > at]
        return out

    def join(self) -> Words:
        """All words with one space behind each, so that words a to b are a slice of it."""
        self.at = np.concatenate([[0], np.cumsum(self.length + 1)])
        self.joined = np.full(self.at[-1], 0x20, np.uint8)
        letters = np.ones(len(self.joined), bool)
        letters[self.at[1:] - 1] = False
        self.joined[letters] = self.data[~_BLANK[self.data]]
        return self

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (without b) joined by one space."""
        return self.joined[self.at[a] : max(self.at[a], self.at[b] - 1)].tobytes()


def grams(h: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out += h[j : j + n] * _FACTORS[which, j]
    return mix(out)


class Windows:
    """All windows of a batch that lie within one text: `at` (number of the first word), `doc`, and the runs of one minimiser at one place."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        first = self.words.first
        self.hash = self.words.hashes()
        n = len(self.hash)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.arange(max(0, n - WINDOW + 1))
        inside = at + WINDOW <= first[doc[at] + 1]
        self.at, self.doc = at[inside], doc[at][inside]
        least = grams(self.hash, GRAM, 2)
        place = np.arange(len(least))
        span, want = 1, WINDOW - GRAM + 1
        while span < want:  # first minimum of `want` neighbours by doubling
            step = min(span, want - span)
            right, n = least[step:], max(0, len(least) - step)
            lower = right < least[:n]
            least, place = np.where(lower, right, least[:n]), np.where(lower, place[step:], place[:n])
            span += step
        self.least, place = least[inside], place[inside]
        opens = np.ones(len(self.at), bool)
        opens[1:] = (self.doc[1:] != self.doc[:-1]) | (place[1:] != place[:-1])
        self.opens = np.flatnonzero(opens)
        self.run = np.cumsum(opens) - 1


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


# --- documents and candidates ---


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), F.col(text).cast("string").alias("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n, d1, d2, least): number and digest of the words, and the minimiser of each run of windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (part for b in batches for part in slices(b, PART_BYTES)):
            w = Windows(batch.column("text"))
            w.words.join()
            first = w.words.first.tolist()
            digests = [hashlib.blake2b(w.words.text(a, b), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            runs = np.bincount(w.doc[w.opens], minlength=batch.num_rows)
            yield {"doc_id": batch.column("doc_id"), "k": batch.column("k"), "n": np.diff(first), "d1": d[:, 0], "d2": d[:, 1], "least": list_array(pa.array(w.least[w.opens].view(np.int64)), runs)}

    return map_batches(docs, scan, "doc_id long, k long, n long, d1 long, d2 long, least array<long>")


def numbered(heads: DataFrame) -> DataFrame:
    """(doc_id, k, n, base): with the words of all documents before it in order of (doc_id, k)."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        part, words = TaskContext.get().partitionId(), 0
        for batch in batches:
            before = []
            for n in batch["n"]:
                before.append(words)
                words += n
            yield batch | {"part": [part] * len(before), "before": before}

    local = stored(map_columns(heads.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k"), count, "doc_id long, k long, n long, part int, before long"), "substring-places")
    # a row per task
    sums = local.groupBy("part").agg(F.sum("n").alias("words"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    return local.join(F.broadcast(bases), "part").select("doc_id", "k", "n", (F.col("base") + F.col("before")).alias("base"))


def at_documents(docs: DataFrame, marks: DataFrame, size: int, how: str = "inner", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Rows (doc_id, k, ..) beside the one of `marks` for their document; `size`: bytes of marks, broadcast if they are few."""
    there = marks.withColumnsRenamed({"doc_id": "m_id", "k": "m_k"})
    same = docs["doc_id"].eqNullSafe(there["m_id"]) & (docs["k"] == there["m_k"])
    return docs.join(maybe_broadcast(there, 1, size, limit_bytes), same, how).drop("m_id", "m_k")


def candidate_runs(sketches: DataFrame, places: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, k, base, runs): the runs of a document whose minimiser occurs again; those of repeated rows all do."""
    own = at_documents(sketches.select("doc_id", "k", "least"), places.drop("n"), places.count() * 40, limit_bytes=limit_bytes)
    rows = own.select("doc_id", "k", "base", F.posexplode("least").alias("run", "x"))
    again = stored(rows.groupBy("x").count().where("count > 1").select("x"), "substring-again")
    n = again.count()
    found = rows.join(F.broadcast(again), "x") if n * 16 <= limit_bytes else skew_join(stored(rows, "substring-runs"), again, ["x"])
    return stored(found.groupBy("doc_id", "k", "base").agg(F.collect_set("run").alias("runs")), "substring-marks")


def candidate_windows(docs: DataFrame, marks: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, k, pos, place, h1, h2, before, behind) of the windows in the marked runs."""
    size = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (part for b in batches for part in slices(b, PART_BYTES)):
            w = Windows(batch.column("text"))
            runs = batch.column("runs")
            # number of the first run of each text, then the marked runs of all texts
            first = np.searchsorted(w.doc[w.opens], np.arange(batch.num_rows))
            marked = np.zeros(len(w.opens), bool)
            marked[np.repeat(first, runs.value_lengths().to_numpy(zero_copy_only=False)) + runs.flatten().to_numpy()] = True
            one, two = grams(w.hash, WINDOW, 0).view(np.int64), grams(w.hash, WINDOW, 1).view(np.int64)
            print_ = (one >> 32).astype(np.int32)
            own = marked[w.run] if len(w.run) else np.zeros(0, bool)
            at, doc = w.at[own], w.doc[own]
            starts, ends = at == w.words.first[doc], at + WINDOW == w.words.first[doc + 1]
            pos = at - w.words.first[doc]
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "k": batch.column("k").take(pa.array(doc)), "pos": pos,
                "place": pos + batch.column("base").to_numpy()[doc], "h1": one[at], "h2": two[at],
                "before": np.where(starts, 0, print_[at - 1]), "behind": np.where(ends, 0, print_[np.minimum(at + 1, len(print_) - 1)]),
            }

    joined = at_documents(docs, marks, size[0] * 48 + size[1] * 4, limit_bytes=limit_bytes).select("doc_id", "k", "base", "runs", "text")
    return map_batches(joined, scan, "doc_id long, k long, pos long, place long, h1 long, h2 long, before int, behind int")


# --- the graph ---


def repeated_edges(windows: DataFrame) -> DataFrame:
    """(place, n, h1, h2, before, behind): windows that occur again, with their first place, and a neighbour if it is always the same."""
    alone = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return windows.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"), alone("before"), alone("behind")).where("n > 1")


def linked_edges(edges: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """(range, place, h1, h2, linked) of the edges: whether the path from the edge at the place before goes on here without a branch. The last place of a range is looked at from the next one as well."""
    mask = (1 << range_bits) - 1
    own = edges.withColumn("print", F.shiftright("h1", 32).cast("int")).withColumn("home", F.shiftright("place", range_bits))
    seen = F.when(F.col("place").bitwiseAND(F.lit(mask)) == mask, F.array("home", F.col("home") + 1)).otherwise(F.array("home"))
    ranged = own.withColumn("range", F.explode(seen))
    last = Window.partitionBy("range").orderBy("place")
    of = lambda c: F.lag(c).over(last)
    goes_on = (of("place") == F.col("place") - 1) & (F.col("n") == of("n")) & (of("behind") == F.col("print")) & (F.col("before") == of("print"))
    return ranged.withColumn("linked", F.coalesce(goes_on, F.lit(False))).where("range = home").select("range", "place", "h1", "h2", "linked")


def compact(linked: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """(h1, h2, place, windows): the nonbranching paths, by their first edge."""
    upto = Window.partitionBy("range").orderBy("place")
    begins = ~F.col("linked") | (F.shiftright(F.col("place") - 1, range_bits) != F.col("range"))
    part = linked.withColumn("head", F.max(F.when(begins, F.col("place"))).over(upto))
    at_head = lambda c: F.max(F.when(F.col("place") == F.col("head"), F.col(c))).alias(c)
    parts = stored(part.groupBy("range", "head").agg(F.count("*").alias("windows"), at_head("linked"), at_head("h1"), at_head("h2")).drop("range"), "substring-paths")
    # parts that go on from the range before: join ends with beginnings, then double the steps
    ends = parts.select((F.col("head") + F.col("windows")).alias("head"), F.col("head").alias("root"))
    own = parts.where("linked").select("head").join(ends, "head").checkpoint()
    while True:
        jump = own.select(F.col("head").alias("root"), F.col("root").alias("far"))
        new = own.join(jump, "root", "left").select("head", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")).checkpoint()
        own = new.select("head", "root")
        if new.where("moved").isEmpty():
            break
    whole = parts.join(own, "head", "left").groupBy(F.coalesce("root", "head").alias("place")).agg(F.sum("windows").alias("windows"))
    return parts.where("NOT linked").select(F.col("head").alias("place"), "h1", "h2").join(whole, "place")


# --- spans ---

CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


#: log2 of the places of a slot by which spans are brought to the documents they start in.
SLOT_BITS = 9


def joined_spans(found: DataFrame) -> DataFrame:
    """(doc_id, k, pos, words, source) of paths (doc_id, k, pos, place, path, windows) that start later than their source: those that follow one another here and there are one span."""
    later = found.where("place > path").withColumn("shift", F.col("place") - F.col("path"))
    along = Window.partitionBy("doc_id", "k").orderBy("shift", "pos")
    end = F.col("pos") + F.col("windows")
    begins = F.coalesce((F.col("shift") != F.lag("shift").over(along)) | (F.col("pos") > F.lag(end).over(along)), F.lit(True))
    runs = later.withColumn("end", end).withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("long")).over(along))
    return runs.groupBy("doc_id", "k", "shift", "run").agg(
        F.min("pos").alias("pos"), (F.max("end") - F.min("pos") + WINDOW - 1).alias("words"), F.min("path").alias("source"),
    ).drop("shift", "run")


def sources_of(spans: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, k, pos, words, source): where the distinct sources of spans stand; places: (doc_id, k, n, base)."""
    slots = places.select("doc_id", "k", "n", "base", F.explode(F.sequence(F.shiftright("base", SLOT_BITS), F.shiftright(F.col("base") + F.col("n") - 1, SLOT_BITS))).alias("slot"))
    wanted = spans.select("source", "words").distinct().withColumn("slot", F.shiftright("source", SLOT_BITS))
    there = wanted.join(slots, "slot").where((F.col("source") >= F.col("base")) & (F.col("source") < F.col("base") + F.col("n")))
    return there.select("doc_id", "k", (F.col("source") - F.col("base")).alias("pos"), "words", "source")


def compared(docs: DataFrame, spans: DataFrame, places: DataFrame, limit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(spans whose words are those of their source, the others), by digests of the words at both places."""
    both = stored(spans.withColumn("own", F.lit(False)).unionByName(sources_of(spans, places).withColumn("own", F.lit(True))), "substring-spans")
    lists = both.groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "words", "source", "own")).alias("spans"))

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            words = Words(pa.array(batch["text"], pa.string())).join()
            out: dict = {c: [] for c in ("doc_id", "k", "pos", "words", "source", "own", "d1", "d2")}
            for i, own in enumerate(batch["spans"]):
                base = int(words.first[i])
                for s in own:
                    text = words.text(base + s["pos"], base + s["pos"] + s["words"])
                    one, two = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), np.int64).tolist()
                    for c, v in zip(out, (batch["doc_id"][i], batch["k"][i], s["pos"], s["words"], s["source"], s["own"], one, two), strict=True):
                        out[c].append(v)
            yield out

    rows = at_documents(docs, lists, both.count() * 40, limit_bytes=limit_bytes).select("doc_id", "k", "spans", "text")
    found = stored(map_columns(rows, read, "doc_id long, k long, pos long, words long, source long, own boolean, d1 long, d2 long"), "substring-read")
    key = ["source", "words", "d1", "d2"]
    odd = stored(found.groupBy(*key).agg(F.max("own").alias("own")).where("NOT own").drop("own"), "substring-odd")
    mine = found.where("NOT own")
    if odd.isEmpty():
        return mine.select(*spans.columns), spans.limit(0)
    return mine.join(odd, key, "left_anti").select(*spans.columns), mine.join(odd, key, "left_semi").select(*spans.columns)


def verified_spans(docs: DataFrame, found: DataFrame, places: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, k, pos, words) of later spans; a long one is read at both places, and of one that differs (equal hashes of other words) the windows that do not are left."""
    spans = stored(joined_spans(found), "substring-joined")
    same, odd = compared(docs, spans.where(F.col("words") >= LONG_WORDS), places, limit_bytes)
    if not odd.isEmpty():
        one = odd.select("doc_id", "k", F.explode(F.sequence(F.lit(0), F.col("words") - WINDOW)).alias("i"), "pos", "source")
        windows = one.select("doc_id", "k", (F.col("pos") + F.col("i")).alias("pos"), F.lit(WINDOW).cast("long").alias("words"), (F.col("source") + F.col("i")).alias("source"))
        same = same.unionByName(compared(docs, stored(windows, "substring-odd-windows"), places, limit_bytes)[0])
    return same.unionByName(spans.where(F.col("words") < LONG_WORDS)).drop("source")


def covered(spans: DataFrame) -> DataFrame:
    """(doc_id, k, pos, words) of spans that may overlap -> the same words in as few spans as there can be."""
    along = Window.partitionBy("doc_id", "k").orderBy("pos", "words")
    end = F.col("pos") + F.col("words")
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("begins", F.coalesce(F.col("pos") > before, F.lit(True)).cast("long")).withColumn("end", end).withColumn("run", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "k", "run").agg(F.min("pos").alias("pos"), (F.max("end") - F.min("pos")).alias("words")).drop("run")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit_bytes: int = LIMIT_BYTES, range_bits: int = RANGE_BITS) -> DataFrame:
    """(doc_id, k, whole, spans): per document with words in earlier windows, whether all are, else the spans (pos, words); k: hash of the text."""
    rows = _keyed(docs, text, doc_id)
    sketches = stored(sketch(rows), "substring-sketches")
    long = sketches.where(F.col("n") >= WINDOW)
    heads = stored(long.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "k", "n")).alias("x")).select("x.*"), "substring-heads")
    one = heads.withColumnsRenamed({"doc_id": "m_id", "k": "m_k"}).drop("n")
    narrow = long.select("doc_id", "k").distinct()
    copies = narrow.join(one, narrow["doc_id"].eqNullSafe(one["m_id"]) & (narrow["k"] == one["m_k"]), "left_anti")
    places = stored(numbered(heads), "substring-bases")
    marks = candidate_runs(long, places, limit_bytes)

    windows = candidate_windows(rows, marks, limit_bytes)
    edges = stored(repeated_edges(windows), "substring-edges")
    paths = stored(compact(linked_edges(edges, range_bits), range_bits).withColumnRenamed("place", "path"), "substring-unitigs")
    at = windows.select("h1", "h2", "doc_id", "k", "pos", "place")
    n = paths.count()
    found = at.join(F.broadcast(paths), ["h1", "h2"]) if n * 48 <= limit_bytes else skew_join(stored(at, "substring-windows"), paths, ["h1", "h2"])
    later = verified_spans(rows, found.select("doc_id", "k", "pos", "place", "path", "windows"), places, limit_bytes)
    listed = covered(later).groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "words")).alias("spans"))
    return stored(listed.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True), "substring-removed")


@F.pandas_udf(CUT)
def _cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, wholes, spans in parts:
        texts, wholes, spans, out = texts.fillna("").tolist(), wholes.tolist(), spans.tolist(), []
        for start, end in text_batches(texts, PART_BYTES):
            words = Words(pa.array(texts[start:end], pa.string())).join()
            for i in range(start, end):
                a, b = (int(x) for x in words.first[i - start : i - start + 2])
                if wholes[i] is None:  # nothing is known of this text
                    out.append((words.text(a, b).decode(), b - a, 0))
                    continue
                gone = np.full(b - a, bool(wholes[i]))
                for s in () if spans[i] is None else spans[i]:
                    gone[s["pos"] : s["pos"] + s["words"]] = True
                # runs of words that stay
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8))).tolist()
                kept = b" ".join(words.text(a + x, a + y) for x, y in zip(edge[::2], edge[1::2], strict=True))
                out.append((kept.decode(), b - a, int(gone.sum())))
        yield pd.DataFrame(out, columns=["text", "n_words", "n_removed"])


def drop_repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit_bytes: int = LIMIT_BYTES, range_bits: int = RANGE_BITS) -> DataFrame:
    """`docs` with the words that stay, joined by one space, as text, and n_words and n_removed."""
    removed = repeated_spans(docs, text, doc_id, limit_bytes, range_bits)
    size = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), F.col(text).cast("string").alias("text"))
    both = at_documents(rows, removed, size[0] * 48 + max(0, size[1]) * 24, "left", limit_bytes).select("row", _cut("text", "whole", "spans").alias("cut"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return both.select(*[F.col("cut.text").alias(c) if c == text else F.col(f"row.`{c}`") for c in kept], "cut.n_words", "cut.n_removed")


#: DuckDB SQL of drop_repeated_spans over documents: every window with its first place, then the words that later ones cover.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {documents}
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20
), x AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM s
), later AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM x
), p AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w
), c AS (
  SELECT p.doc_id, p.i, p.word, max(CASE WHEN again THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.i = p.i
), t AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
