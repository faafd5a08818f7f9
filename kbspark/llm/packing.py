"""Swap-based local search for packing token sequences.

Texts are encoded once; only checksums and lengths of the pieces travel. A text over the limit is
cut into pieces of exactly the limit, all but the first. Pieces are dealt by hash into groups of
about GROUP pieces. A group starts with one piece a bin, and the local search does the packing. A pass
takes each underfull bin as the source; a step moves a piece from it into another underfull bin, or
exchanges one for one, two for one or one for two, so that the other bin becomes fuller, and raises
the sum of squared fills. Steps go on until the source is empty or none is left; passes go on until
one empties no bin, or the number of bins is the smallest possible (tokens / limit, rounded up).

Pieces of one length are interchangeable, so the search works on lengths; no exchange is lost by that.
A group wastes less than about one bin, so the number of sequences does not depend on how many
groups there are.

Defined results: null and empty texts are the end id alone; repeated rows are packed each time;
a null id is packed like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_batches, stored
from kbspark.llm.tokens import default_path, hugging_face

VOCABULARY, END_ID, LIMIT, GROUP = "byte_bpe_50k.json", 2, 1024, 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens: the first takes the rest, the others the limit."""
    n = -(-counts // limit)
    document = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)
    first = (counts - 1) % limit + 1
    start = np.where(piece == 0, 0, first[document] + (piece - 1) * limit)
    return document, start, np.where(piece == 0, first[document], limit)


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """A row per piece of every document."""
    vocabulary = vocabulary or default_path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = hugging_face(vocabulary, True)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            found = encoder.encode_bytes([t or "" for t in batch.column("text").to_pylist()])
            counts = np.fromiter(map(len, found), np.int64, len(found)) // len(end) + 1
            ids = memoryview(np.frombuffer(b"".join([x for ids in found for x in (ids, end)]), encoder.dtype).astype("<u4")).cast("B")
            document, start, length = cut(counts, limit)
            at = ((np.cumsum(counts) - counts)[document] + start) * 4
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(document)), "piece": (np.arange(len(start)) - np.searchsorted(document, document)).astype(np.int32), "start": start, "length": length,
                "ids_crc32": np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(at)),
            }

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), encode, PIECES)


class Offers:
    """What the open bins can give in exchange: (free space f, given length t) -> bins.

    A source that gives s for t needs t < s <= t + f; afterwards the bin has t + f - s free.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.bins: dict[tuple[int, int], set[int]] = {}
        #: Free spaces that occur with each t + f, as bits, and the largest of them.
        self.bits = [0] * (limit + 1)
        self.largest = np.zeros(limit + 1, np.int64)

    def add(self, b: int, free: int, given: set[int]) -> None:
        for t in given:
            at = self.bins.setdefault((free, t), set())
            if not at:
                self.bits[t + free] |= 1 << free
                self.largest[t + free] = self.bits[t + free].bit_length() - 1
            at.add(b)

    def drop(self, b: int, free: int, given: set[int]) -> None:
        for t in given:
            at = self.bins[free, t]
            at.discard(b)
            if not at:
                self.bits[t + free] &= ~(1 << free)
                self.largest[t + free] = self.bits[t + free].bit_length() - 1

    def best(self, s: int) -> tuple[int, int] | None:
        """(free, t) of the exchange for s that leaves least free space, the largest shift among these."""
        if s > self.limit:
            return None
        fits = self.largest[s:] > np.arange(self.limit + 1 - s)
        k = int(fits.argmax())
        if not fits[k]:
            return None
        free = int(self.largest[s + k])
        return free, s + k - free


def pair_sums(lengths: list[int]) -> set[int]:
    of = Counter(lengths)
    return {a + b for a, b in combinations(of, 2)} | {2 * a for a, n in of.items() if n > 1}


def pair_of(lengths: list[int], total: int) -> tuple[int, int]:
    of = Counter(lengths)
    return next((a, total - a) for a in sorted(of, reverse=True) if of.get(total - a, 0) > (a + a == total))


class Search:
    """The state of a group: bins as lists of lengths, and the offers of those with free space."""

    def __init__(self, bins: list[list[int]], limit: int):
        self.bins, self.limit = bins, limit
        self.fill = [sum(b) for b in bins]
        self.moves, self.singles, self.pairs = Offers(limit), Offers(limit), None
        self.steps = Counter()
        for b in range(len(bins)):
            self._share(b, Offers.add)

    def _share(self, b: int, act) -> None:
        """Add or drop (act) what a bin offers; full and empty ones offer nothing."""
        free = self.limit - self.fill[b]
        if free and self.fill[b]:
            act(self.moves, b, free, {0})
            act(self.singles, b, free, set(self.bins[b]))
            if self.pairs is not None:
                act(self.pairs, b, free, pair_sums(self.bins[b]))

    def _with_pairs(self) -> Offers:
        """Pairs are listed from the first time on that they are needed."""
        if self.pairs is None:
            self.pairs = Offers(self.limit)
            for b, lengths in enumerate(self.bins):
                free = self.limit - self.fill[b]
                if free and lengths and b != self.source:
                    self.pairs.add(b, free, pair_sums(lengths))
        return self.pairs

    def _step(self, kind: str, offers: Offers, given: dict[int, tuple[int, ...]]) -> bool:
        """Exchange one of the given subsets of the source, the largest that can be, where it leaves least space."""
        for s in sorted(given, reverse=True):
            found = offers.best(s)
            # a bin so much emptier than the source that the shift would lower the sum of squares takes nothing
            if found and self.limit - found[0] + s - found[1] > self.fill[self.source]:
                break
        else:
            return False
        free, t = found
        target = min(offers.bins[found])
        back = () if not t else (t,) if offers is self.singles else pair_of(self.bins[target], t)
        self._share(target, Offers.drop)
        for x in given[s]:
            self.bins[self.source].remove(x)
            self.bins[target].append(x)
        for x in back:
            self.bins[target].remove(x)
            self.bins[self.source].append(x)
        self.fill[self.source] -= s - t
        self.fill[target] += s - t
        self._share(target, Offers.add)
        self.steps[kind] += 1
        return True

    def step(self) -> bool:
        """One step out of the source, if there is any."""
        lengths = self.bins[self.source]
        ones = {s: (s,) for s in lengths}
        if self._step("move", self.moves, ones) or self._step("one for one", self.singles, ones):
            return True
        twos = {s: pair_of(lengths, s) for s in pair_sums(lengths) if s <= self.limit}
        return self._step("two for one", self.singles, twos) or self._step("one for two", self._with_pairs(), ones)

    def empty(self, source: int) -> bool:
        """Steps out of a bin until it is empty or none is left."""
        self.source = source
        self._share(source, Offers.drop)
        while self.fill[source] and self.step():
            pass
        self._share(source, Offers.add)
        return not self.fill[source]


def local_search(bins: list[list[int]], limit: int) -> Search:
    """Empty bins into others until a pass empties none, or no fewer bins can do. The first pass begins with the fullest bin, which settles long pieces before short ones fill the gaps."""
    state = Search(bins, limit)
    left, least, sign = sum(map(bool, state.fill)), -(-sum(state.fill) // limit), -1
    while left > least:
        before = left
        for source in sorted(range(len(bins)), key=lambda b: (sign * state.fill[b], b)):
            if 0 < state.fill[source] < limit and left > least:
                left -= state.empty(source)
        if left == before:
            break
        sign = 1
    return state


def pack_lengths(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins as lists of indices."""
    state = local_search([[n] for n in lengths.tolist()], limit)
    held: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        held.setdefault(int(lengths[i]), []).append(i)
    return [[held[n].pop() for n in b] for b in state.bins if b]


def pack(of: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Give every piece (columns of PIECES) a sequence_id and an offset."""
    of = stored(of, "pieces")
    groups = max(1, -(-of.count() // group))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, items in enumerate(pack_lengths(lengths, limit)):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += int(lengths[i])
        first = rows["group"][0].as_py() << 32
        return rows.drop_columns("group").append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    dealt = of.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """Encode, cut and pack: a row per piece with its place."""
    return pack(pieces(docs, text, doc_id, vocabulary, end_id, limit), limit)
