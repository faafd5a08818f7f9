"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased; in UTF-8 these are runs of
bytes, so tasks find them in Arrow's own buffers. Terms are bucketed by length: up to 8 bytes become one
64-bit word, up to 16 two; each bucket is radix-sorted (16-bit digits, the last one first) and its runs are
counted in numpy. Longer terms stand in buckets of 32, 64, 128, ... bytes that are sorted as byte strings, so
a bucket takes less than twice the bytes of its terms. Tasks add up before anything is shuffled.

A language keeps the terms of at least `min_docs` of its documents. With V kept terms and N occurrences of
them in a group, a term's share is p = 1 + floor(SCALE * (count + 1) / (N + V)), and the divergence at a term
is floor((p - q)**2 / q); all arithmetic is on integers. The kept terms of a language are dealt over tasks,
which sum the divergences of all pairs of its sources in blocks of terms.

Defined results: null text, language and source read as ''; a row is a document, so repeated rows count
again; a (lang, source) without terms is a group as well, with count 0 throughout; a language without kept
terms has pairs of value 0 and no terms; equal values are ranked by the item's UTF-8 bytes; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import map_batches, maybe_broadcast, stored

SCALE, MIN_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
#: Bytes of text that a task holds before it counts, and cells of a block of terms by sources.
HELD_BYTES, BLOCK_CELLS = 16 << 20, 1 << 17

_BYTE = np.arange(256)
#: Bytes that belong to terms, and what they are counted as.
IN_TERM = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def term_places(data: np.ndarray, ends: np.ndarray, members: np.ndarray = IN_TERM) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of member bytes in texts that stand one after another and end at `ends`."""
    inside = members[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1 - start


def packed_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of up to 8 * words bytes as `words` big-endian numbers, zeros behind their ends; data has room behind the last term."""
    at = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    out = []
    for k in range(words):
        empty = (8 * np.clip(8 * (k + 1) - length, 0, 7)).astype(np.uint64)
        out.append(at[start + 8 * k].astype(np.uint64) >> empty << empty)
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned keys, the first one most significant: counting passes over 16-bit digits, those that are all equal left out."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(keys: list[np.ndarray], doc: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, occurrences, documents) of each run of equal keys in an order that keeps documents together."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    new_doc = new.copy()
    by_doc = doc[order]
    new_doc[1:] |= by_doc[1:] != by_doc[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else first


def binary_array(rows: np.ndarray, length: np.ndarray) -> pa.Array:
    """Arrow binaries from rows of bytes and their lengths."""
    if len(length) and int(length.sum()) >= 1 << 31:
        raise ValueError("a block of terms of 2 GB")
    flat = rows[np.arange(rows.shape[1]) < length[:, None]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def count_terms(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of texts (binary array without nulls), by bucket of length; group: a number per text."""
    by_group = np.argsort(group, kind="stable")
    texts, group = texts.take(pa.array(by_group)), group[by_group]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    start, length = term_places(raw, ends)
    doc = np.searchsorted(ends, start, side="right")
    width, longest = 8, int(length.max(initial=0))
    data = np.concatenate([LOWER[raw], np.zeros(16, np.uint8)])
    while width < 2 * longest or width == 8:
        own = np.flatnonzero((length <= width) & (length > (width // 2 if width > 8 else 0)))
        if len(own):
            s, n, d = start[own], length[own], doc[own]
            g = group[d].astype(np.uint32)
            if width <= 16:
                keys = [g, *packed_words(data, s, n, width // 8)]
                order = radix_order(keys)
            else:
                cells = np.minimum(s[:, None] + np.arange(width), len(data) - 1)
                rows = np.where(np.arange(width) < n[:, None], data[cells], 0).astype(np.uint8)
                keys = [g, rows.view(f"S{width}").ravel()]
                order = np.argsort(keys[1], kind="stable")
                order = order[np.argsort(g[order], kind="stable")]
            first, times, docs = run_counts(keys, d, order)
            cells = np.minimum(s[first][:, None] + np.arange(width), len(data) - 1)
            yield g[first], binary_array(data[cells], n[first]), times, docs
        width *= 2


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, source, term binary, n, docs): occurrences of each term in a group, and its documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[dict]:
            rows = pa.Table.from_batches(held).combine_chunks()
            langs, names = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            many = max(1, len(names.dictionary))
            for g, term, n, d in count_terms(rows["text"].combine_chunks(), langs.indices.to_numpy() * many + names.indices.to_numpy()):
                yield {"lang": langs.dictionary.take(pa.array(g // many)), "source": names.dictionary.take(pa.array(g % many)), "term": term, "n": n, "docs": d}
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(as_text(lang).alias("lang"), as_text(source).alias("source"), F.encode(as_text(text), "UTF-8").alias("text"))
    return (
        map_batches(rows, count, "lang string, source string, term binary, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count, occurrences, terms):
    """p of a term: 1 + floor(SCALE * (count + 1) / (N + V)), in decimals so that no corpus is too large."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(20,0)) * ({count} + 1)) div ({occurrences} + {terms})")


def pair_sums(kept: DataFrame, sources: dict[str, list[str]], absent: dict[str, list[int]]) -> DataFrame:
    """(lang, a, b, value): per pair of a language's sources (places in its list) the summed divergence of a from b over its kept terms.

    kept: lang, own array<struct<source,p>>, the sources that have a term; `absent` is p of those that have not.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place = {x: {s: i for i, s in enumerate(names)} for x, names in sources.items()}
        total = {x: np.zeros((len(names), len(names)), np.int64) for x, names in sources.items()}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, x in enumerate(langs.dictionary.to_pylist()):
                lists = batch.column(1).filter(pa.array(langs.indices.to_numpy() == k))
                entries = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                names = entries.field("source").dictionary_encode()
                column = np.array([place[x][s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                step = max(1, BLOCK_CELLS // len(place[x]))
                for at in range(0, len(lists), step):
                    own = (row >= at) & (row < at + step)
                    p = np.repeat(np.array(absent[x], np.int64)[:, None], min(step, len(lists) - at), axis=1)
                    p[column[own], row[own] - at] = entries.field("p").to_numpy()[own]
                    for b in range(len(p)):
                        total[x][:, b] += ((p - p[b]) ** 2 // p[b]).sum(axis=1)
        for x, sums in total.items():
            a, b = np.nonzero(sums)
            yield {"lang": pa.array([x] * len(a), pa.string()), "a": a.astype(np.int32), "b": b.astype(np.int32), "value": sums[a, b]}

    return map_batches(kept.select("lang", "own"), add_up, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the divergence from each other source of its language, and the terms it has more of than its language.

    The list of sources is held by the driver: the result has a row for every pair of a language's sources, so
    it is the root of the result's size.
    """
    counts = term_counts(docs, text, lang, source)
    kept = stored(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own"))
        .where(F.col("docs") >= min_docs).drop("docs"),
        "divergence-terms",
    )
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    used = kept.select("lang", F.explode("own").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("group_n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    groups = groups.join(used, ["lang", "source"], "left").join(F.broadcast(whole), "lang", "left").na.fill(0, ["group_n", "terms", "lang_n"])
    groups = stored(groups.withColumn("absent", F.when(F.col("terms") > 0, share("0", "group_n", "terms"))), "divergence-groups")
    sources: dict[str, list[str]] = {}
    absent: dict[str, list[int]] = {}
    for r in groups.where("terms > 0").select("lang", "source", "absent").sort("lang", "source").collect():
        sources.setdefault(r["lang"], []).append(r["source"])
        absent.setdefault(r["lang"], []).append(r["absent"])
    few = maybe_broadcast(groups, groups.count(), 256)

    entries = kept.select("lang", "term", "n", F.explode("own").alias("x")).select("lang", "term", "n", F.col("x.source").alias("source"), F.col("x.n").alias("own_n"))
    shared = entries.join(few, ["lang", "source"]).withColumns({"p": share("own_n", "group_n", "terms"), "q": share("n", "lang_n", "terms")})
    shared = stored(shared.select("lang", "source", "term", "p", "q"), "divergence-shares")
    value = F.expr("((p - q) * (p - q)) div q")
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), value.alias("value"))

    together = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("own"))
    listed = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"))
    one, other = (listed.select("lang", F.col("source").alias(s), F.col("place").alias(p)) for s, p in (("source", "a"), ("item", "b")))
    pairs = one.join(other, "lang").where("a <> b").join(pair_sums(together, sources, absent), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


#: DuckDB SQL of source_divergence with its defaults over documents.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM {documents}
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT lang, source, no, unnest(words) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT no) >= 3
), c AS MATERIALIZED (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
    (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v, coalesce((SELECT sum(n) FROM k WHERE k.lang = g.lang), 0) AS lang_total FROM g
), p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.lang_total + s.v)::HUGEINT AS q
  FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM part
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
