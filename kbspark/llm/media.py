"""Media columns with content-defined chunking.

A payload is cut where a rolling gear hash of the last 64 bytes hits a mask, within smallest and
largest chunk sizes, so equal passages give equal chunks wherever they stand. Chunk digests are
deduplicated by Spark joins: a chunk that several payloads have is stored once, as a chunk of its
own; the other chunks stand in the form of their media. The ordered chunk list of a media rebuilds
it, and every chunk is verified by its digest when it is read back.

Samples are unsigned 8-bit: a text's UTF-8 bytes, padded with 0 to a positive multiple of 64. The
stored form of a media is one binary value (little-endian): magic 'CDC1', u32 chunks; for each chunk
a 16-byte digest, a u32 length and u8 1 if its samples stand here, 0 if they are a chunk of their
own; then the samples that stand here. Its size and sha256 are those of the bytes read from the store.

Payload bytes are not shuffled on the way in: tasks scan the texts twice, first for digests, then
to write what the join says is theirs. The list that tells them so is broadcast if its counted
size is small, else joined by shuffle. A media or a chunk that very many rows use is joined by
broadcast (skew_join), so no task gets all its uses.

Defined results: null and empty texts are one payload of 64 zero bytes; equal payloads are one
media; repeated rows share it; a null id is kept; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_columns, maybe_broadcast, skew_join, stored

UNIT, WINDOW = 64, 64
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 8192, 10
DIGEST_BYTES = 16


@functools.cache
def gear_table() -> np.ndarray:
    """256 fixed 64-bit values made by a hash of the byte's number."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:8], "little") for b in range(256)], np.uint64)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of UNIT, and the length before."""
    data = (text or "").encode("utf-8")
    return data + b"\0" * (-len(data) % UNIT or UNIT * (not data)), len(data)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at every place: the sum over the last 64 bytes of gear[byte] shifted by its age, by doubling."""
    h, span = gear_table()[data], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint64(span)) if len(h) > span else h[span:]
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n, ends, start = len(data), [], 0
    if n > MIN_CHUNK:
        hit = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) >> np.uint64(64 - MASK_BITS) == 0) + 1
        for end in hit.tolist():
            while end - start > MAX_CHUNK:
                start += MAX_CHUNK
                ends.append(start)
            if end - start >= MIN_CHUNK:
                ends.append(end)
                start = end
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return ends + [n] * (n > start)


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def feature_of(payload: bytes) -> str:
    """Mean, spread and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    spread = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    used = share[share > 0]
    return f"mean={mean:.4f};spread={spread:.4f};entropy={float(-(used * np.log2(used)).sum()):.4f}"


ENTRY = struct.Struct(f"<{DIGEST_BYTES}sIB")


def write_form(parts: list[bytes], names: list[bytes], away: set[int]) -> bytes:
    """The stored form of a media; away: places of chunks that are stored on their own."""
    entries = [ENTRY.pack(name, len(c), k not in away) for k, (c, name) in enumerate(zip(parts, names, strict=True))]
    return b"".join([b"CDC1", struct.pack("<I", len(parts)), *entries, *(c for k, c in enumerate(parts) if k not in away)])


def read_form(form: bytes) -> list[tuple[bytes, bytes | None]]:
    """(digest, samples or None) of the chunks in order."""
    if form[:4] != b"CDC1":
        raise ValueError("not a media of this version")
    (n,) = struct.unpack_from("<I", form, 4)
    at, out = 8 + n * ENTRY.size, []
    for name, size, here in ENTRY.iter_unpack(form[8:at]):
        out.append((name, form[at : at + size] if here else None))
        at += size * here
    if at != len(form):
        raise ValueError("a media has another length than its chunks")
    return out


def read_back(form: bytes, away: dict[int, bytes]) -> dict:
    """Features of a media from its stored form and the chunks stored on their own; a chunk that fails its digest is an error."""
    parts = [(name, away.get(k) if samples is None else samples) for k, (name, samples) in enumerate(read_form(form))]
    if any(samples is None or digest(samples) != name for name, samples in parts):
        raise ValueError("a chunk read back is missing or does not match its digest")
    payload = b"".join(samples for _, samples in parts)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(), "feature": feature_of(payload), "n_chunks": len(parts),
    }


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
#: A media that stands alone, a mixed one (with the places and digests of its chunks elsewhere), or a chunk (its samples).
STORED = "kind string, id binary, form binary, places array<int>, chunks array<binary>"


def media_key(text: str):
    """sha256 of the payload as a column expression."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / UNIT)).cast("int") * UNIT
    return F.unhex(F.sha2(F.rpad(data, size, F.lit(b"\0")), 256))


def chunk_lists(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """First scan: (doc_id, n_bytes, media, list): the payload's sha256 and its ordered chunk digests."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_bytes": [], "media": [], "list": []}
            for t in batch["text"]:
                payload, n = payload_of(t)
                out["n_bytes"].append(n)
                out["media"].append(hashlib.sha256(payload).digest())
                out["list"].append([digest(c) for c in chunks(payload)])
            yield out

    return map_columns(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), scan, "doc_id long, n_bytes long, media binary, list array<binary>")


def write_media(docs: DataFrame, lists: DataFrame, text: str, doc_id: str, limit_bytes: int = 64 << 20) -> DataFrame:
    """Second scan: the media and chunk tables.

    Each media is written by one row of its smallest id, each shared chunk by one place in one media.
    """
    owners = stored(lists.groupBy("media").agg(F.min("doc_id").alias("doc_id"), F.first("list").alias("list")), "media-owners")
    places = stored(owners.select("media", F.posexplode("list").alias("pos", "chunk")), "media-places")
    shared = stored(
        places.groupBy("chunk")
        .agg(F.min(F.struct("media", "pos")).alias("at"), F.count("*").alias("uses"))
        .where("uses > 1").select("chunk", "at"), "media-shared"
    )
    # a row for each media with shared chunks: their positions, and those of them that it writes
    marks = (
        skew_join(places, shared, ["chunk"])
        .groupBy("media")
        .agg(F.collect_list("pos").alias("elsewhere"), F.collect_list(F.when(F.struct("media", "pos") == F.col("at"), F.col("pos"))).alias("writes"))
    )
    rows_of = stored(
        skew_join(lists.select("doc_id", "media"), owners.select("media", F.col("doc_id").alias("owner")), ["media"])
        .groupBy("doc_id", "media").agg(F.count("*").alias("rows"), F.first(F.col("doc_id").eqNullSafe(F.col("owner"))).alias("owns")), "media-rows",
    )
    # rows that the scan passes by: those that only use a media, and equal rows of an owner, of which one writes it below
    passed = rows_of.where("NOT owns OR rows > 1").select("doc_id", "media")
    todo = owners.select("doc_id", "media").join(marks, "media").withColumn("copy", F.lit(False))
    todo = todo.join(passed, (todo["media"] == passed["media"]) & todo["doc_id"].eqNullSafe(passed["doc_id"]), "left_anti").unionByName(passed.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    todo = stored(todo.withColumnsRenamed({"doc_id": "todo_id", "media": "todo_media"}), "media-todo")
    sizes = todo.agg(F.count("*"), F.coalesce(F.sum(F.size("elsewhere") + F.size("writes")), F.lit(0))).first()
    todo = maybe_broadcast(todo, 1, sizes[0] * 96 + sizes[1] * 4, limit_bytes)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), media_key(text).alias("media"))
    mine = own["doc_id"].eqNullSafe(todo["todo_id"]) & (own["media"] == todo["todo_media"])
    marked = own.join(todo, mine, "left").where("copy IS NULL OR NOT copy").select("text", "elsewhere", "writes")
    twice = rows_of.where("owns AND rows > 1").select(F.col("doc_id").alias("todo_id"), F.col("media").alias("todo_media"))
    n = twice.count()
    if n:
        few = maybe_broadcast(twice, n, 96, limit_bytes)
        one = own.join(few, own["doc_id"].eqNullSafe(few["todo_id"]) & (own["media"] == few["todo_media"])).dropDuplicates(["media"])
        marked = marked.unionByName(one.select("media", "text").join(marks, "media", "left").select("text", "elsewhere", "writes"))

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {c.split()[0]: [] for c in STORED.split(", ")}
            for t, elsewhere, writes in zip(batch["text"], batch["elsewhere"], batch["writes"], strict=True):
                payload, _ = payload_of(t)
                parts = chunks(payload)
                names = [digest(c) for c in parts]
                away = sorted(elsewhere or ())
                rows = [("mixed" if away else "media", hashlib.sha256(payload).digest(), write_form(parts, names, set(away)), away, [names[k] for k in away])]
                rows += [("chunk", names[k], parts[k], [], []) for k in writes or ()]
                for row in rows:
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
            yield out

    return stored(map_columns(marked, write, STORED), "media-store", "kind")


def read_media(store: DataFrame) -> DataFrame:
    """Rebuild every media from the stored tables: (media, features)."""

    def rebuild(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = [read_back(form, {x["pos"]: x["samples"] for x in away or ()}) for form, away in zip(batch["form"], batch["away"], strict=True)]
            yield {"media": batch["id"]} | {c: [r[c] for r in rows] for c in FEATURES.replace(" long", "").replace(" string", "").split(", ")}

    schema = f"media binary, {FEATURES}"
    alone = store.where("kind = 'media'").select("id", "form", F.lit(None).cast("array<struct<pos:int,samples:binary>>").alias("away"))
    part = store.where("kind = 'mixed'")
    lists = stored(part.select("id", F.explode(F.arrays_zip("places", "chunks")).alias("x")).select("id", F.col("x.places").alias("pos"), F.col("x.chunks").alias("chunk")), "media-uses")
    held = store.where("kind = 'chunk'").select(F.col("id").alias("chunk"), F.col("form").alias("samples"))
    away = skew_join(lists, held, ["chunk"]).groupBy("id").agg(F.collect_list(F.struct("pos", "samples")).alias("away"))
    # a chunk that is not found leaves its media without it, which rebuild reports
    whole = part.select("id", "form").join(away, "id", "left")
    return map_columns(alone, rebuild, schema).unionByName(map_columns(whole, rebuild, schema))


def media_round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit_bytes: int = 64 << 20) -> DataFrame:
    """Store every text as media, read the store back: doc_id, n_bytes and the features of its media."""
    lists = stored(chunk_lists(docs, text, doc_id), "media-lists")
    features = stored(read_media(write_media(docs, lists, text, doc_id, limit_bytes)).dropDuplicates(["media"]), "media-features")
    return skew_join(lists.select("doc_id", "n_bytes", "media"), features, ["media"]).drop("media")
