"""WARC archives: writer of one gzip member per record, and a splittable reader.

Writing: payload digests are grouped to find the smallest id of each payload; that record is a
response, the others revisit it and carry headers alone. Each task streams its records into files
of its own; only files named in the committed manifest count.

Reading: files are dealt out as byte ranges. A task looks for gzip magic in its range, takes a
place as a record only if a member that begins with a WARC version line decodes from there, and
owns the records that start inside its range, reading past its end to finish the last one. After
a record it goes on behind that member. Payloads here are UTF-8 text, which can never hold the
magic bytes, so bytes inside a stored member cannot pass as a record. A record that begins well and
does not decode to its end is an error, and so are a file that is shorter than the manifest says
and, through `missing_records`, a file that gives fewer records than were written.

Pages are scanned twice, once for digests and once to write; the list of revisits between them is
broadcast if its counted size is small, so payloads are not shuffled.

Defined results: null payloads are empty; a null url leaves the target out; empty payloads are
deduplicated like others; rows that repeat both id and payload are all responses, and where one id
has several payloads each pair of id and payload stands for itself; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import file_system, map_columns, maybe_broadcast, scratch_path, skew_join, stored

MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES, SPLIT_BYTES = 1 << 30, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, level: int = 6, limit_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives; returns the manifest (path, size, records).

    min_bytes: payloads of fewer bytes are responses always.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    keys = stored(base.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha"), "warc-keys")
    firsts = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = stored(skew_join(keys, stored(firsts, "warc-firsts"), ["sha"]).where("NOT page_id <=> first").select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "first").distinct(), "warc-again")
    again = maybe_broadcast(again, again.count(), 64, limit_bytes)
    marked = base.join(again, base["page_id"].eqNullSafe(F.col("r_id")) & (base["sha"] == F.col("r_sha")), "left").select("page_id", "url", "payload", "first", F.col("r_sha").isNotNull().alias("again"))

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        sink, path, size, records = None, "", 0, 0
        for batch in batches:
            for page, target, payload, first, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "first", "again")), strict=True):
                if sink is not None and size >= ROLL_BYTES:
                    sink.close()
                    yield {"path": [path], "size": [size], "records": [records]}
                    sink = None
                if sink is None:
                    path, size, records = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, place = file_system(path)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(place, compression=None)
                    size += sink.write(member(info_record(), level))
                size += sink.write(member(record(page, target, payload, first, revisit), level))
                records += 1
        if sink is not None:
            sink.close()
            yield {"path": [path], "size": [size], "records": [records]}

    return stored(map_columns(marked, write, "path string, size long, records long"), "warc-manifest")


class RangeReader:
    """Records of a file that start in [start, end)."""

    def __init__(self, source, size: int, start: int, end: int, step: int = STEP):
        self.source, self.size, self.start, self.end, self.step = source, size, start, end, step
        self.base, self.held = start, b""

    def _more(self) -> bool:
        at = self.base + len(self.held)
        if at >= self.size:
            return False
        self.source.seek(at)
        self.held += self.source.read(min(self.step, self.size - at))
        return True

    def _drop(self, to: int) -> None:
        self.held, self.base = self.held[to - self.base :], to

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at a place and the place behind it, or None if no WARC record begins there."""
        unpacker, out, fed, limit = zlib.decompressobj(31), [], at - self.base, len(VERSION_LINE)
        while not unpacker.eof:
            data = unpacker.unconsumed_tail
            if not data:
                if fed >= len(self.held) and not self._more():
                    if limit:
                        return None
                    raise ValueError(f"the record at byte {at} has no end")
                data, fed = self.held[fed:], len(self.held)
            try:
                out.append(unpacker.decompress(data, max(0, limit - sum(map(len, out)))))  # the version line first, then all
            except zlib.error as error:
                if limit:
                    return None
                raise ValueError(f"the record at byte {at} does not decode") from error
            if limit and sum(map(len, out)) >= limit:
                if b"".join(out) != VERSION_LINE:
                    return None
                limit = 0
        return None if limit else (b"".join(out), self.base + fed - len(unpacker.unused_data))

    def __iter__(self) -> Iterator[bytes]:
        at = self.start
        while at < self.end:
            found = self.held.find(MAGIC, at - self.base)
            if found < 0:
                at = max(at, self.base + len(self.held) - len(MAGIC) + 1)  # the magic may lie across two reads
                self._drop(min(at, self.base + len(self.held)))
                if not self._more():
                    return
                continue
            at = self.base + found
            if at >= self.end:
                return
            self._drop(at)
            decoded = self._member(at)
            if decoded is None:
                at += 1
            else:
                yield decoded[0]
                at = decoded[1]
                self._drop(at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers with lower-case names, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


RECORDS = "path string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the archives in a manifest (path, size), with the path of their file.

    A revisit's digest and length come from its headers, a response's from the bytes that were read.
    """

    def number(name: str) -> int | None:
        text = name.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["at"], strict=True):
                fs, place = file_system(path)
                with fs.open_input_file(place) as source:
                    if source.size() != size:
                        raise ValueError(f"{path} has {source.size()} bytes in place of {size}")
                    out: dict = {c.split()[0]: [] for c in RECORDS.split(", ")}
                    held = 0
                    for data in RangeReader(source, size, start, min(size, start + split_bytes)):
                        fields, block = parse(data)
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            n, sha = len(payload), payload_digest(payload)
                            if fields["warc-payload-digest"] != f"sha1:{sha}":
                                raise ValueError(f"digest of {fields['warc-record-id']} does not match")
                        else:
                            n, sha = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha1:")
                        row = (path, number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, number(fields["warc-refers-to"]) if kind == "revisit" else None, sha, n, payload if payloads and kind == "response" else None)
                        for c, v in zip(out, row, strict=True):
                            out[c].append(v)
                        held += len(payload) + 200
                        if held > 8 << 20:
                            yield out
                            out, held = {c: [] for c in out}, 0
                    yield out

    splits = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("at"))
    tasks = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(0))).first()[0]
    return map_columns(splits.repartition(max(1, min(int(tasks), 100_000)), "path", "at"), read, RECORDS)


def missing_records(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(path, records, found) of the files that gave another number of records than the manifest says."""
    found = records.groupBy("path").agg(F.count("*").alias("found"))
    return manifest.select("path", "records").join(found, "path", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("records <> found")


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to. A file that lacks records is an error."""
    manifest = write_warc(pages, folder or scratch_path(pages.sparkSession, "warc"), **options)
    records = stored(read_warc(manifest, payloads=False).drop("payload", "url"), "warc-records")
    lost = missing_records(manifest, records).first()
    if lost:
        raise ValueError(f"{lost['path']}: {lost['found']} of {lost['records']} records were read")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of warc_round_trip: base32 has 4 characters for 5 hexadecimal digits of the SHA-1.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM {pages}
), d AS (
  SELECT page_id, first, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
