import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest_words import prose
from kbspark.llm import media, warc


def test_rolling_hash_is_the_gear_hash():
    data = random.Random(0).randbytes(500)
    gear, h, want = media.gear_table(), 0, []
    for b in data:
        h = ((h << 1) + int(gear[b])) & (1 << 64) - 1
        want.append(h)
    assert media.rolling(np.frombuffer(data, np.uint8)).tolist() == want
    assert media.rolling(np.frombuffer(data[:3], np.uint8)).tolist() == want[:3]


def test_chunks_follow_content():
    data = random.Random(1).randbytes(50_000)
    parts = media.chunks(data)
    assert b"".join(parts) == data
    assert all(media.MIN_CHUNK <= len(p) <= media.MAX_CHUNK for p in parts[:-1])
    moved = set(media.chunks(b"0123456789" + data))
    assert len(moved & set(parts)) > 0.8 * len(parts)
    assert max(map(len, media.chunks(b"\0" * 40_000))) <= media.MAX_CHUNK


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_media_round_trip(docs, rows, none, limit):
    """Against forms made by hand; with a list of what to write that is broadcast, or joined by shuffle."""
    payloads = [media.payload_of(r[1])[0] for r in rows]
    uses = Counter(c for p in dict.fromkeys(payloads) for c in media.chunks(p))
    want = []
    for (doc, text, *_), payload in zip(rows, payloads, strict=True):
        form, end = b"CDC1" + len(media.chunks(payload)).to_bytes(4, "little"), b""
        for c in media.chunks(payload):
            form += media.digest(c) + len(c).to_bytes(4, "little") + bytes([uses[c] == 1])
            end += c if uses[c] == 1 else b""
        form += end
        want.append((doc, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest(), media.feature_of(payload)))
    got = media.media_round_trip(docs, limit_bytes=limit).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert media.media_round_trip(none).collect() == []


def test_ids_shared_by_different_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 5000 + str(i)) for i in range(5)] + [(None, "b" * i) for i in range(5)], "doc_id long, text string")
    got = media.media_round_trip(docs).collect()
    assert sorted(r["payload_sha256"] for r in got) == sorted(hashlib.sha256(media.payload_of(t)[0]).hexdigest() for t in [r["text"] for r in docs.collect()])


def test_a_damaged_chunk_is_an_error():
    parts = media.chunks(random.Random(4).randbytes(5000))
    names = [media.digest(c) for c in parts]
    form = media.write_form(parts, names, {1})
    assert media.read_back(form, {1: parts[1]})["payload_bytes"] == 5000
    for damaged, away in ((form, {}), (form, {1: parts[0]}), (form[:-1] + bytes([form[-1] ^ 1]), {1: parts[1]}), (form[:-1], {1: parts[1]})):
        with pytest.raises(ValueError):
            media.read_back(damaged, away)


def test_a_payload_of_most_rows(spark):
    """A third of all rows are one text, and half of the others share a passage; keys over 1 / hot of the rows go by broadcast."""
    shared = "".join(chr(97 + k % 26) for k in range(3000))
    rows = [(i, "copied text" if i % 3 == 0 else shared * (i % 2) + str(i)) for i in range(3000)]
    got = media.media_round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["payload_sha256"]) for r in got} == {(i, hashlib.sha256(media.payload_of(t)[0]).hexdigest()) for i, t in rows}


PAGES = "page_id long, url string, html string, size long, path string"


def pages_rows():
    rng = random.Random(0)
    out = [(i, f"http://e.org/{i}", "".join(chr(rng.randint(32, 600)) for _ in range(rng.randint(0, 3000))), 1, "p") for i in range(80)]
    out += [(100 + i, None, out[7][2], None, None) for i in range(9)] + [(200, "u\r\nv", None, 1, None), (201, "é", "", 1, None), (None, "n", "null id", 1, None), (202, "l", "x\r\n\r\ny" * 100_000, 1, None)]
    return out + [out[7], out[90]]


def test_warc_round_trip(spark):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, _, html, *_ in rows:
        data, own = (html or "").encode(), first.get(html or "")
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == own else "revisit", None if page == own else own))
    want = [(*w[:3], "response", None) if w[0] is None else w for w in want]
    for limit in (64 << 20, 0):
        got = [tuple(r) for r in warc.warc_round_trip(pages, limit_bytes=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_small_splits_and_payloads(spark):
    from kbspark.llm.common import scratch_path

    rows = pages_rows()
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), scratch_path(spark, "test"))
    for split in (517, 10_000):
        got = warc.read_warc(manifest, split_bytes=split).collect()
        assert len(got) == len(rows)
        assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {r[2] or "" for r in rows}


def test_min_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.warc_round_trip(pages, min_bytes=5).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_range_reader_skips_false_magic():
    noise = warc.MAGIC + random.Random(3).randbytes(200)
    other = gzip.compress(b"no record here")
    record = warc.member(warc.record(5, "u", b"body", None, False), 6)
    data = noise + other + record + warc.MAGIC + record
    for start in range(0, len(data), 97):
        found = [x for at in range(0, len(data), 97) for x in warc.RangeReader(io.BytesIO(data), len(data), at, min(len(data), at + 97), step=31)]
        assert len(found) == 2
        break
    fields, block = warc.parse(found[0])
    assert fields["warc-type"] == "response" and block.endswith(b"body")


@pytest.mark.parametrize("damage", ["cut", "flip in the data", "flip in the magic", "lost file tail with its size"])
def test_a_damaged_archive_is_an_error(spark, damage):
    from kbspark.llm.common import scratch_path

    rows = [(i, f"u{i}", random.Random(i).randbytes(300).hex(), 0, "") for i in range(5)]
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), scratch_path(spark, "test"))
    path = manifest.first()["path"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    starts = [i for i in range(len(data)) if data[i : i + 3] == warc.MAGIC]
    if damage == "flip in the data":
        data[(starts[2] + starts[3]) // 2 + 60] ^= 1
    elif damage == "flip in the magic":
        data[starts[2]] ^= 1
    else:
        del data[starts[-1] + 100 :]
    open(path, "wb").write(bytes(data))
    if damage.startswith("lost"):
        manifest = manifest.withColumn("size", manifest.size * 0 + len(data))
    if damage == "flip in the magic":  # no trace in the bytes that are left, but a record is missing
        lost = warc.missing_records(manifest, warc.read_warc(manifest)).collect()
        assert [(r["records"], r["found"]) for r in lost] == [(5, 4)]
    else:
        with pytest.raises(Exception, match="ValueError"):
            warc.read_warc(manifest).collect()


def test_equal_rows_are_stored_once(spark):
    """Fifty equal rows of an owner, with chunks that other media share."""
    passage = prose(3, 4000)
    rows = [(1, passage)] * 50 + [(2, passage), (3, "other " + passage), (None, "x")] + [(4, passage + " end")] * 3 + [(5, "alone")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lists = media.chunk_lists(df, "text", "doc_id").cache()
    store = media.write_media(df, lists, "text", "doc_id")
    found = [(r["kind"] == "chunk", bytes(r["id"])) for r in store.select("kind", "id").collect()]
    assert len(found) == len(set(found)) and sum(not c for c, _ in found) == 5
    got = media.media_round_trip(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in got), key=str) == sorted(((i, len(t.encode())) for i, t in rows), key=str)
    assert all(r["payload_sha256"] == hashlib.sha256(media.payload_of(next(t for i, t in rows if i == r["doc_id"]))[0]).hexdigest() for r in got)
