"""Token-id files with fixed-width bit packing.

Every id takes the minimum number of bits that the vocabulary needs. A file holds blocks of
BLOCK_IDS ids, each block on a byte boundary, then the byte offset of every block, so any range of
ids is read from its blocks alone and unpacked by numpy.

Layout (little-endian): magic 'TIDS', u16 version, u16 bits, u32 ids in a block; the blocks; u64
offset of each block and of their end; u64 number of blocks, of ids, and offset of the table.

Documents are range-partitioned by id, so that files, and the documents in them, are in ascending
order; each task writes files of about ROLL_IDS ids under names of its own, and only files named in
the committed index count, so repeated or lost tasks leave no wrong data. The index has a row per
document; where a file begins in the whole order follows from the ids per file, a small table.

Defined results: null and empty texts hold the end id alone; a null id sorts first; repeated rows
are written each time (ties are in order of text); an empty table writes no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import file_system, map_columns, maybe_broadcast, scratch_path, stored
from kbspark.llm.tokens import default_path, hugging_face

MAGIC, VERSION, BLOCK_IDS = b"TIDS", 1, 1 << 16
HEADER = np.dtype([("magic", "S4"), ("version", "<u2"), ("bits", "<u2"), ("block_ids", "<u4")])
VOCABULARY, END_ID = "word_bpe_49k.json", 2
ROLL_IDS = 1 << 28


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    flags = ((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8)
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class IdWriter:
    """Streams ids into one file."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.n, self.buffer, self.held = sink, bits, 0, [], 0
        self.offsets = [HEADER.itemsize]
        sink.write(np.array([(MAGIC, VERSION, bits, BLOCK_IDS)], HEADER).tobytes())

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= BLOCK_IDS:
            ids = np.concatenate(self.buffer)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(ids[at : at + BLOCK_IDS])
            self.buffer, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.buffer))
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array([len(self.offsets) - 1, self.n, self.offsets[-1]], "<u8").tobytes())
        self.sink.close()


class IdReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        head = np.frombuffer(source.read(HEADER.itemsize), HEADER)[0]
        if head["magic"] != MAGIC or head["version"] != VERSION:
            raise ValueError("not a token-id file of this version")
        self.bits, self.block_ids = int(head["bits"]), int(head["block_ids"])
        source.seek(size - 24)
        blocks, self.n, at = (int(x) for x in np.frombuffer(source.read(24), "<u8"))
        source.seek(at)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)

    def _ids(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first..last (without last)."""
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last] - self.offsets[first]))
        out, base = [], self.offsets[first]
        for b in range(first, last):
            count = min(self.block_ids, self.n - b * self.block_ids)
            out.append(unpack(data[int(self.offsets[b] - base) : int(self.offsets[b + 1] - base)], self.bits, count))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def read(self, start: int, count: int) -> np.ndarray:
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids + 1
        return self._ids(first, last)[start - first * self.block_ids :][:count]


INDEX = "part int, file int, path string, doc_id long, at long, n long"


def write_ids(
    docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id",
    vocabulary: str | None = None, end_id: int = END_ID, blanks_matter: bool = False, roll_ids: int = ROLL_IDS,
) -> DataFrame:
    """Encode, write, and return the committed index: a row per document with its file and place there.

    blanks_matter: whether the vocabulary's ids show white space (the default one drops it).
    """
    vocabulary = vocabulary or default_path(VOCABULARY)

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        writer, path, part, file = None, "", TaskContext.get().partitionId(), -1
        encoder = hugging_face(vocabulary, blanks_matter)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            out: dict = {c.split()[0]: [] for c in INDEX.split(", ")}
            for doc, ids in zip(batch["doc_id"], encoder.encode([t or "" for t in batch["text"]]), strict=True):
                if writer is not None and writer.n >= roll_ids:
                    writer.close()
                    writer = None
                if writer is None:
                    file += 1
                    path = f"{folder}/ids-{part:06d}-{file:06d}-{uuid.uuid4().hex}.tids"
                    fs, place = file_system(path)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    writer = IdWriter(fs.open_output_stream(place), bits_for(encoder.vocab_size))
                for c, v in zip(out, (part, file, path, doc, writer.n, len(ids) + 1), strict=True):
                    out[c].append(v)
                writer.add(ids)
                writer.add(end)
            yield out
        if writer is not None:
            writer.close()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(map_columns(ordered, write, INDEX), "ids-index")


def read_ids(index: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32, from the files."""

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        reader, opened = None, None
        for batch in batches:
            path, base, doc_ids, at, n = (batch[c] for c in ("path", "base", "doc_id", "at", "n"))
            i = 0
            while i < len(n):  # runs of documents of about a million ids that stand one after another in a file
                to = i + 1
                while to < len(n) and path[to] == path[i] and at[to] == at[to - 1] + n[to - 1] and at[to] + n[to] - at[i] <= 1 << 20:
                    to += 1
                if path[i] != opened:
                    fs, place = file_system(path[i])
                    reader, opened = IdReader(fs.open_input_file(place)), path[i]
                ids = memoryview(reader.read(at[i], at[to - 1] + n[to - 1] - at[i]).astype("<u4")).cast("B")
                crcs = [zlib.crc32(ids[4 * (a - at[i]) : 4 * (a - at[i] + k)]) for a, k in zip(at[i:to], n[i:to], strict=True)]
                yield {"doc_id": doc_ids[i:to], "start": [b + a for b, a in zip(base[i:to], at[i:to], strict=True)], "n_tokens": n[i:to], "ids_crc32": crcs}
                i = to

    files = index.groupBy("part", "file").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file of ROLL_IDS ids
    bases = stored(files.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")), "ids-bases")
    placed = index.join(maybe_broadcast(bases, bases.count(), 16), ["part", "file"])
    return map_columns(placed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the ids of `docs` to files and return what the files hold."""
    return read_ids(write_ids(docs, folder or scratch_path(docs.sparkSession, "ids"), **options))
