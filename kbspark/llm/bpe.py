"""Byte-level BPE through a sentencepiece model made from the vocabulary.

A rank file is turned into a sentencepiece BPE model without training: every token becomes a piece
of byte-mapped characters scored by its negative rank, with identity normalisation. Merging the
pair of best score, leftmost first, is then merging the pair of lowest rank. Texts are cut by the
vocabulary's pattern; a match that is itself a token is that token, any other is encoded by the
model. Decoding maps ids back to their bytes.

Defined results: null and empty texts have no ids; a text has no length limit; each row stands
alone; other columns are carried along, but one of the result's name (`into`), which it replaces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import held_by_worker
from kbspark.llm.tokens import UnitEncoder, byte_characters, default_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised model: piece 0 is unknown (sentencepiece asks for one), the others are in order of rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    spec, norm = model.trainer_spec, model.normalizer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 0, -1, -1, -1
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.rank_of_piece = [-1, *sorted(self.ranks.values())]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.mapping = {b: c for b, c in enumerate(byte_characters())}
        self.encoder = UnitEncoder(self._units, max(self.ranks.values()) + 1, True)

    def _units(self, units: list[str]) -> list[list[int]]:
        """Each match of the pattern separately; those that are no tokens go to the model in one call."""
        out, hard, places = [], [], []
        for unit in units:
            ids = []
            for match in self.find(unit):
                data = match.encode("utf-8")
                rank = self.ranks.get(data)
                if rank is None:
                    places.append((ids, len(ids)))
                    hard.append(data.decode("latin-1").translate(self.mapping))
                ids.append(rank)
            out.append(ids)
        rank_of = self.rank_of_piece
        for (ids, at), found in zip(reversed(places), reversed(self.sp.encode(hard, num_threads=1) if hard else []), strict=True):
            ids[at : at + 1] = [rank_of[p] for p in found]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return held_by_worker((path, pattern), lambda: ByteBpe(path, pattern))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with an array column of ids."""
    vocabulary, pattern = vocabulary or default_path(VOCABULARY), pattern or default_pattern()

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in texts:
            yield pd.Series([x.astype(np.int32) for x in bpe.encode([t or "" for t in batch])], dtype=object)

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with a binary column of what the ids stand for; null ids decode to no bytes."""
    vocabulary, pattern = vocabulary or default_path(VOCABULARY), pattern or default_pattern()

    @F.pandas_udf("binary")
    def back(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in column:
            yield pd.Series([bpe.decode([] if x is None else x.tolist()) for x in batch], dtype=object)

    return docs.withColumn(into, back(F.col(ids)))


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_decode(docs: DataFrame, text: str = "text", into: str = "bpe", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with the digests of ids and of decoded bytes, in one pass; ids never leave the task."""
    vocabulary, pattern = vocabulary or default_path(VOCABULARY), pattern or default_pattern()

    @F.pandas_udf(DIGEST)
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(vocabulary, pattern)
        for batch in texts:
            rows = []
            for ids in map(np.ndarray.tolist, bpe.encode([t or "" for t in batch])):
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=DIGEST.names)

    return docs.withColumn(into, both(F.col(text)))
