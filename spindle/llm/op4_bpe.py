"""Byte-level BPE encoding and decoding through a sentencepiece model.

The vocabulary of byte-level ranks is written out as a sentencepiece BPE model: each token's
bytes become printable characters one by one, its score is its negative rank, and the
normaliser is the identity. The model merges, at every step, the pair whose token has the
best score, which is the pair of least rank. Pre-tokens (matches of the pattern) are encoded
one by one; a pre-token that is a token itself gets its id at once. Decoding maps ids back to
the bytes of their tokens.

Edge cases: a null text counts as empty and has no ids; a null ``doc_id`` is kept; repeated
rows are encoded each; very long pre-tokens take no more than their own memory; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op1_packing import byte_alphabet
from .shared import modest_batches, slices, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Encoded pre-tokens that a worker remembers; the memory is emptied when it is full.
MEMORY = 400_000
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


# --- the model file, field by field ---------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the id after the last is unknown."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    to_char = byte_alphabet()
    pieces = ["".join(to_char[b] for b in token) for token in sorted(ranks, key=ranks.get)]
    normal, unknown, bpe = 1, 2, 2
    out = [_bytes(1, _bytes(1, p.encode()) + _float(2, float(-rank)) + _number(3, normal)) for rank, p in enumerate(pieces)]
    out.append(_bytes(1, _bytes(1, b"<unk>") + _float(2, 0.0) + _number(3, unknown)))
    n = len(pieces)
    none = (1 << 64) - 1  # -1: the model has no such piece
    out.append(_bytes(2, _number(3, bpe) + _number(4, n + 1) + _number(40, n) + b"".join(_number(f, none) for f in (41, 42, 43)) + _bytes(45, b"<unk>")))
    out.append(_bytes(3, _bytes(1, b"identity") + _bytes(2, b"") + b"".join(_number(f, 0) for f in (3, 4, 5))))
    return b"".join(out)


class Codec:
    """Encodes texts to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        alphabet = byte_alphabet()
        self.printable = {b: alphabet[b] for b in range(256)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def piece(self, pre_token: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (ids := self.memory.get(pre_token)) is None:
            raw = pre_token.encode()
            own = self.ranks.get(raw)
            ids = (own,) if own is not None else tuple(self.model.encode(raw.decode("latin-1").translate(self.printable)))
            if len(pre_token) <= LONGEST_REMEMBERED:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[pre_token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, piece = self.memory.get, self.piece
        for m in self.split.findall(text):
            out += get(m) or piece(m)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(vocabulary: str = RANKS) -> Codec:
    import public_tokenizers

    return Codec(read_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, vocabulary: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([own.encode(t.as_py()) for t in batch[1]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """(doc_id, text): texts of a table of (doc_id, ids); bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([own.decode(x.as_py() or []).decode(errors="replace") for x in batch["ids"]], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: number of ids, digest of the ids, digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            n, ids_, bytes_ = [], [], []
            for t in batch[1]:
                ids = own.encode(t.as_py())
                n.append(len(ids))
                ids_.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                bytes_.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(bytes_, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
