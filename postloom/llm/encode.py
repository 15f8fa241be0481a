"""Encoding a corpus with a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The vocabulary's pieces are byte strings with ranks. Each byte is written as one printable character, the
pieces become the pieces of a BPE model, the score of a piece is its negative rank, and the normaliser does
nothing. The model's merges are then those of the vocabulary: the pair of lowest rank first, from the left.
Texts are cut into pre-tokens by the vocabulary's own pattern, and each distinct pre-token of a batch is
encoded once. The vocabulary is read on the driver and the model, whose size it bounds, is broadcast.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that cuts texts before the merges. White space is the Unicode property, as
# in the pattern's home libraries; Python's own \s also takes four control characters.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_UNKNOWN = "͸"  # never produced: all 256 bytes are pieces


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """The pieces in order of rank; ranks must run from 0 without gaps and hold every single byte."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(n): base64.b64decode(piece) for piece, n in pairs}
    if sorted(ranks) != list(range(len(ranks))) or len({*ranks.values()}) != len(ranks):
        raise ValueError("ranks have gaps or pieces occur twice")
    pieces = [ranks[i] for i in range(len(ranks))]
    if len({p for p in pieces if len(p) == 1}) != 256:
        raise ValueError("a byte is missing")
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: a varint, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model with these pieces as ids 0, 1, ...; the unknown piece comes after them."""
    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, _UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    trainer += _field(45, _UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, pattern: str = PATTERN, kept: int = 1 << 18):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.latin = str.maketrans({chr(b): c for b, c in self.table.items()})
        self.bytes = {c: b for b, c in self.table.items()}
        self.known: dict[str, np.ndarray] = {}
        self.kept = kept

    def mapped(self, token: str) -> str:
        # a lone surrogate can't come from Spark's strings, which are UTF-8
        return token.encode("utf-8", "replace").decode("latin-1").translate(self.latin)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.find(t) if t else [] for t in texts]
        new = list({t for tokens in cut for t in tokens if t not in self.known})
        if len(self.known) + len(new) > self.kept:
            self.known, new = {}, list({t for tokens in cut for t in tokens})
        for token, ids in zip(new, self.sp.encode([self.mapped(t) for t in new], num_threads=1) if new else [], strict=True):
            self.known[token] = np.asarray(ids, np.int32)
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[t] for t in tokens]) if tokens else none for tokens in cut]

    def decode(self, ids: list[int]) -> str:
        return bytes(self.bytes[c] for c in "".join(self.sp.id_to_piece([int(i) for i in ids]))).decode("utf-8", "replace") if len(ids) else ""


@lru_cache(maxsize=4)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): the token ids of each text. A null or empty text has an empty list, never null.

    One row comes out per row, repeated and null keys included; strings of special tokens are ordinary
    text. Whole texts are encoded, whatever their length.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for b in batches:
            # few rows at a time: the ids of a long text take several times its size
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = codec.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return spread(rows).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, text): the texts that lists of ids stand for; empty for an empty list, null for a null one.

    Bytes that are no UTF-8, as after cutting a list, become U+FFFD.
    """
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    @F.pandas_udf("string")
    def decoded(lists: pd.Series) -> pd.Series:
        codec = _codec(model.value, pattern)
        return lists.map(lambda x: None if x is None else codec.decode(x))

    return df.select(df[key].alias(key), decoded(df[ids]).alias("text"))
