"""Variable-byte codec: little-endian groups of seven bits, the high bit set on all bytes but the last."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_length(value: Column) -> Column:
    """Bytes that a value of 0 or more takes."""
    return (F.lit(1) + F.floor((F.length(F.bin(value)) - 1) / 7)).cast("int")


def varint(value: Column) -> Column:
    """The encoding of a value as BINARY; a negative value is an error, null stays null."""
    checked = F.when(value < 0, F.raise_error(F.lit("a varint can't be negative"))).otherwise(value.cast("long"))
    last = varint_length(checked) - 1

    def group(i: Column) -> Column:
        bits = F.call_function("shiftrightunsigned", checked, i * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(bits.bitwiseOR(F.when(i < last, F.lit(128)).otherwise(F.lit(0)))), 2, "0")

    return F.when(value.isNotNull(), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), group), "")))


def encode_values(values: np.ndarray) -> bytes:
    """All values, one after the other; vectorised over the values."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    n = np.ones(len(v), np.int64)
    for i in range(1, 10):
        n += v >= np.uint64(1) << np.uint64(7 * i)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(v)), n)
    place = np.arange(ends[-1]) - np.repeat(ends - n, n)
    out = (v[owner] >> (place * 7).astype(np.uint64)) & np.uint64(127)
    out[place < n[owner] - 1] |= np.uint64(128)
    return out.astype(np.uint8).tobytes()


def decode_values(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("the last value is cut off")
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & np.uint64(127)) << (place * 7).astype(np.uint64), starts).astype(np.int64)


def encode_postings(doc_ids: np.ndarray, tfs: np.ndarray) -> bytes:
    """Gap and frequency of each posting in turn. Ids must ascend strictly, from 1 at least."""
    ids = np.asarray(doc_ids, np.int64)
    gaps = np.diff(ids, prepend=0)
    if (gaps <= 0).any():
        raise ValueError("ids must ascend from 1")
    return encode_values(np.stack([gaps, np.asarray(tfs, np.int64)], axis=1).ravel())


def decode_postings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = decode_values(data)
    return np.cumsum(v[0::2]), v[1::2]
