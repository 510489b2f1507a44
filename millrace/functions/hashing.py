"""Unsigned 64-bit hashes. As BIGINT is signed, they are carried as 16 hex digits, which compare as unsigned."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters of FNV-1a and of the SplitMix64 generator.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def first_u64_le(sha_hex: Column) -> Column:
    """First 8 bytes of a hash, read as a little-endian number, as big-endian hex."""
    return F.concat(*(F.substring(sha_hex, at, 2) for at in range(15, 0, -2)))


def seeded_hash(seed: int, text: Column) -> Column:
    """Hash of a text under a seed: SHA-256 of the seed's 8 little-endian bytes and the text."""
    return first_u64_le(F.sha2(F.concat(F.lit(bytearray(seed.to_bytes(8, "little"))), F.encode(text, "UTF-8")), 256))


def fnv1a64(data: bytes) -> int:
    value = FNV_OFFSET
    for b in data:
        value = ((value ^ b) * FNV_PRIME) & _MASK
    return value


def mix64(value: int) -> int:
    value = ((value ^ (value >> 30)) * MIX_A) & _MASK
    value = ((value ^ (value >> 27)) * MIX_B) & _MASK
    return value ^ (value >> 31)


class SplitMix:
    """A stream of 64-bit numbers; ``many`` gives the next n at once."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & _MASK
        return mix64(self.state)

    def many(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = np.uint64(self.state) + np.uint64(GOLDEN) * np.arange(1, n + 1, dtype=np.uint64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        self.state = (self.state + GOLDEN * n) & _MASK
        return z ^ (z >> np.uint64(31))


def unit24(value: int) -> np.float32:
    """The top 24 bits as a number from 0 to below 1."""
    return np.float32(value >> 40) / np.float32(1 << 24)


@F.pandas_udf(T.StringType())
def fnv1a64_hex(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else f"{fnv1a64(t.encode()):016x}" for t in texts], dtype=object)


def shuffle_order(n: int, seed: int, epoch: int) -> np.ndarray:
    """Positions 0..n-1 in the order of an epoch: an exchange from the end, each with one below or at it."""
    draws = SplitMix(seed ^ (GOLDEN * (epoch + 1) & _MASK)).many(max(n - 1, 0))
    order = np.arange(n, dtype=np.int64)
    for at, draw in zip(range(n - 1, 0, -1), draws.tolist()):
        other = draw % (at + 1)
        order[at], order[other] = order[other], order[at]
    return order


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
