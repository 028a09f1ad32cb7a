"""Seeded 64-bit-key hashing as Column expressions, so that sketches hash inside generated code, and the same in Python.

A key's magnitude is hashed by the 32-bit Murmur3 of its low and high words, its sign flipping the high word.  Spark's
``hash`` is that function with the fixed seed 42 and chains over its arguments, and a 4-byte input maps one to one onto
hashes: some integer's hash is any wanted seed, and hashing that integer first seeds the rest.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
GOLDEN = 0x9E3779B1  # step between rows
SECOND = 0x85EBCA6B  # what the second lane's seed differs by
_C1, _C2 = 0xCC9E2D51, 0x1B873593  # Murmur3's multipliers
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35  # of its finalizer


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & MASK


def finalize(x: int) -> int:
    """Murmur3's 32-bit finalizer."""
    x = ((x ^ (x >> 16)) * _F1) & MASK
    x = ((x ^ (x >> 13)) * _F2) & MASK
    return x ^ (x >> 16)


def _round(h: int, word: int) -> int:
    k = (_rotl((word * _C1) & MASK, 15) * _C2) & MASK
    return (_rotl(h ^ k, 13) * 5 + 0xE6546B64) & MASK


def hash_key(key: int, seed: int) -> int:
    """The 32-bit hash of one lane."""
    size = abs(key)
    high = (size >> 32) ^ (1 if key < 0 else 0)
    return finalize(_round(_round(seed & MASK, size & MASK), high & MASK) ^ 8)


def seeding_int(seed: int, start: int = 42) -> int:
    """The signed integer whose hash under the seed ``start`` is ``seed``."""
    inverse = lambda m: pow(m, -1, 1 << 32)
    x = seed & MASK
    x ^= x >> 16
    x = (x * inverse(_F2)) & MASK
    x ^= (x >> 13) ^ (x >> 26)
    x = (x * inverse(_F1)) & MASK
    x ^= x >> 16
    x ^= 4
    k = _rotl(((x - 0xE6546B64) * inverse(5)) & MASK, 19) ^ start
    word = (_rotl((k * inverse(_C2)) & MASK, 17) * inverse(_C1)) & MASK
    return word - (1 << 32) if word >> 31 else word


def lane(key: Column, seed: int) -> Column:
    """``hash_key`` of a LONG column, as a LONG from 0 to 2^32 - 1."""
    word = F.abs(key).bitwiseXOR(F.when(key < 0, F.lit(1 << 32)).otherwise(F.lit(0)).cast("long"))
    return F.hash(F.lit(seeding_int(seed)).cast("int"), word).cast("long").bitwiseAND(F.lit(MASK))


def _times(x: Column, m: int) -> Column:
    """x * m modulo 2^32, in halves so that no product leaves 64 bits."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(m)
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def finalized(x: Column) -> Column:
    """``finalize`` of a LONG column from 0 to 2^32 - 1."""
    x = _times(x.bitwiseXOR(F.shiftright(x, 16)), _F1)
    x = _times(x.bitwiseXOR(F.shiftright(x, 13)), _F2)
    return x.bitwiseXOR(F.shiftright(x, 16))


@lru_cache(maxsize=1 << 16)
def row_columns(key: int, seed: int, d: int, w: int) -> tuple[int, ...]:
    """The cell of a key in each of d rows of w cells (a power of two)."""
    base = hash_key(key, seed) ^ hash_key(key, seed ^ SECOND)
    return tuple(finalize(base ^ ((i * GOLDEN) & MASK)) & (w - 1) for i in range(d))
