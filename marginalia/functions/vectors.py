"""Vector functions over ARRAY<FLOAT>."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """In doubles; infinite if the lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def quantized(v: Column, dimension: int) -> Column:
    """A bit for each component, set if it is positive, as words of 64 bits."""
    words = []
    for low in range(0, dimension, 64):
        n = min(64, dimension - low)
        bits = F.zip_with(F.slice(v, low + 1, n), F.sequence(F.lit(0), F.lit(n - 1)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        words.append(F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def quantized_query(v: list[float]) -> list[int]:
    """The same for one vector at hand."""
    out = []
    for low in range(0, len(v), 64):
        word = sum(1 << i for i, x in enumerate(v[low : low + 64]) if x > 0)
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def to_blob(v: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(v)}f", *v)


def from_blob(data: bytes) -> list[float] | None:
    """None if the length isn't that of whole floats."""
    return None if len(data) % 4 else list(struct.unpack(f"<{len(data) // 4}f", data))
