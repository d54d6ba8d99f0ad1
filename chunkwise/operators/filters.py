"""Byte and bit transposition.

With items of E bytes, ``shuffle`` puts all first bytes first, then all second bytes;
``bitshuffle`` does so with bits, over groups of eight items. Bytes that make no
whole item (or group of eight) keep their place. As permutations of a reshaped array
they need no loop; ``permutation`` gives the same order as Spark columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _head(data: bytes, typesize: int, group: int = 1) -> tuple[np.ndarray, bytes]:
    """The items that are moved, one a row, and the bytes that stay."""
    items = len(data) // typesize // group * group
    moved = np.frombuffer(data, np.uint8, items * typesize).reshape(items, typesize)
    return moved, data[items * typesize :]


def shuffle(data: bytes, typesize: int) -> bytes:
    items, tail = _head(data, typesize)
    return items.T.tobytes() + tail


def unshuffle(data: bytes, typesize: int) -> bytes:
    items, tail = _head(data, typesize)
    return items.reshape(typesize, -1).T.tobytes() + tail


#: For each byte an integer that has bit b of it as the lowest bit of byte b.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def _turned(octets: np.ndarray) -> np.ndarray:
    """Groups of eight bytes (on the first axis of eight) as 8 x 8 bits, turned: byte b gets bit b of every byte."""
    out = SPREAD[octets[0]]
    for m in range(1, 8):
        out |= SPREAD[octets[m]] << np.uint64(m)
    return out[..., None].view(np.uint8)  # the eight bytes are the last axis


def bitshuffle(data: bytes, typesize: int) -> bytes:
    items, tail = _head(data, typesize, 8)
    groups = items.reshape(-1, 8, typesize)  # group, item, byte
    return _turned(groups.transpose(1, 2, 0)).transpose(0, 2, 1).tobytes() + tail


def bitunshuffle(data: bytes, typesize: int) -> bytes:
    items, tail = _head(data, typesize, 8)
    planes = items.reshape(typesize, 8, len(items) // 8)  # byte, bit, group of eight items
    return _turned(planes.transpose(1, 2, 0)).transpose(0, 2, 1).tobytes() + tail


def permutation(size: Column, typesize: Column, inverse: bool = False) -> Column:
    """For each byte of a shuffled buffer (or unshuffled, if ``inverse``) its place in the source, from 0."""
    size, typesize = size.cast("long"), typesize.cast("long")
    items = F.floor(size / typesize)
    one, many = (items, typesize) if not inverse else (typesize, items)

    def source(i: Column) -> Column:
        # destination i holds byte i div one of item i mod one; the inverse swaps the two
        moved = (i % F.greatest(one, F.lit(1))) * many + F.floor(i / F.greatest(one, F.lit(1)))
        return F.when(i < items * typesize, moved).otherwise(i)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("long"), size - 1), source)).otherwise(F.array().cast("array<bigint>"))


def permuted(data: Column, order: Column) -> Column:
    """A binary column's bytes in a given order. For short buffers; UDFs move whole blocks."""
    digits = F.hex(data)
    return F.unhex(F.array_join(F.transform(order, lambda i: F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2))), ""))


def native_shuffle(data: Column, typesize: Column) -> Column:
    return permuted(data, permutation(F.octet_length(data), typesize))


def native_unshuffle(data: Column, typesize: Column) -> Column:
    return permuted(data, permutation(F.octet_length(data), typesize, inverse=True))
