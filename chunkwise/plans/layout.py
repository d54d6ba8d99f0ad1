"""Block sizes and splitting.

Each rule is written once over an expression algebra, ``Ints`` for Python integers and
``Cols`` for Spark columns: encoders run it on a worker's numbers, and queries plan
whole tables with it as native expressions.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwise import constants as C


class Ints:
    """Python integers and booleans."""

    @staticmethod
    def case(*branches: tuple[Any, Any], default: Any) -> Any:
        return next((value for condition, value in branches if condition), default)

    least, greatest = min, max
    both = staticmethod(lambda *x: all(x))
    either = staticmethod(lambda *x: any(x))
    div = staticmethod(lambda a, b: a // b)
    lift = staticmethod(lambda x: x)


class Cols:
    """Spark columns."""

    @staticmethod
    def case(*branches: tuple[Column, Any], default: Any) -> Column:
        when = F
        for condition, value in branches:
            when = when.when(condition, value)
        return when.otherwise(default)

    least, greatest = staticmethod(F.least), staticmethod(F.greatest)
    both = staticmethod(lambda *x: reduce(lambda a, b: a & b, x))
    either = staticmethod(lambda *x: reduce(lambda a, b: a | b, x))
    div = staticmethod(lambda a, b: F.floor(a / b).cast("long"))
    lift = staticmethod(lambda x: x if isinstance(x, Column) else F.lit(x))


def splits(alg: Any, codec: Any, clevel: Any, typesize: Any, size: Any, filter_id: Any, version: Any) -> Any:
    """Whether a block of ``size`` bytes is cut into one stream per byte of an item."""
    codec, clevel, typesize, size, filter_id, version = map(alg.lift, (codec, clevel, typesize, size, filter_id, version))
    roomy = alg.both(typesize <= C.MAX_SPLIT_TYPESIZE, alg.div(size, alg.greatest(typesize, alg.lift(1))) >= C.MIN_SPLIT_ITEMS)
    fast = alg.either(codec == C.BYTELZ, codec == C.LZ4, alg.both(codec == C.ZSTD, clevel <= 5))
    v1 = alg.both(codec != C.ZSTD, roomy)
    v2 = alg.both(filter_id == C.SHUFFLE, fast, roomy)
    return alg.either(alg.both(version == 1, v1), alg.both(version == 2, v2))


def blocksize(alg: Any, codec: Any, clevel: Any, typesize: Any, nbytes: Any, filter_id: Any, version: Any) -> Any:
    """Bytes in a block."""
    codec, clevel, typesize, nbytes = map(alg.lift, (codec, clevel, typesize, nbytes))
    split = splits(alg, codec, clevel, typesize, nbytes, filter_id, version)
    strong = alg.either(codec == C.LZ4HC, codec == C.ZLIB, codec == C.ZSTD)
    base = alg.case((strong, alg.lift(2 * C.L1)), default=alg.lift(C.L1))
    leveled = alg.case(
        (clevel == 0, alg.div(base, alg.lift(4))),
        (clevel == 1, alg.div(base, alg.lift(2))),
        (clevel == 2, base),
        (clevel == 3, base * 2),
        (alg.both(clevel >= 4, clevel <= 5), base * 4),
        (alg.both(clevel >= 6, clevel <= 8), base * 8),
        (alg.both(clevel == 9, strong), base * 16),
        (clevel == 9, base * 8),
        default=base,
    )
    large = alg.case((nbytes >= C.L1, leveled), default=nbytes)
    per_item = alg.case((clevel <= 3, alg.lift(32)), (clevel <= 6, alg.lift(64)), (clevel == 7, alg.lift(128)), (clevel == 8, alg.lift(256)), default=alg.lift(512))
    for_split = alg.least(alg.greatest(per_item * 1024 * typesize, alg.lift(C.L1)), alg.lift(C.MAX_SPLIT_BLOCK))
    size = alg.least(alg.case((alg.both(clevel > 0, split), for_split), default=large), nbytes)
    whole = alg.case((size > typesize, size - size % alg.greatest(typesize, alg.lift(1))), default=size)
    return alg.case((nbytes < typesize, alg.greatest(nbytes, alg.lift(1))), default=alg.greatest(whole, alg.lift(1)) if alg is Cols else max(whole, 1))


def nblocks(alg: Any, nbytes: Any, size: Any) -> Any:
    nbytes, size = alg.lift(nbytes), alg.lift(size)
    return alg.div(nbytes + size - 1, size)


def leftover(alg: Any, nbytes: Any, size: Any) -> Any:
    """Whether the last block is short; a short block isn't split."""
    return alg.lift(nbytes) % alg.lift(size) != 0


def planned_flags(alg: Any, codec: Any, clevel: Any, typesize: Any, nbytes: Any, filter_id: Any, version: Any) -> Any:
    """The header's flag byte, but for the bit that tells that compression didn't pay."""
    codec, clevel, nbytes, filter_id, version = map(alg.lift, (codec, clevel, nbytes, filter_id, version))
    size = blocksize(alg, codec, clevel, typesize, nbytes, filter_id, version)
    split = splits(alg, codec, clevel, typesize, size, filter_id, version)
    own = alg.case((filter_id == C.SHUFFLE, alg.lift(C.FLAG_SHUFFLE)), (filter_id == C.BITSHUFFLE, alg.lift(C.FLAG_BITSHUFFLE)), default=alg.lift(0))
    marked = alg.case((version == 2, alg.lift(C.FLAG_SHUFFLE | C.FLAG_BITSHUFFLE)), default=own)
    told = alg.either(version == 1, alg.both(clevel != 0, nbytes >= C.MIN_BUFFER))
    whole = alg.case((split, alg.lift(0)), (told, alg.lift(C.FLAG_DONT_SPLIT)), default=alg.lift(0))
    return marked + whole + format_code(alg, codec, version) * (1 << C.FORMAT_SHIFT)


def format_code(alg: Any, codec: Any, version: Any) -> Any:
    """The codec's code in the flag byte."""
    codec, version = alg.lift(codec), alg.lift(version)
    v1 = alg.case(*[(codec == i, alg.lift(v)) for i, v, _ in C.CODECS.values()], default=alg.lift(0))
    v2 = alg.case(*[(codec == i, alg.lift(v)) for i, _, v in C.CODECS.values()], default=alg.lift(0))
    return alg.case((version == 1, v1), default=v2)


def codec_of_format(alg: Any, code: Any) -> Any:
    """The codec that a v1 frame's format code stands for; -1 if none."""
    code = alg.lift(code)
    return alg.case(*[(code == f, alg.lift(i)) for f, i in C.V1_FORMATS.items()], default=alg.lift(-1))
