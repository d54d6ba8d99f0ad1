"""Headers as native expressions: nothing of a frame but its first bytes is looked at, and no Python runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwise import constants as C
from chunkwise.plans import layout
from chunkwise.plans.layout import Cols


def byte(frame: Column, at: int | Column) -> Column:
    """The byte at a place from 0, as an integer."""
    place = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.hex(F.substring(frame, place.cast("int"), F.lit(1))), 16, 10).cast("int")


def uint32(frame: Column, at: int | Column) -> Column:
    """The little-endian unsigned integer at a place from 0, as a long."""
    return sum((byte(frame, at + i).cast("long") * (1 << 8 * i) for i in range(1, 4)), byte(frame, at).cast("long"))


def int32(frame: Column, at: int | Column) -> Column:
    value = uint32(frame, at)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def _readable(frame: Column, value: Column) -> Column:
    return F.when(F.octet_length(frame) >= C.HEADER_V1, value)


def metainfo(frame: Column) -> Column:
    """(typesize, flags), null for what can't be a frame."""
    return _readable(frame, F.struct(byte(frame, 3).alias("typesize"), byte(frame, 2).alias("flags")))


def sizes(frame: Column) -> Column:
    """(nbytes, cbytes, blocksize); zeros for what can't be a frame."""
    cols = {"nbytes": 4, "cbytes": 12, "blocksize": 8}
    return F.struct(*[F.coalesce(_readable(frame, uint32(frame, at)), F.lit(0).cast("long")).alias(name) for name, at in cols.items()])


def validate(frame: Column, cbytes: Column | None = None) -> Column:
    """The size of the buffer, if the frame says it has ``cbytes`` bytes (its length by default); else null."""
    return _readable(frame, F.when(uint32(frame, 12) == (F.octet_length(frame) if cbytes is None else cbytes), uint32(frame, 4)))


def header(frame: Column) -> Column:
    """All fields of a header; those of version 2 are null in version 1, and all are null for what can't be a frame."""
    version, flags = byte(frame, 0), byte(frame, 2)
    v2 = version.isin(*C.EXTENDED_VERSIONS)
    slots = F.array(*[byte(frame, 16 + i) for i in range(C.MAX_FILTERS)])
    marked = flags.bitwiseAND(C.FLAG_SHUFFLE | C.FLAG_BITSHUFFLE)
    nbytes, blocksize = uint32(frame, 4), uint32(frame, 8)
    codec = F.when(v2, byte(frame, 22)).otherwise(layout.codec_of_format(Cols, F.shiftright(flags, C.FORMAT_SHIFT)))
    fields = {
        "version": version,
        "versionlz": byte(frame, 1),
        "flags": flags,
        "typesize": byte(frame, 3),
        "nbytes": nbytes,
        "blocksize": blocksize,
        "cbytes": uint32(frame, 12),
        "filters": F.when(v2, slots),
        "compcode": codec,
        "filters_meta": F.when(v2, F.array(*[byte(frame, 24 + i) for i in range(C.MAX_FILTERS)])),
        "is_v1": ~v2,
        "memcpyed": flags.bitwiseAND(C.FLAG_MEMCPY) != 0,
        "dont_split": flags.bitwiseAND(C.FLAG_DONT_SPLIT) != 0,
        "doshuffle": F.when(v2, F.array_contains(slots, C.SHUFFLE)).otherwise(marked == C.FLAG_SHUFFLE),
        "dobitshuffle": F.when(v2, F.array_contains(slots, C.BITSHUFFLE) & ~F.array_contains(slots, C.SHUFFLE)).otherwise(marked == C.FLAG_BITSHUFFLE),
        "nblocks": F.when(blocksize > 0, layout.nblocks(Cols, nbytes, F.greatest(blocksize, F.lit(1)))).otherwise(F.lit(0).cast("long")),
    }
    long_enough = F.octet_length(frame) >= F.when(v2, C.HEADER_V2).otherwise(C.HEADER_V1)
    return F.when(long_enough, F.struct(*[c.alias(name) for name, c in fields.items()]))


def outcome(frame: Column, h: Column) -> Column:
    """What reading a frame with header ``h`` would say, as far as header and index tell."""
    length = F.when(h["is_v1"], C.HEADER_V1).otherwise(C.HEADER_V2).cast("long")
    whole = h["version"].isin(*C.KNOWN_VERSIONS) & h["cbytes"].between(length, F.octet_length(frame)) & (h["nbytes"] <= C.MAX_BUFFER) & ((h["nbytes"] == 0) | (h["blocksize"] > 0))
    strange = F.coalesce(F.exists(h["filters"], lambda f: ~f.isin(C.NOFILTER, C.SHUFFLE, C.BITSHUFFLE)), F.lit(False))
    end = length + 4 * h["nblocks"]
    starts = block_starts(frame, h)
    return (
        F.when(h.isNull() | ~whole, C.INVALID_HEADER)
        .when(strange, C.FAILED)
        .when(h["memcpyed"], F.when(length + h["nbytes"] > h["cbytes"], C.FAILED).otherwise(C.OK))
        .when(h["nbytes"] == 0, C.OK)
        .when(~h["compcode"].isin(*C.CODEC_NAMES), C.UNSUPPORTED_CODEC)
        .when((end > h["cbytes"]) | F.exists(starts, lambda s: (s < end) | (s >= h["cbytes"])), C.FAILED)
        .otherwise(C.OK)
    )


def block_starts(frame: Column, h: Column) -> Column:
    """Where the blocks of a compressed frame begin; null where the index doesn't fit into it."""
    length = F.when(h["is_v1"], C.HEADER_V1).otherwise(C.HEADER_V2).cast("long")
    fits = ~h["memcpyed"] & (h["nblocks"] > 0) & (F.octet_length(frame) >= length + 4 * h["nblocks"])
    last = F.when(fits, h["nblocks"] - 1).otherwise(0).cast("long")
    return F.when(fits, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: uint32(frame, length + i * 4)))


def header_bytes(version: int, codec: str, typesize: Column, flags: Column, nbytes: Column, blocksize: Column, cbytes: Column, filter_id: Column | None = None) -> Column:
    """A header, built from its fields."""

    def le(value: Column, width: int) -> Column:
        digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
        return F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)])

    head = [F.lit(f"{C.VERSION_V2 if version == 2 else C.VERSION_V1:02X}01"), le(flags, 1), le(typesize, 1), le(nbytes, 4), le(blocksize, 4), le(cbytes, 4)]
    if version == 2:
        filter_id = F.lit(0) if filter_id is None else filter_id
        head += [F.lit("00" * 5), le(filter_id, 1), F.lit(f"{C.CODECS[codec][0]:02X}" + "00" * 9)]
    return F.unhex(F.concat(*head))


def stored(frame: Column) -> Column:
    """Whether the buffer stands in the frame as it is, whole."""
    length = F.when(byte(frame, 0).isin(*C.EXTENDED_VERSIONS), C.HEADER_V2).otherwise(C.HEADER_V1)
    sound = byte(frame, 0).isin(*C.KNOWN_VERSIONS) & (uint32(frame, 12) <= F.octet_length(frame)) & (length + uint32(frame, 4) <= uint32(frame, 12))
    return F.coalesce((F.octet_length(frame) >= length) & (byte(frame, 2).bitwiseAND(C.FLAG_MEMCPY) != 0) & sound, F.lit(False))


def stored_payload(frame: Column, first: Column | None = None, size: Column | None = None) -> Column:
    """Bytes of a stored buffer, all by default."""
    length = F.when(byte(frame, 0).isin(*C.EXTENDED_VERSIONS), C.HEADER_V2).otherwise(C.HEADER_V1)
    begin = length + 1 if first is None else length + 1 + first
    return F.substring(frame, begin.cast("int"), (uint32(frame, 4) if size is None else size).cast("int"))
