"""Frames: one buffer, cut into blocks, filtered, compressed, and put behind a header.

These functions work on the bytes of one frame. Spark sees them as Arrow functions
(``chunkwise.functions``) and as the reader and writer of ``chunkwise.sources``.

Rules where writers of the format differ or fail: level 0 and buffers of fewer than 32
bytes are stored as they are; one filter at most; type sizes 1 to 255, and 0 counts
as 1; versions 1 to 5 are read. Nothing that a frame says is trusted: every length is
checked, and a broken frame gives a status, never an exception.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from chunkwise import constants as C
from chunkwise.operators import codecs, filters
from chunkwise.plans import layout
from chunkwise.plans.layout import Ints


class BadFrame(ValueError):
    """What is wrong with a frame: one of the statuses."""


@dataclass(frozen=True)
class CParams:
    """How a buffer is compressed. Parameters below ``filters`` can only have their defaults."""

    codec: str = C.DEFAULT_CODEC
    clevel: int = C.DEFAULT_CLEVEL
    typesize: int = C.DEFAULT_TYPESIZE
    filter: str = C.DEFAULT_FILTER
    version: int = 2
    filters_meta: tuple[int, ...] = (0,) * C.MAX_FILTERS
    use_dict: bool = False
    nthreads: int = C.DEFAULT_NTHREADS
    blocksize: int = 0
    splitmode: str = "forward_compat"
    codec_meta: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "codec", C.ALIASES.get(self.codec, self.codec))
        if self.codec not in C.CODECS:
            raise ValueError(f"no codec {self.codec!r}; there are {', '.join(C.CODECS)}")
        if self.filter not in C.FILTERS:
            raise ValueError(f"no filter {self.filter!r}; there are {', '.join(C.FILTERS)}")
        if not 0 <= self.clevel <= 9:
            raise ValueError("levels are 0 to 9")
        if not 0 <= self.typesize <= C.MAX_TYPESIZE:
            raise ValueError("type sizes are 0 to 255")
        if self.version not in (1, 2):
            raise ValueError("frame versions are 1 and 2")
        if len(self.filters_meta) != C.MAX_FILTERS or any(not 0 <= m <= 255 for m in self.filters_meta):
            raise ValueError("filters_meta is six bytes")
        for f in fields(self)[fields(self).index(next(x for x in fields(self) if x.name == "use_dict")) :]:
            if getattr(self, f.name) != f.default:
                raise ValueError(f"{f.name} can't be chosen")

    @property
    def width(self) -> int:
        return max(1, self.typesize)

    @property
    def codec_id(self) -> int:
        return C.CODECS[self.codec][0]

    @property
    def filter_id(self) -> int:
        """Shuffling single bytes does nothing and isn't recorded."""
        chosen = C.FILTERS[self.filter]
        return C.NOFILTER if chosen == C.SHUFFLE and self.width == 1 else chosen


@dataclass(frozen=True)
class DParams:
    """How a frame is read: there is nothing to choose."""

    nthreads: int = C.DEFAULT_NTHREADS

    def __post_init__(self) -> None:
        if self.nthreads != C.DEFAULT_NTHREADS:
            raise ValueError("nthreads can't be chosen")


@dataclass(frozen=True)
class Context:
    """Parameters of both directions."""

    cparams: CParams = field(default_factory=CParams)
    dparams: DParams = field(default_factory=DParams)


@dataclass(frozen=True)
class Header:
    version: int
    flags: int
    typesize: int
    nbytes: int
    blocksize: int
    cbytes: int
    codec: int
    filter: int
    length: int

    @property
    def memcpyed(self) -> bool:
        return bool(self.flags & C.FLAG_MEMCPY)

    @property
    def nblocks(self) -> int:
        return -(-self.nbytes // self.blocksize) if self.blocksize else 0

    def block(self, i: int) -> tuple[int, int]:
        """Where block i begins and how many bytes it has."""
        at = i * self.blocksize
        return at, min(self.blocksize, self.nbytes - at)

    def streams(self, size: int) -> int:
        """Into how many streams a block of this size is cut."""
        split = not self.flags & C.FLAG_DONT_SPLIT and size == self.blocksize
        return self.typesize if split else 1


def build_header(p: CParams, nbytes: int, blocksize: int, cbytes: int, flags: int) -> bytes:
    version = C.VERSION_V2 if p.version == 2 else C.VERSION_V1
    head = struct.pack("<4B3I", version, C.CODEC_FORMAT_VERSION, flags, p.typesize, nbytes, blocksize, cbytes)
    if p.version == 1:
        return head
    slots = bytes([0] * (C.MAX_FILTERS - 1) + [p.filter_id])
    return head + slots + bytes([p.codec_id, 0]) + bytes(p.filters_meta) + bytes(2)


def parse_header(frame: bytes) -> Header:
    if len(frame) < C.HEADER_V1:
        raise BadFrame(C.INVALID_HEADER)
    version, _, flags, typesize, nbytes, blocksize, cbytes = struct.unpack_from("<4B3I", frame)
    extended = version in C.EXTENDED_VERSIONS
    length = C.HEADER_V2 if extended else C.HEADER_V1
    if version not in C.KNOWN_VERSIONS or len(frame) < length or not length <= cbytes <= len(frame) or nbytes > C.MAX_BUFFER:
        raise BadFrame(C.INVALID_HEADER)
    if extended:
        codec, slots = frame[22], frame[16:22]
        filter_id = next((f for f in (C.SHUFFLE, C.BITSHUFFLE) if f in slots), C.NOFILTER)
        if any(f not in (C.NOFILTER, C.SHUFFLE, C.BITSHUFFLE) for f in slots):
            raise BadFrame(C.FAILED)  # filters that were recorded but never specified here
    else:
        codec = layout.codec_of_format(Ints, flags >> C.FORMAT_SHIFT)
        marked = flags & (C.FLAG_SHUFFLE | C.FLAG_BITSHUFFLE)
        filter_id = {C.FLAG_SHUFFLE: C.SHUFFLE, C.FLAG_BITSHUFFLE: C.BITSHUFFLE}.get(marked, C.NOFILTER)
    if nbytes and not blocksize:
        raise BadFrame(C.INVALID_HEADER)
    return Header(version, flags, max(1, typesize), nbytes, blocksize, cbytes, codec, filter_id, length)


def encode(data: bytes, p: CParams) -> bytes:
    """The frame of a buffer."""
    n = len(data)
    if n > C.MAX_BUFFER:
        raise ValueError(f"a frame holds at most {C.MAX_BUFFER} bytes")
    plan = (p.codec_id, p.clevel, p.width, n, p.filter_id, p.version)
    size, flags = layout.blocksize(Ints, *plan), layout.planned_flags(Ints, *plan)
    header = C.HEADER_V2 if p.version == 2 else C.HEADER_V1
    body = _blocks(data, p, size, header) if p.clevel and n >= C.MIN_BUFFER else None
    if body is None:
        return build_header(p, n, size, header + n, flags | C.FLAG_MEMCPY) + data
    return build_header(p, n, size, header + len(body), flags) + body


def _blocks(data: bytes, p: CParams, size: int, header: int) -> bytes | None:
    """The index and the blocks, or None where a stream doesn't shrink."""
    n = len(data)
    count = -(-n // size)
    starts, out, room = [], bytearray(), n - 4 * count  # a frame is never longer than its header and its buffer
    for i in range(count):
        block = data[i * size : (i + 1) * size]
        if p.filter_id == C.SHUFFLE:
            block = filters.shuffle(block, p.width)
        elif p.filter_id == C.BITSHUFFLE:
            block = filters.bitshuffle(block, p.width)
        split = len(block) == size and layout.splits(Ints, p.codec_id, p.clevel, p.width, size, p.filter_id, p.version)
        part = len(block) // p.width if split else len(block)
        starts.append(header + 4 * count + len(out))
        for at in range(0, len(block), part):
            stream = block[at : at + part]
            packed = codecs.compress(p.codec_id, p.clevel, stream, room - len(out) - 4)
            if packed is None or len(packed) >= len(stream):
                return None
            out += struct.pack("<i", len(packed)) + packed
    return struct.pack(f"<{count}I", *starts) + bytes(out) if len(out) < n else None


def _index(frame: bytes, h: Header) -> tuple[int, ...]:
    end = h.length + 4 * h.nblocks
    if end > h.cbytes:
        raise BadFrame(C.FAILED)
    starts = struct.unpack_from(f"<{h.nblocks}I", frame, h.length)
    if any(not end <= s < h.cbytes for s in starts):
        raise BadFrame(C.FAILED)
    return starts


def streams(frame: bytes, h: Header, start: int, size: int) -> Iterator[tuple[int, str, bytes, int]]:
    """(size field, kind, payload, bytes it gives) of each stream of the block that begins at ``start``."""
    count = h.streams(size)
    each, rest = divmod(size, count)
    if rest:
        raise BadFrame(C.FAILED)
    at = start
    for _ in range(count):
        if at + 4 > h.cbytes:
            raise BadFrame(C.FAILED)
        (field_value,) = struct.unpack_from("<i", frame, at)
        length = field_value if field_value > 0 else int(field_value < 0)
        payload = frame[at + 4 : at + 4 + length]
        at += 4 + length
        if at > h.cbytes:
            raise BadFrame(C.FAILED)
        kind = "zeros" if not field_value else "run" if field_value < 0 else "raw" if field_value == each else "codec"
        yield field_value, kind, payload, each


def _stream(h: Header, field_value: int, kind: str, payload: bytes, each: int) -> bytes:
    if kind == "zeros":
        return bytes(each)
    if kind == "run":
        if not payload[0] & 1:
            raise BadFrame(C.FAILED)
        return bytes([-field_value & 255]) * each
    if kind == "raw":
        return payload
    out = codecs.decompress(h.codec, payload, each)
    if out is None:
        raise BadFrame(C.FAILED)
    return out


def decode_block(frame: bytes, h: Header, start: int, size: int) -> bytes:
    block = b"".join(_stream(h, *s) for s in streams(frame, h, start, size))
    if h.filter == C.SHUFFLE and h.typesize > 1:
        return filters.unshuffle(block, h.typesize)
    if h.filter == C.BITSHUFFLE and h.blocksize >= h.typesize:
        return filters.bitunshuffle(block, h.typesize)
    return block


def decode(frame: bytes) -> bytes:
    """The buffer of a frame; raises ``BadFrame`` with a status."""
    h = parse_header(frame)
    return _range(frame, h, 0, h.nbytes)


def _range(frame: bytes, h: Header, first: int, end: int) -> bytes:
    """Bytes ``first`` to ``end``, from the blocks that hold them."""
    if h.memcpyed:
        if h.length + h.nbytes > h.cbytes:
            raise BadFrame(C.FAILED)
        return frame[h.length + first : h.length + end]
    if first >= end:
        return b""
    if h.codec not in C.CODEC_NAMES:
        raise BadFrame(C.UNSUPPORTED_CODEC)
    starts = _index(frame, h)
    touched = range(first // h.blocksize, (end - 1) // h.blocksize + 1)
    out = b"".join(decode_block(frame, h, starts[i], h.block(i)[1]) for i in touched)
    skipped = touched.start * h.blocksize
    return out[first - skipped : end - skipped]


def get_items(frame: bytes, start: int, count: int) -> bytes:
    """Items ``start`` to ``start + count``; only their blocks are decoded."""
    h = parse_header(frame)
    if start < 0 or count < 0 or (start + count) * h.typesize > h.nbytes:
        raise BadFrame(C.OUT_OF_RANGE)
    return _range(frame, h, start * h.typesize, (start + count) * h.typesize)


def blocks_touched(frame: bytes, start: int, count: int) -> int:
    h = parse_header(frame)
    if h.memcpyed or not count:
        return 0
    return ((start + count) * h.typesize - 1) // h.blocksize - start * h.typesize // h.blocksize + 1
