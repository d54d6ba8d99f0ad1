"""Block codecs by id."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
import xxhash

from chunkwise import constants as C
from chunkwise.operators import bytelz


class UnsupportedCodec(ValueError):
    """A codec id that isn't known."""


# Fixed values of the LZ4 frame format: its mark, the descriptor of independent blocks of 4 MB with a declared size.
LZ4_MAGIC, LZ4_DESCRIPTOR, LZ4_BLOCK = bytes.fromhex("04224d18"), b"\x68\x70", 4 << 20


@lru_cache
def _arrow(name: str) -> pa.Codec:
    return pa.Codec(name)


@lru_cache
def _zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


def compress(codec: int, level: int, data: bytes, room: int) -> bytes | None:
    """The compressed bytes, or None where the codec declines or needs over ``room`` bytes."""
    if codec == C.BYTELZ:
        return bytelz.compress(data, level, room)
    if codec in (C.LZ4, C.LZ4HC):
        out = _arrow("lz4_raw").compress(data, asbytes=True)
    elif codec == C.SNAPPY:
        out = _arrow("snappy").compress(data, asbytes=True)
    elif codec == C.ZLIB:
        out = zlib.compress(data, level)
    elif codec == C.ZSTD:
        out = _zstd(level).compress(data)
    else:
        raise UnsupportedCodec(codec)
    return out if len(out) <= room else None


def decompress(codec: int, data: bytes, size: int) -> bytes | None:
    """``size`` bytes, or None where the data is broken."""
    if codec not in C.CODEC_NAMES:
        raise UnsupportedCodec(codec)
    try:
        if codec == C.BYTELZ:
            return bytelz.decompress(data, size)
        if codec in (C.LZ4, C.LZ4HC):
            out = _lz4(data, size)
        elif codec == C.SNAPPY:
            if _snappy_size(data) != size:
                return None
            out = _arrow("snappy").decompress(data, size, asbytes=True)
        elif codec == C.ZLIB:
            inflate = zlib.decompressobj()
            out = inflate.decompress(data, size + 1)
        else:
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
    except Exception:  # every library has its own errors for broken data
        return None
    return out if out is not None and len(out) == size else None


def _lz4(data: bytes, size: int) -> bytes | None:
    """The bytes of an LZ4 block. The library doesn't tell how many a block gave, but holds a frame to the size it declares."""
    if 0 < size <= LZ4_BLOCK:
        declared = LZ4_DESCRIPTOR + size.to_bytes(8, "little")
        check = bytes([xxhash.xxh32_intdigest(declared) >> 8 & 255])
        return _arrow("lz4").decompress(b"".join((LZ4_MAGIC, declared, check, len(data).to_bytes(4, "little"), data, bytes(4))), size, asbytes=True)
    out = _arrow("lz4_raw").decompress(data, size, asbytes=True)
    try:  # one that fits into a byte less gave too little
        _arrow("lz4_raw").decompress(data, size - 1)
    except (OSError, ValueError):
        return out
    return None


def _snappy_size(data: bytes) -> int:
    size = 0
    for i, byte in enumerate(data[:5]):
        size |= (byte & 127) << 7 * i
        if byte < 128:
            break
    return size
