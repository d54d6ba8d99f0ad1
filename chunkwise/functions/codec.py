"""Compression as column functions.

They run as Arrow functions, a batch of frames at a time; what frames decode to is handed
on in pieces, since it may be many times as large as they are. Buffers that were stored
uncompressed are cut out by native expressions: Python gets a null instead of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwise import constants as C
from chunkwise._ship import ship
from chunkwise.functions.header import stored, stored_payload
from chunkwise.operators import frame as frames
from chunkwise.operators.frame import BadFrame, Context, CParams
from chunkwise.operators.pieces import cut


def _pieces(work: Callable[..., bytes | None], *columns: pa.Array) -> Iterator[pa.Array]:
    """One value at a time out of Arrow memory, and some into it at once; nulls stay null."""
    out = (None if any(not v.is_valid for v in row) else work(*(v.as_py() for v in row)) for row in zip(*columns, strict=True))
    for done in cut(out, lambda v: len(v or b"")):
        yield pa.array(done, pa.binary())


def _each(work: Callable[..., bytes | None], *columns: pa.Array) -> pa.Array:
    """All values of a batch as one array."""
    return pa.concat_arrays([pa.array([], pa.binary()), *_pieces(work, *columns)])


def compress(buffer: Column, params: CParams | Context | None = None, **options: object) -> Column:
    """The frame of a binary or string column's value, with the parameters of ``CParams`` or as options."""
    if isinstance(params, Context):
        params = params.cparams
    params = params or CParams(**options)

    ship()

    @F.arrow_udf("binary")
    def encode(data: pa.Array) -> pa.Array:
        return _each(lambda d: frames.encode(d, params), data)

    return encode(buffer.cast("binary"))


def easy_compress(buffer: Column, version: int = 2) -> Column:
    """``compress`` with the settings of the easy interface: level 5, items of 8 bytes, shuffled."""
    return compress(buffer, CParams(filter=C.EASY_FILTER, version=version))


def decompress(frame: Column, mode: str = "permissive") -> Column:
    """The buffer of a frame of either version. Broken frames give null, or fail the job where ``mode`` is "failfast"."""
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"no mode {mode!r}")

    ship()

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(d: bytes) -> bytes | None:
            try:
                return frames.decode(d)
            except BadFrame:
                if mode == "failfast":
                    raise
                return None

        for data in batches:
            yield from _pieces(one, data)

    native = stored(frame)
    return F.coalesce(F.when(native, stored_payload(frame)), decode(F.when(~native, frame)))


def status(frame: Column) -> Column:
    """What reading a frame comes to: ok, invalid_header, unsupported_codec or failed; null for null."""

    ship()

    @F.arrow_udf("string")
    def read(data: pa.Array) -> pa.Array:
        def one(d: bytes) -> str:
            try:
                frames.decode(d)
            except BadFrame as e:
                return str(e)
            return C.OK

        return pa.array([one(v.as_py()) if v.is_valid else None for v in data], pa.string())

    native = stored(frame)
    return F.when(native, F.lit(C.OK)).otherwise(read(F.when(~native, frame)))


def get_items(frame: Column, start: Column | int, count: Column | int) -> Column:
    """The bytes of ``count`` items from ``start`` on; null where the range or the frame is bad."""
    start, count = (c if isinstance(c, Column) else F.lit(c) for c in (start, count))

    ship()

    @F.arrow_udf("binary")
    def read(data: pa.Array, start: pa.Array, count: pa.Array) -> pa.Array:
        def one(d: bytes, s: int, n: int) -> bytes | None:
            try:
                return frames.get_items(d, s, n)
            except BadFrame:
                return None

        return _each(one, data, start, count)

    return read(frame, start.cast("long"), count.cast("long"))
