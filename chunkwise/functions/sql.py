"""The functions by SQL names.

After ``register(spark)``::

    SELECT frame_compress(text, 'zstd', 3, 1, 'none', 2) FROM documents
    SELECT frame_decompress(frame), frame_status(frame), frame_items(frame, 10, 5) FROM chunks
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkwise import constants as C
from chunkwise._ship import ship
from chunkwise.operators import frame as frames
from chunkwise.operators.frame import BadFrame, CParams


def _outcome(frame: bytes) -> tuple[bytes | None, str]:
    try:
        return frames.decode(frame), C.OK
    except BadFrame as e:
        return None, str(e)


def register(spark: SparkSession) -> None:
    """Makes frame_compress, frame_decompress, frame_status and frame_items known to the session's SQL."""
    ship(spark)

    @F.arrow_udf("binary")
    def frame_compress(data: pa.Array, codec: pa.Array, clevel: pa.Array, typesize: pa.Array, filter_name: pa.Array, version: pa.Array) -> pa.Array:
        params = zip(*(c.to_pylist() for c in (codec, clevel, typesize, filter_name, version)), strict=True)
        buffers = data.cast(pa.binary())
        return pa.array([frames.encode(d.as_py(), CParams(*p)) if d.is_valid else None for d, p in zip(buffers, params, strict=True)], pa.binary())

    @F.arrow_udf("binary")
    def frame_decompress(data: pa.Array) -> pa.Array:
        return pa.array([_outcome(d.as_py())[0] if d.is_valid else None for d in data], pa.binary())

    @F.arrow_udf("string")
    def frame_status(data: pa.Array) -> pa.Array:
        return pa.array([_outcome(d.as_py())[1] if d.is_valid else None for d in data], pa.string())

    @F.arrow_udf("binary")
    def frame_items(data: pa.Array, start: pa.Array, count: pa.Array) -> pa.Array:
        def one(d: bytes, s: int, n: int) -> bytes | None:
            try:
                return frames.get_items(d, s, n)
            except BadFrame:
                return None

        rows = zip(data.to_pylist(), start.to_pylist(), count.to_pylist(), strict=True)
        return pa.array([None if None in r else one(*r) for r in rows], pa.binary())

    for f in (frame_compress, frame_decompress, frame_status, frame_items):
        spark.udf.register(f.__name__, f)
