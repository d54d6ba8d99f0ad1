"""Typed columns into chunks of frames and back.

A chunk holds a run of consecutive items of one column: their values as little-endian
bytes in one frame, a second frame of one byte an item where some are null, and for
strings and binaries a frame of 32-bit offsets besides that of the bytes.

Schema of chunks: chunk_id, first (place of the first item), n, frame, validity, offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chunkwise._ship import ship
from chunkwise.operators import frame as frames
from chunkwise.operators.frame import CParams
from chunkwise.operators.pieces import PIECE, cut

#: Bytes of an item of each type.
WIDTHS = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16, T.StringType: 1, T.BinaryType: 1,
}
ITEMS = 4096


def width_of(kind: T.DataType) -> int:
    for known, width in WIDTHS.items():
        if isinstance(kind, known):
            return width
    raise ValueError(f"columns of type {kind.simpleString()} can't be packed")


def _raw(values: pa.Array) -> bytes:
    """The bytes of fixed-width values without nulls."""
    if pa.types.is_boolean(values.type):
        values = values.cast(pa.int8())
    width = values.type.bit_width // 8
    return values.buffers()[1][values.offset * width : (values.offset + len(values)) * width].to_pybytes() if len(values) else b""


def _zero(kind: pa.DataType) -> pa.Scalar:
    if pa.types.is_string(kind):
        return pa.scalar("", kind)
    if pa.types.is_binary(kind):
        return pa.scalar(b"", kind)
    if pa.types.is_decimal(kind):
        return pa.scalar(0).cast(kind)
    return pa.Array.from_buffers(kind, 1, [None, pa.py_buffer(bytes(16))])[0]


def _frames(values: pa.Array, params: CParams) -> tuple[bytes, bytes | None, bytes | None]:
    validity = offsets = None
    if values.null_count:
        flags = pc.is_valid(values).cast(pa.uint8())
        validity = frames.encode(_raw(flags), replace(params, typesize=1))
        values = pc.fill_null(values, _zero(values.type))
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        data = values.cast(pa.binary())
        ends = np.frombuffer(data.buffers()[1], "<i4")[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, "<i4")
        offsets = frames.encode((ends - ends[0]).tobytes(), replace(params, typesize=4))
        body = data.buffers()[2]
        raw = body[int(ends[0]) : int(ends[-1])].to_pybytes() if body is not None else b""
    else:
        raw = _raw(values)
    return frames.encode(raw, params), validity, offsets


def _values(raw: bytes, kind: pa.DataType, n: int, validity: bytes | None, ends: bytes | None) -> pa.Array:
    mask = None
    if validity is not None:
        bits = np.packbits(np.frombuffer(frames.decode(validity), np.uint8), bitorder="little")
        mask = pa.py_buffer(bits.tobytes())
    if ends is not None:
        return pa.Array.from_buffers(kind, n, [mask, pa.py_buffer(frames.decode(ends)), pa.py_buffer(raw)])
    if pa.types.is_boolean(kind):
        raw = np.packbits(np.frombuffer(raw, np.uint8), bitorder="little").tobytes()
    return pa.Array.from_buffers(kind, n, [mask, pa.py_buffer(raw)])


def packed(values: Column, kind: T.DataType, params: CParams) -> Column:
    """The frames of an array column: a struct (frame, validity, offsets)."""
    width_of(kind)
    params = replace(params, typesize=width_of(kind))

    ship()

    @F.arrow_udf("struct<frame:binary,validity:binary,offsets:binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for done in cut((_frames(v.values, params) if v.is_valid else (None,) * 3 for v in lists), lambda d: sum(len(x or b"") for x in d)):
                yield pa.StructArray.from_arrays([pa.array([d[i] for d in done], pa.binary()) for i in range(3)], names=["frame", "validity", "offsets"])

    return encode(values)


def _lists(values: list[pa.Array | None], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *(0 if x is None else len(x) for x in values)]).astype(np.int32)
    whole = [x for x in values if x is not None]
    mask = pa.array([x is None for x in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays(whole) if whole else pa.array([], kind), mask=mask)


def unpacked(frame: Column, n: Column, kind: T.DataType, validity: Column | None = None, offsets: Column | None = None) -> Column:
    """The array column of a chunk's frames."""
    arrow = to_arrow_type(kind)

    ship()

    @F.arrow_udf(T.ArrayType(kind))
    def decode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            lists = (_values(frames.decode(d.as_py()), arrow, k.as_py(), v.as_py(), o.as_py()) if d.is_valid else None for d, k, v, o in zip(*columns, strict=True))
            for done in cut(lists, lambda v: 0 if v is None else v.nbytes):
                yield _lists(done, arrow)

    none = F.lit(None).cast("binary")
    return decode(frame, n, none if validity is None else validity, none if offsets is None else offsets)


def pack(df: DataFrame, place: str, value: str, params: CParams | None = None, items: int = ITEMS) -> DataFrame:
    """The chunks of a column; ``place`` numbers its rows without gaps or repetition, else the query fails.

    Rows meet by chunk, so a task holds single chunks of ``items`` rows whatever the table's size.
    """
    params = params or CParams()
    rows = df.select(F.floor(F.col(place) / items).alias("chunk_id"), F.struct(F.col(place).alias("p"), F.col(value).alias("v")).alias("_x"))
    chunks = rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    places, first = F.transform("_x", lambda x: x["p"].cast("long")), F.col("_x")[0]["p"].cast("long")
    dense = places == F.sequence(first, first + F.size("_x") - 1)
    wrong = F.raise_error(F.concat(F.lit("places have gaps or repeat in chunk "), F.col("chunk_id").cast("string"))).cast(chunks.schema["_x"].dataType)
    chunks = chunks.withColumn("_x", F.when(dense, F.col("_x")).otherwise(wrong))
    done = packed(F.transform("_x", lambda x: x["v"]), df.schema[value].dataType, params)
    out = chunks.select("chunk_id", F.col("_x")[0]["p"].alias("first"), F.size("_x").cast("long").alias("n"), done.alias("_f"))
    return out.select("chunk_id", "first", "n", "_f.*")


def _pieces(found: Iterable[tuple[int, int, pa.Array]], batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, elem_idx, v) of runs of values, each with its chunk's row in the batch and its first place.

    They are handed on some ``PIECE`` bytes at a time, so what is held doesn't grow with the chunks of a batch.
    """
    held: list[tuple[int, int, pa.Array]] = []

    def done() -> pa.RecordBatch:
        of = pa.array(np.repeat([i for i, _, _ in held], [len(v) for _, _, v in held]).astype(np.int64))
        places = pa.array(np.concatenate([np.arange(at, at + len(v), dtype=np.int64) for _, at, v in held]))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), places, pa.concat_arrays([v for _, _, v in held])], names=[*keys, "elem_idx", "v"])

    size = 0
    for i, at, values in found:
        step = max(1, len(values) * PIECE // max(1, values.nbytes + 8 * len(values)))
        for k in range(0, len(values), step):
            part = values[k : k + step]
            held.append((i, at + k, part))
            size += part.nbytes + 8 * len(part)
            if size >= PIECE:
                yield done()
                held.clear()
                size = 0
    if held:
        yield done()


def _rows(chunks: DataFrame, kind: T.DataType, keys: list[str], lo: Column | None = None, count: Column | None = None) -> DataFrame:
    """Rows (keys, elem_idx, v) of chunks, or of ``count`` items of each from ``lo`` on.

    Not an array column that is exploded: Spark would then filter by its size, and pack and unpack everything twice for it.
    """
    arrow, ranged = to_arrow_type(kind), lo is not None
    place = chunks.select(F.col("first") + F.lit(0)).schema[0].dataType
    parts = {"_first": F.col("first"), "_lo": F.lit(0) if lo is None else lo, "_n": F.col("n") if count is None else count, "_all": F.col("n")}

    ship()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
            for i, row in enumerate(zip(*(batch.column(c) for c in ("_first", "_lo", "_n", "_all", "_frame", "_validity", "_offsets")), strict=True)):
                first, start, n, whole, frame, validity, ends = (x.as_py() for x in row)
                if frame is None:
                    continue
                if ranged and validity is None and ends is None:
                    try:
                        yield i, first + start, _values(frames.get_items(frame, start, n), arrow, n, None, None)
                    except frames.BadFrame:
                        continue
                else:
                    yield i, first + start, _values(frames.decode(frame), arrow, whole, validity, ends)[start : start + n]

        for batch in batches:
            yield from _pieces(found(batch), batch, keys)

    columns = [*keys, *(c.cast("long").alias(k) for k, c in parts.items()), *(F.col(c).alias(f"_{c}") for c in ("frame", "validity", "offsets"))]
    schema = T.StructType([*(chunks.schema[k] for k in keys), T.StructField("elem_idx", T.LongType()), T.StructField("v", kind)])
    return chunks.select(*columns).mapInArrow(decode, schema).select(*keys, F.col("elem_idx").cast(place).alias("elem_idx"), "v")


def unpack(chunks: DataFrame, kind: T.DataType, keys: list[str] | None = None) -> DataFrame:
    """Rows (elem_idx, v) of all chunks, with the columns of their chunk that ``keys`` names before them."""
    return _rows(chunks, kind, keys or [])


def unpack_range(chunks: DataFrame, kind: T.DataType, start: int, count: int) -> DataFrame:
    """Rows (elem_idx, v) of items ``start`` to ``start + count``.

    Chunks outside the range are left out before anything is decoded, and of the
    others only the blocks inside it are. Chunks with nulls or offsets are decoded whole.
    """
    end = start + count
    touched = chunks.where((F.col("first") < end) & (F.col("first") + F.col("n") > start))
    lo, hi = F.greatest(F.lit(start) - F.col("first"), F.lit(0)), F.least(F.lit(end) - F.col("first"), F.col("n"))
    return _rows(touched, kind, [], lo, hi - lo)
