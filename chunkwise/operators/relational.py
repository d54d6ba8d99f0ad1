"""Frames taken apart into tables: headers, blocks and streams.

Each is a native projection of the one before. Only the compressed payloads that a
caller decodes reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise import constants as C
from chunkwise._ship import ship
from chunkwise.functions.header import block_starts, byte, header, int32, outcome
from chunkwise.operators import codecs, filters
from chunkwise.operators.pieces import cut


def headers(chunks: DataFrame, frame: str = "frame") -> DataFrame:
    """``chunks`` without its frames, with the fields of their headers."""
    rest = [c for c in chunks.columns if c != frame]
    return chunks.select(*rest, header(F.col(frame)).alias("_h")).select(*rest, "_h.*")


def blocks(chunks: DataFrame, frame: str = "frame") -> DataFrame:
    """A row for each block of every frame: where it begins and what it holds.

    Adds status, block_idx, bstart, block_cbytes, block_nbytes, leftover, nstreams, neblock. A
    stored frame is one block of its bytes as they are. A frame that can't be read, or holds
    nothing, is one row without a block, whose status tells which.
    """
    f, h = F.col(frame), F.col("_h")
    rest = [c for c in chunks.columns if c != frame]
    read = chunks.select(*rest, f.alias("_f"), header(f).alias("_h"))
    f = F.col("_f")
    read = read.withColumn("status", outcome(f, h))
    length = F.when(h["is_v1"], C.HEADER_V1).otherwise(C.HEADER_V2).cast("long")
    starts = F.when((F.col("status") == C.OK) & (h["nbytes"] > 0), F.when(h["memcpyed"], F.array(length)).otherwise(block_starts(f, h)))
    indexed = read.withColumn("_starts", starts).select("*", F.posexplode_outer("_starts").alias("block_idx", "bstart"))
    # blocks may be stored in any order: a block ends where the next one in the frame begins
    after = F.array_min(F.filter("_starts", lambda s: s > F.col("bstart")))
    cut = F.least(h["blocksize"], h["nbytes"] - F.col("block_idx") * h["blocksize"])
    out = indexed.withColumns({"block_cbytes": F.coalesce(after, h["cbytes"]) - F.col("bstart"), "block_nbytes": F.when(F.col("bstart").isNotNull(), F.when(h["memcpyed"], h["nbytes"]).otherwise(cut))})
    short = ~h["memcpyed"] & (F.col("block_nbytes") < h["blocksize"])
    count = F.when(h["dont_split"] | h["memcpyed"] | short, 1).otherwise(F.greatest(h["typesize"], F.lit(1)))
    out = out.withColumns({"leftover": F.when(F.col("bstart").isNotNull(), short), "nstreams": F.when(F.col("bstart").isNotNull(), count)})
    out = out.withColumn("neblock", F.floor(F.col("block_nbytes") / F.col("nstreams")).cast("int"))
    return out.select(*rest, "status", "block_idx", "bstart", "block_cbytes", "block_nbytes", "leftover", "nstreams", "neblock", F.col("_f").alias(frame), h.alias("header"))


def streams(block_rows: DataFrame, frame: str = "frame") -> DataFrame:
    """A row for each stream of every block: adds stream_idx, size_field, kind, payload.

    The bytes of a stored frame are one stream without a size field; rows without a block stay as they are.
    """
    f = F.col(frame)
    start = F.struct(F.col("bstart").alias("at"), F.array().cast("array<struct<at:bigint,size_field:bigint>>").alias("found"))

    def step(state, i):
        field = int32(f, state["at"])
        length = F.when(field > 0, field).when(field < 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct((state["at"] + 4 + length).alias("at"), F.concat(state["found"], F.array(F.struct(state["at"].alias("at"), field.alias("size_field")))).alias("found"))

    stored = F.col("header.memcpyed")
    whole = F.array(F.struct((F.col("bstart") - 4).alias("at"), F.lit(None).cast("long").alias("size_field")))
    found = F.when(stored, whole).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("nstreams")), start, step, lambda s: s["found"]))
    found = F.when(F.col("bstart").isNotNull(), found)
    rest = [c for c in block_rows.columns if c not in (frame, "header")]
    out = block_rows.select(*rest, f.alias("_f"), "header", F.posexplode_outer(found).alias("stream_idx", "_s"))
    field = F.col("_s.size_field")
    kind = F.when(F.col("bstart").isNull(), None).when(stored, "stored").when(field == 0, "zeros").when(field < 0, "run").when(field == F.col("neblock"), "raw").otherwise("codec")
    length = F.when(stored, F.col("block_nbytes")).when(field > 0, field).when(field < 0, 1).otherwise(0)
    payload = F.substring(F.col("_f"), (F.col("_s.at") + 5).cast("int"), length.cast("int"))
    return out.select(*rest, "stream_idx", field.cast("int").alias("size_field"), kind.alias("kind"), payload.alias("payload"), "header")


def decoded_blocks(stream_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The streams' blocks, put together again and unfiltered: rows (keys, block_idx, data, status); broken ones have no data."""

    ship()

    @F.arrow_udf("binary")
    def expand(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            made = (codecs.decompress(c.as_py(), p.as_py(), n.as_py()) if p.is_valid else None for p, c, n in zip(*columns, strict=True))
            for done in cut(made, lambda d: len(d or b"")):
                yield pa.array(done, pa.binary())

    @F.arrow_udf("binary")
    def unfilter(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        undo = {C.SHUFFLE: filters.unshuffle, C.BITSHUFFLE: filters.bitunshuffle}
        for columns in batches:
            made = (undo.get(f.as_py(), lambda d, _: d)(d.as_py(), t.as_py()) if d.is_valid else None for d, f, t in zip(*columns, strict=True))
            for done in cut(made, lambda d: len(d or b"")):
                yield pa.array(done, pa.binary())

    n = F.col("neblock")
    fill = F.lpad(F.hex(F.pmod(-F.col("size_field"), F.lit(256)).cast("long")), 2, "0")
    # an Arrow function sees every row, so those it isn't for are null to it
    data = F.coalesce(
        F.when(F.col("kind") == "zeros", F.unhex(F.repeat(F.lit("00"), n))),
        F.when((F.col("kind") == "run") & (byte(F.col("payload"), 0) % 2 == 1), F.unhex(F.repeat(fill, n))),
        F.when(F.col("kind").isin("raw", "stored"), F.col("payload")),
        expand(F.when(F.col("kind") == "codec", F.col("payload")), F.col("header.compcode"), n),
    )
    which = F.when(F.col("header.memcpyed"), C.NOFILTER).when(F.col("header.doshuffle") & (F.col("header.typesize") > 1), C.SHUFFLE).when(F.col("header.dobitshuffle"), C.BITSHUFFLE).otherwise(C.NOFILTER)
    # a block has one stream for each byte of an item at most
    parts = stream_rows.withColumn("_d", data).groupBy(*keys, "block_idx").agg(
        F.array_sort(F.collect_list(F.struct("stream_idx", "_d"))).alias("_parts"),
        F.first(which).alias("_which"),
        F.first("header.typesize").alias("_typesize"),
        F.first("status").alias("_status"),
    )
    whole = ~F.exists("_parts", lambda p: p["_d"].isNull())
    digits = F.when(whole, F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["_d"])), "")))
    data = unfilter(digits, F.col("_which"), F.col("_typesize"))
    return parts.select(*keys, "block_idx", data.alias("data"), F.when(whole | F.col("block_idx").isNull(), F.col("_status")).otherwise(C.FAILED).alias("status"))


def library_info(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with library, lib_version and lib_code of each codec name; null for others. Names are exact."""
    info = F.create_map(*[x for n, (lib, version, code) in C.LIBRARIES.items() for x in (F.lit(n), F.struct(F.lit(lib).alias("library"), F.lit(version).alias("lib_version"), F.lit(code).alias("lib_code")))])
    return names.withColumn("_i", F.try_element_at(info, F.col(name))).select(*names.columns, "_i.library", "_i.lib_version", "_i.lib_code")


def codec_dimension(spark: SparkSession) -> DataFrame:
    """One row for each codec: codec, name, v1_format, v2_format, library, lib_version, lib_code."""
    rows = [(i, name, v1, v2, *C.LIBRARIES[elsewhere]) for elsewhere, (name, (i, v1, v2)) in zip(C.LIBRARIES, C.CODECS.items(), strict=True)]
    return spark.createDataFrame(rows, "codec int, name string, v1_format int, v2_format int, library string, lib_version string, lib_code int")


def status_code(status: Column) -> Column:
    """The number that stands for an outcome elsewhere; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in C.STATUS_CODES.items() for x in pair]), status)
