"""The engine's operators as queries over the test tables, and SQL to hold them against.

Frames are shown as hex strings or as what they decode to; sizes that depend on a
codec library's build are never compared.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise import constants as C
from chunkwise._ship import ship
from chunkwise.functions import compress, decompress, easy_compress, get_items, header, metainfo, sizes, status, validate
from chunkwise.functions.header import header_bytes
from chunkwise.operators import filters, pack, relational
from chunkwise.operators.frame import Context, CParams, DParams
from chunkwise.plans import layout
from chunkwise.plans.layout import Cols
from chunkwise.sources import framed

Query = Callable[[SparkSession, str], DataFrame]
DOUBLE = T.DoubleType()
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share; a machine's own will do where there is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/framed-{os.getpid()}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(q: Query) -> Query:
        QUERIES[name] = q
        if sql:
            ORACLE_SQL[name] = sql
        return q

    return put


# Round trips of a dense column.


def event_chunks(spark: SparkSession, sf_dir: str, params: CParams, items: int = pack.ITEMS) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "events"), "event_id", "value", params, items)


EVENTS = "SELECT event_id, value FROM events"


def _roundtrip(spark: SparkSession, sf_dir: str, params: CParams) -> DataFrame:
    return pack.unpack(event_chunks(spark, sf_dir, params), DOUBLE).select(F.col("elem_idx").alias("event_id"), F.col("v").alias("value"))


for _codec in C.CODECS:
    for _filter in C.FILTERS:
        for _version in (1, 2):
            query(f"roundtrip_{_codec}_{_filter}_v{_version}", EVENTS)(partial(_roundtrip, params=CParams(_codec, 5, 8, _filter, _version)))
for _level in (0, 1, 9):
    query(f"roundtrip_level{_level}", EVENTS)(partial(_roundtrip, params=CParams(clevel=_level, filter="shuffle")))


@query("flagship_range_sum", "SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total FROM events WHERE event_id >= 100 AND event_id < 900")
def flagship_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack, compress, read a range back, and add it up."""
    chunks = event_chunks(spark, sf_dir, CParams(filter="shuffle"), 256)
    rows = pack.unpack_range(chunks, DOUBLE, 100, 800)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("elem_idx").alias("first_id"), F.max("elem_idx").alias("last_id"), F.round(F.sum("v"), 4).alias("total"))


@query("compression_pays", "SELECT count(*) > 0 AS any_chunk, true AS all_compressed FROM events")
def compression_pays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted places compress in every chunk, so no round trip passes by storing bytes."""
    events = table(spark, sf_dir, "events")
    chunks = pack.pack(events, "event_id", "event_id", CParams(filter="shuffle"), 1000)
    h = chunks.select(header(F.col("frame")).alias("h"))
    return h.agg((F.count(F.lit(1)) > 0).alias("any_chunk"), F.bool_and(~F.col("h.memcpyed") & (F.col("h.cbytes") < F.col("h.nbytes"))).alias("all_compressed"))


# Round trips of single buffers.


def _text_roundtrip(spark: SparkSession, sf_dir: str, packer: Callable[[Column], Column]) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packer(F.col("text")).alias("frame"))
    return docs.select("doc_id", F.md5(decompress(F.col("frame"))).alias("digest"), validate(F.col("frame")).alias("nbytes"))


TEXTS = "SELECT doc_id, md5(text) AS digest, strlen(text) AS nbytes FROM documents"
for _name, _packer in {
    "compress_v1": lambda t: compress(t, CParams(typesize=4, filter="shuffle", version=1)),
    "compress_v2": lambda t: compress(t, CParams(typesize=4, filter="shuffle")),
    "compress_ctx_v1": lambda t: compress(t, Context(CParams("zlib", 6, 2, "bitshuffle", 1))),
    "compress_ctx_v2": lambda t: compress(t, Context(CParams("lz4", 9, 16, "bitshuffle"), DParams())),
    "easy_compress_v1": lambda t: easy_compress(t, 1),
    "easy_compress_v2": lambda t: easy_compress(t, 2),
    "compress_options": lambda t: compress(t, codec="zstd", clevel=3, typesize=1),
}.items():
    query(_name, TEXTS)(partial(_text_roundtrip, packer=_packer))


@query("cross_v1_v2_decode", "SELECT doc_id, md5(text) AS digest, true AS same FROM documents")
def cross_v1_v2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reader for both versions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", easy_compress(F.col("text"), 1).alias("a"), easy_compress(F.col("text"), 2).alias("b"))
    docs = docs.select("doc_id", decompress(F.col("a")).alias("a"), decompress(F.col("b"), "failfast").alias("b"))
    return docs.select("doc_id", F.md5("a").alias("digest"), (F.col("a") == F.col("b")).alias("same"))


@query("decompress_status", "SELECT 'ok' AS status, count(*) AS n FROM documents")
def decompress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(easy_compress(F.col("text")).alias("frame"))
    return docs.select(status(F.col("frame")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("roundtrip_embeddings", "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings")
def roundtrip_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of 32-bit floats for each row."""
    vectors = table(spark, sf_dir, "embeddings")
    done = vectors.select("vec_id", F.size("embedding").cast("long").alias("n"), pack.packed(F.col("embedding"), T.FloatType(), CParams(filter="shuffle")).alias("f"))
    back = pack.unpack(done.select("vec_id", F.lit(0).cast("long").alias("first"), "n", "f.*"), T.FloatType(), ["vec_id"])
    return back.select("vec_id", F.col("elem_idx").alias("pos"), F.col("v").cast("double").alias("v"))


def _typed(spark: SparkSession, sf_dir: str, source: str, place: str, column: str, show: Callable[[Column], Column] = lambda c: c, cast: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, source)
    if cast:
        rows = rows.withColumn(column, F.expr(cast))
    chunks = pack.pack(rows, place, column, CParams("zstd", filter="shuffle"), 500)
    back = pack.unpack(chunks, rows.schema[column].dataType)
    return back.select(F.col("elem_idx").alias("place"), show(F.col("v")).alias("v"))


_typed_cases = {
    "int": ("event_id", "user_id", "CAST(user_id AS INT)", "user_id::INT", lambda c: c),
    "long": ("event_id", "user_id", None, "user_id", lambda c: c),
    "short": ("event_id", "user_id", "CAST(user_id % 1000 AS SMALLINT)", "(user_id % 1000)::SMALLINT", lambda c: c),
    "byte": ("event_id", "user_id", "CAST(user_id % 100 AS TINYINT)", "(user_id % 100)::TINYINT", lambda c: c),
    "boolean": ("event_id", "user_id", "user_id % 3 = 0", "user_id % 3 = 0", lambda c: c),
    "date": ("event_id", "ts", "CAST(ts AS DATE)", "ts::DATE::VARCHAR", lambda c: c.cast("string")),
    "timestamp": ("event_id", "ts", None, "epoch_us(ts)", lambda c: F.unix_micros(c.cast("timestamp"))),
    "string": ("event_id", "event_type", None, "event_type", lambda c: c),
    "decimal": ("event_id", "user_id", "CAST(user_id AS DECIMAL(20, 2))", "user_id", lambda c: c.cast("long")),
    "nullable_long": ("event_id", "user_id", "IF(user_id % 4 = 0, NULL, user_id)", "CASE WHEN user_id % 4 <> 0 THEN user_id END", lambda c: c),
    "nullable_string": ("event_id", "event_type", "IF(user_id % 4 = 0, NULL, event_type)", "CASE WHEN user_id % 4 <> 0 THEN event_type END", lambda c: c),
}
for _name, (_place, _column, _cast, _sql, _show) in _typed_cases.items():
    query(f"roundtrip_type_{_name}", f"SELECT {_place} AS place, {_sql} AS v FROM events")(partial(_typed, source="events", place=_place, column=_column, cast=_cast, show=_show))


# Positional reads.


def _getitem(spark: SparkSession, sf_dir: str, start: int, count: int, params: CParams) -> DataFrame:
    rows = pack.unpack_range(event_chunks(spark, sf_dir, params, 1000), DOUBLE, start, count)
    return rows.select(F.col("elem_idx").alias("event_id"), F.col("v").alias("value"))


for _name, (_start, _count) in {"range": (250, 500), "single": (777, 1), "block_edge": (999, 2), "empty": (10, 0), "subset": (5, 5), "all": (0, 10**9)}.items():
    _sql = f"{EVENTS} WHERE event_id >= {_start} AND event_id < {_start + _count}"
    query(f"getitem_{_name}", _sql)(partial(_getitem, start=_start, count=_count, params=CParams("zstd", filter="shuffle")))


@query("getitem_last", f"{EVENTS} QUALIFY event_id = max(event_id) OVER ()")
def getitem_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = event_chunks(spark, sf_dir, CParams("lz4", filter="bitshuffle"), 1000)
    last = chunks.agg(F.max(F.struct("first", "n", "frame")).alias("c")).select("c.*")
    item = get_items(F.col("frame"), F.col("n") - 1, F.lit(1))
    return last.select((F.col("first") + F.col("n") - 1).alias("event_id"), pack.unpacked(compress(item, CParams()), F.lit(1).cast("long"), DOUBLE)[0].alias("value"))


_ENCODED = "hex(encode(coalesce(text, '')))"


@query("getitem_bytes", f"SELECT doc_id, CASE WHEN length({_ENCODED}) >= 24 THEN {_ENCODED}[9:24] END AS items FROM documents")
def getitem_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items 1 and 2 of four bytes; null where a text has fewer."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(get_items(compress(text, CParams(typesize=4, filter="shuffle")), 1, 2)).alias("items"))


@query("getitem_out_of_range", "SELECT doc_id, NULL::VARCHAR AS items FROM documents")
def getitem_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.hex(get_items(compress(F.col("text"), CParams(typesize=1)), F.octet_length("text"), F.lit(1))).alias("items"))


_WIDTHS = (*range(1, 17), 24, 32, 100)


@query("getitem_grid", f"""
    SELECT n_nationkey, t AS typesize, f AS filter, hex(encode(repeat(n_name, 200)))[6 * t + 1 : 16 * t] AS items
    FROM nation, (SELECT unnest({list(_WIDTHS)}) AS t), (SELECT unnest({list(C.FILTERS)}) AS f)
""")
def getitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items 3 to 7 of every width, through every filter."""
    text = F.repeat("n_name", 200)
    cells = [
        F.struct(F.lit(t).alias("typesize"), F.lit(f).alias("filter"), F.hex(get_items(compress(text, CParams("lz4", typesize=t, filter=f)), 3, 5)).alias("items"))
        for t in _WIDTHS
        for f in C.FILTERS
    ]
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(*cells)))


# Headers.


def _le(value: str, width: int) -> str:
    return " || ".join(f"lpad(to_hex(({value} >> {8 * i}) & 255), 2, '0')" for i in range(width))


@query("header_v2_memcpy_frame", f"SELECT n_nationkey, upper('05010701' || {_le('strlen(n_name)', 4)} || {_le('strlen(n_name)', 4)} || {_le('strlen(n_name) + 32', 4)} || repeat('00', 16) || hex(encode(n_name))) AS frame FROM nation")
def header_v2_memcpy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", F.hex(compress(F.col("n_name"), CParams(typesize=1))).alias("frame"))


@query("header_v1_memcpy_frame", f"SELECT r_regionkey, upper('02011201' || {_le('strlen(r_name)', 4)} || {_le('strlen(r_name)', 4)} || {_le('strlen(r_name) + 16', 4)} || hex(encode(r_name))) AS frame FROM region")
def header_v1_memcpy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return region.select("r_regionkey", F.hex(compress(F.col("r_name"), CParams(typesize=1, version=1))).alias("frame"))


@query("header_build", "SELECT n_nationkey, true AS same FROM nation")
def header_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers built natively are those that the encoder writes."""
    nation = table(spark, sf_dir, "nation").withColumn("n", F.octet_length("n_name"))
    frame = compress(F.col("n_name"), CParams("zlib", typesize=1))
    flags = layout.planned_flags(Cols, C.ZLIB, 5, 1, F.col("n").cast("long"), 0, 2) + C.FLAG_MEMCPY
    built = F.concat(header_bytes(2, "zlib", F.lit(1), flags, F.col("n"), F.col("n"), F.col("n") + C.HEADER_V2), F.col("n_name").cast("binary"))
    return nation.select("n_nationkey", (built == frame).alias("same"))


@query("empty_buffer", "SELECT '0501070800000000010000002000000000000000000000000000000000000000' AS v2, '02011208000000000100000010000000' AS v1, 0 AS nbytes, 'ok' AS status")
def empty_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(compress(F.lit(b""), CParams()).alias("v2"), compress(F.lit(b""), CParams(version=1)).alias("v1"))
    return one.select(F.hex("v2").alias("v2"), F.hex("v1").alias("v1"), F.octet_length(decompress(F.col("v2"))).alias("nbytes"), status(F.col("v1")).alias("status"))


DOC_FRAME = CParams("zstd", 5, 8, "shuffle")


@query("cbuffer_sizes", "SELECT doc_id, strlen(text) AS nbytes, true AS fits FROM documents")
def cbuffer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", compress(F.col("text"), DOC_FRAME).alias("frame"))
    docs = docs.select("doc_id", "frame", sizes(F.col("frame")).alias("s"))
    return docs.select("doc_id", F.col("s.nbytes").alias("nbytes"), ((F.col("s.cbytes") == F.octet_length("frame")) & (F.col("s.blocksize") > 0)).alias("fits"))


@query("cbuffer_metainfo", "SELECT n_nationkey, 1 AS typesize, 39 + 96 - 32 AS flags FROM nation")
def cbuffer_metainfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type size and raw flags: stored, both filter bits, format code 3."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", compress(F.col("n_name"), CParams("zlib", typesize=1)).alias("frame"))
    return nation.select("n_nationkey", metainfo(F.col("frame")).alias("m")).select("n_nationkey", "m.typesize", "m.flags")


@query("cbuffer_validate", "SELECT doc_id, strlen(text) AS whole, NULL::BIGINT AS cut, NULL::BIGINT AS tiny FROM documents")
def cbuffer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", compress(F.col("text"), DOC_FRAME).alias("f"))
    return docs.select("doc_id", validate(F.col("f")).alias("whole"), validate(F.col("f"), F.octet_length("f") - 1).alias("cut"), validate(F.substring("f", 1, 8)).alias("tiny"))


@query("header_fields", "SELECT n_nationkey, 5 AS version, 1 AS versionlz, 8 AS typesize, strlen(n_name) AS nbytes, 5 AS compcode, true AS memcpyed, true AS doshuffle, false AS dobitshuffle, false AS is_v1, 1 AS last_filter FROM nation")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", compress(F.col("n_name"), DOC_FRAME).alias("frame"))
    h = relational.headers(nation)
    return h.select("n_nationkey", "version", "versionlz", "typesize", "nbytes", "compcode", "memcpyed", "doshuffle", "dobitshuffle", "is_v1", F.col("filters")[5].alias("last_filter"))


@query("complib_info", "SELECT * FROM (VALUES ('blosclz', 'BloscLZ', '2.5.1', 0), ('lz4', 'LZ4', '1.9.4', 1), ('lz4hc', 'LZ4', '1.9.4', 1), ('snappy', 'Snappy', '1.1.9', 2), ('zlib', 'Zlib', '1.2.11', 3), ('zstd', 'Zstd', '1.5.2', 4), ('LZ4', NULL, NULL, NULL), ('none', NULL, NULL, NULL)) t(name, library, lib_version, lib_code)")
def complib_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in [*C.LIBRARIES, "LZ4", "none"]], "name string")
    return relational.library_info(names)


@query("cparams_defaults", "SELECT 'bytelz' AS codec, 5 AS clevel, 8 AS typesize, 'none' AS filter, 1 AS nthreads, 1 AS reader_threads")
def cparams_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Context()
    values = (c.cparams.codec, c.cparams.clevel, c.cparams.typesize, c.cparams.filter, c.cparams.nthreads, c.dparams.nthreads)
    return spark.createDataFrame([values], "codec string, clevel int, typesize int, filter string, nthreads int, reader_threads int")


@query("codec_dimension", "SELECT * FROM (VALUES (0, 'bytelz', 0, 0, 'BloscLZ', 0), (1, 'lz4', 1, 1, 'LZ4', 1), (2, 'lz4hc', 1, 1, 'LZ4', 1), (3, 'snappy', 2, 3, 'Snappy', 2), (4, 'zlib', 3, 3, 'Zlib', 3), (5, 'zstd', 4, 4, 'Zstd', 4)) t(codec, name, v1_format, v2_format, library, lib_code)")
def codec_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.codec_dimension(spark).drop("lib_version")


@query("status_codes", "SELECT * FROM (VALUES ('ok', 0), ('failed', -1), ('unsupported_codec', -7), ('invalid_header', -11), ('out_of_range', -33), ('other', NULL)) t(status, code)")
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = spark.createDataFrame([(s,) for s in [*C.STATUS_CODES, "other"]], "status string")
    return outcomes.select("status", relational.status_code(F.col("status")).alias("code"))


# Plans over a grid of parameters.

GRID = [(i % 6, (0, 1, 2, 3, 5, 6, 7, 8, 9)[i % 9 if i % 2 else (i // 2) % 9], (1, 2, 4, 8, 16, 20)[(i // 3) % 6], (i // 5) % 3, 1 + (i // 7) % 2, (1, 60, 3000)[(i // 2) % 3]) for i in range(72)]
_GRID_SQL = ", ".join(map(str, GRID))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(g, ("codec", "clevel", "typesize", "filter", "version", "mult"), strict=True)]) for g in GRID])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.explode(grid).alias("g"))
    return docs.select("doc_id", (F.col("size") * F.col("g.mult")).alias("nbytes"), "g.*")


def _plan_args() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("codec", "clevel", "typesize", "nbytes", "filter", "version"))


_KEYS = "doc_id, codec, clevel, typesize, filter, version, mult"


def _split_rule(size: str) -> str:
    return f"""(typesize <= 16 AND {size} // typesize >= 32 AND CASE version WHEN 1 THEN codec <> 5
        ELSE filter = 1 AND (codec IN (0, 1) OR (codec = 5 AND clevel <= 5)) END)"""


_PLAN = f"""
    WITH g AS (SELECT doc_id, strlen(text) * mult AS nbytes, codec, clevel, typesize, filter, version, mult
        FROM documents, (VALUES {_GRID_SQL}) v(codec, clevel, typesize, filter, version, mult)),
    a AS (SELECT *, {_split_rule("nbytes")} AS early, CASE WHEN codec IN (2, 4, 5) THEN 65536 ELSE 32768 END AS base FROM g),
    b AS (SELECT *, CASE
            WHEN clevel > 0 AND early THEN least(greatest(1024 * typesize * CASE WHEN clevel <= 3 THEN 32 WHEN clevel <= 6 THEN 64 WHEN clevel = 7 THEN 128 WHEN clevel = 8 THEN 256 ELSE 512 END, 32768), 4194304)
            WHEN nbytes < 32768 THEN nbytes
            ELSE CASE WHEN clevel = 0 THEN base // 4 WHEN clevel = 1 THEN base // 2 WHEN clevel = 2 THEN base WHEN clevel = 3 THEN base * 2
                WHEN clevel <= 5 THEN base * 4 WHEN clevel <= 8 OR base = 32768 THEN base * 8 ELSE base * 16 END
        END AS wanted FROM a),
    p AS (SELECT *, CASE WHEN nbytes < typesize THEN greatest(nbytes, 1)
            WHEN least(wanted, nbytes) > typesize THEN least(wanted, nbytes) - least(wanted, nbytes) % typesize ELSE greatest(least(wanted, nbytes), 1) END AS blocksize FROM b)
"""


@query("plan_blocksize", f"{_PLAN} SELECT {_KEYS}, blocksize FROM p")
def plan_blocksize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir)
    return rows.select(*_KEYS.split(", "), layout.blocksize(Cols, *_plan_args()).cast("long").alias("blocksize"))


@query("plan_split", f"{_PLAN} SELECT {_KEYS}, {_split_rule('blocksize')} AS split FROM p")
def plan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir).withColumn("blocksize", layout.blocksize(Cols, *_plan_args()))
    codec, clevel, typesize, _, filter_id, version = _plan_args()
    return rows.select(*_KEYS.split(", "), layout.splits(Cols, codec, clevel, typesize, F.col("blocksize"), filter_id, version).alias("split"))


@query("plan_nblocks", f"{_PLAN} SELECT {_KEYS}, (nbytes + blocksize - 1) // blocksize AS nblocks FROM p")
def plan_nblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir)
    return rows.select(*_KEYS.split(", "), layout.nblocks(Cols, F.col("nbytes"), layout.blocksize(Cols, *_plan_args())).alias("nblocks"))


@query("plan_leftover", f"{_PLAN} SELECT {_KEYS}, nbytes % blocksize <> 0 AS leftover FROM p")
def plan_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir)
    return rows.select(*_KEYS.split(", "), layout.leftover(Cols, F.col("nbytes"), layout.blocksize(Cols, *_plan_args())).alias("leftover"))


@query(
    "plan_flags",
    f"""{_PLAN} SELECT {_KEYS}, (CASE version WHEN 2 THEN 5 ELSE CASE filter WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 0 END END
        + CASE WHEN {_split_rule('blocksize')} THEN 0 WHEN version = 1 OR (clevel <> 0 AND nbytes >= 32) THEN 16 ELSE 0 END
        + 32 * CASE codec WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN CASE version WHEN 1 THEN 2 ELSE 3 END WHEN 4 THEN 3 ELSE 4 END)::BIGINT AS flags FROM p""",
)
def plan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planned(spark, sf_dir)
    return rows.select(*_KEYS.split(", "), layout.planned_flags(Cols, *_plan_args()).cast("long").alias("flags"))


@query("fmt_map_roundtrip", "SELECT * FROM (VALUES ('bytelz', 0, 0, 0, 0), ('lz4', 1, 1, 1, 1), ('lz4hc', 2, 1, 1, 1), ('snappy', 3, 2, 3, 3), ('zlib', 4, 3, 3, 4), ('zstd', 5, 4, 4, 5)) t(name, codec, v1_format, v2_format, v1_decoded)")
def fmt_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codecs = spark.createDataFrame([(n, i) for n, (i, _, _) in C.CODECS.items()], "name string, codec int")
    v1 = layout.format_code(Cols, F.col("codec"), 1)
    return codecs.select("name", "codec", v1.alias("v1_format"), layout.format_code(Cols, F.col("codec"), 2).alias("v2_format"), layout.codec_of_format(Cols, v1).alias("v1_decoded"))


# Filters.


def _bytes_query(work: Callable[[bytes], bytes], spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)

    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([work(d.as_py()) if d.is_valid else None for d in data], pa.binary())

    return table(spark, sf_dir, "part").select("p_partkey", F.hex(run(F.col("p_name").cast("binary"))).alias("moved"))


_MOVED = "SELECT p_partkey, array_to_string([{place} FOR k IN range(n)], '') AS moved FROM (SELECT p_partkey, hex(encode(p_name)) AS h, strlen(p_name) AS n FROM part)"


def _shuffle_sql(t: int, inverse: bool = False) -> str:
    items = f"greatest(n // {t}, 1)"
    place = f"(k % {items}) * {t} + k // {items}" if not inverse else f"(k % {t}) * {items} + k // {t}"
    return _MOVED.format(place=f"CASE WHEN k < n // {t} * {t} THEN substr(h, 1 + 2 * ({place}), 2) ELSE substr(h, 1 + 2 * k, 2) END")


def _bitshuffle_sql(t: int) -> str:
    """Bit m of byte k is bit b of item 8g + m's byte j, where k = (8j + b) * groups + g."""
    groups = f"(n // {t} // 8)"
    digit = "(instr('0123456789ABCDEF', substr(h, {0}, 1)) - 1)"
    at = f"1 + 2 * ((8 * (k % greatest({groups}, 1)) + m) * {t} + k // greatest({groups}, 1) // 8)"
    value = f"((16 * {digit.format(at)} + {digit.format(f'{at} + 1')}) >> (k // greatest({groups}, 1) % 8)) & 1"
    byte = f"list_sum([({value}) << m FOR m IN range(8)])::INT"
    return _MOVED.format(place=f"CASE WHEN k < {groups} * 8 * {t} THEN upper(lpad(to_hex({byte}), 2, '0')) ELSE substr(h, 1 + 2 * k, 2) END")


for _t in (1, 2, 4, 8):
    query(f"shuffle_t{_t}", _shuffle_sql(_t))(partial(_bytes_query, partial(filters.shuffle, typesize=_t)))
    query(f"unshuffle_t{_t}", _shuffle_sql(_t, True))(partial(_bytes_query, partial(filters.unshuffle, typesize=_t)))
for _t in (1, 2):
    query(f"bitshuffle_t{_t}", _bitshuffle_sql(_t))(partial(_bytes_query, partial(filters.bitshuffle, typesize=_t)))


def _undo_bits(data: bytes, t: int) -> bytes:
    return filters.bitunshuffle(filters.bitshuffle(data, t), t)


for _t in (1, 2, 4):
    query(f"bitunshuffle_t{_t}", "SELECT p_partkey, hex(encode(p_name)) AS moved FROM part")(partial(_bytes_query, partial(_undo_bits, t=_t)))


@query("shuffle_native_t3", _shuffle_sql(3))
def shuffle_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same permutation as Spark columns."""
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(filters.native_shuffle(F.col("p_name").cast("binary"), F.lit(3))).alias("moved"))


@query("unshuffle_native_t3", _shuffle_sql(3, True))
def unshuffle_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(filters.native_unshuffle(F.col("p_name").cast("binary"), F.lit(3))).alias("moved"))


# Blocks and streams.


def _id_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 10,000 longs at level 1: blocks of 32 KB times 8 hold a chunk each but the level's own block size cuts unsplit ones."""
    return pack.pack(table(spark, sf_dir, "events"), "event_id", "event_id", CParams("zlib", 1, filter="shuffle"), 10_000)


_BLOCKS = "WITH c AS (SELECT event_id // 10000 AS chunk_id, count(*) * 8 AS nbytes FROM events GROUP BY 1), b AS (SELECT chunk_id, nbytes, unnest(range((nbytes + 32767) // 32768)) AS block_idx FROM c)"


@query("block_index", f"{_BLOCKS} SELECT chunk_id, block_idx, least(32768, nbytes - block_idx * 32768) AS block_nbytes, nbytes > 32768 AND nbytes - block_idx * 32768 < 32768 AS leftover, 1 AS nstreams, true AS in_order FROM b")
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.blocks(_id_chunks(spark, sf_dir))
    return rows.select("chunk_id", F.col("block_idx").cast("long").alias("block_idx"), "block_nbytes", "leftover", "nstreams", ((F.col("bstart") >= 32) & (F.col("block_cbytes") > 0)).alias("in_order"))


@query("stream_split", """
    WITH c AS (SELECT event_id // 1024 AS chunk_id, count(*) * 8 AS nbytes FROM events GROUP BY 1),
    s AS (SELECT *, CASE WHEN nbytes = 8192 THEN 8 ELSE 1 END AS n FROM c)
    SELECT chunk_id, unnest(range(n)) AS stream_idx, nbytes // n AS neblock, true AS filled FROM s
""")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole blocks of shuffled longs are cut into eight streams; the shorter last one isn't."""
    ids = pack.pack(table(spark, sf_dir, "events"), "event_id", "event_id", CParams("zstd", 5, filter="shuffle"), 1024)
    chunks = ids.withColumn("frame", F.when(F.col("n") == 1024, F.col("frame")).otherwise(_short_block(F.col("frame"))))
    rows = relational.streams(relational.blocks(chunks))
    return rows.select("chunk_id", F.col("stream_idx").cast("long").alias("stream_idx"), F.col("neblock").cast("long").alias("neblock"), (F.octet_length("payload") == F.coalesce("size_field", "block_nbytes")).alias("filled"))


def _short_block(frame: Column) -> Column:
    """The frame with the block size of a whole chunk, as where it is the last of several."""
    return F.concat(F.substring(frame, 1, 8), F.unhex(F.lit("00200000")), F.substring(frame, 13, 2**30))


@query("relational_decode", "SELECT event_id // 10000 AS chunk_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, sum(event_id)::BIGINT AS total FROM events GROUP BY 1")
def relational_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames decoded as tables: blocks, streams, payloads, and blocks again."""
    parts = relational.decoded_blocks(relational.streams(relational.blocks(_id_chunks(spark, sf_dir))), ["chunk_id"])
    none = F.lit(None).cast("binary")
    frames = parts.select("chunk_id", F.lit(0).cast("long").alias("first"), F.floor(F.octet_length("data") / 8).cast("long").alias("n"), compress(F.col("data"), CParams()).alias("frame"), none.alias("validity"), none.alias("offsets"))
    rows = pack.unpack(frames, T.LongType(), ["chunk_id"])
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_id"), F.max("v").alias("last_id"), F.sum("v").alias("total"))


_DIGESTS = "upper(md5(c_custkey::VARCHAR) || md5((c_custkey + 1)::VARCHAR) || md5((c_custkey + 2)::VARCHAR))"


def _digest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of 48 bytes that no codec shrinks for each customer, which is stored as it is."""
    digests = F.unhex(F.concat(*[F.md5((F.col("c_custkey") + i).cast("string").cast("binary")) for i in range(3)]))
    return table(spark, sf_dir, "customer").select("c_custkey", compress(digests, CParams("zstd", typesize=8, filter="shuffle")).alias("frame"))


@query("relational_stored", f"SELECT c_custkey, 0 AS block_idx, {_DIGESTS} AS data, 'ok' AS status FROM customer")
def relational_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored frames as tables: one block, and its bytes as they are."""
    parts = relational.decoded_blocks(relational.streams(relational.blocks(_digest_frames(spark, sf_dir))), ["c_custkey"])
    return parts.select("c_custkey", F.col("block_idx").cast("long").alias("block_idx"), F.hex("data").alias("data"), "status")


@query("relational_broken", "SELECT c_custkey, NULL::BIGINT AS block_idx, NULL::VARCHAR AS data, CASE c_custkey % 4 WHEN 0 THEN 'invalid_header' WHEN 1 THEN 'invalid_header' WHEN 2 THEN 'failed' ELSE 'unsupported_codec' END AS status FROM customer")
def relational_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken frames as tables: a row each, with the status that reading them gives."""
    frames = table(spark, sf_dir, "customer").select("c_custkey", compress(F.repeat("c_name", 40), CParams("zstd", typesize=1, filter="none")).alias("frame"))
    f, kind = F.col("frame"), F.col("c_custkey") % 4
    broken = F.when(kind == 0, F.substring(f, 1, 40)).when(kind == 1, _with_byte(f, 0, 77)).when(kind == 2, _with_byte(f, 35, 255)).otherwise(_with_byte(f, 22, 9))
    parts = relational.decoded_blocks(relational.streams(relational.blocks(frames.select("c_custkey", broken.alias("frame")))), ["c_custkey"])
    told = frames.select("c_custkey", status(broken).alias("read"))
    rows = parts.join(told, "c_custkey").withColumn("status", F.when(F.col("status") == F.col("read"), F.col("status")).otherwise(F.concat_ws(" but ", "status", "read")))
    return rows.select("c_custkey", F.col("block_idx").cast("long").alias("block_idx"), F.hex("data").alias("data"), "status")


def _handmade(spark: SparkSession, sf_dir: str, size_field: Column, payload: Column, codec: str = "lz4") -> DataFrame:
    """A frame for each nation: one block of 40 bytes with one stream."""
    body = F.concat(F.unhex(F.lit("24000000")), size_field, payload)
    flags = F.lit(C.FLAG_SHUFFLE | C.FLAG_BITSHUFFLE | C.FLAG_DONT_SPLIT | C.CODECS[codec][2] << C.FORMAT_SHIFT)
    head = header_bytes(2, codec, F.lit(1), flags, F.lit(40), F.lit(40), F.octet_length(body) + C.HEADER_V2)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(head, body).alias("frame"))


def _field(value: Column) -> Column:
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 32))), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, 7 - 2 * i, 2) for i in range(4)]))


def _both_ways(frames: DataFrame) -> DataFrame:
    """Decoded by the frame reader and as tables."""
    tables = relational.decoded_blocks(relational.streams(relational.blocks(frames)), ["n_nationkey"])
    read = frames.select("n_nationkey", F.hex(decompress(F.col("frame"))).alias("data"))
    return read.join(tables.select("n_nationkey", F.hex("data").alias("as_tables")), "n_nationkey")


@query("rle_zero", "SELECT n_nationkey, repeat('00', 40) AS data, repeat('00', 40) AS as_tables FROM nation")
def rle_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_ways(_handmade(spark, sf_dir, _field(F.lit(0)), F.lit(b"")))


_run = "repeat(lpad(upper(to_hex(n_nationkey + 1)), 2, '0'), 40)"


@query("rle_value", f"SELECT n_nationkey, {_run} AS data, {_run} AS as_tables FROM nation")
def rle_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_ways(_handmade(spark, sf_dir, _field(-F.col("n_nationkey") - 1), F.unhex(F.lit("01"))))


_raw = "upper(hex(encode(rpad(n_name, 40, '.'))))"


@query("raw_stream", f"SELECT n_nationkey, {_raw} AS data, {_raw} AS as_tables FROM nation")
def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_ways(_handmade(spark, sf_dir, _field(F.lit(40)), F.rpad("n_name", 40, ".").cast("binary")))


def _statuses(spark: SparkSession, sf_dir: str, change: Callable[[Column], Column], params: CParams) -> DataFrame:
    frames = table(spark, sf_dir, "nation").select("n_nationkey", compress(F.repeat("n_name", 40), params).alias("f"))
    broken = frames.select("n_nationkey", change(F.col("f")).alias("f"))
    return broken.select("n_nationkey", status(F.col("f")).alias("status"), decompress(F.col("f")).isNull().alias("no_data"))


def _with_byte(frame: Column, at: int, value: int) -> Column:
    return F.concat(F.substring(frame, 1, at), F.lit(bytes([value])), F.substring(frame, at + 2, 2**30))


for _name, _outcome, _change, _params in [
    ("error_truncated", "invalid_header", lambda f: F.substring(f, 1, 50), CParams()),
    ("error_short", "invalid_header", lambda f: F.substring(f, 1, 8), CParams()),
    ("error_no_bytes", "invalid_header", lambda f: F.substring(f, 1, 0), CParams()),
    ("error_version", "invalid_header", lambda f: _with_byte(f, 0, 77), CParams()),
    ("error_bad_codec", "unsupported_codec", lambda f: _with_byte(f, 22, 9), CParams("zstd")),
    ("error_bad_index", "failed", lambda f: _with_byte(f, 35, 255), CParams("zstd")),
    ("error_bad_filter", "failed", lambda f: _with_byte(f, 16, 3), CParams("zstd")),
]:
    query(_name, f"SELECT n_nationkey, '{_outcome}' AS status, true AS no_data FROM nation")(partial(_statuses, change=_change, params=_params))


@query("error_bad_token", "SELECT n_nationkey, 'failed' AS status FROM nation")
def error_bad_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _handmade(spark, sf_dir, _field(F.lit(-7)), F.unhex(F.lit("02")))
    return frames.select("n_nationkey", status(F.col("frame")).alias("status"))


# Files of frames.


def _written(spark: SparkSession, sf_dir: str) -> str:
    framed.register(spark)
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("elem_idx"), F.col("value").alias("v"))
    rows.repartitionByRange("elem_idx").sortWithinPartitions("elem_idx").write.format("framed").option("items", 1000).mode("append").save(path)
    return path


@query("source_scan", EVENTS)
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.format("framed").option("type", "double").load(_written(spark, sf_dir))
    return read.select(F.col("elem_idx").alias("event_id"), F.col("v").alias("value"))


@query("source_range", f"{EVENTS} WHERE event_id >= 990 AND event_id < 1010")
def source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate reaches the reader, which opens only the chunks it touches."""
    read = spark.read.format("framed").option("type", "double").load(_written(spark, sf_dir))
    return read.where("elem_idx >= 990 AND elem_idx < 1010").select(F.col("elem_idx").alias("event_id"), F.col("v").alias("value"))


@query("source_chunks", "SELECT event_id // 1000 AS chunk_id, min(event_id) AS first, count(*) AS n, count(*) * 8 AS nbytes, true AS smaller FROM events GROUP BY 1")
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk by its number; two tasks may have written parts of one."""
    read = spark.read.format("framed").option("mode", "chunks").load(_written(spark, sf_dir))
    smaller = F.sum("cbytes") <= F.sum("nbytes") + 32 * F.count(F.lit(1))
    return read.groupBy("chunk_id").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("nbytes").alias("nbytes"), smaller.alias("smaller"))


# Ratios: they depend on the codec libraries' builds, so there is nothing to hold them against.


def _ratio(spark: SparkSession, sf_dir: str, source: str, text: str, by: str) -> DataFrame:
    rows = table(spark, sf_dir, source).select(F.expr(by).alias("part"), sizes(compress(F.col(text), CParams("zstd", typesize=1))).alias("s"))
    return rows.groupBy("part").agg(F.sum("s.nbytes").alias("nbytes"), F.sum("s.cbytes").alias("cbytes"), (F.sum("s.nbytes") / F.sum("s.cbytes")).alias("ratio"))


query("ratio_by_source")(partial(_ratio, source="documents", text="text", by="source"))
query("ratio_by_lang")(partial(_ratio, source="documents", text="text", by="lang"))
query("ratio_by_site")(partial(_ratio, source="pages", text="html", by="substring_index(parse_url(url, 'HOST'), '.', -1)"))
