"""The engine on Spark: every query against its SQL, the data source, streaming, plans."""

import glob
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise import _files, queries, streaming
from chunkwise import constants as C
from chunkwise.functions import codec, compress, decompress, get_items, header, status
from chunkwise.operators import codecs, pack, pieces, relational
from chunkwise.operators import frame as frames
from chunkwise.operators.frame import CParams
from chunkwise.sources import framed

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == sorted(repr([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_ratios(spark, name):
    assert all(r["cbytes"] < r["nbytes"] for r in queries.QUERIES[name](spark, SF).collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_headers_and_stored_frames_stay_native(spark):
    df = spark.createDataFrame([(b"x" * 40,)], "frame binary").select(header(F.col("frame")).alias("h"))
    assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_nulls_and_modes(spark):
    good = spark.createDataFrame([(b"a" * 100,), (None,), (b"",)], "d binary").select("d", compress(F.col("d"), CParams("zstd", typesize=1)).alias("f"))
    rows = good.select("d", decompress(F.col("f")).alias("back"), status(F.col("f")).alias("s"), get_items(F.col("f"), 0, 0).alias("none")).collect()
    assert [(r["d"], r["s"]) for r in rows] == [(b"a" * 100, "ok"), (None, None), (b"", "ok")] and all(r["d"] == r["back"] for r in rows)
    broken = spark.createDataFrame([(b"\x05" * 40,)], "f binary")
    assert broken.select(decompress(F.col("f"))).first()[0] is None
    with pytest.raises(Exception, match="invalid_header|failed"):
        broken.select(decompress(F.col("f"), "failfast")).collect()
    with pytest.raises(ValueError):
        decompress(F.col("f"), "other")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "p long, v double")
    chunks = pack.pack(df, "p", "v")
    assert chunks.collect() == [] and pack.unpack(chunks, T.DoubleType()).collect() == []
    assert pack.unpack_range(chunks, T.DoubleType(), 0, 5).collect() == []


TYPED = {
    "long": (T.LongType(), [1, None, -(2**62), 0]), "string": (T.StringType(), ["", "é", None, "x" * 1000]), "binary": (T.BinaryType(), [b"", b"\x00", None, b"abc"]),
    "boolean": (T.BooleanType(), [True, False, None, True]), "float": (T.FloatType(), [0.5, None, -1.5, 3.0]), "short": (T.ShortType(), [1, -1, None, 5]),
}


@pytest.mark.parametrize("name", TYPED)
def test_data_source(spark, tmp_path, name):
    kind, values = TYPED[name]
    rows = [(i, values[i % 4] if i < 60 else values[0]) for i in range(150)]
    framed.register(spark)
    schema = T.StructType([T.StructField("elem_idx", T.LongType()), T.StructField("v", kind)])
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / name)
    for mode in ("append", "overwrite"):
        df.repartitionByRange(3, "elem_idx").sortWithinPartitions("elem_idx").write.format("framed").option("items", 20).option("codec", "zstd").mode(mode).save(path)
    read = spark.read.format("framed").option("type", kind.simpleString()).load(path)

    def shown(found):
        return sorted((r[0], bytes(r[1]) if isinstance(r[1], bytearray) else r[1]) for r in found)

    assert sorted(map(str, shown(read.where("elem_idx >= 0").collect()))) == sorted(map(str, rows))
    assert shown(read.where("elem_idx = 70").collect()) == [(70, values[0])]
    assert shown(read.where("elem_idx > 98 AND elem_idx <= 101").collect()) == rows[99:102]
    assert shown(read.where("elem_idx IN (61, 140)").collect()) == [rows[61], rows[140]]
    assert read.where("elem_idx > 1000").collect() == []


def test_predicates_leave_out_chunks(spark, tmp_path):
    framed.register(spark)
    path = str(tmp_path / "f")
    spark.range(1000).select(F.col("id").alias("elem_idx"), (F.col("id") * 0.5).alias("v")).coalesce(1).write.format("framed").option("items", 50).mode("append").save(path)
    reader = framed.FramedReader(f"file://{path}", {"type": "double"}, None)
    assert sum(len(p.chunks()) for p in reader.partitions()) == 20
    list(reader.pushFilters([framed.GreaterThanOrEqual(("elem_idx",), 120), framed.LessThan(("elem_idx",), 151), framed.GreaterThan(("v",), 1)]))
    assert [(c.first, c.n) for p in reader.partitions() for c in p.chunks()] == [(100, 50), (150, 50)]
    list(reader.pushFilters([framed.GreaterThan(("elem_idx",), 5000)]))
    assert [p.path for p in reader.partitions()] == [""]  # the name alone rules the file out
    assert not [f for f in os.listdir(path) if f.endswith(".part")]


def test_chunks_have_the_numbers_of_their_places(spark, tmp_path):
    framed.register(spark)
    path = f"file://{tmp_path}/f"
    spark.range(2500).select(F.col("id").alias("elem_idx"), F.col("id").alias("v")).coalesce(1).write.format("framed").option("items", 1000).mode("append").save(path)
    read = spark.read.format("framed").option("mode", "chunks").load(path)
    assert sorted((r["chunk_id"], r["first"], r["n"]) for r in read.collect()) == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 500)]


def test_paths_name_their_store():
    assert _files.qualified("/a/b", "hdfs://host:9000") == "hdfs://host:9000/a/b"
    assert _files.qualified("/a/b") == "file:///a/b" and _files.qualified("file:/a/b") == "file:///a/b"
    assert _files.qualified("s3a://bucket/a") == "s3a://bucket/a" and _files.qualified("hdfs://host/a") == "hdfs://host/a"
    with pytest.raises(ValueError):
        _files.qualified("a/b", "hdfs://host:9000")


@pytest.mark.parametrize("places", [[0, 5, 9], [0, 0, 2], [0, 1, 1]])
def test_gaps_are_refused(spark, places):
    df = spark.createDataFrame([(p, float(p)) for p in places], "p long, v double")
    with pytest.raises(Exception, match="gaps or repeat"):
        pack.pack(df, "p", "v").collect()


@needs_data
@pytest.mark.parametrize(("name", "functions", "maps"), [("roundtrip_type_long", 1, 1), ("roundtrip_lz4hc_shuffle_v2", 1, 1), ("getitem_range", 1, 1), ("roundtrip_embeddings", 1, 1)])
def test_chunks_are_packed_and_unpacked_once(spark, name, functions, maps):
    steps = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert (steps.count("ArrowEvalPython"), steps.count("MapInArrow")) == (functions, maps)


@pytest.mark.parametrize(("kind", "values"), [(pa.int64(), [*range(999), None]), (pa.string(), ["x" * i for i in range(1000)])])
def test_rows_are_handed_on_in_pieces(monkeypatch, kind, values):
    monkeypatch.setattr(pack, "PIECE", 8000)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"])], names=["k"])
    found = [(0, 5, pa.array(values, kind)), (1, 0, pa.array(values[:0], kind)), *((2, 1000 * i, pa.array(values[:10], kind)) for i in range(200))]
    made = list(pack._pieces(iter(found), batch, ["k"]))
    assert max(b.nbytes for b in made) < 40_000 and len(made) > 4
    want = [("abc"[i], at + j, v) for i, at, run in found for j, v in enumerate(run.to_pylist())]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want


def _iterates(df, name):
    """Whether the function of this name hands its results on in pieces."""
    from pyspark.util import PythonEvalType

    found, todo = [], [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        expressions = [node.expressions().apply(i) for i in range(node.expressions().size())]
        while expressions:
            e = expressions.pop()
            expressions += [e.children().apply(i) for i in range(e.children().size())]
            if e.getClass().getSimpleName() == "PythonUDF" and e.name() == name:
                found.append(e.evalType() == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)
    return bool(found) and all(found)


def test_chunks_are_encoded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 100)
    assert [len(p) for p in pieces.cut([b"x" * n for n in (30, 30, 50, 200, 0, 99)], len)] == [3, 1, 2] and not list(pieces.cut([], len))
    lists = spark.range(50).select("id", F.when(F.col("id") % 9 > 0, F.sequence(F.lit(0).cast("long"), F.col("id") * 100)).alias("v")).coalesce(1)
    made = lists.select("id", "v", pack.packed(F.col("v"), T.LongType(), CParams("lz4hc", filter="shuffle")).alias("f"))
    back = made.select("id", "v", pack.unpacked(F.col("f.frame"), F.size("v").cast("long"), T.LongType()).alias("b"))
    assert _iterates(back, "encode") and _iterates(back, "decode")
    assert all(r["v"] == r["b"] for r in back.collect())


def test_frames_decode_in_pieces(spark, monkeypatch):
    frames_ = spark.range(20).select("id", compress(F.repeat(F.lit("ab"), (F.col("id") * 1000).cast("int")), CParams("lz4", 9, 16, "bitshuffle")).alias("f")).coalesce(1)
    back = frames_.select("id", decompress(F.col("f")).cast("string").alias("t"))
    assert _iterates(back, "decode") and {r["id"]: r["t"] for r in back.collect()} == {i: "ab" * 1000 * i for i in range(20)}
    monkeypatch.setattr(pieces, "PIECE", 1000)
    made = list(codec._pieces(lambda d: d * 100, pa.array([b"x" * (i % 7) for i in range(40)] + [None])))
    assert max(p.nbytes for p in made) < 3000 and [v for p in made for v in p.to_pylist()] == [b"x" * (i % 7) * 100 for i in range(40)] + [None]
    assert codec._each(bytes, pa.array([], pa.binary())).to_pylist() == [] and codec._each(bytes, pa.array([b"a" * 999, None, b"b"] * 2)).to_pylist() == [b"a" * 999, None, b"b"] * 2


def test_unpack_keeps_keys_nulls_and_the_type_of_places(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i}") for i in range(100)]
    chunks = pack.pack(spark.createDataFrame(rows, "p int, v string"), "p", "v", CParams("lz4"), 30)
    back = pack.unpack(chunks, T.StringType(), ["chunk_id"])
    assert back.schema["elem_idx"].dataType == T.IntegerType()
    assert sorted(map(tuple, back.collect())) == [(p // 30, p, v) for p, v in rows]
    assert sorted(map(tuple, pack.unpack_range(chunks, T.StringType(), 25, 40).collect())) == rows[25:65]


def test_blocks_of_stored_empty_and_broken_frames(spark):
    noise = os.urandom(100)
    made = [frames.encode(noise, CParams("zstd")), frames.encode(b"", CParams("zstd")), frames.encode(bytes(5000), CParams("lz4", typesize=4)), b"short", None]
    df = spark.createDataFrame(list(enumerate(made)), "k int, frame binary")
    rows = relational.blocks(df)
    assert {(r["k"], r["status"], r["block_idx"]) for r in rows.collect()} == {(0, "ok", 0), (1, "ok", None), (2, "ok", 0), (3, "invalid_header", None), (4, "invalid_header", None)}
    got = {r["k"]: (r["data"] and bytes(r["data"]), r["status"]) for r in relational.decoded_blocks(relational.streams(rows), ["k"]).collect()}
    assert got[0] == (noise, "ok") and got[2] == (bytes(5000), "ok") and {got[i] for i in (3, 4)} == {(None, "invalid_header")}


def test_blocks_are_decoded_in_pieces(spark):
    """Every codec and filter, split and unsplit blocks, one broken stream."""
    data = b"".join(i.to_bytes(8, "little") for i in range(30_000))
    kinds = [(c, f) for c in C.CODECS for f in C.FILTERS]
    made = [frames.encode(data, CParams(c, 1, 8, f)) for c, f in kinds]
    broken = bytearray(made[kinds.index(("zlib", "shuffle"))])
    broken[-1] ^= 255
    rows = relational.decoded_blocks(relational.streams(relational.blocks(spark.createDataFrame(list(enumerate([*made, bytes(broken)])), "k int, frame binary"))), ["k"])
    assert _iterates(rows, "expand") and _iterates(rows, "unfilter")
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["k"], r["block_idx"])):
        got.setdefault(r["k"], []).append((r["data"], r["status"]))
    for k in range(len(kinds)):
        assert b"".join(d for d, _ in got[k]) == data and {s for _, s in got[k]} == {"ok"}
    assert [s for _, s in got[len(kinds)]].count("failed") == 1 and got[len(kinds)][-1] == (None, "failed")


@pytest.mark.parametrize("size", [1, 100, 5 << 20])
def test_lz4_blocks_must_give_their_size(size):
    data = (b"abcdefgh" * (size // 8 + 1))[:size]
    packed = codecs.compress(C.CODECS["lz4"][0], 5, data, 2 * size + 100)
    assert codecs.decompress(C.CODECS["lz4"][0], packed, size) == data
    assert codecs.decompress(C.CODECS["lz4"][0], packed, size + 1) is None
    assert codecs.decompress(C.CODECS["lz4"][0], packed, max(0, size - 1)) is None


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select("id", F.concat(F.lit("text "), F.col("id")).alias("text")).write.parquet(source)
    stream = spark.readStream.schema("id long, text string").parquet(source)
    done = streaming.restored(streaming.compressed(stream, "text", CParams(typesize=1)))
    q = done.writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT id, CAST(buffer AS STRING) AS t FROM restored").collect()
    assert sorted((r["id"], r["t"]) for r in rows) == [(i, f"text {i}") for i in range(100)]


def test_sql_names(spark):
    from chunkwise.functions import sql

    sql.register(spark)
    spark.createDataFrame([("abc" * 50,), (None,)], "t string").createOrReplaceTempView("texts")
    rows = spark.sql("""
        WITH f AS (SELECT t, frame_compress(t, 'zstd', 3, 1, 'none', 2) AS frame FROM texts)
        SELECT t, CAST(frame_decompress(frame) AS STRING) AS back, frame_status(frame) AS status, CAST(frame_items(frame, 3, 3) AS STRING) AS items, frame_status(substr(frame, 1, 5)) AS cut FROM f
    """).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("abc" * 50, "abc" * 50, "ok", "abc", "invalid_header"), (None,) * 5], key=str)
