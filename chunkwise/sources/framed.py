"""A data source for files of frames: ``spark.read.format("framed")``.

A file holds the frames of one column one after the other, then an index (JSON: the
items of a whole chunk, and for each chunk the place of its first item, its items,
where its frames stand and how long they are), the index's length and a closing mark; its name tells the range of places in
it. Predicates on ``elem_idx`` leave out files by their names, which is all the driver
looks at; each task reads one file's index and leaves out chunks before a byte of them
is read, and blocks of the chunks that remain.

Tasks write files of at most ``FILE_BYTES`` (and one chunk) under names that no reader
takes up; the driver gives them their names, many at a time, when the whole write is
done. Overwriting takes away what was there before after that, so a reader that comes
between finds both, never neither.

Paths without a scheme lie in Spark's default file system, as for its own sources.

Options: ``type`` (the column's SQL type, needed to read), and for writing ``items``,
``codec``, ``clevel``, ``filter``, ``version``. ``mode`` "values" (default) reads rows
(elem_idx, v); "chunks" reads (chunk_id, first, n, nbytes, cbytes) from indexes and
headers, without payloads.

Predicates are only offered to Python sources where
``spark.sql.python.filterPushdown.enabled`` is true; ``register`` sets that.
Writing takes rows (elem_idx, v) sorted by ``elem_idx`` within partitions.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from chunkwise import constants as C
from chunkwise._files import default_store, opened, qualified
from chunkwise._ship import ship
from chunkwise.operators import frame as frames
from chunkwise.operators import pack
from chunkwise.operators.frame import CParams

MARK = b"FRAMED01"
#: Bytes of frames in one file, which one task reads.
FILE_BYTES = 128_000_000
#: Items of a batch handed to Spark.
BATCH = 65_536
#: The codec of files that don't name one: the format's own default is a byte loop in Python.
CODEC = "lz4"
#: Files renamed at the same time.
AT_ONCE = 32


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)

    class Here(Framed):  # a class of its own, so that what it knows of the session goes with it
        store = default_store(spark)

    spark.dataSource.register(Here)


@dataclass
class Chunk:
    first: int
    n: int
    at: int
    lengths: list[int]  # of the frames of values, validity and offsets; 0 where there is none
    number: int = 0


@dataclass
class Part(InputPartition):
    """A file, and which places of it are wanted: from ``lo`` up to, without, ``hi``."""

    path: str
    size: int
    lo: int
    hi: int

    def chunks(self) -> list[Chunk]:
        return [c for c in index_of(self.path, self.size) if c.first < self.hi and c.first + c.n > self.lo]


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    where, inner = opened(path)
    found = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.base_name.endswith(".framed"))


def index_of(path: str, size: int) -> list[Chunk]:
    """The index of a file, from its end."""
    where, inner = opened(path)
    with where.open_input_file(inner) as f:
        tail = f.read_at(16, size - 16)
        length, mark = struct.unpack("<Q8s", tail)
        if mark != MARK:
            raise ValueError(f"{path} isn't a file of frames")
        index = json.loads(f.read_at(length, size - 16 - length))
        return [Chunk(*c, c[0] // index["items"]) for c in index["chunks"]]


class Framed(DataSource):
    store = "file:///"

    @property
    def path(self) -> str:
        return qualified(self.options["path"], self.store)

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> T.StructType | str:
        if self.options.get("mode", "values") == "chunks":
            return "chunk_id long, first long, n long, nbytes long, cbytes long"
        return f"elem_idx long, v {self.options.get('type', 'double')}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FramedReader(self.path, self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FramedWriter(self.path, self.options, schema, overwrite)


class FramedReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: T.StructType) -> None:
        self.path, self.options, self.schema = path, options, schema
        self.lo, self.hi = 0, 2**62  # the items wanted: lo up to, without, hi

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute == ("elem_idx",) if hasattr(f, "attribute") else False:
                match f:
                    case EqualTo(value=v):
                        self.lo, self.hi = max(self.lo, v), min(self.hi, v + 1)
                    case GreaterThan(value=v):
                        self.lo = max(self.lo, v + 1)
                    case GreaterThanOrEqual(value=v):
                        self.lo = max(self.lo, v)
                    case LessThan(value=v):
                        self.hi = min(self.hi, v)
                    case LessThanOrEqual(value=v):
                        self.hi = min(self.hi, v + 1)
                    case In(value=v) if v:
                        self.lo, self.hi = max(self.lo, min(v)), min(self.hi, max(v) + 1)
            yield f  # Spark applies them again: lists and nulls aren't handled here in full

    def partitions(self) -> list[Part]:
        out = []
        for path, size in _files(self.path):
            first, end = map(int, path.rsplit("/", 1)[1].split("-")[:2])
            if first < self.hi and end > self.lo:
                out.append(Part(path, size, self.lo, self.hi))
        return out or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, inner = opened(partition.path)
        chunks_only = self.options.get("mode", "values") == "chunks"
        kind = None if chunks_only else to_arrow_type(self.schema["v"].dataType)
        with where.open_input_file(inner) as f:
            for c in partition.chunks():
                if chunks_only:
                    h = frames.parse_header(f.read_at(C.HEADER_V2, c.at) + bytes(c.lengths[0]))
                    row = [c.number, c.first, c.n, h.nbytes, h.cbytes]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["chunk_id", "first", "n", "nbytes", "cbytes"])
                    continue
                ends = np.cumsum([0, *c.lengths])
                data = f.read_at(int(ends[-1]), c.at)
                body, valid, offsets = (data[a:b] or None for a, b in zip(ends, ends[1:], strict=False))
                lo, hi = max(0, partition.lo - c.first), min(c.n, partition.hi - c.first)
                if valid is None and offsets is None:  # only the blocks that hold the items
                    values = pack._values(frames.get_items(body, lo, hi - lo), kind, hi - lo, None, None)
                else:
                    values = pack._values(frames.decode(body), kind, c.n, valid, offsets).slice(lo, hi - lo)
                place = pa.array(np.arange(c.first + lo, c.first + hi))
                batch = pa.RecordBatch.from_arrays([place, values], names=["elem_idx", "v"])
                for at in range(0, batch.num_rows, BATCH):
                    yield batch.slice(at, BATCH)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, by the names they have and those they get."""

    names: list[tuple[str, str]]


class _File:
    """One file that is being written."""

    def __init__(self, root: str, params: CParams, items: int, where) -> None:
        self.params, self.items, self.name = params, items, uuid.uuid4().hex
        self.root, self.out = root, where.open_output_stream(f"{root}/{self.name}.part")
        self.chunks: list[Chunk] = []
        self.at = 0

    def put(self, first: int, values: pa.Array) -> None:
        made = [x or b"" for x in pack._frames(values, self.params)]
        self.out.write(b"".join(made))
        self.chunks.append(Chunk(first, len(values), self.at, [len(x) for x in made]))
        self.at += sum(map(len, made))

    def close(self) -> tuple[str, str]:
        index = json.dumps({"items": self.items, "chunks": [[c.first, c.n, c.at, c.lengths] for c in self.chunks]}).encode()
        self.out.write(index + struct.pack("<Q8s", len(index), MARK))
        self.out.close()
        first, end = min(c.first for c in self.chunks), max(c.first + c.n for c in self.chunks)
        return f"{self.root}/{self.name}.part", f"{self.root}/{first}-{end}-{self.name}.framed"


class FramedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.options, self.schema = path, options, schema
        self.old = [p for p, _ in _files(path)] if overwrite else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        kind = self.schema["v"].dataType
        params = CParams(o.get("codec", CODEC), int(o.get("clevel", C.DEFAULT_CLEVEL)), pack.width_of(kind), o.get("filter", C.EASY_FILTER), int(o.get("version", 2)))
        items = int(o.get("items", pack.ITEMS))
        where, root = opened(self.path)
        root = root.rstrip("/")
        where.create_dir(root, recursive=True)
        names: list[tuple[str, str]] = []
        file: _File | None = None
        for first, values in _runs(batches, items):
            file = file or _File(root, params, items, where)
            file.put(first, values)
            if file.at >= FILE_BYTES:
                names.append(file.close())
                file = None
        if file:
            names.append(file.close())
        return Written(names)

    def _each(self, work, names: list) -> None:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for _ in pool.map(work, names):
                pass

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = opened(self.path)
        self._each(lambda names: where.move(*names), [n for m in messages if m for n in m.names])
        self._each(lambda path: where.delete_file(opened(path)[1]), self.old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = opened(self.path)
        self._each(lambda names: where.delete_file(names[0]), [n for m in messages if m for n in m.names])


def _runs(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[tuple[int, pa.Array]]:
    """(first place, values) of whole chunks: runs of consecutive places that don't cross a multiple of ``items``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch])
        places = rows.column("elem_idx").to_numpy()
        cut = np.flatnonzero((places[1:] != places[:-1] + 1) | (places[1:] % items == 0)) + 1
        yield from _pieces(rows, [0, *cut.tolist()])
        held = rows.slice(int(cut[-1]) if len(cut) else 0).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held)
        yield from _pieces(rows, [0, rows.num_rows])


def _pieces(rows: pa.Table, bounds: list[int]) -> Iterator[tuple[int, pa.Array]]:
    for a, b in pairwise(bounds):
        values = rows.column("v").slice(a, b - a).combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        yield rows.column("elem_idx")[a].as_py(), values
