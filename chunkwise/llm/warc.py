"""Web archives packed in ZIP files, written and read back by ranges.

Writing: pages become WARC records, compressed one by one and appended to archives of
bounded size. An archive is a ZIP file with stored members: ``archive/data.warc.gz``,
``indexes/index.cdx`` (where each record stands in the WARC member) and
``datapackage.json``. Of pages with equal payloads the one with the smallest id is
written as a response, the others as revisits that refer to it.

Reading: the end of the file gives the central directory, through the ZIP64 records
where they stand, the directory gives the members: all of ``archive/`` that are WARC
files, compressed or not, and all indexes of ``indexes/``, plain, gzipped or deflated.
The indexes give the records, which are read by ranges of the stored WARC members; a
WARC member that no index speaks of is read from record to record. Nothing is extracted.
Archives are dealt to tasks one by one, to as many tasks as there are archives
(``TASKS`` at most), and files are opened in the store where Spark would look for them.

Which payloads are equal is found by their SHA-1 digests: their least ids are
aggregated before they are shuffled, and joined back in a way that may split a digest
held by many pages. Archives are named by the task attempt that wrote them, and the
list of archives is written to the shared folder once, so that repeated tasks leave
unlisted files behind and nothing else.

Defined results: a null payload counts as empty; a very long payload is one record,
alone in its archive if it is larger than one, and held in memory by one task; a null id
sorts after all others (a page without id refers to the smallest id of its payload; if
no page of a payload has an id all are responses); rows that tie on payload and smallest
id are all responses; a null URL is written as the record's own name; an empty table
gives no archive and an empty result; other columns are left out, whatever they are
called. Of archives made elsewhere records of other types than response, revisit and
resource are left out, and records that aren't named like pages have a null page id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise._files import default_store, opened, qualified
from chunkwise.llm._common import ship, staged, staged_path

#: Bytes of compressed records in one archive, and records, at most (one larger record may exceed the bytes).
ARCHIVE_BYTES = 64_000_000
ARCHIVE_RECORDS = 50_000
#: Records closer than this are read together, up to READ bytes at a time.
GAP, READ = 64_000, 8_000_000
#: Tasks that archives are dealt to, at most.
TASKS = 100_000

WARC, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
#: Folders of an archive's members, and how the members are called that are read.
ARCHIVES, INDEXES = "archive/", "indexes/"
WARCS, CDX = (".warc", ".warc.gz"), (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"

# Fixed values of the ZIP format: signatures, and the layouts behind them.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, LOCATOR64_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
ENTRY_LAYOUT, LOCAL_LAYOUT = "<4s6H3L5H2L", "<4s5H3L2H"
ZIP64_EXTRA, MOST_COMMENT, FULL32, FULL16 = 1, 65535, 0xFFFFFFFF, 0xFFFF

Reader = Callable[[int, int], bytes]  # offset, length


class BadArchive(ValueError):
    """A file that isn't a ZIP-packaged archive of the kind read here."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # of its bytes in the file
    header: int  # where its local header stands


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(read: Reader, size: int) -> dict[str, Member]:
    """The members of a ZIP file of so many bytes."""
    fixed = struct.calcsize(END_LAYOUT)
    tail_at = max(0, size - fixed - MOST_COMMENT)
    tail = read(tail_at, size - tail_at)
    at = len(tail) - fixed
    while True:
        at = tail.rfind(END, 0, at + len(END)) if at >= 0 else -1
        if at < 0:
            raise BadArchive("no end of central directory")
        _, _, _, _, count, length, start, comment = struct.unpack_from(END_LAYOUT, tail, at) if at + fixed <= len(tail) else (0,) * 7 + (-1,)
        if at + fixed + comment == len(tail):
            break
        at -= 1
    if count == FULL16 or length == FULL32 or start == FULL32:
        place = tail_at + at - struct.calcsize(LOCATOR64_LAYOUT)
        if place < 0:
            raise BadArchive("no ZIP64 locator")
        sign, _, end64, _ = struct.unpack(LOCATOR64_LAYOUT, read(place, struct.calcsize(LOCATOR64_LAYOUT)))
        if sign != LOCATOR64 or end64 + struct.calcsize(END64_LAYOUT) > size:
            raise BadArchive("no ZIP64 locator")
        sign, *_, count, length, start = struct.unpack(END64_LAYOUT, read(end64, struct.calcsize(END64_LAYOUT)))
        if sign != END64:
            raise BadArchive("no ZIP64 end of central directory")
    if start + length > size:
        raise BadArchive("the central directory ends beyond the file")
    return _entries(read(start, length), count)


def _entries(directory: bytes, count: int) -> dict[str, Member]:
    out, at, fixed = {}, 0, struct.calcsize(ENTRY_LAYOUT)
    for _ in range(count):
        if directory[at : at + 4] != ENTRY or at + fixed > len(directory):
            raise BadArchive("broken central directory")
        fields = struct.unpack_from(ENTRY_LAYOUT, directory, at)
        method, packed, plain, name_len, extra_len, comment_len, disk, header = fields[4], *fields[8:14], fields[16]
        name = directory[at + fixed : at + fixed + name_len]
        extra = directory[at + fixed + name_len : at + fixed + name_len + extra_len]
        wide = _extra(extra, ZIP64_EXTRA)
        # the wide field holds those of these that don't fit, in this order
        values = []
        for value in (plain, packed, header):
            if value == FULL32:
                if len(wide) < 8:
                    raise BadArchive("broken ZIP64 field")
                value, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            values.append(value)
        if disk not in (0, FULL16):
            raise BadArchive("archives of several disks aren't read")
        out[name.decode()] = Member(name.decode(), method, values[1], values[2])
        at += fixed + name_len + extra_len + comment_len
    return out


def _extra(extra: bytes, wanted: int) -> bytes:
    while len(extra) >= 4:
        kind, length = struct.unpack_from("<2H", extra)
        if kind == wanted:
            return extra[4 : 4 + length]
        extra = extra[4 + length :]
    return b""


def data_at(read: Reader, member: Member) -> int:
    """Where the bytes of a member begin."""
    fields = struct.unpack(LOCAL_LAYOUT, read(member.header, struct.calcsize(LOCAL_LAYOUT)))
    if fields[0] != LOCAL:
        raise BadArchive(f"no local header of {member.name}")
    return member.header + struct.calcsize(LOCAL_LAYOUT) + fields[-2] + fields[-1]


def record(name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, those of its HTTP head if it has one, and its payload."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or not version.startswith("WARC/"):
        raise BadArchive("not a WARC record")
    fields = _fields(lines)
    length = int(fields.get("content-length", -1))
    block = rest[: max(0, length)]
    if len(block) != length:
        raise BadArchive("a record is cut short")
    if fields.get("warc-type") not in ("response", "revisit") or not block.startswith(b"HTTP/"):
        return fields, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http.decode("latin-1").split("\r\n")[1:]), payload


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class ArchiveWriter:
    """Writes one archive to a stream."""

    def __init__(self, stream) -> None:
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.out = self.zip.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
        self.index: list[tuple[str, int, str]] = []
        self.bytes = 0
        self.digest = hashlib.sha256()

    def add(self, name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> None:
        packed = gzip.compress(record(name, url, payload, digest, refers_to), compresslevel=6, mtime=0)
        line = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "digest": digest, "offset": self.bytes, "length": len(packed), "filename": WARC}
        self.index.append((url, self.bytes, json.dumps(line)))
        self.out.write(packed)
        self.digest.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        self.out.close()
        index = "".join(f"{url} {DATE} {line}\n" for url, _, line in sorted(self.index)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        resources = [{"path": WARC, "bytes": self.bytes, "hash": f"sha256:{self.digest.hexdigest()}"}, {"path": INDEX, "bytes": len(index), "hash": f"sha256:{hashlib.sha256(index).hexdigest()}"}]
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()


def records(read: Reader, size: int) -> Iterator[bytes]:
    """All records of an archive, by ranges."""
    found = members(read, size)
    warcs = {n: m for n, m in found.items() if n.startswith(ARCHIVES) and n.lower().endswith(WARCS)}
    places: dict[str, set[tuple[int, int]]] = {n: set() for n in warcs}
    for name, member in found.items():
        if name.startswith(INDEXES) and name.lower().endswith(CDX):
            for file, offset, length in _indexed(read, member):
                file = file if file in places else ARCHIVES + file.rsplit("/", 1)[-1]
                if file not in places:
                    raise BadArchive(f"{name} speaks of {file}, which isn't there")
                places[file].add((offset, length))
    if not warcs:
        raise BadArchive(f"no WARC member in {ARCHIVES}")
    for name, member in warcs.items():
        if member.method != zipfile.ZIP_STORED:
            raise BadArchive(f"{name} isn't stored")
        packed, base = name.lower().endswith(".gz"), data_at(read, member)
        if places[name]:
            for raw in _ranges(read, base, member.size, sorted(places[name])):
                yield gzip.decompress(raw) if packed else raw
        else:
            yield from _in_turn(read, base, member.size, packed)


def _indexed(read: Reader, member: Member) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of an index's lines; each ends with a JSON object."""
    data = read(data_at(read, member), member.size)
    if member.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -zlib.MAX_WBITS)
    elif member.method != zipfile.ZIP_STORED:
        raise BadArchive(f"{member.name} is packed in a way that isn't read")
    if member.name.lower().endswith(".gz"):
        data = gzip.decompress(data)
    for line in data.decode().splitlines():
        key, brace, rest = line.partition("{")
        if not brace or key.startswith("!"):
            continue  # a head line
        entry = json.loads(brace + rest)
        yield entry["filename"], int(entry["offset"]), int(entry["length"])


def _ranges(read: Reader, base: int, end: int, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at these places of a member, near ones read together."""
    i = 0
    while i < len(places):
        first, j = places[i][0], i
        stop = first + places[i][1]
        while j + 1 < len(places) and places[j + 1][0] <= stop + GAP and places[j + 1][0] + places[j + 1][1] - first <= READ:
            j += 1
            stop = max(stop, places[j][0] + places[j][1])
        if stop > end:
            raise BadArchive("a record ends beyond its member")
        chunk = read(base + first, stop - first)
        for offset, length in places[i : j + 1]:
            yield chunk[offset - first : offset - first + length]
        i = j + 1


def _in_turn(read: Reader, base: int, size: int, packed: bool) -> Iterator[bytes]:
    """The records of a member without an index, from its beginning on."""
    held, out, inflate = bytearray(), bytearray(), zlib.decompressobj(31)
    for at in range(0, size, READ):
        part = read(base + at, min(READ, size - at))
        if not packed:
            held += part
        for i in range(0, len(part) if packed else 0, GAP):
            rest = part[i : i + GAP]
            while rest:  # a gzip member for each record
                out += inflate.decompress(rest)
                rest = inflate.unused_data
                if inflate.eof:
                    yield bytes(out)
                    inflate, out = zlib.decompressobj(31), bytearray()
        done = 0
        while (whole := _length(held, done)) and done + whole <= len(held):
            yield bytes(held[done : done + whole])
            done += whole
        del held[:done]
    if held or out:
        raise BadArchive("a record is cut short")


def _length(data: bytearray, at: int) -> int:
    """Bytes of the record that begins at ``at``, with the blank lines behind it; 0 if its head isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    return end + 4 - at + int(_fields(data[at:end].decode().split("\r\n")[1:])["content-length"]) + 4 if end >= 0 else 0


def _text_id(x: int | None) -> str:
    return f"{ID}{'' if x is None else x}"


def _id(text: str) -> int | None:
    found = text.strip("<>").removeprefix(ID)
    return int(found) if text.strip("<>").startswith(ID) and found else None


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (id, url, payload, refers_to): ``refers_to`` is the smallest id of an equal payload of
    ``least_bytes`` or more, null where the row is that response itself."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    equal = own.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = equal.where("n > 1").select("digest", "first")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(equal, "digest", "left").select("id", "url", "payload", refers.alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write (id, url, payload, refers_to) rows to archives in ``folder``: rows (path, bytes, records)."""
    ship(rows.sparkSession)

    folder = qualified(folder, default_store(rows.sparkSession)).rstrip("/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(folder)
        where.create_dir(root, recursive=True)
        name, stream, writer = "", None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            stream.close()
            done = [f"{root}/{name}", where.get_file_info(f"{root}/{name}").size, len(writer.index)]
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array(done[1:2], pa.int64()), pa.array(done[2:], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for id_, url, payload, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = where.open_output_stream(f"{root}/{name}")
                    writer = ArchiveWriter(stream)
                id_, data, refers = id_.as_py(), payload.as_py(), refers.as_py()
                url = quote(url.as_py() or _text_id(id_), safe=":/?#[]@!$&'()*+,;=%-._~")
                writer.add(_text_id(id_), url, data, digest_of(data), None if refers is None else _text_id(refers))
                if writer.bytes >= ARCHIVE_BYTES or len(writer.index) >= ARCHIVE_RECORDS:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(work, "path string, bytes long, records long")


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, record_id string"
KINDS = ("response", "revisit", "resource")


def _row(raw: bytes) -> tuple | None:
    """A record as a row of ``SCHEMA``; None for one of another type."""
    fields, http, block = parsed(raw)
    kind, name = fields.get("warc-type", ""), fields.get("warc-record-id", "").strip("<>")
    if kind not in KINDS:
        return None
    digest = fields.get("warc-payload-digest", "")
    # a digest is of the payload as it was sent, which isn't known where it came in parts
    if kind != "revisit" and (digest.startswith("sha1:") or not digest) and "transfer-encoding" not in http:
        if digest and digest_of(block) != digest.removeprefix("sha1:").upper():
            raise BadArchive(f"{name}: the payload doesn't have its digest")
        digest = digest or digest_of(block)
    refers = _id(fields.get("warc-refers-to", "")) if kind == "revisit" else None
    length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    payload, n = (None, length) if kind == "revisit" else (block, len(block))
    return _id(name), fields.get("warc-target-uri"), kind, payload, n, digest.removeprefix("sha1:") or None, refers, name


def read(archives: DataFrame) -> DataFrame:
    """All records of the archives (path, bytes): rows of ``SCHEMA``; a revisit has no payload.

    A response whose payload doesn't have its digest, or a broken archive, fails the read.
    """
    ship(archives.sparkSession)
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "record_id"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    store = default_store(archives.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0), batch.column(1), strict=True):
                where, inner = opened(qualified(path.as_py(), store))
                rows, held = [], 0
                with where.open_input_file(inner) as f:
                    for raw in records(lambda at, n, f=f: f.read_at(n, at), size.as_py()):
                        if (row := _row(raw)) is None:
                            continue
                        rows.append(row)
                        held += len(row[3] or b"")
                        if held > READ:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    # dealt in turn to a number of tasks that adaptive execution doesn't lower: the list is tiny, what it stands for isn't
    tasks = min(max(1, archives.count()), TASKS)
    return archives.select("path", "bytes").repartition(tasks).mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages to archives in ``folder`` (scratch by default) and read them back: rows of ``SCHEMA``."""
    folder = folder or staged_path(pages.sparkSession, "archives")
    listed = staged(write(with_originals(pages, id_col, url_col, payload_col, least_bytes), folder), "archive-list")
    return read(listed)
