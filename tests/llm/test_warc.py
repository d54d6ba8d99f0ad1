import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

from chunkwise.llm import warc


def pages():
    rng = random.Random(3)
    html = ["<html>" + "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000))) + "</html>" for _ in range(30)]
    rows = [(i, f"https://example.com/{i} é\n", h) for i, h in enumerate(html)]
    rows += [(100 + i, None, html[i]) for i in range(10)] + [(200, "u", None), (201, "u", ""), (202, "", None), (203, "u", "x" * 300000), (204, "v", "x" * 300000)]
    rows += [(None, "u", html[0]), (None, "u", "only without id"), (None, "u", "only without id"), (5, "again", html[5]), (5, rows[5][1], html[5]), (6, "u", "WARC/1.1\r\n\r\n")]
    return rows


def brute(rows, least):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None) if len(data) >= least else None
        refers = first if first is not None and i != first else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,size", [(0, 64_000_000), (100, 4000), (10**9, 64_000_000)])
def test_round_trip(spark, monkeypatch, tmp_path, least, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(df, least_bytes=least, folder=f"file://{tmp_path}/a").collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == brute(rows, least)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in got if r["payload"] is not None}
    assert payloads <= {(i, (h or "").encode()) for i, _, h in rows}
    for path in (tmp_path / "a").iterdir():  # other readers understand the archives
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert gzip.decompress(z.read(warc.WARC)).startswith(b"WARC/1.1\r\n")


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(comment=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    writer.add("urn:page:1", "u", b"one", warc.digest_of(b"one"), None)
    writer.add("urn:page:2", "u", b"one", warc.digest_of(b"one"), "urn:page:1")
    writer.zip.comment = comment
    writer.close()
    return out.getvalue()


def reader(data):
    return (lambda at, n: data[at : at + n]), len(data)


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in the comment" * 5, b"x" * 65535])
def test_members_are_those_of_the_library(comment):
    data = archive(comment)
    found = warc.members(*reader(data))
    with zipfile.ZipFile(io.BytesIO(archive())) as z:  # the library itself can't read the second comment
        assert {(i.filename, i.file_size, i.header_offset) for i in z.infolist()} == {(m.name, m.size, m.header) for m in found.values()}
        for m in found.values():
            at = warc.data_at(reader(data)[0], m)
            assert data[at : at + m.size] == z.read(m.name)
    assert len(list(warc.records(*reader(data)))) == 2


def test_zip64_directory():
    """More members than 16 bits count force the ZIP64 end of the directory."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66000):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"data")
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = warc.members(*reader(data))
    assert len(found) == 66001
    at = warc.data_at(reader(data)[0], found["wide"])
    assert data[at : at + found["wide"].size] == b"data"


def test_broken_archives():
    data = archive()
    for bad in (b"", b"PK\x05\x06", data[:-1], data[:100], data[10:], b"no archive" * 10):
        with pytest.raises(warc.BadArchive):
            list(warc.records(*reader(bad)))


def foreign(rng):
    """An archive as other tools make it: three WARC members, indexes of three kinds, records of other types."""
    texts = [f"page {i} " + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 500))) for i in range(60)]
    raws = [warc.record(f"urn:uuid:{i}", f"https://a.example/{i}", t.encode(), warc.digest_of(t.encode()), None) for i, t in enumerate(texts)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:info>\r\nContent-Length: 4\r\n\r\nhead\r\n\r\n"
    members, indexes = [info, info, info], [[], [], []]
    for i, raw in enumerate(raws):
        one = gzip.compress(raw) if i % 3 != 1 else raw
        members[i % 3] = members[i % 3] if members[i % 3] != info or i % 3 == 1 else gzip.compress(info)
        indexes[i % 3].append({"offset": str(len(members[i % 3])), "length": str(len(one)), "filename": ("a.warc.gz", "archive/b.warc", "c.warc.gz")[i % 3]})
        members[i % 3] += one
    lines = ["".join(f"com,example)/ 2020 {json.dumps(x)}\n" for x in part).encode() for part in indexes]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc.gz", members[0])
        z.writestr("pages/pages.jsonl", "{}", compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("archive/b.warc", members[1])
        z.writestr("archive/c.warc.gz", members[2])
        z.writestr("indexes/one.cdx.gz", gzip.compress(b"!meta 0 {}\n" + lines[0]))
        z.writestr("indexes/two.cdxj", lines[1], compress_type=zipfile.ZIP_DEFLATED)
    return texts, out.getvalue()  # c.warc.gz has no index


@pytest.mark.parametrize("read,gap", [(8_000_000, 64_000), (100, 7)])
def test_archives_made_elsewhere(spark, monkeypatch, tmp_path, read, gap):
    monkeypatch.setattr(warc, "READ", read)
    monkeypatch.setattr(warc, "GAP", gap)
    texts, data = foreign(random.Random(5))
    found = [warc.parsed(r) for r in warc.records(*reader(data))]
    payloads = [p.decode() for f, _, p in found if f["warc-type"] == "response"]
    assert sorted(payloads) == sorted(texts) and len(found) == len(texts) + 1  # the head record of the member without index
    (tmp_path / "x.wacz").write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / "x.wacz"), len(data))], "path string, bytes long")
    got = warc.read(listed).collect()
    assert {(r["record_id"], bytes(r["payload"]).decode(), r["page_id"]) for r in got} == {(f"urn:uuid:{i}", t, None) for i, t in enumerate(texts)}


def test_every_archive_has_a_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 2)
    df = spark.createDataFrame([(i, f"u{i}", f"text {i}") for i in range(100)], "page_id long, url string, html string").repartition(1)
    listed = warc.staged(warc.write(warc.with_originals(df).coalesce(1), str(tmp_path / "a")), "list")
    read = warc.read(listed)
    tasks = read.rdd.mapPartitions(lambda rows: [len({r["page_id"] for r in rows})]).collect()
    assert listed.count() == 50 and tasks == [2] * 50


def test_an_archive_that_lacks_a_member():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc.gz", b"")
        z.writestr("indexes/index.cdx", 'k 1 {"filename": "b.warc.gz", "offset": 0, "length": 1}')
    with pytest.raises(warc.BadArchive):
        list(warc.records(*reader(out.getvalue())))
