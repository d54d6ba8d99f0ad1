"""The registered queries, whole, over the smallest tables: digest columns against plain Python, and SQL."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_simhash import brute
from tokenizers import Tokenizer

from chunkwise.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.items()}


def test_op1(spark, docs):
    got = [tuple(r) for r in queries.op1_sharding(spark, SF).collect()]
    data = {i: (t or "").encode() for i, t in docs.items()}
    assert sorted(r[:4] for r in got) == sorted((i, len(t) + 8, zlib.crc32(t), "rows") for i, t in data.items())
    shards = defaultdict(list)
    for *_, shard, slot, grown in got:
        shards[shard].append(slot)
        assert grown is None
    assert set(shards) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)


def test_op2(spark, docs):
    got = sorted((tuple(r) for r in queries.op2_simhash(spark, SF).collect()), key=str)
    assert got == brute(list(docs.items()), 2)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert set(got) == set(docs)
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels)
    for i, r in got.items():
        folded = toxicity.fold(docs[i])
        readings = dict.fromkeys([folded, toxicity.without_marks(folded)])
        exceptions = [toxicity.fold(p) for p in model.exceptions]
        safe = {(at, at + len(p)) for t in readings for p in exceptions for at in range(len(t)) if t.startswith(p, at)}
        hits = {(at, at + len(term), w) for t in readings for term, w in model.terms for at in range(len(t)) if t.startswith(term, at)}
        total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in safe))
        want = 0.0
        if model.factors:
            x, y = np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))
            want = 1 / (1 + np.exp(-(model.factors[0] + model.factors[1] * x + model.factors[2] * y))) if total else 1 / (1 + np.exp(-model.factors[0]))
        assert r["score"] == pytest.approx(want, abs=1e-9) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


def test_op5(spark, docs):
    rows = queries.op5_substring_dedup(spark, SF).collect()
    assert {"doc_id", "partner_id"} <= set(rows[0].asDict()) if rows else True
    assert all(r["doc_id"] in docs and r["partner_id"] in docs for r in rows)


def test_op8(spark, ids):
    got = queries.op8_packing(spark, SF).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]][r["start"]] = r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, cut in pieces.items():
        starts = sorted(cut)
        assert [*starts, len(ids[i])] == [0, *np.cumsum([cut[s] for s in starts]).tolist()]
    assert set(pieces) == set(ids)
    for cells in sequences.values():
        ends = np.cumsum([n for _, n in sorted(cells)])
        assert [at for at, _ in sorted(cells)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_op9(spark, ids):
    lengths = Counter(len(x) - 1 for x in ids.values())
    got = {(r["length"], r["docs"]) for r in queries.op9_token_counts(spark, SF).where("kind = 'length'").collect()}
    assert got == set(lengths.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    shown = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert shown(map(tuple, got.collect())) == shown(want.fetchall())
