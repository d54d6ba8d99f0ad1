import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import SCHEMA, nasty_rows, prose

from chunkwise.llm import components, simhash


def brute_fingerprint(text, k):
    words, word = [], b""
    for c in (text or "").encode():
        if c in (0x20, 9, 10, 11, 12, 13):
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [word] if word else []
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(nodes, linked):
    part = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    return part


def brute(rows, distance):
    fps = [(i, brute_fingerprint(t, 3)) for i, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    part = brute_parts(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= distance])
    least = {}
    for i, f in fps:
        if i is not None:
            least[part[f]] = min(i, least.get(part[f], i))
    return sorted(((i, f"{f:016x}", least.get(part[f])) for i, f in fps), key=str)


@pytest.mark.parametrize("distance,segments,length", [(2, 5, 2), (7, 8, 2), (3, 4, 1)])
def test_against_brute_force(spark, distance, segments, length):
    rows = nasty_rows()
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), distance=distance, segments=segments, length=length)
    got = sorted(((r["id"], f"{r['fp'] % 2**64:016x}", r["component"]) for r in out.collect()), key=str)
    assert got == brute(rows, distance)


@pytest.mark.parametrize("distance,segments,length", [(2, 5, 2), (7, 8, 2)])
def test_crowded_buckets_are_divided(spark, monkeypatch, distance, segments, length):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(120)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    monkeypatch.setattr(simhash, "BUCKET", 16)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    linked = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, distance, segments, length).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in linked)
    ordered = sorted(fps)
    every = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= distance]
    assert brute_parts(ordered, linked) == brute_parts(ordered, every)


@pytest.mark.parametrize("seed", range(5))
def test_spanning_forest(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, 80).astype(np.uint64), rng.integers(0, 30, 80).astype(np.uint64)
    d = rng.integers(0, 5, 80)
    keep = simhash.joining(x, y, d)
    nodes = set(x.tolist()) | set(y.tolist())
    edges = list(zip(x.tolist(), y.tolist(), strict=True))
    assert brute_parts(nodes, [edges[i] for i in keep]) == brute_parts(nodes, edges)
    part, cost = {n: n for n in nodes}, []
    for i in np.argsort(d, kind="stable"):
        a, b = (part[e] for e in edges[i])
        if a != b:
            cost.append(d[i])
            part = {n: a if p == b else p for n, p in part.items()}
    assert sorted(d[keep].tolist()) == sorted(cost)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(rng.randint(200, 280), rng.randint(200, 280)) for _ in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == brute_parts(nodes, [e for e in edges if e[0] != e[1]])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.deduplicate(df).collect() == []


def test_deduplicate_keeps_clean_rows_and_columns(spark):
    rng = random.Random(3)
    clean = [prose(rng, 200) for _ in range(60)]
    words = [clean[i].split() for i in range(10)]
    for w in words:
        w[100] = "changed"
    rows = [(i, t, None, None, None) for i, t in enumerate(clean)] + [(100 + i, " ".join(w), "x", 1, 1.0) for i, w in enumerate(words)]
    out = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "keep_id", "_key", "group_size"]
    kept = {r["doc_id"] for r in out.collect()}
    assert set(range(60)) <= kept
    assert len(kept & set(range(100, 110))) <= 1


def test_texts_of_one_fingerprint_are_verified(spark):
    rng = random.Random(12)
    words = prose(rng, 120).split()
    rows = []
    for i in range(6):  # one set of words in six orders: one fingerprint, unlike shingles
        rng.shuffle(words)
        rows.append((i, " ".join(words), None, None, None))
    rows += [(10 + i, rows[i][1] + " " + words[-1], None, None, None) for i in (2, 5)]  # near copies with that fingerprint
    fps = {r["fp"] for r in simhash.described(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 5).collect()}
    assert len(fps) == 1
    assert {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(6))


def test_links_that_fail_hide_no_copies(spark):
    rng = random.Random(13)
    of = lambda ws: [*simhash._sets(pa.array([" ".join(ws)]), 5)][0][2]
    fp = lambda ws: int(simhash.fingerprints(of(ws), [len(of(ws))])[0])
    rows, n = [], 0
    while n < 8:
        a = prose(rng, 200).split()
        new = prose(rng, 12).split()
        b = [*a, *new[:6]]
        rng.shuffle(b)  # between a and c by its words, but with shingles of its own
        x, y, z = fp(a), fp(b), fp([*a, *new])
        if 0 < max((x ^ y).bit_count(), (y ^ z).bit_count()) < (x ^ z).bit_count() <= 7 and len({x, y, z}) == 3:
            rows += [(10 * n + i, " ".join(t), None, None, None) for i, t in enumerate((a, b, [*a, *new]))]
            n += 1
    left = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert left == {10 * i + j for i in range(8) for j in (0, 1)}


def test_marks_at_words_make_no_difference(spark):
    rng = random.Random(15)
    rows = []
    for i in range(20):
        words = prose(rng, 80).split()
        rows += [(2 * i, " ".join(words), None, None, None), (2 * i + 1, "*** " + ", ".join(f"|{w}|" for w in words).upper() + "!", None, None, None)]
    assert {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(0, 40, 2))
