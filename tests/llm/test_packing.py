import random
from functools import lru_cache

import numpy as np
import pytest
from cases import SCHEMA, nasty_rows

from chunkwise.llm import packing, token_counts, tokens


def brute_first_fit(lengths, capacity):
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            room.append(capacity)
            b = len(room) - 1
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), 64, 33, 1]) for _ in range(rng.choice([0, 1, 2, 3, 100, 257]))]
    where, offset = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 64)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == brute_first_fit(lengths, 64)


@lru_cache
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_byte_bpe().path)


def ids_of(text):
    return exact().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("group", [8192, 1040])
def test_every_id_is_packed_once(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = nasty_rows() + [(5000, "a <|endoftext|> b", None, None, None), (5001, " " * 3000 + "y", None, None, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), tokens.public_byte_bpe()).collect()
    want = sorted((str(i), np.array([*ids_of(t), 1], "<u4").tobytes()) for i, t, *_ in rows)
    docs, used = {}, {}
    for r in out:
        assert r["length"] * 4 == len(r["ids"]) and 1 <= r["length"] <= 2048
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    got = sum(r["length"] for r in out)
    assert got == sum(len(x) // 4 for _, x in want)
    unique = [(str(d), b"".join(x for _, x in sorted(p))) for (d, n), p in docs.items() if sum(len(x) for _, x in p) == 4 * n]
    assert set(unique) <= set(want) and len(unique) > 300


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.5, 1, 8000).astype(np.int64) + 1, 2048)
    where, _ = packing.first_fit_decreasing(lengths, 2048)
    assert lengths.sum() / ((where.max() + 1) * 2048) > 0.99


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack(df, tokens.public_byte_bpe()).collect() == []
    sums = token_counts.suffix_sums(token_counts.histogram(df, tokens.public_byte_bpe()))
    assert sums.collect() == []
    assert [tuple(r) for r in token_counts.at_limits(sums, [10]).collect()] == [(10, *[0] * 7)]
    assert {r["kind"] for r in token_counts.report(token_counts.histogram(df, tokens.public_byte_bpe())).collect()} == {"limit"}


def test_fast_encoder_gives_the_tokenizers_ids():
    encode = tokens.encoder(tokens.public_byte_bpe())
    for text in ["", " ", "Hello  world\n\n", "É é ß 你好 🙂", "<|endoftext|>", "x" * 3000, "it's 123 $$$ ###", "\u00a0 a\u2028b"]:
        assert encode(text).tolist() == ids_of(text)


def test_token_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    rows = nasty_rows()
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame(rows, SCHEMA), tokens.public_byte_bpe())).cache()
    n = [len(ids_of(t)) for _, t, *_ in rows]
    want = sorted((x, n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), len(n), sum(n), sum(min(x, y) for y in n)) for x in set(n))
    assert sorted(tuple(r) for r in sums.collect()) == want
    limits = [0, 1, 7, 100, 2048, 10**7]
    at = lambda x: (x, n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), len(n), sum(n), sum(min(x, y) for y in n))
    assert [tuple(r) for r in token_counts.at_limits(sums, limits).collect()] == [at(x) for x in limits]
    shares = [0.0, 0.5, 0.9, 1.0]
    of = lambda share: min(x for x in n if sum(y <= x for y in n) >= np.ceil(share * len(n)))
    assert [tuple(r) for r in token_counts.quantiles(sums, shares).collect()] == [(s, *at(of(s))) for s in shares]
    every = {tuple(r) for r in token_counts.report(token_counts.histogram(spark.createDataFrame(rows, SCHEMA), tokens.public_byte_bpe()), limits, shares).collect()}
    assert every == {("length", None, *w) for w in want} | {("limit", None, *at(x)) for x in limits} | {("quantile", s, *at(of(s))) for s in shares}
