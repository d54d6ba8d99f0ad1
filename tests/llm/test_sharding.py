from collections import Counter
from math import comb

import numpy as np
import pytest
from cases import SCHEMA, nasty_rows

from chunkwise.llm import sharding


def test_hypergeometric_has_the_right_probabilities():
    rng = np.random.default_rng(0)
    n = 20000
    found = Counter(sharding.hypergeometric(7, 12, 9, rng) for _ in range(n))
    for k in range(0, 8):
        p = comb(7, k) * comb(12, 9 - k) / comb(19, 9)
        assert abs(found[k] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-9
    assert sharding.hypergeometric(0, 5, 3, rng) == 0 and sharding.hypergeometric(5, 0, 3, rng) == 3
    large = sharding.hypergeometric(4 * 10**10, 10**11, 10**7, rng)
    assert abs(large - 10**7 * 4 / 14) < 12 * 1600


def row_by_row(rows, shards, rng):
    """The matrix drawn in another way: source after source, from the places that are left."""
    left, out = np.array(shards), []
    for n in rows:
        out.append(rng.multivariate_hypergeometric(left, n))
        left = left - out[-1]
    return np.array(out)


def by_tree(rows, shards, seed):
    upto = np.cumsum([0, *rows])
    return np.array([sharding.matrix_row(upto, np.array(shards), seed, i) for i in range(len(rows))])


@pytest.mark.parametrize("seed", range(5))
def test_matrix_sums(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 50, 12 + seed).tolist()
    n, k = sum(rows), 7
    shards = [n // k + (i < n % k) for i in range(k)]
    for matrix in (by_tree(rows, shards, seed), row_by_row(rows, shards, rng)):
        assert (matrix >= 0).all() and matrix.sum(1).tolist() == rows and matrix.sum(0).tolist() == shards


def test_matrix_has_the_distribution_of_one_drawn_row_by_row():
    rows, shards, n = [5, 0, 9, 3, 7], [8, 8, 8], 4000
    rng = np.random.default_rng(1)
    one = np.array([by_tree(rows, shards, seed) for seed in range(n)])
    other = np.array([row_by_row(rows, shards, rng) for _ in range(n)])
    mean = np.outer(rows, shards) / sum(rows)
    assert np.abs(one.mean(0) - mean).max() < 0.1 and np.abs(other.mean(0) - mean).max() < 0.1
    assert np.abs(one.var(0) - other.var(0)).max() < 0.15
    cov = lambda m: np.cov(m.reshape(n, -1).T)
    assert np.abs(cov(one) - cov(other)).max() < 0.15


def test_a_task_derives_its_row_of_a_large_matrix():
    rows = np.random.default_rng(0).integers(0, 10**6, 800_000)
    upto = np.cumsum([0, *rows.tolist()])
    sizes = np.array([int(upto[-1]) // 24 + (i < int(upto[-1]) % 24) for i in range(24)])
    row = sharding.matrix_row(upto, sizes, 3, 654_321)
    assert row.sum() == rows[654_321] and (np.abs(row - row.mean()) < 8 * np.sqrt(row.mean())).all()


@pytest.mark.parametrize("size", [1000, 64_000_000])
def test_no_task_receives_much(spark, monkeypatch, size):
    monkeypatch.setattr(sharding, "PART_BYTES", size)
    out = sharding.shard(spark.range(20_000).repartition(3), 2)
    tasks = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == 20_000 and max(tasks) < 1.3 * 20_000 / len(tasks)
    assert len(tasks) == 4 if size > 10**6 else len(tasks) > 40


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards(spark, shards):
    rows = nasty_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sharding.shard(df, shards)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(shards))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_every_shard_is_as_likely(spark):
    df = spark.range(4000).repartition(6)
    got = sharding.shard(df, 4, seed=3).collect()
    pairs = Counter((r["id"] // 1000, r["shard"]) for r in got)
    assert all(abs(n - 250) < 5 * np.sqrt(250 * 0.75) for n in pairs.values())
    slots = np.corrcoef([r["id"] for r in got], [r["slot"] for r in got])[0, 1]
    assert abs(slots) < 0.1


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.shard(df, 3).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([(1, 2)], "id long, Slot long"), 3)
