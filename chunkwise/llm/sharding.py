"""Uniform sharding by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn first, exactly as a
uniform shuffle of all rows into shards of fixed sizes would have it: the matrix has the
multivariate hypergeometric distribution. Each partition then permutes its own rows
(which row gets which of its places), the rows are exchanged, and each shard permutes
what it received. The result is a uniform shuffle whose shard sizes are exact: no two
differ by more than one row.

The matrix is drawn as a binary tree over the sources. A node has the shards' places
that its sources fill; how they fall to its left and right half is drawn with a seed of
the node's own. So a task derives the rows of its own sources, by as many steps as the
tree is deep, and nobody holds the matrix: what is sent to the tasks is one number for
each source partition.

The input is written once to the shared folder together with each row's source
partition and place. The draws depend on these and the seed alone, so a lost executor
repeats its tasks with the same result, and however the written table is split again,
rows keep their shards. A shard is exchanged in sub-shards of about ``PART_BYTES``, each
a task of its own, and as many as the session has shuffle partitions at least; a row's
place in its shard is the sub-shard's first place plus its rank there. Contents play no
part, so no key, source or text can make a shard or a task large; copies of a text
(equal texts) are spread like any other rows.

Defined results: null and empty texts and rows with nulls are rows like any other; very
long texts are moved whole and count as one row; rows that tie in every column, and
repeated rows, each have their own place; an empty table gives an empty result; other
columns are carried, whatever they are called, but for ``shard`` and ``slot``, which are
refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwise.llm._common import fresh, partitions, ship, staged_path
from chunkwise.llm.shingles import mix

#: monotonically_increasing_id() has the place in the lower bits, the partition above.
PLACE_BITS = 33
#: Bytes of written rows that one task receives, about.
PART_BYTES = 64_000_000


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` without replacement are good; exact for counts of any size.

    Inverts the distribution function over 12 standard deviations about the mode; the
    ratios of neighbouring probabilities need no factorials.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = np.sqrt(max(0.0, draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))))
    reach = int(12 * spread) + 20
    first, last = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split(places: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each shard's places ``draws`` rows fill: multivariate hypergeometric."""
    out, rest = np.zeros(len(places), np.int64), int(places.sum())
    for j, n in enumerate(places.tolist()):
        rest -= n
        out[j] = hypergeometric(n, rest, draws, rng)
        draws -= int(out[j])
    return out


def matrix_row(upto: np.ndarray, shards: np.ndarray, seed: int, source: int) -> np.ndarray:
    """How many rows a source sends to each shard.

    ``upto``: rows before each source, and of all; ``shards``: the places of each shard."""
    if int(upto[-1]) != int(shards.sum()):
        raise ValueError("rows and places differ")
    lo, hi, places = 0, len(upto) - 1, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(places, int(upto[mid] - upto[lo]), np.random.default_rng([seed, 1, lo, hi]))
        lo, hi, places = (lo, mid, left) if source < mid else (mid, hi, places - left)
    return places


def local_shards(counts: np.ndarray, seed: int, source: int) -> np.ndarray:
    """The shard of each place of a source partition: its row of the matrix in random order."""
    labels = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return np.random.default_rng([seed, 2, source]).permutation(labels)


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (its place there, without gaps).

    Columns of these names in ``df`` are refused.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    if clash := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    spark = df.sparkSession
    ship(spark)
    at, to, part, first, rank = fresh(df, "_at", "_to", "_part", "_first", "_rank")
    source = F.shiftright(F.col(at), PLACE_BITS)
    path = staged_path(spark, "shard")
    numbered = df.withColumn(at, F.monotonically_increasing_id())
    numbered.write.parquet(path)
    held = spark.read.schema(numbered.schema).parquet(path)
    # one row for each source partition, of which the driver keeps a list while it writes them
    rows = {r["source"]: r["n"] for r in held.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sources, n = sorted(rows), sum(rows.values())
    sizes = np.array([n // shards + (i < n % shards) for i in range(shards)], np.int64)
    upto = np.cumsum([0, *(rows[s] for s in sources)])
    shared = spark.sparkContext.broadcast((np.array(sources, np.int64), upto))
    parts = max(1, -(-partitions(spark) // shards), -(-_bytes(spark, path) // (shards * PART_BYTES)))

    @F.arrow_udf("struct<shard:int,part:int,lot:long>")
    def place(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        sources, places = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
        found = np.zeros(len(at), np.int32)
        for s in np.unique(sources).tolist():
            mine = sources == s
            key = (id(shared), s)
            if _last.get("key") != key:
                known, upto = shared.value
                row = matrix_row(upto, sizes, seed, int(np.searchsorted(known, s)))
                _last.update(key=key, labels=local_shards(row, seed, s))
            found[mine] = _last["labels"][places[mine]]
        lot = mix(mix(at.astype(np.uint64) + np.uint64(seed)) + np.uint64(0x9E3779B97F4A7C15))
        cols = [pa.array(found), pa.array((lot % np.uint64(parts)).astype(np.int32)), pa.array((lot >> np.uint64(1)).astype(np.int64))]
        return pa.StructArray.from_arrays(cols, names=["shard", "part", "lot"])

    # one row for each task of the exchange below
    counts = held.select(place(F.col(at)).alias(to)).groupBy(F.col(f"{to}.shard").alias("shard"), F.col(f"{to}.part").alias(part)).agg(F.count(F.lit(1)).alias(rank))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", part, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(first))
    sent = held.withColumn(to, place(F.col(at))).withColumns({"shard": F.col(f"{to}.shard"), part: F.col(f"{to}.part")})
    # a sub-shard is a partition, so a sorted row's number in its partition is its rank
    ranked = sent.repartitionById(shards * parts, F.col("shard") * parts + F.col(part)).sortWithinPartitions(F.col(f"{to}.lot"), F.col(at))
    ranked = ranked.withColumn(rank, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    return ranked.join(F.broadcast(firsts), ["shard", part]).select(*(ranked[f"`{c}`"] for c in df.columns), "shard", (F.col(first) + F.col(rank)).alias("slot"))


#: The shards of the source partition that a worker saw last.
_last: dict = {}


def _bytes(spark: SparkSession, path: str) -> int:
    """Size of a written table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
