"""SimHash near-duplicates, searched with a pigeonring filter.

A fingerprint is cut into m segments on a ring. If two fingerprints differ in at most
t bits, some segment starts a chain on the ring of which every prefix of l segments
differs in at most l*t/m bits (rounded down). Fingerprints are filed, for every start,
under the first segments of the chain, as they are and, where the budget allows, with
bits flipped; those that meet there must hold the budgets of all longer prefixes
before the whole distance is counted.

Texts of one fingerprint are one row in the search. Of the links within a bucket those
of a minimum spanning forest (by distance) are passed on, so a bucket never gives more
links than it has members, what any links join stays joined, and the closest do it. A
bucket with over ``BUCKET`` members is divided by the chain's next segment, again with
the flips that the budget allows, until it is small or a further division would take
over ``FLIPS`` flips; what is left then is compared in blocks of bounded memory.

Defined results: null and empty texts have the fingerprint zero, which links like any
other; a very long text's shingles are hashed whole, some at a time; a component of rows
without any id has no id; rows that tie, or share an id, share their part; repeated rows
are one; an empty table gives an empty result. Other columns are carried by
``deduplicate``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.llm import shingles
from chunkwise.llm._common import ship, staged
from chunkwise.llm.components import components

BITS = 64
#: Members of a bucket that are compared in one task.
BUCKET = 4096
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 100_000
#: A bucket is divided by one more segment if that takes no more flips.
FLIPS = 128
#: Pairs compared at once.
PAIRS_AT_ONCE = 400_000
#: Bytes of a text's sketch; how far below the wanted similarity a pair's sketches may be (some six standard errors); pairs of sketches compared at once.
SKETCH, DOUBT, SKETCHES_AT_ONCE = 256, 0.15, 20_000


def shingle_digests(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of all runs of k words; of the whole sequence where there are fewer."""
    words = text.lower().split()  # bytes: folds A-Z only and splits at 0x20 and 0x09-0x0D only
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)]


def fingerprints(digests: list[int] | np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each text, whose digests stand one after the other, the bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(np.array(sizes)[full])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = np.array(digests, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros((len(full), BITS), np.int64)
    for at in range(0, len(hashes), COUNT_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + COUNT_AT_ONCE], axis=1)
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(bits), "left")
        cuts = np.maximum(starts[lo:hi] - at, 0)
        counts[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    out[full] = np.packbits(counts * 2 > (ends - starts)[:, None], axis=1).view(">u8").ravel()
    return out


def _prints(texts: pa.Array, k: int) -> pa.Array:
    """Fingerprints of texts as signed longs."""
    done: list[np.ndarray] = []
    digests: list[int] = []
    sizes: list[int] = []
    for text in texts:
        found = shingle_digests((text.as_py() or "").encode(), k)
        digests += found
        sizes.append(len(found))
        if len(digests) > COUNT_AT_ONCE:
            done.append(fingerprints(digests, sizes))
            digests, sizes = [], []
    done.append(fingerprints(digests, sizes))
    return pa.array(np.concatenate(done).view(np.int64))


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Rows (id, fp): every row's fingerprint as a signed long."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _prints(batch.column(1), k)], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


@dataclass(frozen=True)
class Ring:
    """Segments of a fingerprint, and what their chains may differ in."""

    distance: int
    segments: int

    def cut(self, i: int) -> tuple[int, int]:
        """Lowest bit and width of segment i."""
        lo, hi = BITS * i // self.segments, BITS * (i + 1) // self.segments
        return lo, hi - lo

    def mask(self, start: int, length: int) -> int:
        """The bits of a chain."""
        out = 0
        for j in range(length):
            lo, width = self.cut((start + j) % self.segments)
            out |= ((1 << width) - 1) << lo
        return out

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def flips(self, start: int, length: int) -> list[int]:
        """All differences that a chain of this length may have: each prefix keeps its budget."""
        out = [(0, 0)]
        for j in range(length):
            lo, width = self.cut((start + j) % self.segments)
            most = self.budget(j + 1)
            out = [(d | sum(1 << lo + b for b in bits), n + r) for d, n in out for r in range(min(most - n, width) + 1) for bits in combinations(range(width), r)]
        return [d for d, _ in out]

    def divides(self, length: int) -> bool:
        """Whether chains may be filed under one more segment."""
        if length + 1 >= self.segments:
            return False
        return len(self.flips(0, length)) <= FLIPS and len(self.flips(0, length + 1)) <= FLIPS


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _filed(fps: DataFrame, ring: Ring, length: int) -> DataFrame:
    """Rows (start, key, fp, home): every fingerprint under its own chains and, not at home, under those it may meet."""
    rows = []
    for s in range(ring.segments):
        own = F.col("fp").bitwiseAND(F.lit(signed(ring.mask(s, length))))
        flips = [signed(d) for d in ring.flips(s, length)]
        rows += [F.struct(F.lit(s).alias("start"), own.bitwiseXOR(F.lit(d)).alias("key"), F.lit(d == 0).alias("home")) for d in flips]
    rest = [c for c in fps.columns if c != "fp"]
    return fps.select("fp", *rest, F.explode(F.array(*rows)).alias("x")).select("x.start", "x.key", "fp", "x.home", *rest)


def _linked(fp: np.ndarray, home: np.ndarray, start: int, ring: Ring, length: int, equal: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs (of rows at home, of all) that the ring and then the whole distance let through; ``equal``: and of equal fingerprints."""
    at_home = np.flatnonzero(home)
    step = max(1, PAIRS_AT_ONCE // max(1, len(at_home)))
    for at in range(0, len(fp), step):
        part = fp[at : at + step]
        x = (fp[at_home][:, None] ^ part[None, :]).ravel()
        left = np.arange(len(x)) if equal else np.flatnonzero(x)
        for n in range(length + 1, ring.segments):
            if not len(left):
                break
            left = left[np.bitwise_count(x[left] & np.uint64(ring.mask(start, n))) <= ring.budget(n)]
        left = left[np.bitwise_count(x[left]) <= ring.distance]
        if len(left):
            yield at_home[left // len(part)], at + left % len(part)


def joining(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which links make a minimum spanning forest, by Boruvka's steps: each part takes its least link until none is left."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    part = np.arange(len(nodes))
    order = np.argsort(distance, kind="stable")  # a link's rank: no two are alike
    taken = np.zeros(len(x), bool)
    while True:
        order = order[part[a[order]] != part[b[order]]]
        if not len(order):
            return np.flatnonzero(taken)
        both = np.concatenate([part[a[order]], part[b[order]]])
        rank = np.concatenate([np.arange(len(order))] * 2)
        least = np.full(len(nodes), len(order))
        np.minimum.at(least, both, rank)
        best = order[np.unique(least[np.unique(both)])]
        taken[best] = True
        # parts that took a link to each other become one: hook larger numbers to smaller ones until nothing moves
        for u, v in zip(*(part[e[best]].tolist() for e in (a, b)), strict=True):
            u, v = _root(part, u), _root(part, v)
            part[max(u, v)] = min(u, v)
        while (up := part[part]).tolist() != part.tolist():
            part = up


def _root(part: np.ndarray, x: int) -> int:
    while part[x] != x:
        x = part[x]
    return int(x)


def _closest(start: int, ring: Ring, length: int, fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Of the fingerprints within the distance the closest links that join all parts that any links join."""
    x = y = np.zeros(0, np.uint64)
    for a, b in _linked(fp, home, start, ring, length):
        x, y = np.concatenate([x, fp[a]]), np.concatenate([y, fp[b]])
        keep = joining(x, y, np.bitwise_count(x ^ y))
        x, y = x[keep], y[keep]  # few more links than members
    return list(zip(x.tolist(), y.tolist(), strict=True))


def _likest(start: int, ring: Ring, length: int, similarity: float, fp: np.ndarray, home: np.ndarray, part: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Of the nodes within the distance and of different parts the likest links that join all parts that any links join."""
    sketches = np.frombuffer(b"".join(sketch.tolist()), np.uint8).reshape(len(sketch), SKETCH)
    node = node.view(np.uint64)
    links = [np.zeros(0, np.int64)] * 2
    apart = np.zeros(0, np.int64)
    for a, b in _linked(fp, home, start, ring, length, equal=True):
        fit = (part[a] != part[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[fit], b[fit]
        for at in range(0, len(a), SKETCHES_AT_ONCE):
            p, q = a[at : at + SKETCHES_AT_ONCE], b[at : at + SKETCHES_AT_ONCE]
            differ = (sketches[p] != sketches[q]).sum(1)
            may = differ <= SKETCH * (1 - similarity + DOUBT)
            links = [np.concatenate([old, new[may]]) for old, new in zip(links, (p, q), strict=True)]
            apart = np.concatenate([apart, differ[may]])
            keep = joining(part[links[0]], part[links[1]], apart)
            links, apart = [x[keep] for x in links], apart[keep]
    return list(zip(*(node[x].tolist() for x in links), strict=True))


def _search(filed: DataFrame, ring: Ring, length: int, within: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """Rows (a, b, start): the links ``within`` finds in a bucket; and, with b null, members of buckets that must be divided."""
    last, names = not ring.divides(length), filed.columns[4:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int | None, int]] = []

        def bucket(start: int, fp: np.ndarray, home: np.ndarray, *rest: np.ndarray) -> None:
            if len(fp) > BUCKET and not last:
                out.extend((x, None, start) for x in fp.tolist())
            elif home.any():
                out.extend((a, b, start) for a, b in within(start, ring, length, fp=fp, home=home, **dict(zip(names, rest, strict=True))))

        held: list[tuple[np.ndarray, ...]] = []  # rows of the bucket that goes on
        over: tuple[int, int] | None = None  # a bucket whose rows go on as they come, as it must be divided
        for batch in batches:
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            if over:
                same = int(((cols[0] == over[0]) & (cols[1] == over[1])).sum())  # sorted, so they stand first
                out.extend((x, None, over[0]) for x in cols[2][:same].view(np.uint64).tolist())
                cols = tuple(c[same:] for c in cols)
            if held:
                cols = tuple(np.concatenate(x) for x in zip(*held, cols, strict=True))
                held = []
            start, key, fp, home, *rest = cols
            if len(key):
                over = None
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1
                at = np.concatenate([[0], cuts, [len(key)]])
                sizes = np.diff(at)[:-1]
                for i in np.flatnonzero(sizes > 1).tolist():
                    s = slice(at[i], at[i + 1])
                    bucket(int(start[s.start]), fp[s].view(np.uint64), home[s], *(c[s] for c in rest))
                if len(key) - at[-2] > BUCKET and not last:
                    over = int(start[-1]), int(key[-1])
                    out.extend((x, None, over[0]) for x in fp[at[-2] :].view(np.uint64).tolist())
                else:
                    held = [tuple(c[at[-2] :] for c in cols)]
            yield _rows(out)
            out.clear()
        if held:
            start, _, fp, home, *rest = held[0]
            bucket(int(start[0]), fp.view(np.uint64), home, *rest)
        yield _rows(out)

    near = filed.repartition("start", "key").sortWithinPartitions("start", "key", "fp")
    return near.mapInArrow(work, "a long, b long, start int")


def _rows(rows: list[tuple[int, int | None, int]]) -> pa.RecordBatch:
    a, b, start = zip(*rows, strict=True) if rows else ((), (), ())
    long = lambda x: pa.array(x, pa.uint64()).view(pa.int64())
    return pa.RecordBatch.from_arrays([long(a), long(b), pa.array(start, pa.int32())], names=["a", "b", "start"])


def links(fps: DataFrame, distance: int = 2, segments: int = 5, length: int = 2, within: Callable[..., list[tuple[int, int]]] = _closest) -> DataFrame:
    """Rows (a, b) of the distinct fingerprints ``fp`` that join all that lie within ``distance``.

    ``segments`` of the ring, of which the first ``length`` of a chain are the bucket's key;
    ``within`` finds the links of a bucket, from all columns that ``fps`` has.
    """
    ship(fps.sparkSession)
    ring = Ring(distance, segments)
    filed, out = _filed(fps, ring, length), None
    while True:
        found = staged(_search(filed, ring, length, within), "buckets")
        joined = found.where("b IS NOT NULL").select("a", "b")
        out = joined if out is None else out.unionAll(joined)
        rest = found.where("b IS NULL")
        if not ring.divides(length) or rest.isEmpty():
            return out
        length += 1
        members = rest.select(F.col("a").alias("fp"), "start").distinct()
        members = members.join(fps, "fp") if len(fps.columns) > 1 else members
        filed = _filed_from(members, ring, length)


def _filed_from(members: DataFrame, ring: Ring, length: int) -> DataFrame:
    """Like ``_filed`` for the chains that begin at the members' own starts."""
    out, rest = None, [c for c in members.columns if c not in ("fp", "start")]
    for s in range(ring.segments):
        own = F.col("fp").bitwiseAND(F.lit(signed(ring.mask(s, length))))
        flips = F.array(*[F.lit(signed(d)) for d in ring.flips(s, length)])
        filed = members.where(F.col("start") == s).select("start", "fp", *rest, F.explode(flips).alias("d"))
        filed = filed.select("start", own.bitwiseXOR(F.col("d")).alias("key"), "fp", (F.col("d") == 0).alias("home"), *rest)
        out = filed if out is None else out.unionAll(filed)
    return out


def clustered(printed: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (id, fp, component): the least id that each row of ``printed`` (id, fp) reaches over ``joined`` (a, b)."""
    least = printed.groupBy("fp").agg(F.min("id").alias("least"))
    reach = components(joined).withColumnRenamed("node", "fp")
    linked = reach.join(least, "fp")
    # both are written, so that the joins with them are of two plain shuffles, which Spark splits where a key has many rows
    best = staged(linked.groupBy("root").agg(F.min("least").alias("best")), "best")
    reached = reach.join(best, "root").select("fp", "best")
    whole = staged(least.join(reached, "fp", "left").select("fp", F.coalesce("best", "least").alias("component")), "parts")
    return printed.join(whole, "fp").select("id", "fp", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2, segments: int = 5, length: int = 2) -> DataFrame:
    """Rows (id, fp, component), one for each row of ``df``."""
    printed = staged(fingerprinted(df, id_col, text_col, k), "fingerprints")
    joined = links(printed.select("fp").distinct(), distance, segments, length)
    return clustered(printed, joined)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text a digest of its set of word k-shingles (of its words as they are, where it has none), the set, and that of its words."""
    for block in shingles.blocks(texts, k):
        for i, (a, b) in enumerate(pairwise(block.at.tolist())):
            found = np.unique(block.hashes[a:b])
            if len(found):
                node = xxhash.xxh64_intdigest(found.tobytes(), 42)
            else:
                words = (texts[block.first + i].as_py() or "").lower().split()
                node = xxhash.xxh64_intdigest(" ".join(words).encode(), 43)
            yield node, found, np.unique(block.words[block.word_at[i] : block.word_at[i + 1]])


def described(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (id, doc, fp, node, size): a key of id and text, the fingerprint of the distinct words that shingles are made of, and the k-shingle set's digest and size."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("doc", "fp", "node", "size"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, words, prints, held = [], [], [], [], 0
            for node, found, own in _sets(batch.column(2), k):
                nodes.append(node)
                sizes.append(len(found))
                words.append(own)
                held += len(own)
                if held > COUNT_AT_ONCE:
                    prints.append(fingerprints(np.concatenate(words), [*map(len, words)]))
                    words, held = [], 0
            prints.append(fingerprints(np.concatenate(words or [np.zeros(0, np.uint64)]), [*map(len, words)]))
            cols = [batch.column(0), batch.column(1), pa.array(np.concatenate(prints).view(np.int64)), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def _texts(df: DataFrame, printed: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, text) of the ``wanted`` nodes, one text each."""
    least = printed.groupBy("node").agg(F.min("doc").alias("doc")).join(wanted, "node")
    return df.select(F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).join(least, "doc").select("node", "text")


def similar(df: DataFrame, joined: DataFrame, printed: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """The links (a, b) of nodes whose sets of word k-shingles have a Jaccard similarity of at least ``similarity``."""
    wanted = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [found.tobytes() for _, found, _ in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both > 0 and both >= similarity * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = _texts(df, printed, wanted, id_col, text_col)
    shingled = staged(texts.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    pairs = joined.join(shingled.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(shingled.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """Rows (node, sketch) of (node, text): a byte each of ``SKETCH`` least shingles, of which as many agree as the sets are alike."""
    factors = np.random.default_rng(77).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, found, _ in _sets(batch.column(1), k):
                least = np.zeros(SKETCH, np.uint64)
                for at in range(0, len(found), COUNT_AT_ONCE // SKETCH):
                    part = (shingles.mix(found[at : at + COUNT_AT_ONCE // SKETCH])[:, None] * factors).min(0)
                    least = np.minimum(least, part) if at else part
                out.append((shingles.mix(least) & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "sketch"])

    return texts.mapInArrow(work, "node long, sketch binary").dropDuplicates(["node"])


def _parted(nodes: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``nodes`` with ``part``, which nodes have in common that the links ``good`` join."""
    reach = components(good).withColumnRenamed("root", "part")
    return staged(nodes.join(reach, "node", "left").withColumn("part", F.coalesce("part", "node")), "nodes")


def _open(parted: DataFrame) -> DataFrame:
    """Rows (fp, part, node, size) of the nodes that linked fingerprints (of one ``root``), or one, have of several parts."""
    roots = parted.groupBy("root").agg(F.min("part").alias("l"), F.max("part").alias("h")).where("l != h").select("root")
    return parted.join(staged(roots, "roots"), "root").select("fp", "part", "node", "size")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, distance: int = 7, segments: int = 8, length: int = 2) -> DataFrame:
    """One row of each group of near copies (the one with the least id), with all its columns.

    Copies are texts within ``distance`` bits, those of one fingerprint included, whose
    word k-shingles prove to have a Jaccard similarity of at least ``similarity``. The
    fingerprints are of distinct words: one changed word changes k shingles, but one
    word, which keeps near copies' fingerprints close enough for a selective search.

    Texts with one set of shingles are one node. A fingerprint's nodes are first held
    against its least one, and the least ones of linked fingerprints against each other
    over a forest of the closest links. Where that leaves linked fingerprints in several
    parts, their nodes are searched again, now with sketches of their shingles: of each
    bucket the likest links that join its parts are verified (of all links that may be
    good enough, these join what any of them join), round by round until no round joins
    any parts. So no copy is lost to a link that failed, no text goes unverified, and a
    bucket never gives more links than it has members.
    """
    held = [f"_c{i}" for i in range(len(df.columns))]
    names = dict(zip(df.columns, held, strict=True))
    plain, own = df.toDF(*held), (names[id_col], names[text_col])
    printed = staged(described(plain, *own, k), "fingerprints")
    joined = staged(links(printed.select("fp").distinct(), distance, segments, length).distinct(), "joined")
    nodes = staged(printed.select("fp", "node", "size").distinct(), "nodes")
    first = staged(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    one, other = (first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in "ab")
    across = joined.join(one, "a").join(other, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    star = nodes.join(first.where("n > 1"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))

    def check(found: DataFrame) -> DataFrame:
        pairs = found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return staged(similar(plain, staged(pairs, "pairs"), printed, *own, k, similarity), "good")

    good = check(across.unionAll(star))
    roots = components(joined).withColumnRenamed("node", "fp")
    nodes = staged(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "nodes")
    sketches = None
    while True:
        opened = _open(_parted(nodes, good))
        if sketches is None:  # nodes that are all of one part stay so
            opened = staged(opened, "open")
            sketches = staged(sketched(_texts(plain, printed, opened.select("node").distinct(), *own), k), "sketches")
        found = check(links(staged(opened.join(sketches, "node").select("fp", "part", "node", "size", "sketch"), "open"), distance, segments, length, partial(_likest, similarity=similarity)))
        if found.isEmpty():
            break
        good = good.unionAll(found)
    gone = clustered(printed.select("id", F.col("node").alias("fp")), good).where("NOT (id <=> component)").select(F.col("id").alias("_gone")).distinct()
    return plain.join(gone, plain[names[id_col]] == gone["_gone"], "left_anti").toDF(*df.columns)
