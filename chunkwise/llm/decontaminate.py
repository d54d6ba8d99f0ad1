"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of a leaked item
and a whole document is close to zero whatever leaked. Items are therefore
partitioned by their number of shingles, and for the items of each size class (up to
c shingles) documents are searched as passages of 2c shingles that begin every c
shingles: a run of c shingles lies whole in one of them. An item with at least the
threshold's share of its shingles in a passage then has a Jaccard similarity to it of
about 0.19 or more, whatever its place in the class, and shares at least one of
``HASHES`` minima with it but for a chance of about one in a million. Items of fewer
than ``LEAST`` shingles have no useful minima; all their shingles are looked up.

Every document that shares a minimum with an item is verified: the share of the
item's distinct shingles that stand anywhere in the whole document, first by 64-bit
hashes, and where these say enough by the shingles' words themselves.

The items are the stated query set. They are sent to the executors in blocks of
bounded size (``BLOCK_CHARS``), one pass over the documents for each block, so the
documents are never shuffled and any number of items can be searched. Where there are
several blocks, what each finds is written to the shared folder, and the block is taken
back from the executors before the next one is sent; ``remove`` then drops the texts
that were found by their digests.

Defined results: null and empty documents and items contain nothing; an item of fewer
words than a shingle is found in documents whose text is just these words; a very long
document is searched whole, one in a task at a time; a share of just the threshold
counts; repeated documents are reported each; copies of an item are reported by their
own ids; empty tables give empty results; ``remove`` carries all columns, whatever they
are called, ``find`` none but the ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.llm import shingles
from chunkwise.llm._common import ship, staged

#: Characters of items sent to the executors at a time.
BLOCK_CHARS = 16_000_000
#: Minima of a signature.
HASHES = 64
#: Items of fewer shingles are looked up shingle by shingle.
LEAST = 8

_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@dataclass
class Items:
    """Test items prepared for the search."""

    ids: list
    sets: list[np.ndarray]  # distinct shingles, sorted
    texts: list[str] = field(default_factory=list)
    #: For each size class, and each of its hashes, the sorted minima and whose they are.
    classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    #: Shingles of the smallest items, sorted, and whose they are.
    tiny: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def prepare(ids: list, texts: list[str | None], k: int) -> Items:
    items = Items([], [])
    for block in shingles.blocks(pa.array(texts, pa.large_string()), k):
        for i in range(block.texts):
            if block.at[i] < block.at[i + 1]:
                items.ids.append(ids[block.first + i])
                items.texts.append(texts[block.first + i])
                items.sets.append(np.unique(block.hashes[block.at[i] : block.at[i + 1]]))
    by_class: dict[int, list[int]] = {}
    for n, shingle_set in enumerate(items.sets):
        size = len(shingle_set)
        by_class.setdefault(0 if size < LEAST else 1 << (size - 1).bit_length(), []).append(n)
    if tiny := by_class.pop(0, []):
        items.tiny = _sorted(np.concatenate([items.sets[n] for n in tiny]), np.repeat(tiny, [len(items.sets[n]) for n in tiny]))
    for c, members in by_class.items():
        items.classes[c] = [
            _sorted(np.array([(items.sets[n] * a + b).min() for n in members], np.uint64), np.array(members)) for a, b in zip(FACTORS, SHIFTS, strict=True)
        ]
    return items


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _matches(keys: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position in keys, value) of all equal keys in the index."""
    lo, hi = np.searchsorted(index[0], keys, "left"), np.searchsorted(index[0], keys, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return hit, hit
    n = hi[hit] - lo[hit]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(hit, n), index[1][np.repeat(lo[hit], n) + inner]


def candidates(block: shingles.Block, items: Items) -> np.ndarray:
    """Distinct (text, item) rows that share a minimum, or a shingle for the smallest items."""
    found: list[np.ndarray] = []
    sizes = np.diff(block.at)
    full = np.flatnonzero(sizes)  # texts with shingles
    if not len(full):
        return np.zeros((0, 2), np.int64)
    if len(items.tiny[0]):
        text_of = np.repeat(np.arange(block.texts), sizes)
        pos, item = _matches(block.hashes, items.tiny)
        found.append(np.stack([text_of[pos], item], 1))
    plans = []
    for c in items.classes:
        # cut each text into runs of c shingles; a passage is two neighbouring runs
        runs = -(-sizes[full] // c)
        text = np.repeat(full, runs)
        number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        plans.append((c, block.at[text] + number * c, text, text[1:] == text[:-1]))
    for h in range(HASHES if plans else 0):
        values = block.hashes * FACTORS[h] + SHIFTS[h]
        for c, start, text, same in plans:
            least = np.minimum.reduceat(values, start)
            passage = least.copy()
            passage[:-1] = np.where(same, np.minimum(least[:-1], least[1:]), least[:-1])
            pos, item = _matches(passage, items.classes[c][h])
            if len(pos):
                found.append(np.stack([text[pos], item], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def words_of(text: str) -> list[bytes]:
    """The words that shingles are made of."""
    return _WORDS.findall(pc.utf8_lower(pa.scalar(text, pa.large_string())).as_py().encode())


_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")


def exact_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def verified(block: shingles.Block, items: Items, threshold: float, texts: pa.Array, k: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) where the whole text holds the threshold's share of the item."""
    last, have, own = -1, np.zeros(0, np.uint64), None
    for text, item in candidates(block, items).tolist():
        if text != last:
            last, have, own = text, np.unique(block.hashes[block.at[text] : block.at[text + 1]]), None
        want = items.sets[item]
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        if int((have[at] == want).sum()) >= threshold * len(want):
            own = exact_shingles(texts[block.first + text].as_py(), k) if own is None else own
            wanted = exact_shingles(items.texts[item], k)
            shared = len(own & wanted)
            if shared >= threshold * len(wanted):
                yield block.first + text, item, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list, bool]]:
    """All items, a bounded block at a time; and whether there is one block only."""
    size = items.select(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_CHARS) or 1
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for i in range(n):
        rows = (own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)).collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows], n == 1


def _search(k: int, threshold: float, shared) -> Callable[[pa.Array], list[tuple[int, int, int]]]:
    def search(texts: pa.Array) -> list[tuple[int, int, int]]:
        return [hit for block in shingles.blocks(texts, k) for hit in verified(block, shared.value, threshold, texts, k)]

    return search


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (id, item, containment, shared, shingles) of the documents that hold test items."""
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("item", items.schema[item_id].dataType),
            T.StructField("containment", T.DoubleType()),
            T.StructField("shared", T.LongType()),
            T.StructField("shingles", T.LongType()),
        ]
    )
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts, alone in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(ids, texts, k))
        search = _search(k, threshold, shared)

        def found(batches: Iterator[pa.RecordBatch], search=search, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = search(batch.column(1))
                n = [len(shared.value.sets[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([t for t, _, _ in hits], pa.int64())),
                        pa.array([shared.value.ids[i] for _, i, _ in hits], pa_type),
                        pa.array([s / m for (_, _, s), m in zip(hits, n, strict=True)], pa.float64()),
                        pa.array([s for _, _, s in hits], pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    names=schema.names,
                )

        pa_type = _arrow(schema["item"].dataType)
        hits = own.mapInArrow(found, schema)
        if not alone:
            hits = staged(hits, "hits")
            shared.destroy()
        out = out.unionAll(hits)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    ship(docs.sparkSession)
    held = [f"_c{i}" for i in range(len(docs.columns))]
    text_at = docs.columns.index(text_col)
    plain = docs.toDF(*held)
    digest = F.sha2(F.col(held[text_at]), 256)
    gone = None
    for ids, texts, alone in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(prepare(ids, texts, k))
        search = _search(k, threshold, shared)

        def clean(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[t for t, _, _ in search(batch.column(text_at))]] = False
                yield batch.filter(pa.array(stays))

        def leaked(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([0]).take(pa.array(sorted({t for t, _, _ in search(batch.column(1))}), pa.int64()))

        if alone:
            return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
        hits = staged(plain.select(digest.alias("_digest"), held[text_at]).mapInArrow(leaked, "_digest string"), "leaks")
        shared.destroy()
        gone = hits if gone is None else gone.unionAll(hits)
    if gone is None:
        return docs
    return plain.join(gone.distinct(), digest == F.col("_digest"), "left_anti").toDF(*docs.columns)
