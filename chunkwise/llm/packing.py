"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups.

Every document becomes its token ids and one end id, cut into pieces of at most
``capacity`` ids. Pieces are dealt to partitions by a hash, and each partition packs
its pieces in groups of at most ``GROUP`` pieces, so a task holds one group at a time
whatever the input. Within a group the pieces go, longest first, to the leftmost
sequence that has room; a tournament tree over the free room of all sequences finds
it in logarithmic time.

Defined results: a null text counts as empty and is one piece that holds the end id; a
very long text is encoded whole and cut into many pieces; repeated rows are packed once
each, and in one task where they agree in id and text (which holds one group of them at
a time); of pieces of equal length the first in order of hash, id and start is placed
first; an empty table gives an empty result; columns other than the id and the text are
left out, whatever they are called. Packing a task again gives the same sequences, as
pieces are sorted before they are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.llm._common import ship
from chunkwise.llm.tokens import TokenizerFile, encoder

#: Pieces packed together.
GROUP = 8192
#: Ids in one Arrow batch of pieces.
BATCH_IDS = 2_000_000


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the number of its sequence and its offset there."""
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())  # each is a sequence of its own
    where[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1 << max(0, len(rest) - 1).bit_length()
    room = [capacity] * (2 * leaves)  # room[i] is the most room below node i; the root is 1
    sizes = lengths.tolist()
    for i in rest:
        need, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        where[i], offset[i] = full + node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
    return where, offset


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: TokenizerFile, capacity: int, end_id: int) -> DataFrame:
    """Rows (id, start, length, ids, doc_tokens); ``ids`` are little-endian 32-bit integers."""
    ship(df.sparkSession)
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, start, length, ids, total, held = [], [], [], [], [], 0

            def flush(batch=batch, rows=rows, start=start, length=length, ids=ids, total=total):
                out = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
                for x in (rows, start, length, ids, total):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, names=schema.names)

            for i, text in enumerate(batch.column(1)):
                doc = np.concatenate([encode(text.as_py() or ""), end])
                for s in range(0, len(doc), capacity):
                    part = doc[s : s + capacity]
                    rows.append(i)
                    start.append(s)
                    length.append(len(part))
                    ids.append(part.tobytes())
                    total.append(len(doc))
                held += len(doc)
                if held > BATCH_IDS:
                    yield flush()
                    held = 0
            yield flush()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(df: DataFrame, tokenizer: TokenizerFile, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, seed: int = 0) -> DataFrame:
    """The pieces of all documents with their places.

    Rows (``id_col``, start, length, ids, doc_tokens, sequence_id, offset). Sequences
    are meant to be padded to ``capacity``.
    """
    cut = pieces(df, id_col, text_col, tokenizer, capacity, end_id)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held: list[pa.RecordBatch] = []

        def packed(group: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal first
            where, offset = first_fit_decreasing(group.column("length").to_numpy(), capacity)
            out = group.append_column("sequence_id", pa.array(where + first)).append_column("offset", pa.array(offset))
            first += int(where.max()) + 1
            yield from out.to_batches(max_chunksize=1024)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                if sum(b.num_rows for b in held) >= GROUP - 1023:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
        if sum(b.num_rows for b in held):
            yield from packed(pa.Table.from_batches(held))

    lot = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("start"), F.crc32("ids"))
    dealt = cut.repartition(lot).sortWithinPartitions(lot, "id", "start")
    return dealt.mapInArrow(place, schema).withColumnRenamed("id", id_col)
