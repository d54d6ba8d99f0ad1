"""Exact token counts from a histogram of encoded lengths.

Documents are encoded where they are read, once, and leave as (length, documents)
counts, so what is shuffled is one row per length and task. The histogram is written to
the shared folder: everything else is read from it. Suffix sums over it then answer, for
every context limit at once, how many documents reach it, how many tokens remain when
longer documents are cut there, and which share of documents fits.

The suffix sums are taken in two steps, within blocks of lengths and over the blocks'
totals, so no task sees more than one block of lengths or the list of blocks.

Defined results: a null text counts as empty, of length 0; a very long text is encoded
whole and is one more length; documents of equal length are one row, and repeated rows
count each time; an empty table gives an empty histogram, and a report of no rows but
the limits', with zeros; other columns, whatever they are called, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.llm._common import ship, staged
from chunkwise.llm.tokens import TokenizerFile, encoder

#: Lengths in one block.
BLOCK = 256
#: What the report answers: context limits and shares of documents.
LIMITS = tuple(1 << i for i in range(7, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def histogram(df: DataFrame, tokenizer: TokenizerFile, text_col: str = "text") -> DataFrame:
    """Rows (length, docs): how many documents have so many token ids."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            lengths = np.array([len(encode(text.as_py() or "")) for text in batch.column(0)], dtype=np.int64)
            found, docs = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(docs.astype(np.int64))], names=["length", "docs"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(count, "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with sums over it.

    Adds ``tokens`` (of documents of this length), ``docs_from`` and ``tokens_from``
    (documents at least this long and their tokens), ``total_docs`` and
    ``total_tokens``, and ``truncated_tokens``: all tokens when documents are cut to
    this length.
    """
    hist = staged(hist, "lengths")  # read twice below, but made once
    hist = hist.withColumns({"tokens": F.col("length") * F.col("docs"), "_block": F.floor(F.col("length") / BLOCK)})
    blocks = hist.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    # one row per block of lengths: as many as the longest document has blocks
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(everything).alias("total_docs"),
        F.sum("_tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "_block").withColumns(
        {"docs_from": F.sum("docs").over(within) + F.col("_docs_after"), "tokens_from": F.sum("tokens").over(within) + F.col("_tokens_after")}
    )
    return out.select(
        "length", "docs", "tokens", "docs_from", "tokens_from", "total_docs", "total_tokens",
        truncated(F.col("total_tokens"), F.col("tokens_from"), F.col("docs_from"), F.col("length")).alias("truncated_tokens"),
    )


def truncated(total: Column, tokens_from: Column, docs_from: Column, limit: Column) -> Column:
    """Tokens left when the documents counted in ``docs_from`` are cut to ``limit``."""
    return total - tokens_from + limit * docs_from


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The suffix sums' columns for any context limits, whether or not a document has that length.

    ``docs_from`` and ``tokens_from`` of a limit are those of the shortest length that reaches it."""
    reach = [F.min_by(F.struct("length", "docs", "tokens", "docs_from", "tokens_from"), F.when(F.col("length") >= limit, F.col("length"))).alias(f"_{i}") for i, limit in enumerate(limits)]
    one = sums.groupBy().agg(F.first("total_docs").alias("_docs"), F.first("total_tokens").alias("_tokens"), *reach)
    rows = [F.struct(F.lit(limit).cast("long").alias("limit"), F.col(f"_{i}").alias("next")) for i, limit in enumerate(limits)]
    known = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    here = lambda c: F.when(F.col("next.length") == F.col("limit"), F.col(c)).otherwise(0).cast("long")
    out = one.select(known("_docs").alias("total_docs"), known("_tokens").alias("total_tokens"), F.inline(F.array(*rows)))
    out = out.select(F.col("limit").alias("length"), here("next.docs").alias("docs"), here("next.tokens").alias("tokens"), known("next.docs_from").alias("docs_from"), known("next.tokens_from").alias("tokens_from"), "total_docs", "total_tokens")
    return out.withColumn("truncated_tokens", truncated(F.col("total_tokens"), F.col("tokens_from"), F.col("docs_from"), F.col("length")))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The suffix sums' rows of quantiles, with ``share``: the least length that at least this share of documents doesn't exceed."""
    upto = F.col("total_docs") - F.col("docs_from") + F.col("docs")
    row = F.struct(*sums.columns)
    cols = [F.min_by(row, F.when(upto >= F.ceil(F.lit(share) * F.col("total_docs")), F.col("length"))).alias(f"_{i}") for i, share in enumerate(shares)]
    rows = [F.struct(F.lit(float(share)).alias("share"), F.col(f"_{i}").alias("row")) for i, share in enumerate(shares)]
    found = sums.groupBy().agg(*cols).select(F.inline(F.array(*rows)))
    return found.where("row IS NOT NULL").select("share", "row.*")


def report(hist: DataFrame, limits: Sequence[int] = LIMITS, shares: Sequence[float] = SHARES) -> DataFrame:
    """Rows (kind, share, and the suffix sums' columns): kind "length" for every length there is, "limit" for each
    context limit, "quantile" for each share of the documents."""
    sums = staged(suffix_sums(hist), "sums")  # a row for each length
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), (F.col("share") if "share" in df.columns else F.lit(None).cast("double")).alias("share"), *sums.columns)
    return part(sums, "length").unionAll(part(at_limits(sums, limits), "limit")).unionAll(part(quantiles(sums, shares), "quantile"))
