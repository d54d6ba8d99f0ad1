"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. The first four return the rows
they keep, with the columns of ``documents``; the last returns the packed pieces.

Defined results, in every stage: a null text counts as empty, and all empty texts are
copies of one another; very long texts are judged whole; rows whose other columns are
null are rows like any other; of repeated rows one stays; of copies that tie on what
decides (the id) one stays; rows without an id stay unless their text goes; rows that
share an id but not a text are judged one by one, except among near copies, where they
stand or fall together; an empty table gives an empty result; columns beyond those of
``documents`` are carried up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwise.llm import decontaminate, exact_dedup, packing, simhash, tokens, toxicity
from chunkwise.llm._common import delete, release, staged_count, staged_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from their labels doesn't score as toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text (A-Z folded) the one with the largest id."""
    return exact_dedup.deduplicate(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id."""
    return simhash.deduplicate(docs, k=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 2048."""
    return packing.pack(docs, tokens.public_byte_bpe(), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", packed),
]

#: SQL can't express the model of the first stage, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result is the last one's."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        if stage is packed:
            return stage(spark, docs, sf_dir)  # reads the table before, which goes when the program ends
        path = staged_path(spark, f"pipeline-{name}")
        before = staged_count()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        release(spark, before)  # what this stage wrote for itself
        docs = spark.read.schema(out.schema).parquet(path)
        if held:
            delete(spark, held)
        held = path
    return docs
