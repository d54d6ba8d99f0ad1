"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, an external sort puts equal
texts next to each other, and a window over each run of equal texts (Spark's window
closes a run by comparing the whole key of neighbouring rows) picks the row that
stays. Only DataFrame functions are used. Splitters are compared by a text's first
``PREFIX`` characters and, where texts begin alike, by a hash of the whole; so the
sample that the driver takes has rows of bounded size, and no common opening can
collect many texts in one range.

One text may hold any share of the rows. A first pass counts 64-bit hashes of the
texts; texts with more rows than an average partition (fewer than there are
partitions, so the list is bounded) are sorted by (text, salt), which lets the
splitters cut their run into many tasks. The salted pieces of such a text meet again
through a table of at most one row per hot text, keyed by SHA-256.

Defined results: a null text counts as empty; a very long text is compared whole, but
moved as a key once; a null id loses to every other id; of rows that tie on text and id,
or are repeated, exactly one stays; an empty table gives an empty result; other columns
are carried as they are, whatever they are called (``content_sort`` refuses columns
called like its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.llm._common import ascii_lower, fresh, partitions


#: Characters that splitters hold.
PREFIX = 32


def normalised(text: Column) -> Column:
    """A-Z folded to a-z, nothing else; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def hot_hashes(df: DataFrame, text: str) -> list[int]:
    """Hashes of the texts with more rows than an average partition holds."""
    counts = df.groupBy(F.xxhash64(normalised(F.col(text))).alias("h")).count()
    n = partitions(df.sparkSession)
    # a text with over total/n rows: at most n of them
    total = df.select(F.lit(1)).count()
    return [r["h"] for r in counts.where(F.col("count") > max(64, total // n)).select("h").collect()]


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``df`` with what its text's group decides.

    Adds ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` (of the normalised text). ``keep`` is "max" or "min": which id
    of equal texts stays. Columns of these names in ``df`` are refused.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be max or min, not {keep!r}")
    if clash := {"keep_id", "group_size", "kept", "text_sha256"} & {c.lower() for c in df.columns}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    spark = df.sparkSession
    key, opening, digest, salt, rank, n, best, hot_n, hot_best, sha = fresh(df, "_key", "_opening", "_digest", "_salt", "_rank", "_n", "_best", "_hot_n", "_hot_best", "_sha")
    pick = F.max if keep == "max" else F.min
    text, ids = normalised(F.col(text_col)), F.col(id_col)
    hot = hot_hashes(df, text_col)
    sort_key = [F.col(opening), F.col(digest)]
    out = df.withColumn(key, text).withColumns({opening: F.substring(key, 1, PREFIX), digest: F.xxhash64(key)})
    if hot:
        is_hot = F.xxhash64(text).isin(hot)
        out = out.withColumn(salt, F.when(F.col(digest).isin(hot), F.pmod(F.xxhash64(ids), F.lit(partitions(spark)))).otherwise(F.lit(-1).cast("long")))
        sort_key.append(F.col(salt))
    run = Window.partitionBy(*sort_key, F.col(key))
    order = ids.desc_nulls_last() if keep == "max" else ids.asc_nulls_last()
    # the window asks for no other exchange: a range partitioning keeps the rows of a key together
    out = (
        out.repartitionByRange(*sort_key)
        .withColumns({rank: F.row_number().over(run.orderBy(order)), n: F.count(F.lit(1)).over(run), best: pick(ids).over(run)})
        .withColumn("text_sha256", F.sha2(F.col(key), 256))
    )
    if hot:
        whole = df.where(is_hot).groupBy(F.sha2(text, 256).alias(sha)).agg(F.count(F.lit(1)).alias(hot_n), pick(ids).alias(hot_best))
        out = out.join(F.broadcast(whole), out["text_sha256"] == whole[sha], "left")
    else:
        out = out.withColumns({hot_n: F.lit(None).cast("long"), hot_best: F.lit(None).cast(df.schema[id_col].dataType), sha: F.lit(None).cast("string")})
    in_hot = F.col(sha).isNotNull()
    keep_id = F.when(in_hot, F.col(hot_best)).otherwise(F.col(best))
    # when all ids of a hot text are null its rows share one salt, as ties always do
    return out.withColumns(
        {
            "keep_id": keep_id,
            "group_size": F.when(in_hot, F.col(hot_n)).otherwise(F.col(n)).cast("long"),
            "kept": (F.col(rank) == 1) & ids.eqNullSafe(keep_id),
        }
    ).select(*df.columns, "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, with their own columns and names."""
    held = ["_c%d" % i for i in range(len(df.columns))]
    names = dict(zip(df.columns, held, strict=True))
    out = content_sort(df.toDF(*held), names[id_col], names[text_col], keep)
    return out.where("kept").select(*held).toDF(*df.columns)
