"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join over the links; nothing but a count and a
checksum of them reaches the driver. A node with any number of links makes no large
task: its minimum is aggregated before the shuffle, and is written before the join, so
that the join has plain shuffles on either side, which Spark may split (or leave out,
where the minima are few). Each round is written to the shared folder as well, so a
lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm._common import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of it and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): ``root`` is the least node it reaches."""
    links = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
        links = staged(_small_star(staged(_large_star(links), "links")), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
