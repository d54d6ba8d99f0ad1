"""What the corpus operators share: scratch tables, code shipping, column names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise._ship import ship

__all__ = ["LOWER", "UPPER", "ascii_lower", "delete", "fresh", "partitions", "quoted", "release", "scratch_dir", "ship", "staged", "staged_count", "staged_path", "table"]

#: ASCII letters; the contracts fold these and no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


class _Staged(threading.local):
    """The scratch tables of a thread, so that queries beside it keep theirs."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        _every.append(self.paths)


_every: list[list[str]] = []
_staged = _Staged()


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset (tests, one machine) a
    temporary folder takes its place, which only local masters can share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = getattr(spark.sparkContext, "_chunkwise_scratch", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="chunkwise-")
        spark.sparkContext._chunkwise_scratch = found
    return found


def staged_path(spark: SparkSession, label: str) -> str:
    """A new folder for a scratch table, which ``release`` or the end of the program takes away."""
    if not getattr(spark.sparkContext, "_chunkwise_cleans", False):
        atexit.register(_clean, spark.sparkContext)
        spark.sparkContext._chunkwise_cleans = True
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.paths.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_count() -> int:
    return len(_staged.paths)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that this thread made since ``staged_count()`` was ``since``; results read from them must be written."""
    while len(_staged.paths) > since:
        delete(spark, _staged.paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean(context: SparkContext) -> None:
    """What queries left for results that are read later goes when the program ends."""
    with contextlib.suppress(Exception):  # the context may be gone by then
        for paths in _every:
            while context._jvm and paths:
                where = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
                where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    """A column's name as Spark takes it whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` doesn't use, in any letter case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
