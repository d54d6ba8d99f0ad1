"""Opens files, in tasks and on the driver, where Spark itself would look for them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Other names of stores under which Spark knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def default_store(spark: SparkSession) -> str:
    """The store that paths without a scheme lie in, like ``hdfs://host:9000``."""
    return str(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))


def qualified(path: str, store: str = "file:///") -> str:
    """The path with scheme and host; ``store`` is the one of paths that have neither."""
    scheme, colon, rest = path.partition(":")
    if colon and "/" not in scheme:
        return f"file://{rest}" if scheme == "file" and not rest.startswith("//") else path
    if store.startswith("file:"):
        return f"file://{os.path.abspath(path)}"
    if not path.startswith("/"):
        raise ValueError(f"give the whole path in {store}: {path!r}")
    return store.rstrip("/") + path


def opened(path: str):
    """(file system, path in it) of a qualified path."""
    from pyarrow import fs

    path = qualified(path)
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
