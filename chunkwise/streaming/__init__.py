"""Frames in Structured Streaming: compression and decoding are stateless projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.functions import compress, decompress
from chunkwise.operators.frame import CParams


def compressed(stream: DataFrame, column: str, params: CParams | None = None, to: str = "frame") -> DataFrame:
    """The stream with ``column`` replaced by its frame ``to``."""
    return stream.withColumn(to, compress(F.col(column), params)).drop(*([column] if column != to else []))


def restored(stream: DataFrame, frame: str = "frame", to: str = "buffer") -> DataFrame:
    """The stream with its frames replaced by their buffers."""
    return stream.withColumn(to, decompress(F.col(frame))).drop(*([frame] if frame != to else []))
