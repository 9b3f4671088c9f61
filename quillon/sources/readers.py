"""Samples from files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIP, WINDOW = 512, 2048


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files; only the files' bytes, whatever their kind."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def window(samples: DataFrame, size: int = WINDOW, skip: int = SKIP, content: str = "content", least: float | None = 0.5) -> DataFrame:
    """samples with w, at most `size` bytes after the first `skip`.

    Windows shorter than `least` x size are dropped; with least None, only
    empty ones.
    """
    w = F.substring(F.col(content), F.lit(skip + 1), F.lit(size))
    out = samples.withColumn("w", w)
    return out.where(F.octet_length("w") > 0 if least is None else F.octet_length("w") >= size * least)


def text_bytes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(sample_ord, content) of a table's text column, ordered by its key."""
    return df.select(F.col(key).alias("sample_ord"), F.encode(text, "UTF-8").alias("content"))
