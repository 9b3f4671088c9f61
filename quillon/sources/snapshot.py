"""Snapshots of a dictionary and its trails.

As tables: rules, trails and one metadata row, in Parquet. As a file: a
little-endian layout of magic, version, counts, rules, and each trail with its
length first, for exchange; it is held in the driver's memory.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format.
MAGIC = b"BITANLZ1"
VERSION = 1
MOST_ITEMS, MOST_SYMBOLS = 100_000_000, 1_000_000_000


def save_tables(rules: DataFrame, trails: DataFrame, path: str, version: int = VERSION) -> None:
    """Write rules (id, left, right, frequency) and trails (trail_id, symbols) below path."""
    rules.write.parquet(f"{path}/rules")
    trails.write.parquet(f"{path}/trails")
    meta = rules.agg(F.lit(version).alias("version"), F.count("*").alias("rule_count")).join(trails.agg(F.count("*").alias("trail_count")))
    meta.write.parquet(f"{path}/meta")


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, trails), after a check of version, counts and the dictionary's ids."""
    rules, trails, meta = (spark.read.parquet(f"{path}/{name}") for name in ("rules", "trails", "meta"))
    row = meta.first()
    if row is None or row.version != VERSION:
        raise ValueError("unknown snapshot version")
    if rules.count() != row.rule_count or trails.count() != row.trail_count:
        raise ValueError("snapshot is incomplete")
    ids = rules.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n"), F.count_if((F.col("left") >= F.col("id")) | (F.col("right") >= F.col("id"))).alias("bad")).first()
    if row.rule_count and (ids.low != 256 or ids.high != 255 + row.rule_count or ids.n != row.rule_count or ids.bad):
        raise ValueError("not a canonical dictionary")
    return rules, trails


def to_bytes(rules: list[tuple[int, int, int, int]], trails: list[list[int]], version: int = VERSION) -> bytes:
    out = [MAGIC, struct.pack("<IQQ", version, len(rules), len(trails))]
    out += [struct.pack("<4Q", *r) for r in rules]
    out += [struct.pack(f"<Q{len(t)}Q", len(t), *t) for t in trails]
    return b"".join(out)


def from_bytes(data: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[list[int]]]:
    """(version, rules, trails); bytes after the last trail are ignored."""
    at = 0

    def take(layout: str) -> tuple:
        nonlocal at
        size = struct.calcsize(layout)
        if at + size > len(data):
            raise ValueError("snapshot is truncated")
        at += size
        return struct.unpack_from(layout, data, at - size)

    if take("<8s")[0] != MAGIC:
        raise ValueError("not a snapshot")
    version, n_rules, n_trails = take("<IQQ")
    if version != VERSION:
        raise ValueError(f"unknown snapshot version {version}")
    if n_rules > MOST_ITEMS or n_trails > MOST_ITEMS:
        raise ValueError("snapshot counts are out of range")
    rules = [take("<4Q") for _ in range(n_rules)]
    trails = []
    for _ in range(n_trails):
        (n,) = take("<Q")
        if n > MOST_SYMBOLS:
            raise ValueError("a trail's length is out of range")
        trails.append(list(take(f"<{n}Q")))
    return version, rules, trails


def read_file(spark: SparkSession, path: str) -> tuple[int, list[tuple], list[list[int]]]:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return from_bytes(bytes(row.content))
