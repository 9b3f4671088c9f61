"""Hashes of rules and trails, and where data and hashes disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import hash_rule, hash_symbols

BLOCK = 64


def rule_hashes(rules: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, hash) of rules (idx, id, left, right, frequency)."""
    return rules.select(idx, hash_rule(*[F.col(c) for c in ("id", "left", "right", "frequency")]).alias("hash"))


def trail_hashes(trails: DataFrame, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    return trails.select(key, hash_symbols(F.col(symbols)).alias("hash"))


def blocks(symbols: Column, block: int = BLOCK) -> Column:
    """A trail's blocks as an array of arrays; a block size of 0 stands for 64."""
    block = block or BLOCK
    starts = F.sequence(F.lit(0), F.floor((F.size(symbols) - 1) / block).cast("int"))
    cut = F.transform(starts, lambda k: F.slice(symbols, k * block + 1, block))
    return F.when(F.size(symbols) > 0, cut).otherwise(F.array().cast("array<array<bigint>>"))


def block_hashes(trails: DataFrame, block: int = BLOCK, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    """(key, block, hash) for every block of every trail; no shuffle."""
    cut = trails.select(key, F.posexplode(blocks(F.col(symbols), block)).alias("block", "part"))
    return cut.select(key, F.col("block").cast("long").alias("block"), hash_symbols(F.col("part")).alias("hash"))


def manifest(rules: DataFrame, trails: DataFrame, block: int = BLOCK) -> dict[str, DataFrame]:
    return {"rules": rule_hashes(rules), "trails": trail_hashes(trails), "blocks": block_hashes(trails, block)}


def disagreeing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    a = expected.select(*keys, F.col("hash").alias("_a"))
    b = actual.select(*keys, F.col("hash").alias("_b"))
    return a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def corrupted_rules(known: DataFrame, rules: DataFrame) -> DataFrame:
    return disagreeing(known, rule_hashes(rules), ["idx"])


def corrupted_blocks(known: DataFrame, trails: DataFrame, block: int = BLOCK, key: str = "trail_id") -> DataFrame:
    return disagreeing(known, block_hashes(trails, block, key), [key, "block"])


def verify_trails(known: DataFrame, trails: DataFrame, key: str = "trail_id") -> DataFrame:
    """(key, intact) of every trail that either side has."""
    a = known.select(key, F.col("hash").alias("_a"))
    b = trail_hashes(trails, key).select(key, F.col("hash").alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("intact"))
