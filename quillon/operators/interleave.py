"""Interleaving: lane after lane of every L-th position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rank_of(index: Column, n: int, lanes: int = 64) -> Column:
    """Where position `index` of n stands in the interleaved order; lanes are held to 1..n."""
    lanes = max(1, min(lanes, n))
    each, longer = divmod(n, lanes)
    lane = F.pmod(index, F.lit(lanes))
    return (lane * each + F.least(lane, F.lit(longer)) + F.floor(index / lanes)).cast("long")


def interleaved_order(spark: SparkSession, n: int, lanes: int = 64) -> DataFrame:
    """(pos, idx): the index that stands at each place. Closed form, no sort."""
    return spark.range(n).select(rank_of(F.col("id"), n, lanes).alias("pos"), F.col("id").alias("idx"))


def inverse_order(order: DataFrame) -> DataFrame:
    """(idx, pos) for the way back."""
    return order.select(F.col("idx"), F.col("pos"))
