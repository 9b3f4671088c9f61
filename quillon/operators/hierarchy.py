"""The fixed hierarchy: adjacent pairs, layer upon layer, in closed form.

Pairing goes by position, so node i of layer L covers the bytes from i * 2^L
on, up to 2^L of them, and is a relation where its right half is not empty.
The shape depends on the covered length alone; a relation is therefore known
by the bytes that it covers, and no layer waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.lineage import global_ranks


def _pieces(samples: DataFrame, max_layers: int, order: str, hex_bytes: str) -> DataFrame:
    """(ord, pos, part): samples cut into parts of 2^max_layers bytes, in one pass over each."""
    cut = F.regexp_extract_all(F.col(hex_bytes), F.lit(f".{{1,{2 << max_layers}}}"), F.lit(0))
    return samples.select(F.col(order).alias("ord"), F.posexplode(cut).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


def nodes(samples: DataFrame, max_layers: int = 1, order: str = "sample_ord", hex_bytes: str = "h") -> DataFrame:
    """(ord, layer, i, key): every reference to a relation; key is the covered bytes in hexadecimal. No shuffle."""
    parts = _pieces(samples, max_layers, order, hex_bytes).withColumn("n", (F.length("part") / 2).cast("int"))
    parts = parts.withColumn("layer", F.explode(F.sequence(F.lit(1), F.lit(max_layers))))
    span, half = F.expr("shiftleft(1, layer)"), F.expr("shiftleft(1, layer - 1)")
    count = (F.floor((F.col("n") - half - 1) / span) + 1).cast("int")
    parts = parts.where(F.col("n") > half).withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    i = F.col("pos") * F.expr(f"shiftleft(1L, {max_layers} - layer)") + F.col("k")
    return parts.select("ord", "layer", i.alias("i"), F.substring(F.col("part"), 2 * F.col("k") * span + 1, 2 * span).alias("key"))


def relations(references: DataFrame) -> DataFrame:
    """(id, left, right, layer, ref_count, key) of all relations, with dense ids in order of first use."""
    first = F.min(F.struct("ord", "layer", "i")).alias("first")
    found = references.groupBy("key").agg(F.count("*").alias("ref_count"), first)
    found = global_ranks(found, "first").withColumn("id", F.col("rank") + 256)
    # The left part is the largest power of two below the covered length.
    covered = (F.length("key") / 2).cast("int")
    left = F.expr("cast(shiftleft(1, cast(floor(log2(length(key) / 2 - 0.5)) AS int)) AS int)")
    found = found.withColumns({"_l": F.substring(F.col("key"), F.lit(1), 2 * left), "_r": F.substring(F.col("key"), 2 * left + 1, 2 * (covered - left))})
    ids = found.select(F.col("key").alias("_k"), F.col("id").alias("_i"))
    single = lambda c: F.when(F.length(c) == 2, F.conv(c, 16, 10).cast("long"))
    out = found
    for side in ("_l", "_r"):
        named = ids.withColumnsRenamed({"_k": side, "_i": side + "_id"})
        out = out.join(named, side, "left").withColumn(side + "_id", F.coalesce(single(side), side + "_id"))
    return out.select("id", F.col("_l_id").alias("left"), F.col("_r_id").alias("right"), F.col("first.layer").alias("layer"), "ref_count", "key")


def trail_length(n_bytes: str, max_layers: int = 1) -> Column:
    """Symbols left of n bytes: each layer halves them, rounded up, until one is left."""
    return F.when(F.col(n_bytes) == 0, F.lit(0).cast("long")).otherwise(F.ceil(F.col(n_bytes) / float(1 << max_layers)).cast("long"))


def encode(samples: DataFrame, known: DataFrame, max_layers: int = 1, order: str = "sample_ord", hex_bytes: str = "h") -> DataFrame:
    """(ord, pos, symbol): trails by relations' ids. Pieces of one byte stay bytes."""
    pieces = _pieces(samples, max_layers, order, hex_bytes).withColumnRenamed("part", "key")
    out = pieces.join(known.select("key", "id"), "key", "left")
    return out.select("ord", "pos", F.coalesce(F.when(F.length("key") == 2, F.conv("key", 16, 10).cast("long")), "id").alias("symbol"))


def decode(trails: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, h): the bytes of trails in hexadecimal; an unknown symbol fails."""
    byte = F.when(F.col("symbol") < 256, F.lpad(F.hex("symbol"), 2, "0"))
    joined = trails.join(known.select(F.col("id").alias("symbol"), "key"), "symbol", "left")
    part = F.coalesce(byte, "key", F.expr("raise_error(concat('unknown symbol ', symbol))"))
    parts = joined.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return parts.select("ord", F.array_join(F.col("parts.part"), "").alias("h"))
