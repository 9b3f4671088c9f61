"""Mixing sources to target weights.

Sources get word targets by weight, levelled where a target exceeds its
source's cap. Each source's rows fall into hashed blocks; whole passes over a
source come first, and the rest of its target is drawn as permuted blocks, the
last of them by rows. A multivariate-hypergeometric tree then splits the exact
block quotas of all sources among the output shards, blocks of a source go to
shards in their permuted order, and each shard is shuffled locally.

Nulls: a null text has no words, a null source is a source of its own, a null
doc_id is an id like others. Rows without words are placed as often as their
block is; they count for nothing. Rows that are equal in doc_id, source and
text are placed alike. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import WORD_PATTERN, cut, table, text_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
#: Sources up to which their table and the plan of blocks are broadcast; beyond, both are joined by shuffles.
SOURCES_BROADCAST = 1 << 16
#: Blocks of all sources together, beside one per source; what the driver plans with.
BLOCKS = 1 << 14
SHARDS = 64
#: Copies of rows, about, that are put in order together.
ROWS_PER_PART = 1 << 8
SEED = 7919


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets in proportion to weights with sum `total`, none above cap x size."""
    free, targets, left = set(range(len(sizes))), [0.0] * len(sizes), float(total)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = weights[i] * level
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
            free.discard(i)
        left = max(left, 0.0)
    return targets


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: [shards, sources], whose column sums are quotas.

    Each node draws, without replacement, the blocks of its left half from its
    own, so every shard's counts are hypergeometric and the sums are exact.
    """
    if shards == 1:
        return quotas[None, :]
    total, half = int(quotas.sum()), shards // 2
    left = np.zeros_like(quotas)
    if total:
        left = rng.multivariate_hypergeometric(quotas, total * half // shards, method="marginals")
    return np.concatenate([split_tree(left, half, rng), split_tree(quotas - left, shards - half, rng)])


def plan_blocks(blocks: list[tuple], targets: dict, shards: int, seed: int) -> list[tuple]:
    """(source number, block, copies, shards of the whole copies, words wanted of a partial copy or null, its shard)."""
    by_source: dict[int, list[tuple[int, int]]] = {}
    for s, b, size in blocks:
        by_source.setdefault(s, []).append((b, size))
    order: dict[int, list[tuple[int, float | None]]] = {}
    for s in sorted(by_source):
        own = sorted(by_source[s])
        total, left = sum(x for _, x in own), targets[s]
        draws: list[tuple[int, float | None]] = []
        epoch = 0
        while total and left > 0.5:
            rng = np.random.Generator(np.random.PCG64([seed, s, epoch]))
            for k in rng.permutation(len(own)):
                b, size = own[k]
                if left < 0.5:
                    break
                draws.append((b, None if size <= left else left))
                left -= min(size, left)
            epoch += 1
        order[s] = draws
    quotas = np.array([len(order[s]) for s in sorted(order)], np.int64)
    tree = split_tree(quotas, shards, np.random.Generator(np.random.PCG64([seed, 1 << 20])))
    found: dict[tuple[int, int], dict] = {}
    for k, s in enumerate(sorted(order)):
        homes = np.repeat(np.arange(shards), tree[:, k])
        for (b, part), shard in zip(order[s], homes.tolist(), strict=True):
            x = found.setdefault((s, b), {"whole": [], "part": None, "part_shard": None})
            if part is None:
                x["whole"].append(shard)
            else:
                x["part"], x["part_shard"] = part, shard
    return [(s, b, x["whole"], x["part"], x["part_shard"]) for (s, b), x in found.items()]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """A row (struct of docs' columns) with _size, _source_size, _target, _row (hash) and _shards, which take a copy of it each.

    The driver holds one row per source and at most `blocks` + one per source
    for the blocks; both bounds are independent of the rows. Sources are taken
    by code point, null last, with `weights` repeated over them.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.struct("*").alias("row"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("_size"),
        text_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("_row"),
    )
    slim = cut(sized.select("source", "_size", "_row"))
    sources = slim.groupBy("source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r["size"] for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    everything = max(1, sum(r.n for r in sources))
    table_of = [(r.source, i, int(r["size"]), float(t), 1 + math.ceil(blocks * r.n / everything)) for i, (r, t) in enumerate(zip(sources, targets, strict=True))]
    known = spark.createDataFrame(table_of, "source string, _s int, _source_size long, _target double, _blocks int")

    def sent(side: DataFrame) -> DataFrame:  # one row per source, or at most `blocks` and two per source
        return F.broadcast(side) if len(table_of) <= SOURCES_BROADCAST else side

    def placed(df: DataFrame) -> DataFrame:
        k = sent(known.withColumnRenamed("source", "_source"))
        joined = df.join(k, df["source"].eqNullSafe(k["_source"])).drop("_source")
        return joined.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(seed)), F.col("_blocks")).cast("int"))

    by_block = placed(slim).groupBy("_s", "_block").agg(F.sum("_size").alias("size")).collect()  # at most blocks + 2 per source
    planned = plan_blocks([tuple(r) for r in by_block], dict(enumerate(targets)), shards, seed)
    plan = spark.createDataFrame(planned, "_s int, _block int, _whole array<int>, _part double, _part_shard int")
    # Rows of the partly drawn blocks, in hashed order, up to the words wanted.
    last = plan.where("_part is not null").select("_s", "_block", "_part")
    order = "PARTITION BY _s, _block ORDER BY xxhash64(_row, 5), _row"
    drawn = placed(slim).join(sent(last), ["_s", "_block"]).selectExpr("_s", "_block", "_part", "_row", "_size", f"sum(_size) OVER ({order}) AS upto", "xxhash64(_row, 5) AS h")
    near = drawn.where("upto - _size / 2 <= _part").groupBy("_s", "_block").agg(F.max("h").alias("_h"))
    plan = cut(plan.join(near, ["_s", "_block"], "left"))  # as many rows as blocks
    out = placed(sized).join(sent(plan), ["_s", "_block"], "left")
    partial = F.when(F.xxhash64("_row", F.lit(5)) <= F.col("_h"), F.array("_part_shard")).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_shards", F.coalesce(F.concat("_whole", partial), F.array().cast("array<int>")))
    return out.select("row", "_size", "_source_size", "_target", "_row", "_shards")


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken copy of a row, shard by shard.

    A shard's copies are dealt by hash to parts of about ROWS_PER_PART, as many
    as the table's rows ask for, and each part is in a hashed order.
    """
    parts = max(1, math.ceil(docs.count() * SHARE / (options.get("shards", SHARDS) * ROWS_PER_PART)))
    out = mix(docs, **options).select("*", F.posexplode("_shards").alias("_copy", "_shard"))
    salt = F.xxhash64("_row", "_copy", F.lit(SEED))
    out = out.repartition("_shard", F.pmod(salt, F.lit(parts))).sortWithinPartitions("_shard", salt)
    return out.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(
        "row.doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.size("_shards") * F.col("_size")).cast("long").alias("taken"),
        F.size("_shards").alias("copies"),
        F.col("_shards").alias("shards"),
    )
