"""Loss under simulated damage: bursts exactly, random damage by trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.policy import PARITY, quantiles, rule_scores, with_profile


def _group(position: Column, groups: int, size: int, interleaved: bool) -> Column:
    return F.pmod(position, F.lit(groups)) if interleaved else F.floor(position / size).cast("long")


def worst_in_burst(start: Column, length: Column, width: int, interleaved: bool) -> Column:
    """The most errors that a burst puts into one group. In groups of every width-th position it is length / width, rounded up; in groups of width neighbours, the longest part between their borders."""
    if interleaved:
        return F.ceil(length / width).cast("long")
    to_border = F.least(width - F.pmod(start, F.lit(width)), length)
    return F.greatest(to_border, F.least(length - to_border, F.lit(width))).cast("long")


def tolerated(spark: SparkSession, total: int, width: int, capacity: int, interleaved: bool) -> DataFrame:
    """(length, ok) for every burst length, over starts a 256th of the total apart."""
    step = max(1, total // 256)
    lengths = spark.range(1, total + 1).withColumnRenamed("id", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.lit(total) - F.col("length"), F.lit(step).cast("long"))
    worst = F.array_max(F.transform(starts, lambda s: worst_in_burst(s, F.col("length"), width, interleaved)))
    return lengths.select("length", (worst <= capacity).alias("ok"))


def max_burst(spark: SparkSession, total: int = 4096, width: int = 64, capacity: int = 2) -> DataFrame:
    """(layout, max_burst): the length before the first that is not tolerated."""
    out = None
    for name, interleaved in (("contiguous", False), ("interleaved", True)):
        one = tolerated(spark, total, width, capacity, interleaved)
        one = one.agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("length"))) - 1, F.max("length"), F.lit(0)).cast("long").alias("max_burst")).select(F.lit(name).alias("layout"), "max_burst")
        out = one if out is None else out.unionByName(one)
    return out


def burst_failure(spark: SparkSession, symbols: int = 4096, groups: int = 64, capacity: int = 2, errors: tuple[int, ...] = (1, 4, 41)) -> DataFrame:
    """(errors, layout, probability) over all starts."""
    size = symbols // groups
    out = None
    for n in errors:
        for name, interleaved in (("contiguous", False), ("interleaved", True)):
            worst = worst_in_burst(F.col("id"), F.lit(n), groups if interleaved else size, interleaved)
            one = spark.range(symbols - n + 1).agg((F.count_if(worst > capacity).cast("double") / F.count("*")).alias("probability"))
            one = one.select(F.lit(n).cast("long").alias("errors"), F.lit(name).alias("layout"), "probability")
            out = one if out is None else out.unionByName(one)
    return out


def _damaged(spark: SparkSession, trials: int, n: int, errors: int, seed: int, weights: DataFrame | None = None) -> DataFrame:
    """(trial, idx): `errors` of n items per trial, without replacement; by weight if weights (idx, w) are given.

    Exponential keys over weights order the items as successive draws would.
    """
    items = spark.range(trials * n).select(F.floor(F.col("id") / n).cast("long").alias("trial"), F.pmod("id", F.lit(n)).cast("long").alias("idx"))
    key = -F.log(1 - F.rand(seed))
    if weights is not None:
        items = items.join(F.broadcast(weights), "idx")  # one row per item, n in all
        key = key / F.col("w")
    items = items.withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("_key", "idx"))
    return items.withColumn("_rank", rank).where(F.col("_rank") <= errors).select("trial", "idx")


def random_failure(spark: SparkSession, symbols: int = 4096, groups: int = 64, capacity: int = 2, errors: tuple[int, ...] = (1, 4, 41), trials: int = 1000, seed: int = 17) -> DataFrame:
    """(errors, layout, probability) of scattered damage."""
    size = symbols // groups
    out = None
    for n in errors:
        hit = _damaged(spark, trials, symbols, n, seed)
        layouts = F.explode(F.array(*[F.struct(F.lit(name).alias("layout"), _group(F.col("idx"), groups, size, x).alias("grp")) for name, x in (("contiguous", False), ("interleaved", True))]))
        per = hit.select("trial", layouts.alias("x")).groupBy("trial", "x.layout", "x.grp").agg(F.count("*").alias("n"))
        failed = per.groupBy("trial", "layout").agg((F.max("n") > capacity).alias("failed"))
        one = failed.groupBy("layout").agg((F.count_if("failed") / F.lit(float(trials))).alias("probability"))
        one = one.select(F.lit(n).cast("long").alias("errors"), "layout", "probability")
        out = one if out is None else out.unionByName(one)
    return out


def profile_failure(spark: SparkSession, symbols: int = 4096, groups: int = 64, rate: float = 0.01, capacities: tuple[int, ...] = (2, 3, 4, 5, 6), trials: int = 1000, seed: int = 23) -> DataFrame:
    """(capacity, overhead, probability): one set of trials judged by every capacity."""
    hit = _damaged(spark, trials, symbols, int(symbols * rate + 0.5), seed)
    worst = hit.groupBy("trial", F.pmod("idx", F.lit(groups)).alias("grp")).agg(F.count("*").alias("n")).groupBy("trial").agg(F.max("n").alias("worst"))
    each = worst.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])))
    return each.groupBy("capacity").agg((F.col("capacity") / (symbols / groups)).alias("overhead"), (F.count_if(F.col("worst") > F.col("capacity")) / F.lit(float(trials))).alias("probability"))


def _decided(decisions: DataFrame, adaptive: bool, uniform: str) -> DataFrame:
    profile = F.col("profile") if adaptive else F.lit(uniform)
    cap = F.when(profile == "Strong", PARITY["Strong"]).when(profile == "Medium", PARITY["Medium"]).otherwise(PARITY["Light"])
    return decisions.select("idx", "usage", profile.alias("profile"), cap.alias("cap"), "criticality")


STRATEGIES = (("light", False, "Light"), ("adaptive", True, "Light"), ("strong", False, "Strong"))


def rule_failure(decisions: DataFrame, n: int, damages: tuple[float, ...] = (0.01, 0.05, 0.10), trials: int = 200, seed: int = 29) -> DataFrame:
    """(damage, strategy, preserved, cost): a damaged rule is lost where its capacity is below 4."""
    spark = decisions.sparkSession
    weights = decisions.select("idx", (F.col("usage") + 1).cast("double").alias("w"))
    out = None
    for damage in damages:
        for k, (name, adaptive, uniform) in enumerate(STRATEGIES):
            d = _decided(decisions, adaptive, uniform)
            total = d.agg(F.sum("usage").alias("total"), F.sum("cap").cast("long").alias("cost"))
            hit = _damaged(spark, trials, n, max(1, int(n * damage)), seed + k, weights).join(F.broadcast(d), "idx")
            lost = hit.agg((F.sum(F.when(F.col("cap") < 4, F.col("usage")).otherwise(0)) / trials).alias("lost"))
            one = total.join(lost).select(F.lit(damage).alias("damage"), F.lit(name).alias("strategy"), (1 - F.col("lost") / F.nullif("total", F.lit(0).cast("long"))).alias("preserved"), "cost")
            out = one if out is None else out.unionByName(one)
    return out


def grouped(decisions: DataFrame, order: list[Column], size: int = 8) -> DataFrame:
    """decisions with grp, the group within its profile."""
    place = F.row_number().over(Window.partitionBy("profile").orderBy(*order)) - 1
    return decisions.withColumn("grp", F.floor(place / size).cast("long"))


def group_parity(decisions: DataFrame, size: int = 8) -> DataFrame:
    """(strategy, parity): capacity times groups."""
    out = None
    for name, adaptive, uniform in STRATEGIES:
        d = grouped(_decided(decisions, adaptive, uniform), [F.col("idx")], size)
        one = d.select("profile", "grp", "cap").distinct().agg(F.sum("cap").cast("long").alias("parity")).select(F.lit(name).alias("strategy"), "parity")
        out = one if out is None else out.unionByName(one)
    return out


def group_failure(decisions: DataFrame, n: int, damages: tuple[float, ...] = (0.01, 0.05, 0.10), trials: int = 200, size: int = 8, seed: int = 37) -> DataFrame:
    """(damage, strategy, preserved): a group with more errors than its capacity is lost whole."""
    spark = decisions.sparkSession
    weights = decisions.select("idx", (F.col("usage") + 1).cast("double").alias("w"))
    out = None
    for damage in damages:
        for k, (name, adaptive, uniform) in enumerate(STRATEGIES):
            d = grouped(_decided(decisions, adaptive, uniform), [F.col("idx")], size)
            one = _group_loss(spark, d, weights, n, max(1, int(n * damage)), trials, seed + k)
            one = one.select(F.lit(damage).alias("damage"), F.lit(name).alias("strategy"), "preserved")
            out = one if out is None else out.unionByName(one)
    return out


def _group_loss(spark: SparkSession, d: DataFrame, weights: DataFrame, n: int, errors: int, trials: int, seed: int) -> DataFrame:
    own = d.groupBy("profile", "grp").agg(F.sum("usage").alias("group_usage"), F.max("cap").alias("cap"))
    hit = _damaged(spark, trials, n, errors, seed, weights).join(F.broadcast(d.select("idx", "profile", "grp")), "idx")
    bad = hit.groupBy("trial", "profile", "grp").agg(F.count("*").alias("n")).join(F.broadcast(own), ["profile", "grp"]).where("n > cap")
    lost = bad.agg((F.coalesce(F.sum("group_usage"), F.lit(0)) / trials).alias("lost"))
    total = d.agg(F.sum("usage").alias("total"))
    return total.join(lost).select((1 - F.col("lost") / F.nullif("total", F.lit(0).cast("long"))).alias("preserved"))


def quantile_sweep(rules: DataFrame, usage: DataFrame, n: int, mediums=(0.5, 0.6, 0.7, 0.8), strongs=(0.85, 0.9, 0.95, 0.98), trials: int = 40, seed: int = 41, simulate: bool = True) -> DataFrame:
    """(medium_q, strong_q, preserved_1pct, preserved_5pct, preserved_10pct, mean_parity, score); pairs with strong <= medium are left out."""
    spark = rules.sparkSession
    scored = rule_scores(rules, usage)
    known = quantiles(scored, sorted({*mediums, *strongs}))
    out = None
    for mq in mediums:
        for sq in strongs:
            if sq <= mq:
                continue
            d = with_profile(scored, mq, sq, known=known).withColumn("idx", F.col("id") - 256)
            d = grouped(_decided(d, True, "Light"), [F.desc("criticality"), F.col("idx")])
            parity = d.select("profile", "grp", "cap").distinct().agg((F.sum("cap") / F.lit(float(n))).alias("mean_parity"))
            one = parity.select(F.lit(mq).alias("medium_q"), F.lit(sq).alias("strong_q"), "mean_parity")
            if simulate:
                weights = d.select("idx", (1 + F.log1p("usage")).alias("w"))
                for name, rate in (("preserved_1pct", 0.01), ("preserved_5pct", 0.05), ("preserved_10pct", 0.10)):
                    one = one.join(_group_loss(spark, d, weights, n, max(1, round(rate * n)), trials, seed).withColumnRenamed("preserved", name))
                one = one.withColumn("score", (0.5 * F.col("preserved_1pct") + 0.3 * F.col("preserved_5pct") + 0.2 * F.col("preserved_10pct")) / F.col("mean_parity"))
            out = one if out is None else out.unionByName(one)
    return out


def integrated(decisions: DataFrame, rate: float = 0.01, trials: int = 200, size: int = 8, seed: int = 43) -> DataFrame:
    """(strategy, preserved, parity, bad_groups): each rule is damaged on its own, likelier the more it is used; a bad group loses its damaged rules' usage."""
    spark = decisions.sparkSession
    out = None
    total = decisions.agg(F.sum("usage").cast("double").alias("total"))
    for k, (name, adaptive, uniform) in enumerate(STRATEGIES):
        d = grouped(_decided(decisions, adaptive, uniform), [F.col("idx")], size)
        each = spark.range(trials).withColumnRenamed("id", "trial").join(F.broadcast(d.join(F.broadcast(total))))  # trials x rules
        share = F.when(F.col("total") > 0, F.col("usage") / F.col("total")).otherwise(0.0)
        hit = each.where(F.rand(seed + k) < F.least(F.lit(1.0), rate * (1 + 25 * share)))
        bad = hit.groupBy("trial", "profile", "grp").agg(F.count("*").alias("n"), F.sum("usage").alias("lost"), F.max("cap").alias("cap")).where("n > cap")
        lost = bad.agg((F.coalesce(F.sum("lost"), F.lit(0)) / trials).alias("lost"), (F.count("*") / trials).alias("bad_groups"))
        parity = d.select("profile", "grp", "cap").distinct().agg(F.sum("cap").cast("long").alias("parity"))
        one = total.join(lost).join(parity).select(F.lit(name).alias("strategy"), F.when(F.col("total") > 0, 1 - F.col("lost") / F.col("total")).otherwise(1.0).alias("preserved"), "parity", "bad_groups")
        out = one if out is None else out.unionByName(one)
    return out


def overhead(spark: SparkSession, rules: int = 1024, symbols: int = 1 << 20, rule_group: int = 8, trail_block: int = 64) -> DataFrame:
    """Percentages of dual parity and hashes over payload, from the sizes of the records.

    A rule is four 8-byte fields; its group's parity eight packed values and
    two numbers; a block's parity two packed values and two numbers.
    """
    word = 8
    rule_payload, groups = rules * 4 * word, -(-rules // rule_group)
    rule_parity, rule_hash = groups * (8 * word + 2 * word), rules * word
    payload, blocks = symbols * word, -(-symbols // trail_block)
    parity, hashes = blocks * (2 * word + 2 * word), blocks * word + word
    pct = lambda a, b: 100.0 * a / b if b else 0.0
    rows = [
        ("rule_parity", pct(rule_parity, rule_payload)),
        ("rule_integrity", pct(rule_hash, rule_payload)),
        ("rule_total", pct(rule_parity + rule_hash, rule_payload)),
        ("trail_parity", pct(parity, payload)),
        ("trail_integrity", pct(hashes, payload)),
        ("trail_total", pct(parity + hashes, payload)),
        ("combined", pct(rule_parity + rule_hash + parity + hashes, rule_payload + payload)),
    ]
    return spark.createDataFrame(rows, "metric string, overhead_pct double")
