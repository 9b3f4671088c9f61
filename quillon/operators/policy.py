"""How strongly rules and trails deserve protection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.symbols import FIRST_RULE
from quillon.plans.lineage import cut, global_ranks

#: Parity symbols per profile.
PARITY = {"Light": 2, "Medium": 4, "Strong": 6}


def rule_usage(trails: DataFrame, rules: DataFrame, symbols: str = "symbols") -> DataFrame:
    """(id, usage): direct occurrences in trails; 0 for rules that have none."""
    seen = trails.select(F.explode(F.filter(symbols, lambda s: s >= FIRST_RULE)).alias("id")).groupBy("id").agg(F.count("*").alias("usage"))
    return rules.select("id").join(seen, "id", "left").select("id", F.coalesce("usage", F.lit(0)).cast("long").alias("usage"))


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation between neighbours, as low * (1 - t) + high * t; 0 for no values."""
    q = min(max(q, 0.0), 1.0)
    at = F.lit(q) * (F.size(sorted_values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    t = at - F.floor(at)
    value = F.get(sorted_values, low) * (1 - t) + F.get(sorted_values, high) * t
    return F.when(F.size(sorted_values) > 0, value).otherwise(F.lit(0.0))


def quantiles(scored: DataFrame, wanted: list[float], score: str = "criticality") -> dict[float, float]:
    """Quantiles of a column, exact to the bit, from the rows at the ranks that they need.

    Rows are ranked across range partitions; two values per quantile reach the
    driver.
    """
    ranked = global_ranks(scored.select(score), score)
    n = ranked.count()
    if not n:
        return dict.fromkeys(wanted, 0.0)
    places = {q: min(max(q, 0.0), 1.0) * (n - 1) for q in wanted}
    needed = {f(x) for x in places.values() for f in (math.floor, math.ceil)}
    value = {r["rank"]: r[score] for r in ranked.where(F.col("rank").isin(sorted(needed))).collect()}
    out = {}
    for q, x in places.items():
        t = x - math.floor(x)
        out[q] = value[math.floor(x)] * (1 - t) + value[math.ceil(x)] * t
    return out


def profile_of(score: Column, medium_cut: float, strong_cut: float) -> Column:
    """A cut of 0 selects nothing."""
    strong = (score >= strong_cut) & F.lit(strong_cut > 0)
    medium = (score >= medium_cut) & F.lit(medium_cut > 0)
    return F.when(strong, "Strong").when(medium, "Medium").otherwise("Light")


def with_profile(scored: DataFrame, medium: float, strong: float, score: str = "criticality", known: dict[float, float] | None = None) -> DataFrame:
    """scored with profile and parity, by its own quantiles (or those known already)."""
    known = known or quantiles(scored, [medium, strong], score)
    out = scored.withColumn("profile", profile_of(F.col(score), known[medium], known[strong]))
    return out.withColumn("parity", parity_of(F.col("profile")))


def parity_of(profile: Column) -> Column:
    return F.when(profile == "Strong", PARITY["Strong"]).when(profile == "Medium", PARITY["Medium"]).otherwise(PARITY["Light"])


def rule_scores(rules: DataFrame, usage: DataFrame) -> DataFrame:
    """(id, usage, birth_frequency, criticality) for rules (id, frequency); rules without usage count 0."""
    joined = rules.select("id", F.col("frequency").alias("birth_frequency")).join(usage, "id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)).cast("long"))
    return joined.withColumn("criticality", F.log1p("usage") + 0.25 * F.log1p("birth_frequency"))


def rule_protection(rules: DataFrame, usage: DataFrame, medium: float = 0.70, strong: float = 0.95) -> DataFrame:
    """rule_scores with profile and parity."""
    return with_profile(rule_scores(rules, usage), medium, strong).select("id", "usage", "birth_frequency", "criticality", "profile", "parity")


def buckets(decisions: DataFrame, idx: str = "idx") -> DataFrame:
    """(profile, positions): positions in the decision list, in order, by profile."""
    return decisions.groupBy("profile").agg(F.sort_array(F.collect_list(idx)).alias("positions"))


def parity_cost(decisions: DataFrame) -> DataFrame:
    """One row: adaptive and uniform parity, the saving against uniform Strong, and Strong's share of usage."""
    strong = F.col("profile") == "Strong"
    out = decisions.agg(
        F.count("*").alias("rules"),
        F.coalesce(F.sum("parity"), F.lit(0)).cast("long").alias("adaptive_parity"),
        F.coalesce(F.sum("usage"), F.lit(0)).cast("long").alias("total_usage"),
        F.coalesce(F.sum(F.when(strong, F.col("usage"))), F.lit(0)).cast("long").alias("strong_usage"),
        *[F.count_if(F.col("profile") == p).alias(p.lower()) for p in PARITY],
    )
    out = out.withColumn("uniform_strong_parity", F.col("rules") * PARITY["Strong"])
    ratio = lambda a, b, none: F.when(F.col(b) == 0, F.lit(none)).otherwise(F.col(a).cast("double") / F.col(b))
    return out.withColumns({"saving_vs_strong": F.when(F.col("rules") == 0, 0.0).otherwise(1 - ratio("adaptive_parity", "uniform_strong_parity", 1.0)), "strong_usage_share": ratio("strong_usage", "total_usage", 0.0)})


def trail_protection(trails: DataFrame, accesses: DataFrame, n_rules: int, medium: float = 0.80, strong: float = 0.98, key: str = "trail_index", symbols: str = "symbols") -> DataFrame:
    """(key, symbols, access_count, shared_rule_fraction, criticality, profile); trails without accesses count 0."""
    top = FIRST_RULE + n_rules
    size = F.size(symbols).cast("long")
    shared = F.size(F.filter(symbols, lambda s: (s >= FIRST_RULE) & (s < top)))
    out = trails.select(F.col(key), size.alias("symbols"), F.when(size > 0, shared.cast("double") / size).otherwise(0.0).alias("shared_rule_fraction"))
    out = out.join(accesses.select(key, "access_count"), key, "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)).cast("long"))
    score = F.log1p("access_count") + 0.75 * F.col("shared_rule_fraction") + 0.10 * F.log1p("symbols")
    scored = cut(out.withColumn("criticality", score))  # read twice: for the ranks and for the rows
    return with_profile(scored, medium, strong).select(key, "symbols", "access_count", "shared_rule_fraction", "criticality", "profile")
