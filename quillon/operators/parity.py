"""Parity of rules and trails, and recovery of what was lost.

One parity (xor) restores one loss of a group; two, P and Q over GF(256) with
coefficient place + 1, restore two. Rules are lost at known places. Symbols of
a damaged block are found by trying places until the block's hash agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.field import inverse_of, times
from quillon.functions.hashing import hash_symbols
from quillon.operators.integrity import BLOCK

FIELDS = ("id", "left", "right", "frequency")
GROUP = 8
MOST = 255


def _grouped(rules: DataFrame, group: int, idx: str) -> DataFrame:
    return rules.withColumns({"grp": F.floor(F.col(idx) / group).cast("long"), "_place": F.pmod(F.col(idx), F.lit(group)).cast("int")})


def _none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def rule_parity(rules: DataFrame, group: int = GROUP, idx: str = "idx") -> DataFrame:
    """(grp, begin_index, count, xor_<field>...); a group size of 0 gives no groups."""
    size = group or 1
    out = _grouped(rules, size, idx).groupBy("grp").agg(F.min(idx).cast("long").alias("begin_index"), F.count("*").alias("count"), *[F.bit_xor(f).alias(f"xor_{f}") for f in FIELDS])
    return out if group else _none(out)


def rule_dual_parity(rules: DataFrame, group: int = GROUP, idx: str = "idx") -> DataFrame:
    """(grp, begin_index, count, p_<field>, q_<field>...), eight bytes packed in each; sizes 0 and above 255 give no groups."""
    size = group if 0 < group <= MOST else 1
    rows = _grouped(rules, size, idx)
    weight = (F.col("_place") + 1).cast("int")
    sums = [x for f in FIELDS for x in (F.bit_xor(F.col(f).cast("long")).alias(f"p_{f}"), F.bit_xor(times(weight, F.col(f))).alias(f"q_{f}"))]
    out = rows.groupBy("grp").agg(F.min(idx).cast("long").alias("begin_index"), F.count("*").alias("count"), *sums)
    return out if 0 < group <= MOST else _none(out)


def recover_one_rule(parity: DataFrame, rules: DataFrame, lost: DataFrame, group: int = GROUP, idx: str = "idx") -> DataFrame:
    """(idx, fields) of the rule lost from each group of `lost` (idx); places outside a group give no row.

    rules may hold the damaged rows: what stands at a lost place is not read.
    """
    gone = lost.select(F.col(idx).alias("_lost"), F.floor(F.col(idx) / group).cast("long").alias("grp"))
    at = parity.join(gone, "grp").where((F.col("_lost") >= F.col("begin_index")) & (F.col("_lost") < F.col("begin_index") + F.col("count")))
    rest = _grouped(rules, group, idx).join(gone, "grp").where(F.col(idx) != F.col("_lost"))
    rest = rest.groupBy("grp", "_lost").agg(*[F.bit_xor(f).alias(f"_x_{f}") for f in FIELDS])
    out = at.join(rest, ["grp", "_lost"], "left")
    return out.select(F.col("_lost").alias(idx), *[F.col(f"xor_{f}").bitwiseXOR(F.coalesce(f"_x_{f}", F.lit(0).cast("long"))).alias(f) for f in FIELDS])


def solve_two(p: Column, q: Column, ca: Column, cb: Column) -> tuple[Column, Column]:
    """(a, b) with a ^ b = p and ca * a ^ cb * b = q."""
    a = times(inverse_of(ca.bitwiseXOR(cb)), q.bitwiseXOR(times(cb, p)))
    return a, p.bitwiseXOR(a)


def recover_two_rules(parity: DataFrame, rules: DataFrame, lost: DataFrame, group: int = GROUP, idx: str = "idx") -> DataFrame:
    """(idx, fields) of the two rules lost from each group; lost: (grp, a, b), indexes with a <> b inside the group."""
    inside = lambda x: (F.col(x) >= F.col("begin_index")) & (F.col(x) < F.col("begin_index") + F.col("count"))
    at = parity.join(lost.select("grp", "a", "b"), "grp").where(inside("a") & inside("b") & (F.col("a") != F.col("b")))
    rows = _grouped(rules, group, idx).join(lost.select("grp", "a", "b"), "grp").where((F.col(idx) != F.col("a")) & (F.col(idx) != F.col("b")))
    weight = (F.col("_place") + 1).cast("int")
    sums = [x for f in FIELDS for x in (F.bit_xor(F.col(f).cast("long")).alias(f"_p_{f}"), F.bit_xor(times(weight, F.col(f))).alias(f"_q_{f}"))]
    out = at.join(rows.groupBy("grp", "a", "b").agg(*sums), ["grp", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    ca, cb = ((F.col(x) - F.col("begin_index") + 1).cast("int") for x in ("a", "b"))
    solved = {}
    for f in FIELDS:
        p, q = (F.col(f"{k}_{f}").bitwiseXOR(F.coalesce(f"_{k}_{f}", zero)) for k in "pq")
        solved[f] = solve_two(p, q, ca, cb)
    both = F.array(*[F.struct(F.col(x).alias(idx), *[solved[f][k].alias(f) for f in FIELDS]) for k, x in enumerate("ab")])
    return out.select(F.explode(both).alias("r")).select("r.*")


def _blocked(trails: DataFrame, block: int, key: str, symbols: str) -> DataFrame:
    starts = F.sequence(F.lit(0), F.floor((F.size(symbols) - 1) / block).cast("int"))
    cut = trails.where(F.size(symbols) > 0).select(key, F.posexplode(F.transform(starts, lambda k: F.slice(symbols, k * block + 1, block))).alias("block", "part"))
    return cut.withColumn("block", F.col("block").cast("long"))


def _xor(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def _weighted(part: Column) -> Column:
    weighted = F.transform(part, lambda x, i: times(i + 1, x))
    return _xor(weighted)


def trail_parity(trails: DataFrame, block: int = BLOCK, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    """(key, block, begin_index, count, xor_symbol); no shuffle. A block size of 0 gives no blocks."""
    out = _blocked(trails, block or 1, key, symbols)
    out = out.select(key, "block", (F.col("block") * (block or 1)).alias("begin_index"), F.size("part").cast("long").alias("count"), _xor(F.col("part")).alias("xor_symbol"))
    return out if block else _none(out)


def trail_dual_parity(trails: DataFrame, block: int = BLOCK, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    """(key, block, begin_index, count, p, q); sizes 0 and above 255 give no blocks."""
    size = block if 0 < block <= MOST else 1
    out = _blocked(trails, size, key, symbols)
    out = out.select(key, "block", (F.col("block") * size).alias("begin_index"), F.size("part").cast("long").alias("count"), _xor(F.col("part")).alias("p"), _weighted(F.col("part")).alias("q"))
    return out if 0 < block <= MOST else _none(out)


def _unique(tried: DataFrame, key: str) -> DataFrame:
    """Blocks with exactly one repair that the hash accepts."""
    good = tried.where(hash_symbols(F.col("repaired")) == F.col("hash"))
    found = good.groupBy(key, "block").agg(F.count_distinct("repaired").alias("n"), F.first("repaired").alias("repaired"))
    return found.where("n = 1").select(key, "block", "repaired")


def recover_one_symbol(hashes: DataFrame, parity: DataFrame, damaged: DataFrame, block: int = BLOCK, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    """(key, block, repaired) of the damaged trails' blocks in `parity`; ambiguous blocks give no row."""
    part = _blocked(damaged, block, key, symbols)
    at = parity.join(part, [key, "block"]).where(F.size("part") == F.col("count")).join(hashes, [key, "block"])
    # Whatever stands at a place, the symbol there must make up the parity.
    off = F.col("xor_symbol").bitwiseXOR(_xor(F.col("part")))
    tries = at.select(key, "block", "hash", F.explode(F.transform("part", lambda x, i: F.transform("part", lambda y, j: F.when(i == j, y.bitwiseXOR(off)).otherwise(y)))).alias("repaired"))
    return _unique(tries, key)


def recover_two_symbols(hashes: DataFrame, parity: DataFrame, damaged: DataFrame, block: int = BLOCK, key: str = "trail_id", symbols: str = "symbols") -> DataFrame:
    """As recover_one_symbol, for up to two damaged places, from P and Q; blocks of 2 to 255 symbols.

    For places a < b the two unknown errors solve the same pair of equations
    as two lost values, with the parities of the errors.
    """
    part = _blocked(damaged, block, key, symbols)
    at = parity.join(part, [key, "block"]).where((F.size("part") == F.col("count")) & F.col("count").between(2, MOST)).join(hashes, [key, "block"])
    at = at.withColumns({"_p": F.col("p").bitwiseXOR(_xor(F.col("part"))), "_q": F.col("q").bitwiseXOR(_weighted(F.col("part")))})
    at = at.withColumn("a", F.explode(F.sequence(F.lit(1), F.col("count").cast("int") - 1)))
    at = at.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("count").cast("int"))))
    ea, eb = solve_two(F.col("_p"), F.col("_q"), F.col("a"), F.col("b"))
    at = at.withColumn("_e", F.explode(F.array(F.struct(ea.alias("a"), eb.alias("b")))))  # a row, worked out once
    fix = F.transform("part", lambda x, i: F.when(i + 1 == F.col("a"), x.bitwiseXOR(F.col("_e.a"))).when(i + 1 == F.col("b"), x.bitwiseXOR(F.col("_e.b"))).otherwise(x))
    return _unique(at.select(key, "block", "hash", F.explode(F.array(fix)).alias("repaired")), key)
