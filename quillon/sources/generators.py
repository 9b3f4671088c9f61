"""Synthetic samples by rule, as arrays of bytes in one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def repeat_pattern(motif: Column | list[int], n: int, phase: Column | int = 0) -> Column:
    """The motif over and over, from `phase` on."""
    m = motif if isinstance(motif, Column) else F.array(*[F.lit(x) for x in motif])
    phase = phase if isinstance(phase, Column) else F.lit(phase)
    return F.transform(positions(n), lambda i: F.get(m, F.pmod(i + phase, F.size(m))))


def family_motif(family: Column) -> Column:
    """The 16-byte motif of a family, with two pairs repeated."""
    raw = lambda i: F.pmod(family * 37 + i * 11 + F.pmod(i, F.lit(4)) * family, F.lit(256))
    source = {4: 0, 5: 1, 12: 8, 13: 9}
    return F.array(*[raw(F.lit(source.get(i, i))) for i in range(16)])


def families(spark: SparkSession, count: int = 32, n: int = 4096, extra: int = 0) -> DataFrame:
    """(family, bytes): each family's motif from phase (3 x family + extra) mod 16 on."""
    f = F.col("id").cast("int")
    return spark.range(count).select(F.col("id").alias("family"), repeat_pattern(family_motif(f), n, F.pmod(f * 3 + extra, F.lit(16))).alias("bytes"))


def patterned(motif: list[int], n: int, phase: int = 0, noise_period: int = 0) -> Column:
    """A motif whose every noise_period-th byte, but the first, is raised by its position."""
    plain = repeat_pattern(motif, n, phase)
    if not noise_period:
        return plain
    noisy = lambda b, i: F.when((i > 0) & (F.pmod(i, F.lit(noise_period)) == 0), F.pmod(b + i, F.lit(256))).otherwise(b)
    return F.transform(plain, noisy)


def sparse_noise(data: Column, period: int, salt: int) -> Column:
    """Every period-th byte xor (salt + position); a period of 0 changes nothing."""
    if not period:
        return data
    flip = lambda b, i: F.when(F.pmod(i, F.lit(period)) == 0, b.bitwiseXOR(F.pmod(F.lit(salt) + i.bitwiseAND(255), F.lit(256)).cast("int"))).otherwise(b)
    return F.transform(data, flip)


def xorshift_bytes(n: int, seed: int) -> Column:
    """Low bytes of a 32-bit xorshift sequence (13, 17, 5)."""
    mask = 0xFFFFFFFF

    def nxt(x: Column) -> Column:
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(mask))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        return x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(mask))

    start = F.struct(F.lit(seed & mask).cast("long").alias("x"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        return F.transform(F.array(nxt(s["x"])), lambda x: F.struct(x.alias("x"), F.concat(s["out"], F.array(x.bitwiseAND(255).cast("int"))).alias("out")))[0]

    return F.aggregate(positions(n), start, step, lambda s: s["out"])


def random_bytes(n: int, seed: int) -> Column:
    """Uniform bytes of Spark's own seeded generator; only their distribution is promised."""
    return F.transform(F.array_repeat(F.lit(0), n), lambda _: F.floor(F.rand(seed) * 256).cast("int"))


def mix_half(a: Column, b: Column) -> Column:
    """The first half of a and the second half of b."""
    half = F.floor(F.size(a) / 2).cast("int")
    return F.concat(F.slice(a, F.lit(1), half), F.slice(b, half + 1, F.size(b)))


def protection_corpus(spark: SparkSession, samples: int = 24, n: int = 4096) -> DataFrame:
    f = F.col("id").cast("int")
    byte = lambda i: F.pmod(f * 29 + F.pmod(i, F.lit(32)) * 7 + F.pmod(F.floor(i / 8).cast("int"), F.lit(5)) * f, F.lit(256)).cast("int")
    return spark.range(samples).select(F.col("id").alias("sample_ord"), F.transform(positions(n), byte).alias("bytes"))


def mixed_corpus(spark: SparkSession, samples: int = 24, n: int = 8192) -> DataFrame:
    """Runs of a family's capital, of its small letter, and bytes that move on by 13."""
    f = F.col("id").cast("int")
    family = F.pmod(f, F.lit(8))

    def byte(i: Column) -> Column:
        other = F.pmod(i * 13 + f * 7, F.lit(256))
        return F.when(F.pmod(i + f, F.lit(11)) < 5, family + ord("A")).when(F.pmod(i + 3 * f, F.lit(17)) < 8, family + ord("a")).otherwise(other)

    return spark.range(samples).select(F.col("id").alias("sample_ord"), F.transform(positions(n), byte).alias("bytes"))


def zipf_usage(spark: SparkSession, n: int = 1000) -> DataFrame:
    """(id, left, right, frequency, usage): usage falls as 1 / rank, birth frequency a thousandth of it and 2 at least."""
    usage = F.floor(F.lit(1e6) / (1 + F.col("id"))).cast("long")
    zero = F.lit(0).cast("long")
    return spark.range(n).select((F.col("id") + 256).alias("id"), zero.alias("left"), zero.alias("right"), F.greatest(F.lit(2).cast("long"), F.floor(usage / 1000)).cast("long").alias("frequency"), usage.alias("usage"))


def to_binary(data: Column) -> Column:
    """BINARY of an array of bytes."""
    return F.unhex(F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
