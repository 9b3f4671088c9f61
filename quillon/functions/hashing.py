"""64-bit FNV-style hashes within ANSI arithmetic.

Each step takes one byte: h = (h xor byte) * PRIME mod 2^64. As the prime is
2^40 + 435, the product is taken in 32-bit halves, none of which overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash.
OFFSET_BASIS = 1469598103934665603
PRIME = 1099511628211
_LOW = PRIME - (1 << 40)
_MASK = 0xFFFFFFFF


def step(h: Column, byte: Column) -> Column:
    x = h.bitwiseXOR(byte)
    low = x.bitwiseAND(_MASK) * _LOW
    high = F.shiftrightunsigned(x, 32) * _LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(_MASK), 8)
    return F.shiftleft(high.bitwiseAND(_MASK), 32).bitwiseOR(low.bitwiseAND(_MASK))


def mix(h: Column, value: Column) -> Column:
    """h after the eight bytes of value, lowest first."""
    value = value.cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(56), F.lit(8)), h, lambda acc, k: step(acc, _byte(value, k)))


def _byte(value: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, shift).bitwiseAND(0xFF)


def _fold(h: Column, values: Column) -> Column:
    """h after all values: one flat fold over (value, byte) places."""
    return F.aggregate(values, h, mix)


def hash_rule(rule_id: Column, left: Column, right: Column, frequency: Column) -> Column:
    values = F.array(*[c.cast("long") for c in (rule_id, left, right, frequency)])
    return _fold(F.lit(OFFSET_BASIS).cast("long"), values)


def hash_symbols(trail: Column) -> Column:
    """The length first, then the symbols."""
    start = mix(F.lit(OFFSET_BASIS).cast("long"), F.size(trail))
    return _fold(start, trail)


def as_hex(h: Column) -> Column:
    return F.lpad(F.hex(h), 16, "0")
