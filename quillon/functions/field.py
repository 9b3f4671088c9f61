"""GF(256) arithmetic on eight bytes at once, packed in a BIGINT.

The field's polynomial is x^8 + x^4 + x^3 + x^2 + 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REDUCE = 0x1D
_LOW7 = 0x7F7F7F7F7F7F7F7F
_ONES = 0x0101010101010101


def double(v: Column) -> Column:
    """Each byte times x."""
    carry = F.shiftrightunsigned(v, 7).bitwiseAND(_ONES) * _REDUCE
    return F.shiftleft(v.bitwiseAND(_LOW7), 1).bitwiseXOR(carry)


def times(coefficient: Column, v: Column) -> Column:
    """Each byte of v times a coefficient of 0 to 255."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), v.cast("long").alias("x"))

    def add(s: Column, k: Column) -> Column:
        on = F.call_function("shiftright", coefficient.cast("int"), k).bitwiseAND(1) == 1
        return F.struct(F.when(on, s["sum"].bitwiseXOR(s["x"])).otherwise(s["sum"]).alias("sum"), double(s["x"]).alias("x"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), start, add, lambda s: s["sum"])


def multiply(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11D if a & 0x80 else 0)
        b >>= 1
    return out


def inverse(a: int) -> int:
    """a^254; 0 for 0, which has none."""
    out = 1
    for _ in range(254):
        out = multiply(out, a)
    return out if a else 0


_INVERSES: list[int] = []


def inverse_of(a: Column) -> Column:
    """The inverse of a coefficient, from a table that the rule above fills."""
    if not _INVERSES:
        _INVERSES.extend(inverse(k) for k in range(256))
    return F.element_at(F.expr("array(" + ",".join(map(str, _INVERSES)) + ")"), a.cast("int") + 1).cast("long")
