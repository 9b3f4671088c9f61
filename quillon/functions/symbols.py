"""Symbols as characters.

A trail is kept as ids (ARRAY<BIGINT>) at rest and as a string while it is
worked on, one code point to a symbol. Ids 0-255 are bytes, higher ones rules;
ids from 0xD800 on skip the surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_RULE = 256
GAP_AT, GAP = 0xD800, 0x800


def char_of(symbol: int) -> str:
    return chr(symbol if symbol < GAP_AT else symbol + GAP)


def symbol_of(char: Column) -> Column:
    """The id of a one-symbol string."""
    code = F.ascii(char)
    return F.when(code < GAP_AT, code).otherwise(code - GAP).cast("long")


def from_bytes(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def from_text(text: Column) -> Column:
    """The symbols of a text's UTF-8 bytes."""
    return from_bytes(F.encode(text, "UTF-8"))


def chars(z: Column) -> Column:
    """A symbol string's symbols, one string each; none for an empty one."""
    return F.when(F.length(z) > 0, F.split(z, "")).otherwise(F.array().cast("array<string>"))


def to_trail(z: Column) -> Column:
    return F.transform(chars(z), symbol_of)


def from_trail(trail: Column) -> Column:
    """A symbol string of an array of ids."""
    code = lambda s: F.when(s < GAP_AT, s).otherwise(s + GAP)
    return F.array_join(F.transform(trail, lambda s: F.decode(F.unhex(F.lpad(F.hex(code(s)), 8, "0")), "UTF-32")), "")
