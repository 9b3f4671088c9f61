"""Order MinHash fingerprints, in DataFrame operations alone.

A text's k-mers are runs of K words, numbered by occurrence, so that a k-mer
that comes again is another element. Each is hashed once; the hash range is a
ring, parted into equal slots. A slot's order of the elements is the ring's,
begun at the slot, so the TUPLE least elements of all, which may lie in later
slots, are selected, put back into text order and hashed as a tuple. Two texts
share a slot only where they share its elements in the same order, so likeness
falls with edits and with moves, in short texts as in long ones. (One hash,
begun at different places, stands in for a hash per sketch, which would cost
as many times as much as there are slots. Each slot has the chance of sharing
of a hash of its own, but slots of short texts depend on each other.)

A null text is empty. A text without words has only empty slots; one of fewer
than K words has the one k-mer of all its words. A text of fewer than TUPLE
k-mers has no tuple; it fills only the slot in which its k-mer lies. The likeness of two texts
without words is 1. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, table

K, TUPLE = 2, 2
#: Slots of a fingerprint, as a power of two.
SLOT_BITS = 6
#: Most buckets of rows that follow each other; tables of more than MOST_BUCKETS x 1024 rows have larger buckets.
MOST_BUCKETS = 1 << 16
#: Low bits that carry a position while hashes are sorted.
AT_BITS = 26
EMPTY_SLOT = "--------"


def bind(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slots(text: Column, k: int = K, take: int = TUPLE, slot_bits: int = SLOT_BITS) -> Column:
    """The fingerprint's slots: array of 8 hex digits each, or EMPTY_SLOT."""
    words = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    mask = (1 << AT_BITS) - 1

    def grams(w: Column) -> Column:
        whole = F.array(F.xxhash64(w))
        runs = F.transform(F.slice(w, 1, F.size(w) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    keyed = lambda h, at: h.bitwiseAND(~mask).bitwiseOR(at.cast("long").bitwiseAND(mask))
    sorted_grams = bind(words, lambda w: F.sort_array(F.transform(grams(w), keyed)))

    def numbered(s: Column) -> Column:
        name = lambda i: F.shiftright(F.get(s, i), AT_BITS)
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (name(i) != name(i - 1)))

        def runs(b: Column) -> Column:
            return F.flatten(
                F.transform(b, lambda a, r: F.transform(
                    F.slice(s, a + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - a),
                    lambda x, nth: keyed(F.xxhash64(F.shiftright(x, AT_BITS), nth), x.bitwiseAND(mask)),
                ))
            )

        return F.when(F.size(s) > 0, F.sort_array(bind(begins, runs))).otherwise(s)

    def sketch(e: Column) -> Column:
        n = 1 << slot_bits
        rank = lambda x: (F.shiftright(x, 64 - slot_bits) + n // 2).cast("int")  # noqa: E731  slots in the order of signed hashes
        begins = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (rank(F.get(e, i)) != rank(F.get(e, i - 1))))

        def filled(ring: Column, b: Column) -> Column:
            def digest(a: Column) -> Column:
                placed = F.sort_array(F.transform(F.slice(ring, a + 1, F.least(F.lit(take), F.size(e))), lambda x: F.struct(x.bitwiseAND(mask).alias("at"), F.shiftright(x, AT_BITS).alias("h"))))
                return F.lpad(F.hex(F.xxhash64(F.transform(placed, lambda x: x["h"])).bitwiseAND(0xFFFFFFFF)), 8, "0")

            lent = lambda v: F.when(F.size(e) >= take, v).otherwise(F.lit(EMPTY_SLOT))
            gap = lambda a, r: rank(F.get(e, a)) - F.coalesce(rank(F.get(e, F.get(b, r - 1))), F.lit(-1)) - 1
            upto = F.transform(b, lambda a, r: bind(digest(a), lambda v: F.concat(F.array_repeat(lent(v), gap(a, r)), F.array(v))))
            after = F.array_repeat(lent(digest(F.get(b, F.lit(0)))), n - 1 - rank(F.get(e, F.size(e) - 1)))
            return F.concat(F.flatten(upto), after)

        full = bind(F.concat(e, F.slice(e, 1, take - 1)), lambda ring: bind(begins, lambda b: filled(ring, b)))
        turned = bind(full, lambda x: F.concat(F.slice(x, n // 2 + 1, n // 2), F.slice(x, 1, n // 2)))
        return F.when(F.size(e) > 0, turned).otherwise(F.array_repeat(F.lit(EMPTY_SLOT), n))

    return bind(bind(sorted_grams, numbered), sketch)


def joined(marks: Column) -> Column:
    """A fingerprint's slots as one string."""
    return F.array_join(marks, "")


def parted(fingerprint: Column) -> Column:
    """The slots of a joined fingerprint."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{len(EMPTY_SLOT)}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Shared slots over the slots that either text fills, 0 to 1."""

    def of(pairs: Column) -> Column:
        filled = F.size(F.filter(pairs, lambda x: x["x"].isNotNull()))
        same = F.size(F.filter(pairs, lambda x: F.coalesce(x["x"], F.lit(False))))
        return F.when(filled == 0, F.lit(1.0)).otherwise(same.cast("double") / filled)

    flag = lambda x, y: F.struct(F.when((x != EMPTY_SLOT) | (y != EMPTY_SLOT), x == y).alias("x"))
    return bind(F.zip_with(a, b, flag), of)


def with_next(rows: DataFrame, order: str, carried: list[str], rows_per_bucket: int = 1024, prefix: str = "next_") -> DataFrame:
    """rows with `carried` columns of the next row by descending `order` (nulls last; after the last row, the first's).

    Rows are dealt by ranges of `order` to at most MOST_BUCKETS buckets; the first row
    of each bucket is also sent, as a guest, to the bucket before it. Only the
    bounds and first rows of the buckets (ids, no texts) pass the driver. Rows
    that tie in `order` follow each other by a hash of what they carry.
    """
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    tie = F.xxhash64(F.col(carried[0]).isNull(), F.col(carried[0]))
    ids = cut(rows.select(place.alias("_place"), tie.alias("_tie")))
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, n // rows_per_bucket))
    side = max(1, round(buckets**0.5))
    bounds = sorted(set(map(int, ids.approxQuantile("_place", [i / (side * side) for i in range(1, side * side)], 1 / (2 * side * side))))) if n and side > 1 else []
    if bounds:
        coarse = bounds[side - 1 :: side]
        fine = [bounds[i : i + side - 1] for i in range(0, len(bounds), side)]
        fine += [[]] * (len(coarse) + 1 - len(fine))
        longs = lambda xs: "array(" + ",".join(f"{x}L" if x > -(2**63) else "-9223372036854775807L - 1" for x in xs) + ")" if xs else "cast(array() AS array<bigint>)"
        top = F.size(F.filter(F.expr(longs(coarse)), lambda x: x < F.col("_place")))
        nested = F.expr("array(" + ",".join(longs(x) for x in fine) + ")")
        bucket = bind(top, lambda t: t * MOST_BUCKETS + F.size(F.filter(F.get(nested, t), lambda x: x < F.col("_place"))))
    else:
        bucket = F.lit(0)
    firsts = ids.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.max(F.struct("_place", (-F.col("_tie").cast("decimal(20,0)")).alias("t"), "_tie")).alias("f"))
    firsts = sorted(firsts.select("_bucket", "f._place", "f._tie").collect(), reverse=True)  # a row per bucket
    guests = [(f._place, f._tie, firsts[i - 1]._bucket) for i, f in enumerate(firsts)]
    guests = rows.sparkSession.createDataFrame(guests, "_place long, _tie long, _host int").hint("broadcast")
    keyed = rows.select(F.struct("*").alias("row"), place.alias("_place"), tie.alias("_tie")).withColumn("_bucket", bucket)
    dealt = keyed.join(guests, ["_place", "_tie"], "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g"))
    guest = F.struct(F.col("_host").alias("b"), F.lit(True).alias("g"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    w = Window.partitionBy("_to.b").orderBy("_to.g", F.desc("_place"), "_tie")
    out = dealt.select("row", "_to", *[F.lead(F.col("row")[c]).over(w).alias(prefix + c) for c in carried]).where("NOT _to.g")
    own_columns = [F.col("row")[c].alias(c) for c in rows.columns if c not in {prefix + x for x in carried}]
    return out.select(*own_columns, *[prefix + c for c in carried])


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("fingerprint", joined(slots(F.col("text"))))
    both = with_next(marked, "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 3).cast("int")))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = both.withColumn("edited_marks", slots(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        joined(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(parted(F.col("fingerprint")), F.col("edited_marks")).alias("near_edited"),
        likeness(parted(F.col("fingerprint")), parted(F.col("next_fingerprint"))).alias("near_next"),
    )
