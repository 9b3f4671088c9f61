"""Structural figures that are published for synthetic corpora."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.symbols import from_bytes
from quillon.operators import encoding, hierarchy, mining
from quillon.operators.mining import Gate
from quillon.sources import generators
from quillon.streaming import online
from tests.helpers import rep

MOTIF = list(b"ABCDABCD0000XYXY")


def corpus(spark, n, random):
    one = spark.range(1)
    if random:
        columns = [generators.xorshift_bytes(n, s) for s in (0x11111111, 0x22222222, 0x33333333, 0x44444444)]
    else:
        columns = [generators.patterned(MOTIF, n, *x) for x in ((0, 0), (1, 257), (3, 509), (5, 389))]
    return [bytes(x) for x in one.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()]


@pytest.mark.parametrize("random,rules,trail,new", [(False, 12, 77, 23), (True, 0, 1024, 997)])
def test_scale_figures(spark, random, rules, trail, new):
    datas = corpus(spark, 1024, random)
    df = spark.createDataFrame([(k, bytearray(d), d.hex().upper()) for k, d in enumerate(datas)], "sample_ord long, content binary, h string").withColumn("z", from_bytes(F.col("content")))
    found = mining.train(df.where("sample_ord < 3"), 128, Gate(4, 1.2, 0.001))
    assert len(found) == rules
    assert encoding.encode(df.where("sample_ord = 3"), found).first().trail_length == trail
    nodes = hierarchy.nodes(df, 8)
    fresh = nodes.groupBy("key").agg(F.min("ord").alias("first")).where("first = 3").count()
    assert fresh == new and df.withColumn("n", F.lit(1024)).select(hierarchy.trail_length("n", 8).alias("t")).first().t == 4


def test_order_sensitivity_figures():
    motifs = ["ABCDABCD00XYXY00", "mnopmnop12341234", bytes([0, 1, 2, 3, 0, 1, 2, 3, 255, 255, 0, 0, 9, 8, 9, 8]), "qrqrstst77889977", "LMNOLMNOaabbccaa", bytes([5, 5, 6, 6, 5, 5, 6, 6, 10, 11, 10, 11, 12, 13, 12, 13]), "uvwxuvwx22446622", "HIJKHIJKrrssttrr"]
    gate, n = Gate(4, 1.5, 0.001), 16 * 1024
    for order, count, cost in ((range(8), 85, 0.086189), (range(7, -1, -1), 86, 0.086197)):
        rules = []
        for k in order:
            rules += online.learn_sample(rep(motifs[k], n, k % 16), rules, 24, gate)
        got = sum(len(online.encode_one(rep(motifs[k], n, (k * 3 + 1) % 16), rules)) / n for k in range(8)) / 8
        assert len(rules) == count and round(got, 6) == cost


def test_first_cycle_of_consolidation(spark):
    gate = Gate(4, 1.5, 0.001)
    seen, probes = ([bytes(r.bytes) for r in generators.families(spark, 8, 4096, extra).orderBy("family").collect()] for extra in (0, 5))
    rules = []
    for data in seen:
        rules += online.learn_sample(data, rules, 16, gate)
    assert len(rules) == 104
    trails = spark.createDataFrame([(online.encode_one(x, rules),) for x in seen], "z string")
    rules = mining.consolidate(trails, rules, 64, gate)
    assert len(rules) == 152
    assert round(sum(len(online.encode_one(x, rules)) / len(x) for x in probes) / 8, 6) == 0.003265
