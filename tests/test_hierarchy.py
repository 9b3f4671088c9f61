import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import hierarchy


def simulate(datas, layers):
    known, rows, trails = {}, [], []
    for data in datas:
        seq = list(data)
        for layer in range(1, layers + 1):
            if len(seq) < 2:
                break
            out = []
            for i in range(0, len(seq) - 1, 2):
                key = (seq[i], seq[i + 1])
                if key not in known:
                    known[key] = len(rows)
                    rows.append([256 + len(rows), *key, layer, 0])
                rows[known[key]][4] += 1
                out.append(rows[known[key]][0])
            if len(seq) % 2:
                out.append(seq[-1])
            seq = out
        trails.append(seq)
    return [tuple(r) for r in rows], trails


def frame(spark, datas):
    return spark.createDataFrame([(k, d.hex().upper()) for k, d in enumerate(datas)], "sample_ord long, h string")


@pytest.mark.parametrize("layers", [1, 3, 4])
def test_equals_simulation(spark, layers):
    rng = random.Random(layers)
    datas = [b"ABABABAB\0\0\0\0", b"", b"x", bytes(rng.choices(b"ab\0", k=77)), b"ABABABABABABABAB", bytes(rng.choices(range(256), k=33))]
    samples = frame(spark, datas)
    known = hierarchy.relations(hierarchy.nodes(samples, layers)).persist()
    rows, trails = simulate(datas, layers)
    got = [tuple(r) for r in known.orderBy("id").select("id", "left", "right", "layer", "ref_count").collect()]
    assert got == rows
    encoded = hierarchy.encode(samples, known, layers)
    by = {r.ord: r.t for r in encoded.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("t")).collect()}
    assert [[x.symbol for x in by.get(k, [])] for k in range(len(datas))] == trails
    back = {r.ord: r.h for r in hierarchy.decode(encoded, known).collect()}
    assert all(back.get(k, "") == d.hex().upper() for k, d in enumerate(datas))
    lengths = [r.n for r in samples.withColumn("n", (F.length("h") / 2).cast("long")).select(hierarchy.trail_length("n", layers).alias("n")).collect()]
    assert lengths == [len(t) for t in trails]


def test_unknown_symbol_fails(spark):
    known = hierarchy.relations(hierarchy.nodes(frame(spark, [b"ab"]), 1))
    bad = spark.createDataFrame([(0, 0, 999)], "ord long, pos long, symbol long")
    with pytest.raises(Exception):
        hierarchy.decode(bad, known).collect()
