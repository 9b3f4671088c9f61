import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import field
from quillon.functions.hashing import as_hex, hash_rule, hash_symbols
from quillon.operators import integrity, interleave, parity, policy
from quillon.sources import snapshot
from tests.helpers import fnv


def trails(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "trail_id long, symbols array<long>")


def rules(spark, n=10, seed=1):
    rng = random.Random(seed)
    return [(k, 256 + k, rng.randrange(2**40), rng.randrange(2**50), rng.randrange(10**6)) for k in range(n)]


RULES = "idx long, id long, left long, right long, frequency long"


def test_hash_vectors(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(x).cast("long") for x in v]
    assert one.select(hash_rule(*lit(256, 65, 66, 100)).alias("h")).first().h == 3163440783295580623
    rows = [[], [65, 256], [2**63 - 1, -1, 7]]
    got = [r.h for r in trails(spark, rows).select(as_hex(hash_symbols(F.col("symbols"))).alias("h")).collect()]
    assert got == [f"{fnv([len(t), *t]):016X}" for t in rows]
    assert got[1] == "C0DD620804A008BB" and int(got[0], 16) == 5187598658539770339


def test_field():
    assert field.multiply(2, 128) == 29 and field.multiply(3, 7) == 9
    assert field.inverse(0) == 0 and all(field.multiply(a, field.inverse(a)) == 1 for a in range(1, 256))


def test_times_in_lanes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(256), rng.randrange(2**64) - 2**63) for _ in range(50)]
    got = [r.v for r in spark.createDataFrame(rows, "c int, v long").select(field.times(F.col("c"), F.col("v")).alias("v")).collect()]
    for (c, v), g in zip(rows, got, strict=True):
        a, b = v % 2**64, g % 2**64
        assert all((b >> 8 * k) & 255 == field.multiply(c, (a >> 8 * k) & 255) for k in range(8))


def test_corruption_is_located(spark):
    data = rules(spark, 12)
    good = spark.createDataFrame(data, RULES)
    bad = [list(r) for r in data]
    bad[6][3] ^= 1
    known = integrity.rule_hashes(good)
    assert [r.idx for r in integrity.corrupted_rules(known, spark.createDataFrame(bad, RULES)).collect()] == [6]
    assert integrity.corrupted_rules(known, good).isEmpty()
    shorter = integrity.corrupted_rules(known, good.where("idx < 10"))
    assert sorted(r.idx for r in shorter.collect()) == [10, 11]
    t = [list(range(100, 130)), [], [5]]
    hashes = integrity.block_hashes(trails(spark, t), 8)
    t[0][17] ^= 1
    assert [(r.trail_id, r.block) for r in integrity.corrupted_blocks(hashes, trails(spark, t), 8).collect()] == [(0, 2)]
    whole = integrity.verify_trails(integrity.trail_hashes(trails(spark, [list(range(100, 130)), [], [5]])), trails(spark, t))
    assert {r.trail_id: r.intact for r in whole.collect()} == {0: False, 1: True, 2: True}
    assert integrity.block_hashes(trails(spark, [list(range(65))]), 0).count() == 2


def test_rule_recovery(spark):
    data = rules(spark, 11)
    good = spark.createDataFrame(data, RULES)
    damaged = [list(r) for r in data]
    damaged[1][2] ^= 0x55
    damaged[1][4] ^= 3
    lost = spark.createDataFrame([(1,), (10,), (99,)], "idx long")
    got = parity.recover_one_rule(parity.rule_parity(good, 4), spark.createDataFrame(damaged, RULES), lost, 4)
    assert sorted(tuple(r) for r in got.select("idx", "id", "left", "right", "frequency").collect()) == [data[1], data[10]]
    damaged[2][3] ^= 0xABCDE
    two = spark.createDataFrame([(0, 1, 2), (2, 8, 8), (2, 8, 30)], "grp long, a long, b long")
    got = parity.recover_two_rules(parity.rule_dual_parity(good, 4), spark.createDataFrame(damaged, RULES), two, 4)
    assert sorted(tuple(r) for r in got.select("idx", "id", "left", "right", "frequency").collect()) == [data[1], data[2]]
    assert parity.rule_parity(good, 0).isEmpty() and parity.rule_dual_parity(good, 0).isEmpty() and parity.rule_dual_parity(good, 256).isEmpty()


def test_dual_parity_vector(spark):
    row = parity.trail_dual_parity(trails(spark, [[65, 256, 258, 67]]), 4).first()
    assert row.p == 0 and row.q == 0x156


def test_trail_recovery(spark):
    rng = random.Random(5)
    t = [[rng.randrange(256, 300) for _ in range(20)], [7, 8, 9]]
    good = trails(spark, t)
    hashes = integrity.block_hashes(good, 8)
    one = [list(x) for x in t]
    one[0][12] ^= 0x1234
    damaged = trails(spark, one)
    got = parity.recover_one_symbol(hashes, parity.trail_parity(good, 8), damaged, 8)
    assert {(r.trail_id, r.block): r.repaired for r in got.collect()}[0, 1] == t[0][8:16]
    one[0][8] ^= 0x55
    got = parity.recover_two_symbols(hashes, parity.trail_dual_parity(good, 8), trails(spark, one), 8)
    assert {(r.trail_id, r.block): r.repaired for r in got.collect()}[0, 1] == t[0][8:16]
    three = [list(x) for x in one]
    three[0][10] ^= 1
    got = parity.recover_two_symbols(hashes, parity.trail_dual_parity(good, 8), trails(spark, three), 8)
    assert (0, 1) not in {(r.trail_id, r.block) for r in got.collect()}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 127, 128, 4096])
def test_interleaving(spark, n):
    got = [r.idx for r in interleave.interleaved_order(spark, n, 64).orderBy("pos").collect()]
    lanes = max(1, min(64, n))
    assert got == [i for lane in range(lanes) for i in range(lane, n, lanes)]


def test_interleaving_small(spark):
    assert [r.idx for r in interleave.interleaved_order(spark, 5, 2).orderBy("pos").collect()] == [0, 2, 4, 1, 3]


def test_trail_policy(spark):
    t = spark.createDataFrame(
        [(0, [256, 258, 256, 258, 256]), (1, [88, 89, 90, 81, 82]), (2, [257, 257, 258, 257, 258]), (3, [97, 98, 99])], "trail_index long, symbols array<long>"
    )
    a = spark.createDataFrame([(0, 1000), (1, 1), (2, 100)], "trail_index long, access_count long")
    rows = policy.trail_protection(t, a, 3, 0.5, 0.75).orderBy("trail_index").collect()
    assert [r.shared_rule_fraction for r in rows] == [1, 0, 1, 0]
    assert [round(r.criticality, 10) for r in rows] == [7.8379307262, 0.8723231275, 5.5442964638, 0.1386294361]
    assert [r.profile for r in rows] == ["Strong", "Light", "Medium", "Light"] and rows[3].access_count == 0


def test_rule_policy_and_buckets(spark):
    r = spark.createDataFrame([(256, 3072), (257, 1024), (258, 2048), (259, 1024)], "id long, frequency long")
    u = spark.createDataFrame([(256, 30720), (257, 10240), (259, 1024)], "id long, usage long")
    d = policy.rule_protection(r, u).orderBy("id")
    assert [x.profile for x in d.collect()] == ["Strong", "Light", "Light", "Light"]
    assert [x.usage for x in d.collect()] == [30720, 10240, 0, 1024]
    got = {x.profile: x.positions for x in policy.buckets(d.withColumn("idx", F.col("id") - 256)).collect()}
    assert got == {"Strong": [0], "Light": [1, 2, 3]}
    zero = policy.rule_protection(spark.createDataFrame([(256, 0), (257, 0)], "id long, frequency long"), u.where("id < 0"))
    assert {x.profile for x in zero.collect()} == {"Light"}
    cost = policy.parity_cost(d).first()
    assert cost.adaptive_parity == 6 + 3 * 2 and math.isclose(cost.saving_vs_strong, 1 - 12 / 24)
    assert policy.parity_cost(d.where("id < 0")).first().saving_vs_strong == 0


def test_quantile(spark):
    row = spark.range(1).select(policy.quantile(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.75).alias("q"), policy.quantile(F.array().cast("array<double>"), 0.5).alias("e")).first()
    assert row.q == 3.0 and row.e == 0.0


def test_snapshot_file_and_errors():
    rules_, trails_ = [(256, 65, 66, 3), (257, 256, 65, 2)], [[257, 1], []]
    data = snapshot.to_bytes(rules_, trails_)
    assert len(data) == 28 + 2 * 32 + (8 + 16) + 8
    assert snapshot.from_bytes(data + b"more") == (1, rules_, trails_)
    for bad in (b"", b"WRONGMAG" + data[8:], data[:-1], snapshot.to_bytes(rules_, trails_, 2), data[:12] + (10**9).to_bytes(8, "little") + data[20:]):
        with pytest.raises(ValueError):
            snapshot.from_bytes(bad)


def test_snapshot_tables(spark, tmp_path):
    r = spark.createDataFrame([(256, 65, 66, 3)], "id long, left long, right long, frequency long")
    snapshot.save_tables(r, trails(spark, [[256, 1], []]), str(tmp_path / "s"))
    back, t = snapshot.load_tables(spark, str(tmp_path / "s"))
    assert back.count() == 1 and {x.trail_id: x.symbols for x in t.collect()} == {0: [256, 1], 1: []}
    snapshot.save_tables(r.withColumn("left", F.lit(300).cast("long")), trails(spark, [[1]]), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        snapshot.load_tables(spark, str(tmp_path / "bad"))
