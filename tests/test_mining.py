import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.symbols import char_of, from_bytes, from_trail, to_trail
from quillon.operators import encoding, mining
from quillon.operators.mining import Gate, Rule
from tests.helpers import encode, mine, rep


def samples(spark, datas):
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(datas)], "ord long, content binary")
    return df.withColumn("z", from_bytes(F.col("content")))


def as_tuples(rules):
    return [(r.id, r.left, r.right, r.frequency) for r in rules]


CASES = [
    ([b"ABABABAB", b"ABABCDAB", bytes(6) + b"\1\2"], 16, Gate(2, 1.0, 0.0), [(256, 65, 66, 7), (257, 0, 0, 5), (258, 257, 257, 2), (259, 256, 256, 4)]),
    ([b"ABABABAB", b"ABABCDAB", b"ABCDABCD"], 32, Gate(2, 1.0, 0.0), [(256, 65, 66, 9), (257, 67, 68, 3), (258, 256, 257, 3), (259, 256, 256, 3)]),
    ([], 4, Gate(), []),
    ([b"", b"A"], 4, Gate(), []),
]


@pytest.mark.parametrize("datas,budget,gate,expected", CASES)
def test_train_fixed_cases(spark, datas, budget, gate, expected):
    got = as_tuples(mining.train(samples(spark, datas), budget, gate))
    assert got[: len(expected)] == expected
    assert got == mine(datas, 256, budget, gate)


def test_train_long_loop_cuts_lineage(spark):
    datas = [rep("ABABCDCD0000XYXY", 300, k) + rep("mnopmnop12341234", 200, k) for k in range(4)]
    assert as_tuples(mining.train(samples(spark, datas), 30, Gate(3, 1.2, 0.001))) == mine(datas, 256, 30, Gate(3, 1.2, 0.001))


def prose(words=6000, seed=5):
    """Invented text of 400 words, the first ones the most common."""
    draw = random.Random(seed)
    known = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 7))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [" ".join(draw.choices(known, weights, k=words // 20)).encode() for _ in range(20)]


def test_train_takes_few_passes(spark, monkeypatch):
    """Some guesses that come in another order than the rules do not end a pass."""
    datas, gate, real, passes = prose(), Gate(4, 1.5, 0.001), mining._changes, []
    monkeypatch.setattr(mining, "SAMPLE", 1 << 12)
    monkeypatch.setattr(mining, "_changes", lambda *a: passes.append(1) or real(*a))
    got = as_tuples(mining.train(samples(spark, datas), 64, gate))
    assert got == mine(datas, 256, 64, gate) and len(got) == 64
    assert len(passes) <= 10


def test_consolidate_takes_few_passes(spark, monkeypatch):
    datas, gate, real, passes = prose(), Gate(4, 1.5, 0.001), mining._changes, []
    rules = [Rule(*r) for r in mine(datas, 256, 4, gate)]
    trails = encoding.encode(samples(spark, datas), rules).select(F.col("encoded").alias("z"))
    monkeypatch.setattr(mining, "SAMPLE", 1 << 12)
    monkeypatch.setattr(mining, "_changes", lambda *a: passes.append(1) or real(*a))
    got = as_tuples(mining.consolidate(trails, rules, 32, gate)[4:])
    assert got == mine([encode(x, as_tuples(rules)) for x in datas], 260, 32, gate) and len(got) == 32
    assert len(passes) <= 6


@pytest.mark.parametrize("dense", [1, 1 << 10])
def test_train_by_poor_guesses_writes_samples_anew(spark, monkeypatch, dense):
    datas, gate = [*prose(600), bytes(700), b"ABABABA" * 9], Gate(4, 1.2, 0.001)
    for name, value in (("SAMPLE", 60), ("CHUNK", 500), ("REPLAYED", 20), ("DENSE", dense)):
        monkeypatch.setattr(mining, name, value)
    assert as_tuples(mining.train(samples(spark, datas), 40, gate)) == mine(datas, 256, 40, gate)


def test_train_on_large_symbols_and_on_the_rules_own_numbers(spark):
    sequences = [[5, 70000, 0xD7FF, 0xD800, 5, 70000, 0xD800, 0xD800, 0xD800, 256, 257, 256, 257] * 3, [256, 256, 5, 5, 70000, 257] * 5, [9]]
    z = spark.createDataFrame([(s,) for s in sequences], "t array<long>").select(from_trail(F.col("t")).alias("z"))
    for first in (70001, 256):
        got = as_tuples(mining._mine(z, first, 12, Gate()))
        assert got == mine(sequences, first, 12, Gate())


def test_guesses_come_from_few_long_samples_too(spark, monkeypatch):
    monkeypatch.setattr(mining, "SAMPLE", 1000)
    z = samples(spark, [b"ABCDEFGH" * 5000]).select("z")
    assert 500 <= sum(map(len, mining._some(z, 40000))) <= 4064


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ABCD", max_size=60), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_guesses_in_any_order_give_only_right_rules(texts, draw):
    datas, gate = [t.encode("latin-1") for t in texts if len(t) > 1], Gate(1, 0.0, 0.0)
    truth = [Rule(*r) for r in mine(datas, 256, 8, gate)]
    if not truth:
        return
    order = []
    while len(order) < len(truth):  # a guess uses earlier ones only
        order.append(draw.choice([k for k, r in enumerate(truth) if k not in order and all(s < 256 or s - 256 in order for s in (r.left, r.right))]))
    new = {256 + k: 256 + at for at, k in enumerate(order)}
    guess = [Rule(new[truth[k].id], new.get(truth[k].left, truth[k].left), new.get(truth[k].right, truth[k].right), 0) for k in order]
    end = 300

    def line():
        z, ends = mining._laid_out([t for t in texts if len(t) > 1])
        return mining._Line(z, ends, end)

    def counted(line):
        z = line.z[line.z <= end].astype(int)
        pairs = [(a << 32) | b for a, b in zip(z.tolist(), z[1:].tolist()) if end not in (a, b)]
        return mining.Counts(np.array(pairs, np.int64), np.ones(len(pairs), np.int64))

    work, changes, start = line(), [], counted(line())
    for r in guess:
        hits, joins, *sides = work.replace(r.left, r.right, r.id)
        changes.append(mining.Change.of(r, end, hits, joins, *(np.unique(s, return_counts=True) for s in sides)))
    taken, after = mining._kept(start, guess, changes, gate, len(truth), True)
    assert taken == truth[: len(taken)]
    assert order[0] != 0 or taken
    expected = line()
    for r in taken:
        expected.replace(r.left, r.right, r.id)
    expected = counted(expected)
    assert after.pairs.tolist() == expected.pairs.tolist() and after.n.tolist() == expected.n.tolist()


def test_consolidate_appends_and_may_repeat_a_pair(spark):
    rules = [Rule(256, 65, 66, 9)]
    raw = samples(spark, [b"ABABABAB"]).select("z")
    got = mining.consolidate(raw, rules, 1, Gate())
    assert as_tuples(got) == [(256, 65, 66, 9), *mine([b"ABABABAB"], 257, 1, Gate())]


def test_pair_frequency_counts_overlaps(spark):
    df = samples(spark, [b"AAAA", b"BAAB", b"", b"ABAB"])
    assert mining.pair_frequency(df, 65, 65).first().n == 4
    assert mining.pair_frequency(df, 65, 66).first().n == 3


def test_encode_and_decode(spark):
    datas = [b"ABABABCD", b"XABABABY", b"", bytes(range(256))]
    rules = [Rule(*r) for r in mine([b"ABABABAB", b"ABABCDAB", bytes(6) + b"\1\2"], 256, 16, Gate(2, 1.0, 0.0))]
    out = encoding.encode(samples(spark, datas), rules)
    rows = out.select(to_trail(F.col("encoded")).alias("t"), encoding.decode(F.col("encoded"), rules).alias("b"), "rules_applied", "input_bytes").collect()
    for data, row in zip(datas, rows, strict=True):
        expected = encode(data, as_tuples(rules))
        assert row.t == expected and bytes(row.b) == data and row.rules_applied == len(data) - len(expected)
    assert rows[0].t == [259, 256, 67, 68] and rows[1].t == [88, 259, 256, 89]


def test_decode_fails_on_unknown_symbol(spark):
    bad = spark.createDataFrame([(char_of(300),)], "z string")
    with pytest.raises(Exception):
        bad.select(encoding.decode(F.col("z"), [])).collect()


def test_symbols_round_trip_beyond_surrogates(spark):
    trail = [0, 255, 256, 0xD7FF, 0xD800, 0xE000, 70000]
    df = spark.createDataFrame([(trail,)], "t array<long>")
    assert df.select(to_trail(from_trail(F.col("t"))).alias("t")).first().t == trail


def test_compiled_encoder(spark):
    corpus = [b"ABCDABCD0000XYXY"] * 2 + [b"mnopmnop12341234"]
    rules = [Rule(*r) for r in mine(corpus, 256, 64, Gate(2, 1.0, 0.0))]
    assert len(rules) == 16
    row = encoding.compiled_encode(samples(spark, [b"XYABCDABCD0000XY"]), rules).first()
    assert row.compiled_trail == [260, 268, 266, 266, 260] and row.matched_bytes == 16
    assert encoding.trie_node_count(spark, rules).first().nodes == 47
    empty = encoding.compiled_encode(samples(spark, [b"", b"q\n("]), []).collect()
    assert [r.compiled_trail for r in empty] == [[], [113, 10, 40]]


def test_load_rules_rejects_what_is_not_canonical():
    assert mining.load_rules([(256, 65, 66, 3), (257, 256, 256, 2)])
    for bad in ([(257, 1, 2, 3)], [(256, 256, 2, 3)], [(256, 1, 257, 3)]):
        with pytest.raises(ValueError):
            mining.load_rules(bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("AB", max_size=30), min_size=1, max_size=4))
def test_pair_counts_match_a_model(spark, texts):
    from collections import Counter

    got = {(r.left, r.right): r.n for r in mining.pair_counts(samples(spark, [t.encode() for t in texts])).collect()}
    assert got == dict(Counter((ord(a), ord(b)) for t in texts for a, b in zip(t, t[1:])))
