import collections
import hashlib
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import licenses, mixing, ngram_join, order_minhash, packing, recompression
from quillon.llm.common import WordHasher, components, shingle_sets, utf8_buffer
from tests.llm.fixtures import clashing, documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- words ------------------------------------------------------------------


def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = [r[1] for r in rows()]
    raw, offsets = utf8_buffer(pa.array(texts))
    names, starts, ends, first = WordHasher().words(raw, offsets)
    for i, t in enumerate(texts):
        got = [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == WORD.findall(t or "")
    by = collections.defaultdict(set)
    for a, b, n in zip(starts, ends, names):
        by[raw[a:b].tobytes()].add(int(n))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# --- substring dedup --------------------------------------------------------


def strip_model(data, width=35):
    words = [WORD.findall(r[1] or "") for r in data]
    seen = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = collections.Counter()
    for r, w in zip(data, words):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[r[0], len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recompression_equals_brute_force(spark, seed):
    data = rows(seed=seed)
    got = recompression.strip_repeats(documents(spark, seed=seed), digest=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == strip_model(data)


def test_recompression_periodic_texts(spark):
    texts = ["a " * 120, "a " * 60 + "b", "b " + "a " * 36, "x y " * 80, "x y " * 17 + "z", ("p q r s t " * 30), "q r s t p " * 10, " ".join(str(i) for i in range(200)), " ".join(str(i) for i in range(30, 70))]
    data = [(k, t, "", "", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = recompression.strip_repeats(df, digest=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == strip_model(data)


def stripped(spark, texts):
    data = [(k, t, "", "", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = recompression.strip_repeats(df, digest=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    return collections.Counter(tuple(r) for r in got.collect()), data


@pytest.mark.parametrize("size", [1024, 2048])
def test_recompression_words_of_one_polynomial_are_different(spark, size):
    """The Thue-Morse word and its complement, which polynomial hashes modulo 2^64 confuse."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
    other = morse.translate(str.maketrans("ab", "ba"))
    line = " ".join(f"w{k}" for k in range(34))
    got, data = stripped(spark, [f"{line} {morse}", f"{line} {other}", f"{line} {morse} more"])
    assert got == strip_model(data) and sum(r[2] for r in got) == 70


def test_recompression_windows_of_one_polynomial_are_different(spark):
    """Windows of two words in the Thue-Morse order and its complement."""
    words = [["up", "down"][bin(k).count("1") % 2] for k in range(64)]
    got, data = stripped(spark, [" ".join(words), " ".join("up" if w == "down" else "down" for w in words), " ".join(words[5:60])])
    assert got == strip_model(data)


def test_recompression_long_runs_and_long_texts(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"n{k}" for k in rng.integers(0, 10**9, 120_000))  # over a megabyte
    words = long.split()
    got, data = stripped(spark, ["run " * 10_000, "x " + "run " * 34, long, " ".join(["other", *words[60_000:60_080], "end"]), "y" * 1_100_000])
    assert got == strip_model(data)


@pytest.mark.parametrize("often", [2, 64])
def test_recompression_a_common_anchor(spark, monkeypatch, often):
    """One line in half of all documents, in other surroundings each time, found in spread places too."""
    monkeypatch.setattr(recompression, "SEEN", 1)
    monkeypatch.setattr(recompression, "OFTEN", often)
    rng = np.random.default_rng(6)
    own = lambda n: " ".join(f"u{k}" for k in rng.integers(0, 10**9, n))
    line = " ".join(f"c{k}" for k in range(40))
    short = " ".join(f"s{k}" for k in range(20))
    texts = [f"{own(30 + k % 40)} {line} {own(20 + k % 30)}" for k in range(150)] + [f"{own(30)} {short} {own(40)}" for _ in range(120)] + [own(90) for _ in range(30)]
    texts += [texts[0], texts[160]]
    got, data = stripped(spark, texts)
    assert got == strip_model(data)


def test_word_names_are_their_own():
    import pyarrow as pa

    words = sorted({"".join(p)[:n] for n in (1, 2, 7, 8, 9, 14, 15, 16, 17, 40) for p in [("ab" * 20,), ("ba" * 20,), ("a" * 40,), ("\0" * 40,)]})
    raw, offsets = utf8_buffer(pa.array(words))
    high, low, _ = WordHasher().wide(raw, offsets)
    assert len(set(high.tolist())) == len(set(low.tolist())) == len(words)
    folded = WordHasher(fold_case=True).wide(*utf8_buffer(pa.array([w.upper() for w in words])))
    assert folded[0].tolist() == high.tolist()


def test_recompression_edges(spark):
    assert recompression.strip_repeats(empty(spark)).isEmpty()
    assert recompression.strip_repeats(clashing(spark), keep_text=True).count() == len(rows())


# --- n-gram join ------------------------------------------------------------


def join_model(data, threshold=0.8):
    sets = []
    for r in data:
        w = WORD.findall(r[1] or "")
        sets.append(frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n, parent = [0] * len(data), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, r in enumerate(data):
        least[find(k)].append(-1 if r[0] is None else r[0])
    return collections.Counter((-1 if r[0] is None else r[0], min(least[find(k)]), n[k]) for k, r in enumerate(data))


def test_ngram_join_equals_brute_force(spark):
    data = rows()
    got = ngram_join.join(documents(spark)).select("k1", "class_id", "n_links")
    assert collections.Counter(tuple(r) for r in got.collect()) == join_model(data)


def test_ngram_join_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 5)
    base = [f"w{i}" for i in range(150)]
    data = []
    for k in range(23):
        w = list(base)
        w[7 * (k % 20)] = f"new{k}"
        data.append((k, " ".join(w), "", "", 0))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = ngram_join.join(df).select("k1", "class_id", "n_links")
    assert collections.Counter(tuple(r) for r in got.collect()) == join_model(data)


def test_ngram_join_chains_in_large_buckets(spark, monkeypatch):
    """Texts that share most of their words with the next few only, beside near copies: buckets hold rows unlike their leader."""
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 6)
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 3)
    data = [(k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 100)), "", "", 0) for k in range(60)]
    base = [f"w{i}" for i in range(150)]
    data += [(100 + k, " ".join([*base[: 5 * k], f"new{k}", *base[5 * k + 1 :]]), "", "", 0) for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = ngram_join.join(df).select("k1", "class_id", "n_links")
    assert collections.Counter(tuple(r) for r in got.collect()) == join_model(data)


def test_forest_spans_what_all_pairs_do():
    rng = np.random.default_rng(3)
    for n, share in ((1, 0.5), (2, 0.0), (40, 0.02), (60, 0.05), (50, 0.9)):
        link = np.triu(rng.random((n, n)) < share, 1)
        link |= link.T
        asked = []
        edges = ngram_join.forest(n, lambda x, others: asked.append(len(others)) or link[x, others])
        assert all(link[x, y] for x, y in edges)
        names = np.arange(n)
        for _ in range(n):
            names = np.array([min([names[k], *names[link[k]]]) for k in range(n)])
        own = np.arange(n)
        for _ in range(n):
            for x, y in edges:
                own[x] = own[y] = min(own[x], own[y])
        assert (own == names).all() and len(edges) == n - len(set(names.tolist()))
    asked = []
    ngram_join.forest(1000, lambda x, others: asked.append(len(others)) or np.ones(len(others), bool))
    assert sum(asked) == 999  # near copies are held against one row


def test_ngram_join_finds_pairs_at_the_threshold_beside_a_large_group(spark):
    """1000 pairs of Jaccard 0.80 and a group of 250 near copies, of 31,125 pairs."""
    data = []
    for k in range(1000):
        w = [f"p{k}x{i}" for i in range(49)]  # 45 shingles, 5 of which a changed word touches
        data.append((2 * k, " ".join(w), "", "", 0))
        data.append((2 * k + 1, " ".join([*w[:20], "new", *w[21:]]), "", "", 0))
    base = [f"h{i}" for i in range(400)]
    for k in range(250):
        data.append((10000 + k, " ".join([*base[:-1], f"end{k}"]), "", "", 0))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.k1: (r.class_id, r.n_links) for r in ngram_join.join(df).select("k1", "class_id", "n_links").collect()}
    assert all(got[10000 + k] == (10000, 249) for k in range(250))
    assert sum(got[2 * k + 1] == (2 * k, 1) for k in range(1000)) >= 996


def test_ngram_join_depth_has_the_recall_at_the_threshold():
    for threshold in (0.5, 0.7, 0.8, 0.9, 0.95):
        depth = ngram_join.depth_for(threshold)
        assert ngram_join.found_share(threshold, depth) >= ngram_join.RECALL
        assert depth == ngram_join.DEPTH or ngram_join.found_share(threshold, depth + 1) < ngram_join.RECALL


def test_keep_one(spark):
    out = ngram_join.keep_one(clashing(spark))
    assert out.columns == clashing(spark).columns
    kept = [r.doc_id for r in out.collect()]
    model = join_model(rows())
    classes = {c for (d, c, _) in model if c is not None}
    words = [r for r in rows() if WORD.findall(r[1] or "")]
    with_words = {c for (d, c, n) in model} - {r[0] for r in rows() if not WORD.findall(r[1] or "")}
    assert classes and words and sorted(k for k in kept if k in with_words) == sorted(k for k in with_words if k != -1)
    assert len(kept) == len(set(kept) - {None}) + kept.count(None)
    assert ngram_join.keep_one(empty(spark)).isEmpty()


def test_keep_one_leaves_repeated_texts_without_words(spark):
    data = [(None, None, "en", "a", 0), (None, None, "de", "b", 0), (None, None, "de", "b", 0), (7, "", "en", "a", 0), (7, "", "en", "c", 0), (8, "some words", "en", "a", 10), (8, "some words", "en", "b", 10)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = collections.Counter((r.doc_id, r.lang, r.source) for r in ngram_join.keep_one(df).collect() if r.doc_id != 8)
    assert out == collections.Counter((r[0], r[2], r[3]) for r in data if r[0] != 8)
    assert ngram_join.keep_one(df).where("doc_id = 8").count() == 1


def test_shingle_sets():
    import pyarrow as pa

    raw, offsets = utf8_buffer(pa.array(["a b c d e f", "a b c d e f", "a b", "", "a b c d e a b c d e"]))
    names, _, _, first = WordHasher().words(raw, offsets)
    values, bounds = shingle_sets(names, first, 5)
    assert np.diff(bounds).tolist() == [2, 2, 1, 0, 5]
    assert values[0:2].tolist() == values[2:4].tolist()


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}


# --- fingerprints -----------------------------------------------------------


def test_order_minhash_query(spark, tmp_path):
    data = [r for r in rows() if r[0] is not None][:-1]  # distinct ids
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in order_minhash.op2_order_minhash(spark, str(tmp_path)).collect()}
    ordered = sorted(data, key=lambda r: -r[0])
    prints = {}
    for k, r in enumerate(ordered):
        text, nxt = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        x = got[r[0]]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1
        prints.setdefault(text, set()).add(x.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [got[r[0]] for r in ordered if len(WORD.findall(r[1] or "")) > 60]
    assert np.mean([x.near_edited for x in long]) > 0.15 > np.mean([x.near_next for x in long])


def minhash_model(text, k=2, take=2, bits=5):
    """Elements of each slot by plain counting, named by the k-mer and its occurrence."""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    seen, out = collections.Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def test_occurrences_and_order_matter(spark):
    texts = ["a b " * 40, "a b " * 41, "b a " * 40, " ".join(str(i) for i in range(60)), " ".join(str(i) for i in [*range(30, 60), *range(30)]), "", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    marks = {r.k: r.m for r in df.select("k", order_minhash.slots(F.col("text")).alias("m")).collect()}
    assert len(minhash_model(texts[0])) == 79
    full = sum(m != order_minhash.EMPTY_SLOT for m in marks[0])
    assert full > 20  # repeated k-mers are told apart by their occurrence
    assert marks[0] != marks[2] and marks[3] != marks[4]
    assert all(m == order_minhash.EMPTY_SLOT for m in marks[5])
    assert sum(m != order_minhash.EMPTY_SLOT for m in marks[6]) == 1
    pair = spark.createDataFrame([(marks[5], marks[5], marks[3], marks[4])], "a array<string>, b array<string>, c array<string>, d array<string>")
    got = pair.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("x"), order_minhash.likeness(F.col("c"), F.col("d")).alias("y"), order_minhash.likeness(F.col("a"), F.col("c")).alias("z")).first()
    assert got.x == 1.0 and 0 < got.y < 1 and got.z == 0.0


def order_model(text, sketches=64):
    """The tuples of a hash per sketch over all k-mers."""
    out = []
    for k in range(sketches):
        named = [(hashlib.md5(f"{k} {g}".encode()).digest(), at) for at, g in enumerate(minhash_model(text))]
        out.append(tuple(h for h, at in sorted(sorted(named)[:2], key=lambda x: x[1])))
    return out


def test_short_texts_keep_their_order(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    data, dealt = [], collections.defaultdict(list)
    for n in (20, 40, 60, 100, 120, 400):
        for _ in range(40):
            w = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            a, b = " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])
            data.append((n, a, b))
            dealt[n].append(np.mean([x == y for x, y in zip(order_model(a), order_model(b))]))
    df = spark.createDataFrame(data, "n int, a string, b string")
    got = df.select("n", order_minhash.likeness(order_minhash.slots(F.col("a")), order_minhash.slots(F.col("b"))).alias("x")).groupBy("n").agg(F.avg("x").alias("x"))
    got = {r.n: r.x for r in got.collect()}
    assert {n: abs(got[n] - np.mean(x)) < 0.08 for n, x in dealt.items()} == dict.fromkeys(dealt, True), (got, {n: np.mean(x) for n, x in dealt.items()})


def test_every_slot_of_a_text_with_a_tuple_is_filled(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d",), ("a b c d e f " * 40,)], "text string")
    for r in df.select(order_minhash.slots(F.col("text")).alias("m")).collect():
        assert len(r.m) == 64 and order_minhash.EMPTY_SLOT not in r.m


def test_with_next_over_many_buckets(spark):
    df = spark.createDataFrame([(k * k, f"t{k}") for k in range(101)], "doc_id long, text string").withColumn("next_text", F.lit(0))
    for per in (1, 7, 1000):
        got = {r.doc_id: r.next_text for r in order_minhash.with_next(df, "doc_id", ["text"], per).collect()}
        assert got == {k * k: f"t{(k - 1) % 101}" for k in range(101)}
    assert order_minhash.with_next(empty(spark), "doc_id", ["text"]).isEmpty()
    assert order_minhash.with_next(clashing(spark), "doc_id", ["text"], 3).count() == len(rows())


# --- licenses ---------------------------------------------------------------

NOT_SEPARATOR = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def license_model(text):
    words = NOT_SEPARATOR.findall((text or "").translate(FOLD))
    places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSE_TEXTS = [
    "Released under the MIT License.",
    "UNDER the mit---license under the MIT license\nunder THE mit LICENSE",
    "Licensed under the Apache License, Version 2.0; see CC-BY-NC and cc by nc",
    "cc by nc",
    "under the mit licenses; xunder the mit license",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "This is free software: GNU General Public License v3. SPDX-License-Identifier: MIT",
    "Kelvin K cc by nc İ under the mıt license",
    "", None, "no such thing", "All rights reserved.",
]


def test_license_base_equals_model_and_labels(spark, tmp_path):
    data = [(k, t, "", "", 0) for k, t in enumerate([*LICENSE_TEXTS, *[r[1] for r in rows()]])]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licenses.op8_licenses(spark, str(tmp_path)).collect()}
    for k, t, *_ in data:
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_model(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[0].labels == "mit" and got[5].labels == "gpl-3" and got[6].labels == "gpl-3,mit"
    assert "apache-2" in got[2].labels and got[10].labels == "" and got[10].score == 0


def test_rules_are_hundreds_and_gated():
    rules = licenses.rules()
    assert len(rules) > 200 and all(r["keywords"] and min(map(len, r["keywords"])) >= 2 for r in rules)
    assert licenses.keywords("(?:new|old) bsd? licen[sc]e") and licenses.keywords("a(?: b)? cde") == [" cde"]
    for r in rules:
        re.compile(r["pattern"])


def test_contained_hits_are_suppressed(spark):
    df = spark.createDataFrame([("creative commons attribution noncommercial sharealike 4 0 and cc by sa 4 0",)], "text string")
    assert sorted(licenses.scan(df).select("found.labels").first().labels) == ["cc-by-nc-sa", "cc-by-sa"]


# --- packing ----------------------------------------------------------------


def test_packing_round_trip(spark):
    encoder = packing.Encoder()
    from tokenizers import Tokenizer
    import public_tokenizers as P

    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = [r for r in rows() if r[0] is not None][:-1] + [(900, "a<|endoftext|>b  \n c", "", "", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("length", F.lit(1))
    pieces = packing.pack(df.repartition(3)).collect()
    import zlib

    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for k, text, *_ in data:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by[k], key=lambda p: p.start)
        assert own[0].doc_tokens == len(ids) and [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
        assert sum(p.length for p in own) == len(ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
        assert sum(p.length for p in own) == own[0].sequence_length <= 2048
    assert packing.pack(empty(spark)).isEmpty()


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        at = np.unique(np.append(rng.integers(1, n + 1, 12), n))
        pen = rng.integers(0, 5, len(at)).astype(float)
        window = 16
        if np.diff(at, prepend=0).max() > window:
            continue
        best = {0: 0.0}
        for b, p in zip(at.tolist(), pen.tolist()):
            best[b] = min(best[a] + window - (b - a) for a in list(best) if b - a <= window) + p
        cuts = packing.choose_cuts(n, at, pen, window)
        cost = sum(window - (b - a) + pen[list(at).index(b)] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == n and cost == best[n]


def test_split_tail():
    assert packing.split_tail(1024) == [1024] and sum(packing.split_tail(1337)) == 1337 and packing.split_tail(2047) == [2047]


# --- mixing -----------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([10, 10], [1, 1], 30, 2) == [15, 15]
    assert mixing.water_fill([100, 1], [1, 3], 150, 2) == [148, 2]
    assert mixing.water_fill([], [], 0, 2) == [] and mixing.water_fill([0, 0], [3, 1], 0, 2) == [0, 0]


def test_mix_meets_targets_and_repeats(spark):
    df = documents(spark, n=300)
    out = mixing.mix(df).persist()
    total = sum(len(WORD.findall(r[1] or "")) for r in rows(n=300))
    by = out.groupBy("row.source").agg(F.first("_target").alias("t"), F.sum(F.size("_shards") * F.col("_size")).alias("k"), F.max(F.size("_shards")).alias("c"), F.sum("_size").alias("s"), F.max("_size").alias("most"), F.first("_source_size").alias("ss")).collect()
    assert abs(sum(r.t for r in by) - 1.5 * total) < 1e-6
    for r in by:
        assert r.c <= 2 and abs(r.k - r.t) <= r.most and r.t <= 2 * r.s + 1e-9 and r.ss == r.s
    key = lambda d: sorted((str(r.row.doc_id), str(r.row.text)[:20], tuple(r._shards)) for r in d.collect())
    assert key(out) == key(mixing.mix(documents(spark, n=300).repartition(7)))
    assert mixing.mix(empty(spark)).isEmpty() and mixing.shuffled(empty(spark)).isEmpty()
    mixed = mixing.shuffled(clashing(spark))
    assert mixed.columns == clashing(spark).columns and mixed.count() > 0


def test_parts_of_shards_follow_the_rows(spark, monkeypatch):
    df = documents(spark, n=300)
    want = sorted(str(r.doc_id) for r in mixing.shuffled(df).collect())
    for rows_per_part in (1, 1 << 30):
        monkeypatch.setattr(mixing, "ROWS_PER_PART", rows_per_part)
        assert sorted(str(r.doc_id) for r in mixing.shuffled(df).collect()) == want


def test_split_tree_is_exact():
    q = np.array([100, 7, 0, 33])
    t = mixing.split_tree(q, 8, np.random.default_rng(1))
    assert t.shape == (8, 4) and (t.sum(0) == q).all() and t.min() >= 0 and t.sum(1).max() - t.sum(1).min() <= 1


# --- very long texts --------------------------------------------------------


def long_text(n=170_000):
    rng = np.random.default_rng(8)
    return " ".join(f"z{k}" for k in rng.integers(0, 50_000, n))


def test_licenses_on_a_long_text_of_notices(spark):
    import time

    text = "Released under the MIT license. " * 40_000  # 1.3 MB
    df = spark.createDataFrame([(1, text), (2, "released under the mit license")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in licenses.scan(df).selectExpr("doc_id", "size(hits) AS n", "found.labels AS labels", "hits[0].s AS s", "-hits[0].e AS e").collect()}
    assert time.time() - began < 60
    assert got[1].labels == got[2].labels == ["mit"] and got[1].n == 40_000 * got[2].n and (got[2].s, got[2].e) == (0, 5)


def test_other_operators_on_a_long_text(spark):
    text = long_text()
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text, "en", "a", 0), (2, text + " end", "en", "b", 0), (3, "y" * 1_000_001, "en", "a", 0), (4, "short one", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    links = {r.k1: r.n_links for r in ngram_join.join(df).collect()}
    assert links == {1: 1, 2: 1, 3: 0, 4: 0}
    marks = df.select("doc_id", order_minhash.slots(F.col("text")).alias("m"))
    near = marks.alias("a").join(marks.alias("b"), F.expr("a.doc_id = 1 AND b.doc_id = 2")).select(order_minhash.likeness(F.col("a.m"), F.col("b.m")).alias("x")).first().x
    assert near > 0.9
    assert packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").isEmpty()
    assert {r.row.doc_id: r._size for r in mixing.mix(df).select("row", "_size").collect()} == {1: 170_000, 2: 170_001, 3: 1, 4: 2}


# --- order MinHash against a model ------------------------------------------


def swapped_likeness(spark, n, texts=24):
    rng = np.random.default_rng(n)
    rows = []
    for k in range(texts):
        w = [f"v{x}" for x in rng.integers(0, 10**9, n)]
        rows.append((k, " ".join(w), " ".join([*w[n // 2 :], *w[: n // 2]])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    return df.select(F.avg(order_minhash.likeness(order_minhash.slots(F.col("a")), order_minhash.slots(F.col("b")))).alias("x")).first().x


def test_likeness_of_swapped_halves_does_not_depend_on_length(spark):
    found = [swapped_likeness(spark, n) for n in (40, 80, 300, 2000)]
    assert max(found) - min(found) < 0.1 and all(abs(x - 0.5) < 0.12 for x in found)


@pytest.mark.parametrize("window", [64, 100, 2048])
def test_packing_in_windows_of_any_size(spark, window):
    got = packing.pack(documents(spark).repartition(2), window=window)
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("sequence_length").alias("m")).collect()
    assert all(r.n == r.m <= window for r in used)
    parts = got.where("doc_id IS NOT NULL").groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert all(r.n % r.doc_tokens == 0 for r in parts)
