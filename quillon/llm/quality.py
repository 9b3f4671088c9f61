"""Quality by Bradley-Terry pairwise ranking.

Every document gets a strength that is linear in features of its text. The
weights are learned from preference pairs, a good document over a bad one, by
logistic loss on feature differences. A quantile of the strengths of the
labelled rows is the threshold; strengths are then mapped to 0..1 so that the
threshold falls on REJECT_BELOW.

Nulls are empty texts; an empty text has the features of no words and a score
like others. Without labelled pairs every score is the neutral 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm.common import WordHasher, pieces, table, utf8_buffer, windows

#: Labelled rows that the ranking is fitted on, at most, taken in hashed order and half from each label.
LABELLED_ROWS = 12_000
PAIRS = 60_000
REJECT_BELOW = 0.3
PIECE_BYTES = 1 << 19

_CLASSES: dict[str, bytes] = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "bar": b"|",
    "sign": b"#$%&*@^~+=<>\\/_{}[]",
    "quote": b"'\"()-`",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "words_log", "word_len", "word_len_dev", "long_words", "distinct_words", "distinct_fives", "echo", "bare_words", "signed_words", "line_len", "stop_rate", "one"]


def features(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """[texts, FEATURES] of whole texts given as bytes, in numpy."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    lut = np.zeros(256, np.int64)
    for k, chars in enumerate(_CLASSES.values()):
        lut[list(chars)] = k
    m = len(_CLASSES)
    kinds = lut[raw]
    counts = np.bincount(owner * m + kinds, minlength=n * m).reshape(n, m).astype(np.float64)
    rates = counts / np.maximum(size, 1)[:, None]
    names, starts, ends, first = hasher.words(raw, offsets)
    words = np.diff(first).astype(np.float64)
    w1 = np.maximum(words, 1)
    word_owner = np.repeat(np.arange(n), np.diff(first))
    per = lambda x: np.bincount(word_owner, weights=x, minlength=n) / w1
    length = (ends - starts).astype(np.float64)
    mean = per(length)
    dev = np.sqrt(np.maximum(per(length * length) - mean * mean, 0))

    def distinct(values: np.ndarray, who: np.ndarray) -> np.ndarray:
        keyed = (who.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20))
        keyed.sort()
        fresh = np.ones(len(keyed), bool)
        fresh[1:] = keyed[1:] != keyed[:-1]
        return np.bincount((keyed[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)

    fives = windows(names, 5, 5)
    inside = word_owner[4:] == word_owner[: len(fives)] if len(fives) else np.zeros(0, bool)
    five_owner = word_owner[: len(fives)][inside]
    n_fives = np.bincount(five_owner, minlength=n)
    echo = np.zeros(len(names))
    if len(names) > 1:
        echo[1:] = (names[1:] == names[:-1]) & (word_owner[1:] == word_owner[:-1])
    signs = np.isin(np.arange(256), list(_CLASSES["sign"] + _CLASSES["mark"] + _CLASSES["bar"]))[raw].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(signs)])
    signed = (upto[ends] - upto[starts]) > 0
    bare = (upto[ends] - upto[starts]) == ends - starts
    lines = counts[:, list(_CLASSES).index("line")] + 1
    more = [
        np.log1p(words), mean / 8, dev / 8, per(length > 20),
        distinct(names, word_owner) / w1 / np.maximum(1, w1) ** -0.15,
        (distinct(fives[inside], five_owner) + 1) / (n_fives + 1),
        per(echo), per(bare), per(signed), np.log1p(words / lines) / 4,
        counts[:, list(_CLASSES).index("stop")] / w1, np.ones(n),
    ]
    return np.concatenate([rates, np.stack(more, 1)], 1)


class Ranking:
    """Weights over standardised features, and the map from strength to score."""

    def __init__(self, n: int = len(FEATURES)):
        self.mean, self.scale, self.weights = np.zeros(n), np.ones(n), np.zeros(n)
        self.threshold, self.slope, self.fitted = 0.0, 1.0, False

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        base = np.log(REJECT_BELOW / (1 - REJECT_BELOW))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold) + base, -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Ranking:
    """Bradley-Terry: P(i preferred to j) = 1 / (1 + exp(-(s_i - s_j))), s linear in x."""
    out = Ranking(x.shape[1])
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return out
    out.mean, out.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - out.mean) / out.scale, -8, 8)
    rng = np.random.Generator(np.random.PCG64(seed))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, l2 = np.zeros(x.shape[1]), 1e-3
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        g = d.T @ (p - 1) / pairs + l2 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    out.weights, out.fitted = w, True
    s = z @ w
    # The quantile that parts the labels best, both counted alike; midway where a range does.
    values = np.sort(s)
    cuts = np.quantile(values, np.linspace(0, 1, 2001))
    gain = np.searchsorted(np.sort(s[bad]), cuts) / len(bad) - np.searchsorted(np.sort(s[good]), cuts) / len(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    out.threshold = float((cuts[best[0]] + cuts[best[-1]]) / 2)
    out.slope = float(np.clip(4 / max(np.median(s[good]) - out.threshold, 1e-3), 0.05, 20))
    return out


def _feature_rows(df: DataFrame) -> DataFrame:
    """(label, features) of a table with text and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(0))
            for a, b in pieces(offsets, PIECE_BYTES):
                part = offsets[a : b + 1]
                x = features(raw[part[0] : part[-1]], part - part[0], hasher)
                yield pa.record_batch([batch.column(1).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return df.select(F.col("text").cast("string"), F.col("label").cast("int")).mapInArrow(run, "label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS) -> Ranking:
    """Fit on at most `rows` labelled documents, whose ids alone are broadcast.

    The rows are the first of each label in hashed order; a bound on what the
    fit reads, not on what is scored.
    """
    each = rows // 2
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(each) for k in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most `rows` rows
    got = _feature_rows(docs.select("doc_id", "text").join(ids, "doc_id")).toArrow()
    if not got.num_rows:
        return Ranking()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = got.column("label").to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the same fit in whatever order rows arrive
    return fit(x[order], y[order])


def rate(docs: DataFrame, ranking: Ranking, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with a score of the whole text of every row; no shuffle. A column of that name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != column]
    schema = StructType([*[docs.schema[c] for c in keep], StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw, offsets = utf8_buffer(batch.column(at))
            scores = [np.zeros(0)]
            for a, b in pieces(offsets, PIECE_BYTES):
                part = offsets[a : b + 1]
                scores.append(ranking.score(features(raw[part[0] : part[-1]], part - part[0], hasher)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*kept, pa.array(np.concatenate(scores), pa.float64())], names=[*keep, column])

    return docs.mapInArrow(run, schema)


def held_out(fold: int, folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(held_out(0, 5), F.lit(False))
    ranking = learn(docs, table(spark, sf_dir, "labels").where(~out))
    scored = rate(docs, ranking, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
