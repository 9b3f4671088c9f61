"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as an embedding of the word and the mean of embeddings of its
character trigrams. Overlapping windows of words run through gated recurrent
units in both directions; attention weighs the states into one vector and a
logistic unit rates it. A text's rating is that of its worst window, over all
its windows. Everything is trained here, in numpy: labels are those of whole
texts, so each pass trains on the windows that the network itself rates worst.

Nulls are empty texts. A text without words has no window and gets the least
score. Repeated rows are scored alike. Without both labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm.common import WordHasher, pieces, table, utf8_buffer
from quillon.llm.quality import held_out

WIDTH, STRIDE = 16, 8
WORD_ROWS, GRAM_ROWS, EMBED, HIDDEN = 1 << 16, 1 << 14, 10, 8
#: Labelled rows that the network is trained on, at most, in hashed order and a third of them toxic.
LABELLED_ROWS = 6_000
#: How much more an error on a clean text weighs when the threshold is set.
CLEAN_WEIGHS = 3
TOXIC_FROM = 0.7
PIECE_BYTES = 1 << 19
BATCH = 4096


class Words:
    """Words of many texts: letters and digits of any script, A-Z as a-z."""

    def __init__(self):
        self.hasher = WordHasher([b for b in range(128) if not chr(b).isalnum()], fold_case=True)
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] = self.fold[97:123]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """(distinct words' table rows, their trigrams' rows and bounds, each word's number among the distinct, first)."""
        names, starts, ends, first = self.hasher.words(raw, offsets)
        if not len(names):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(1, np.int64), z, first
        distinct, at, number = np.unique(names, return_index=True, return_inverse=True)
        rows = (distinct >> np.uint64(40)).astype(np.int64) % WORD_ROWS
        a, n = starts[at], (ends - starts)[at]
        of = np.repeat(np.arange(len(at)), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = a[of] + inner
        c = self.fold[raw[place]]
        before = np.where(inner > 0, self.fold[raw[np.maximum(place - 1, 0)]], 2)
        after = np.where(inner < n[of] - 1, self.fold[raw[np.minimum(place + 1, len(raw) - 1)]], 3)
        gram = (before * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)).astype(np.uint32)
        gram = ((gram * np.uint32(0x27D4EB2F)) >> np.uint32(12)).astype(np.int64) % GRAM_ROWS
        return rows, gram, np.concatenate([[0], np.cumsum(n)]), number, first


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([windows, WIDTH] word positions, -1 past a text's end; each window's text). Every word is in some window, most in two."""
    n = np.diff(first)
    per = np.where(n > 0, np.maximum(1, -(-(n - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    at = start[:, None] + np.arange(WIDTH)
    return np.where(at < n[text][:, None], at + first[text][:, None], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and the forward and backward passes."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        d, h = 2 * EMBED, HIDDEN
        small = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": small(WORD_ROWS, EMBED), "gram": small(GRAM_ROWS, EMBED, s=0.3), "attend": small(2 * h), "out": small(2 * h, s=0.3), "bias": np.zeros(1, np.float32)}
        for way in ("f", "b"):
            self.p |= {f"{way}x": small(d, 3 * h, s=0.3), f"{way}h": small(h, 3 * h, s=0.3), f"{way}c": np.zeros(3 * h, np.float32)}
        self.scale, self.shift, self.fitted = 1.0, 0.0, False

    def inputs(self, rows: np.ndarray, gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["gram"][gram], bounds[:-1], axis=0) / np.diff(bounds)[:, None]
        return np.concatenate([self.p["word"][rows], chars], 1).astype(np.float32)

    def _run(self, way: str, proj: np.ndarray, idx: np.ndarray, keep: list | None) -> np.ndarray:
        """States [T, B, H] of one direction; proj holds each distinct word's input to the gates, and zeros at its end."""
        n, t = idx.shape
        h, hid = np.zeros((n, HIDDEN), np.float32), HIDDEN
        u = self.p[f"{way}h"]
        out = np.empty((t, n, hid), np.float32)
        for step in range(t) if way == "f" else range(t - 1, -1, -1):
            word = idx[:, step]
            x = proj[word]
            g = h @ u
            zr = _sigmoid(x[:, : 2 * hid] + g[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            c = np.tanh(x[:, 2 * hid :] + r * g[:, 2 * hid :])
            new = c + z * (h - c)
            on = (word >= 0)[:, None]
            new = np.where(on, new, h)
            if keep is not None:
                keep.append((step, h, g, z, r, c, on))
            h = new
            out[step] = h
        return out

    def forward(self, x: np.ndarray, idx: np.ndarray, train: bool = False):
        """Ratings of windows; idx numbers distinct words, -1 for none."""
        keeps: dict[str, list | None] = {w: [] if train else None for w in "fb"}
        states = []
        for way in "fb":
            proj = np.append(x @ self.p[f"{way}x"] + self.p[f"{way}c"], np.zeros((1, 3 * HIDDEN), np.float32), 0)
            states.append(self._run(way, proj, idx, keeps[way]))
        h = np.concatenate(states, 2)  # [T, B, 2H]
        on = (idx >= 0).T
        e = np.where(on, h @ self.p["attend"], -30)
        a = np.exp(e - e.max(0))
        a *= on
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, h)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (h, a, pooled, keeps)) if train else logit

    def backward(self, x: np.ndarray, idx: np.ndarray, saved, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x."""
        h, a, pooled, keeps = saved
        hid = HIDDEN
        g: dict[str, np.ndarray] = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("bh,tbh->tb", d_pool, h)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_h = a[:, :, None] * d_pool + d_e[:, :, None] * self.p["attend"]
        g["attend"] = np.einsum("tb,tbh->h", d_e, h)
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, wx = self.p[f"{way}h"], self.p[f"{way}x"]
            g_u, g_x, g_c = np.zeros_like(u), np.zeros_like(wx), np.zeros(3 * hid, np.float32)
            back = np.zeros((idx.shape[0], hid), np.float32)
            for step, before, gates, z, r, c, on in reversed(keeps[way]):
                d = back + d_h[step, :, k * hid : (k + 1) * hid]
                live = d * on
                d_c = live * (1 - z) * (1 - c * c)
                d_z = live * (before - c) * z * (1 - z)
                d_r = d_c * gates[:, 2 * hid :] * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_c * r], 1)
                d_in = np.concatenate([d_z, d_r, d_c], 1)
                g_u += before.T @ d_gate
                g_c += d_in.sum(0)
                word = idx[:, step]
                ok = word >= 0
                g_x += x[word[ok]].T @ d_in[ok]
                np.add.at(d_x, word[ok], d_in[ok] @ wx.T)
                back = np.where(on, live * z + d_gate @ u.T, d)
            g |= {f"{way}h": g_u, f"{way}x": g_x, f"{way}c": g_c}
        return g, d_x

    def rate(self, raw: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
        """The worst window's rating of each text; -inf without words."""
        rows, gram, bounds, number, first = words(raw, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        if not len(rows):
            return out
        at, text = windows_of(first)
        idx = np.where(at >= 0, number[np.maximum(at, 0)], -1)
        x = self.inputs(rows, gram, bounds)
        logits = np.concatenate([self.forward(x, idx[k : k + BATCH]) for k in range(0, len(idx), BATCH)])
        np.maximum.at(out, text, logits)
        return out

    def score(self, logit: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(logit), 0.5)
        return _sigmoid(np.clip(self.scale * np.maximum(logit, -50) + self.shift, -40, 40))


class Evidence:
    """Log-odds of the toxic label for each table row, by the texts that hold it, shrunk where they are few."""

    def __init__(self, rows: int):
        self.texts = np.zeros((2, rows))  # texts of each label that hold the row

    def add(self, item: np.ndarray, text: np.ndarray, label: np.ndarray) -> None:
        """Some texts, whole: which of them (numbered in `label`) hold which rows."""
        seen = np.unique(item.astype(np.int64) * len(label) + text)
        of, toxic = seen // len(label), label[seen % len(label)] == 1
        for k in (0, 1):
            self.texts[k] += np.bincount(of[toxic == k], minlength=self.texts.shape[1])

    def odds(self, n_clean: int, n_toxic: int) -> np.ndarray:
        clean, toxic = self.texts
        odds = np.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))
        sd = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        return np.where(np.abs(odds) > 2 * sd, np.clip(odds, -3, 3), 0.0)


def train(texts: list[str] | pa.Array, label: np.ndarray, epochs: int = 11, warm: int = 3, seed: int = 9) -> Network:
    """Fit by Adam.

    The first coordinate of each embedding starts from the log-odds of its
    word or trigram, and the first `warm` passes take each text's window with
    the most of that; the others take the window that the network rates worst.
    Each pass also takes windows at random from clean texts. The labels weigh
    alike, however many rows have each.
    """
    net = Network()
    if not len(label) or len(set(label.tolist())) < 2:
        return net
    raw, offsets = utf8_buffer(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    rows, gram, bounds, number, first = Words()(raw, offsets)
    at, text = windows_of(first)
    if not len(text):
        return net
    idx = np.where(at >= 0, number[np.maximum(at, 0)], -1).astype(np.int32)
    del at
    rng = np.random.Generator(np.random.PCG64(seed))
    own = np.unique(text)
    begin = np.searchsorted(text, own)
    size = np.diff(np.append(begin, len(text)))
    y = label[own].astype(np.float32)
    if len(set(y.tolist())) < 2:
        return net
    check = np.zeros(len(own), bool)  # set aside to scale the ratings
    for k in (0, 1):
        check[rng.permutation(np.flatnonzero(y == k))[: int((y == k).sum() * 0.2)]] = True
    heavy = float(np.clip((~check & (y == 0)).sum() / max((~check & (y == 1)).sum(), 1), 0.2, 20))
    # Log-odds from the texts that are fitted, some texts at a time.
    by_word, by_gram = Evidence(WORD_ROWS), Evidence(GRAM_ROWS)
    chosen = own[~check]
    for k in range(0, len(chosen), 256):
        some = chosen[k : k + 256]
        words = [np.unique(number[first[t] : first[t + 1]]) for t in some]
        n_words = np.array([len(w) for w in words])
        word, of = np.concatenate(words), np.repeat(np.arange(len(some)), n_words)
        by_word.add(rows[word], of, label[some])
        n_gram = np.diff(bounds)[word]
        inner = np.repeat(bounds[word], n_gram) + np.arange(n_gram.sum()) - np.repeat(np.cumsum(n_gram) - n_gram, n_gram)
        by_gram.add(gram[inner], np.repeat(of, n_gram), label[some])
    counts = (int((label[chosen] == 0).sum()), int((label[chosen] == 1).sum()))
    odds_word, odds_gram = by_word.odds(*counts), by_gram.odds(*counts)
    net.p["word"][:, 0] = odds_word * 0.5
    net.p["gram"][:, 0] = odds_gram * 0.5
    prior = odds_word[rows] + np.maximum.reduceat(odds_gram[gram], bounds[:-1])
    first_guess = np.where(idx >= 0, prior[np.maximum(idx, 0)], -9).max(1) + 0.01 * rng.random(len(idx))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0

    def all_logits() -> np.ndarray:
        x = net.inputs(rows, gram, bounds)
        return np.concatenate([net.forward(x, idx[k : k + BATCH]) for k in range(0, len(idx), BATCH)])

    def worst(logits: np.ndarray) -> np.ndarray:
        return np.lexsort((-logits, text))[begin]

    batch = int(np.clip((~check).sum() // 12, 16, 128))
    for epoch in range(epochs):
        some = begin + (rng.random(len(own)) * size).astype(np.int64)
        chosen = np.concatenate([worst(first_guess if epoch < warm else all_logits()), some[y == 0]])
        target, fit = np.concatenate([y, y[y == 0]]), np.concatenate([~check, ~check[y == 0]])
        order = rng.permutation(np.flatnonzero(fit))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            w = idx[chosen[pick]]
            used, local = np.unique(w, return_inverse=True)
            local = local.reshape(w.shape) - (used[0] == -1)
            used = used[used >= 0]
            n = (bounds[1:] - bounds[:-1])[used]
            inner = np.repeat(bounds[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            grams, part = gram[inner], np.concatenate([[0], np.cumsum(n)])
            x = net.inputs(rows[used], grams, part)
            logit, saved = net.forward(x, local, train=True)
            weight = np.where(target[pick] == 1, heavy, 1.0)
            d = ((_sigmoid(logit) - target[pick]) * weight / weight.sum()).astype(np.float32)
            g, d_x = net.backward(x, local, saved, d)
            g_word, g_gram = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g_word, rows[used], d_x[:, :EMBED])
            np.add.at(g_gram, grams, np.repeat(d_x[:, EMBED:] / n[:, None], n, axis=0))
            g |= {"word": g_word, "gram": g_gram}
            total = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink = min(1.0, 5.0 / max(total, 1e-9))
            steps += 1
            rate = 0.01 * (0.3 if epoch >= epochs * 0.7 else 1)
            for name, value in net.p.items():
                m, v = moments[name]
                grad = g[name] * shrink + 1e-5 * value
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
    top = np.maximum.reduceat(all_logits(), begin).astype(np.float64)
    aside = check if len(set(y[check].tolist())) > 1 else np.ones(len(own), bool)
    toxic, clean = np.sort(top[aside & (y == 1)]), np.sort(top[aside & (y == 0)])
    # The rating that parts the rows set aside best gets the score TOXIC_FROM; between ratings, nearer to the toxic side.
    edges = np.unique(np.concatenate([toxic, clean]))
    cuts = np.concatenate([edges[:1] - 1, edges[:-1] + 0.65 * np.diff(edges), edges[-1:] + 1])
    gain = (len(toxic) - np.searchsorted(toxic, cuts)) / len(toxic) + CLEAN_WEIGHS * np.searchsorted(clean, cuts) / len(clean)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    cut = float(cuts[best].mean())
    net.scale = float(np.clip(3 / max(np.median(toxic) - cut, 1e-3), 0.1, 10))
    net.shift = float(np.log(TOXIC_FROM / (1 - TOXIC_FROM)) - net.scale * cut)
    net.fitted = True
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = LABELLED_ROWS) -> Network:
    """Train on at most `rows` labelled documents, whole; a bound on what is trained on, not on what is scored."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(rows * (2 - k) // 3) for k in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most `rows` rows
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got.column("text"), got.column("label").to_numpy())


def rate(docs: DataFrame, net: Network, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with a score of every row's whole text; no shuffle. A column of that name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != column]
    schema = StructType([*[docs.schema[c] for c in keep], StructField(column, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the tables and gates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(batch.schema.get_field_index("text")))
            scores = [np.zeros(0)]
            for a, b in pieces(offsets, PIECE_BYTES):
                part = offsets[a : b + 1]
                scores.append(model.score(model.rate(raw[part[0] : part[-1]], part - part[0], words)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*kept, pa.array(np.concatenate(scores).astype(np.float64), pa.float64())], names=[*keep, column])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(held_out(1, 3), F.lit(False))
    net = learn(docs, table(spark, sf_dir, "labels").where(~out))
    scored = rate(docs, net, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
