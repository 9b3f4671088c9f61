"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random and kept as the signs of its coordinates,
with the factor f = <sign / sqrt(D), rotated o> that corrects the signs'
length. <sign / sqrt(D), rotated q> / f estimates <o, q> without bias, and f
bounds its error; several rotations are averaged. q is carried as one signed
byte per coordinate and the length of what the bytes leave out, which bounds
their error in every inner product.

Pairs meet in buckets: signs of further rotations, cut into bands whose width
follows the number of vectors and whose number follows the recall wanted at
the threshold. Only codes and bytes travel to the buckets. Pairs that an upper
bound rules out are dropped; the others join vectors into groups. A group's
vectors are then fetched once, and in it every pair that the codes leave open
is recomputed in double precision, so no pair below the threshold is linked.

Vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths do not link. Equal vectors are one class
and linked; a null vec_id is the least id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import by_group, components, cut, group_bounds, in_blocks, pieces, spanning, table

THRESHOLD, RECALL = 0.95, 0.995
ROTATIONS = 4
#: Standard deviations of the estimate that a pair must fall short by to be ruled out.
SURE = 5.0
BLOCK = 1024
#: Groups of at most this many rows are compared many at a time, pair by pair.
SMALL = 16
#: Coordinates that are unpacked at a time.
CELLS = 1 << 22


@cache
def rotation(dims: int, number: int) -> np.ndarray:
    """A random orthonormal matrix, the same everywhere."""
    rng = np.random.Generator(np.random.PCG64([dims, number, 977]))
    q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, factors) of unit vectors, for ROTATIONS rotations."""
    dims = unit.shape[1]
    signs, factors = [], []
    for k in range(ROTATIONS):
        y = unit @ rotation(dims, k).T
        signs.append(y >= 0)
        factors.append(np.abs(y).sum(1) / math.sqrt(dims))
    return np.packbits(np.concatenate(signs, 1), axis=1), np.stack(factors, 1)


def _scaled(codes: np.ndarray, factors: np.ndarray, dims: int) -> np.ndarray:
    """Codes as vectors whose inner product with _turned(q) estimates that of the coded vector with q."""
    signs = np.unpackbits(codes, axis=1, count=dims * ROTATIONS).astype(np.float32) * 2 - 1
    f = np.maximum(factors, 1e-6).astype(np.float32)
    return (signs.reshape(len(codes), ROTATIONS, dims) / (f[:, :, None] * np.float32(math.sqrt(dims) * ROTATIONS))).reshape(len(codes), -1)


def _turned(unit: np.ndarray) -> np.ndarray:
    return np.concatenate([unit @ rotation(unit.shape[1], k).T.astype(unit.dtype) for k in range(ROTATIONS)], 1).astype(np.float32)


def _deviation(factors: np.ndarray, dims: int) -> np.ndarray:
    f = np.maximum(factors, 1e-6)
    variance = (1 - np.minimum(f, 1) ** 2) / f**2 / max(dims - 1, 1)
    return np.sqrt(variance.sum(1)) / ROTATIONS


def estimates(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([codes, vectors] inner products as the codes tell them, each code's standard deviation)."""
    dims = unit.shape[1]
    return _scaled(codes, factors, dims) @ _turned(unit).T, _deviation(factors, dims)


def packed(unit: np.ndarray) -> np.ndarray:
    """[vectors, bytes]: sign codes, factors, signed bytes, their scale and the length of what they leave out."""
    codes, factors = encode(unit)
    scale = (np.abs(unit).max(1) / 127).astype(np.float32)
    short = np.rint(unit / scale[:, None]).clip(-127, 127).astype(np.int8)
    left = np.linalg.norm(unit - short * scale[:, None].astype(np.float64), axis=1)
    floats = np.concatenate([factors, scale[:, None], left[:, None] * (1 + 1e-6) + 1e-9], 1).astype(np.float32)
    return np.concatenate([codes, short.view(np.uint8), floats.view(np.uint8)], 1)


class Packed:
    """Rows of packed() to judge pairs by: which pairs may reach the threshold."""

    def __init__(self, raw: np.ndarray, dims: int, threshold: float):
        n = -(-dims * ROTATIONS // 8)
        floats = np.ascontiguousarray(raw[:, n + dims :]).view(np.float32)
        factors, scale, self.left = floats[:, :ROTATIONS], floats[:, ROTATIONS], floats[:, ROTATIONS + 1]
        self.unit = np.ascontiguousarray(raw[:, n : n + dims]).view(np.int8) * scale[:, None]
        self.codes, self.turned = _scaled(raw[:, :n], factors, dims), _turned(self.unit)
        self.need = threshold - 1e-3 - SURE * _deviation(factors, dims)  # of the estimate from a row's code
        self.threshold = threshold - 1e-5

    def _bytes_reach(self, inner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return inner + a + b + a * b >= self.threshold

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) stay open."""
        out = np.zeros(len(i), bool)
        step = max(1, CELLS // (4 * self.codes.shape[1]))
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            near = np.einsum("ij,ij->i", self.codes[a], self.turned[b]) + self.left[b] >= self.need[a]
            a, b, kept = a[near], b[near], np.flatnonzero(near)
            near = np.einsum("ij,ij->i", self.codes[b], self.turned[a]) + self.left[a] >= self.need[b]
            near &= self._bytes_reach(np.einsum("ij,ij->i", self.unit[a], self.unit[b]), self.left[a], self.left[b])
            out[at + kept[near]] = True
        return out

    def block(self, a: int, b: int) -> np.ndarray:
        """[rows, rows] of rows a to b: which pairs stay open."""
        left = self.left[a:b]
        out = self.codes[a:b] @ self.turned[a:b].T + left[None, :] >= self.need[a:b, None]
        out &= out.T.copy()
        out &= self._bytes_reach(self.unit[a:b] @ self.unit[a:b].T, left[:, None], left[None, :])
        np.fill_diagonal(out, False)
        return out


def linked(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of at least `threshold`: bounds first, then double precision."""
    norm = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / norm[:, None]
    guess, sd = estimates(*encode(unit), unit)
    open_ = guess + SURE * sd[:, None] + 1e-3 >= threshold
    open_ &= open_.T
    np.fill_diagonal(open_, False)
    a, b = np.nonzero(np.triu(open_))
    out = np.zeros_like(open_)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        ok = (vectors[i] * vectors[j]).sum(1) / (norm[i] * norm[j]) >= threshold
        out[i[ok], j[ok]] = True
    return out | out.T


def bands_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, bands): buckets of about a quarter vector each, and the recall at the threshold."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) + 2)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _coded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(rid, key): the bands of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(4099))
        weights = rng.integers(1, 2**62, (bands, bits), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for dims, at, x in _by_length(batch.column(1)):
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                turns = math.ceil(bits * bands / dims)
                signs = np.concatenate([unit @ rotation(dims, 1000 + k).T >= 0 for k in range(turns)], 1)[:, : bits * bands]
                signs = signs.reshape(len(x), bands, bits).astype(np.uint64)
                keys = (signs * weights).sum(2, dtype=np.uint64) + (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dims))
                rid = batch.column(0).take(pa.array(np.repeat(at, bands)))
                yield pa.record_batch([rid, pa.array(keys.reshape(-1).view(np.int64))], names=["rid", "key"])

    return classes.select("rid", "v").mapInArrow(run, "rid long, key long")


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for dims in np.unique(size):
        at = np.flatnonzero(size == dims)
        yield int(dims), at, flat[starts[at][:, None] + np.arange(dims)].astype(np.float64)


def _codes(classes: DataFrame) -> DataFrame:
    """(rid, dims, code) of classes (rid, v): what travels to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in _by_length(batch.column(1)):
                codes = pa.array([r.tobytes() for r in packed(x / np.sqrt((x * x).sum(1))[:, None])], pa.binary())
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dims, np.int32)), codes], names=["rid", "dims", "code"])

    return classes.select("rid", "v").mapInArrow(run, "rid long, dims int, code binary")


def _small_pairs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the groups of at most SMALL rows."""
    size, i, j = np.diff(bounds), [], []
    for n in range(2, SMALL + 1):
        starts = bounds[:-1][size == n]
        x, y = np.triu_indices(n, 1)
        i.append((starts[:, None] + x).reshape(-1))
        j.append((starts[:, None] + y).reshape(-1))
    return np.concatenate(i), np.concatenate(j)


def _open(threshold: float):
    """Within blocks of a bucket: (a, b) for a spanning forest of the pairs that the codes leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "ci", "cj"]
        for whole in by_group(batches, keys):
            of = whole.column("dims").to_numpy()
            for dims in np.unique(of).tolist():  # lengths that meet under one key are judged apart
                t = whole if (of == dims).all() else whole.filter(pa.array(of == dims))
                bounds, rid, side = group_bounds(t, keys), t.column("rid").to_numpy(), t.column("side").to_numpy()
                cross = t.column("ci").to_numpy() != t.column("cj").to_numpy()
                raw = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                edges = [np.zeros((0, 2), np.int64)]
                for a, b in pieces(bounds, CELLS // dims):
                    at = int(bounds[a])
                    local, end = bounds[a : b + 1] - at, int(bounds[b])
                    rows = Packed(raw[at:end], dims, threshold)
                    i, j = _small_pairs(local)
                    meet = ~cross[at + i] | (side[at + i] != side[at + j])
                    i, j = i[meet], j[meet]
                    near = rows.pairs(i, j)
                    i, j = i[near], j[near]
                    group = np.searchsorted(local, i, "right") - 1
                    order = np.argsort(group, kind="stable")
                    i, j, group = i[order], j[order], group[order]
                    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
                    single = cuts[:-1][np.diff(cuts) == 1]
                    edges.append(rid[at + np.stack([i[single], j[single]], 1)])
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        if y - x > 1:
                            start, stop = local[group[x]], local[group[x] + 1]
                            link = np.zeros((stop - start, stop - start), bool)
                            link[i[x:y] - start, j[x:y] - start] = link[j[x:y] - start, i[x:y] - start] = True
                            edges.append(rid[at + start + np.array(spanning(link))])
                    for k in np.flatnonzero(np.diff(local) > SMALL):
                        start, stop = int(local[k]), int(local[k + 1])
                        link = rows.block(start, stop)
                        if cross[at + start]:
                            link &= side[at + start : at + stop, None] != side[None, at + start : at + stop]
                        edges.append(rid[at + start + np.array(spanning(link), np.int64).reshape(-1, 2)])
                found = np.concatenate(edges)
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _judge(threshold: float):
    """Within blocks of a group: (a, NULL, links), and (a, b, 0) for a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "ci", "cj"]
        for t in by_group(batches, keys):
            bounds = group_bounds(t, keys)
            rid, side, copies = (t.column(c).to_numpy() for c in ("rid", "side", "copies"))
            cross = t.column("ci").to_numpy() != t.column("cj").to_numpy()
            vectors = t.column("v").combine_chunks()
            rows: list[tuple] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for _, at, x in _by_length(vectors.slice(a, b - a)):
                    if len(at) < 2:
                        continue
                    own = a + at
                    link = linked(x, threshold)
                    if cross[a]:
                        link &= side[own][:, None] != side[own][None, :]
                    r, n = rid[own], link @ copies[own]
                    rows += [(int(x), None, int(k)) for x, k in zip(r, n, strict=True) if k]
                    rows += [(int(r[x]), int(r[y]), 0) for x, y in spanning(link)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    return run


_LINKS = "a long, b long, links long"


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors: ident, n_links, component_id, kept."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = vectors.select(F.col(ident).cast("long").alias("_id"), v.alias("v")).withColumn("good", F.coalesce(whole, F.lit(False)))
    own = own.withColumn("rid", F.when(F.col("good"), F.xxhash64("v")))
    # Cosines are those of the vectors given; components far from 1 are scaled by the largest, so that squares are finite.
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))
    classes = own.where("good").groupBy("rid", "v").agg(F.count("*").alias("copies"), F.min(F.coalesce("_id", F.lit(-(2**63)))).alias("least"))
    huge = F.array_max(F.transform("v", lambda y: F.abs(y)))
    classes = cut(classes.withColumn("v", F.when((huge > 1e100) | (huge < 1e-100), scaled).otherwise(F.col("v"))))
    bits, bands = bands_for(classes.count(), threshold, recall)
    met = in_blocks(_coded(classes, bits, bands), "key", "rid", BLOCK, wide=cut(_codes(classes)))
    near = components(met.mapInArrow(_open(threshold), "a long, b long"))
    members = near.select(F.col("node").alias("rid"), F.col("component").alias("grp"))
    judged = in_blocks(members, "grp", "rid", BLOCK, wide=classes.select("rid", "v", "copies"))
    exact = cut(judged.mapInArrow(_judge(threshold), _LINKS))
    links = exact.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    groups = components(exact.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rid"), F.col("component").alias("grp"))
    about = classes.select("rid", "copies", "least").join(links, "rid", "left").join(groups, "rid", "left")
    about = about.select("rid", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("grp", "rid").alias("grp"))
    lowest = about.groupBy("grp").agg(F.min("least").alias("component"))
    about = about.join(lowest, "grp").select("rid", "n_links", "component")
    out = own.select("_id", "rid").join(about, "rid", "left")
    component = F.coalesce(F.when(F.col("component") > -(2**63), F.col("component")), F.col("_id"))
    return out.select(
        F.col("_id").alias(ident),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.a
), comp AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id)""",
}
