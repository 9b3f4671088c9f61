"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts become sets of five-word shingles; texts with equal sets are one class.
Each class gets a MinHash signature, read as TREES labels of DEPTH bytes. A
tree's sorted prefix trie groups the classes that share a label's prefix.
Prefixes are as long as still finds a pair at the threshold itself with the
target recall, so a pair is found alike whatever else the table holds. Pairs whose signatures agree well
enough join classes into candidate groups, and in each group every pair of
sets is compared exactly, in blocks of bounded size.

A text of fewer than five words has one shingle, of all its words. A text
without words (null, empty) links with nothing and is a class of its own.
Repeated rows are copies like others. Classes go by a 64-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import WordHasher, by_group, components, cut, group_bounds, in_blocks, mix64, pieces, shingle_sets, small_side, spanning, table, text_key, utf8_buffer

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 8
RECALL = 0.999
PIECE_BYTES = 1 << 19
#: Rows compared with each other in one go.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 512
#: A signature agreement this far below the threshold (4.5 standard deviations) rules a pair out.
SLACK = 4.5 * (0.16 / (TREES * DEPTH)) ** 0.5
#: Rows of ids that may be broadcast, 24 bytes each.
BROADCAST_ROWS = 1 << 20
#: Leaders of buckets that may be broadcast, some 230 bytes each.
LEADERS_BROADCAST = 1 << 16


def found_share(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """Chance that a pair shares some tree's prefix of the given depth."""
    p = similarity + (1 - similarity) / 256
    return 1 - (1 - p**depth) ** trees


def depth_for(threshold: float, target: float = RECALL) -> int:
    """The longest prefix by which a pair at the threshold is found with the target recall, or else one label byte."""
    return next((d for d in range(DEPTH, 1, -1) if found_share(threshold, d) >= target), 1)


class Minima:
    """Signatures of one byte per hash."""

    def __init__(self, n: int = TREES * DEPTH, seed: int = 31):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.by = rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 2**32, n, dtype=np.uint32)

    def __call__(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[texts, n] bytes; texts without shingles must be left out."""
        low = (values >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(bounds) - 1, len(self.by)), np.uint8)
        scratch = np.empty_like(low)
        for k in range(len(self.by)):
            np.multiply(low, self.by[k], out=scratch)
            np.add(scratch, self.plus[k], out=scratch)
            scratch ^= scratch >> np.uint32(15)
            scratch *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(scratch, bounds[:-1])
            out[:, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        return out


def _piece_sets(batch: pa.RecordBatch, hasher: WordHasher):
    raw, offsets = utf8_buffer(batch.column(batch.schema.get_field_index("text")))
    for a, b in pieces(offsets, PIECE_BYTES):
        part = offsets[a : b + 1]
        names, _, _, first = hasher.words(raw[part[0] : part[-1]], part - part[0])
        values, bounds = shingle_sets(names, first, WIDTH)
        yield a, b, values, bounds


def set_name(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values + np.uint64(0x51ED270B)))])
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix64(sums[bounds[1:]] - sums[bounds[:-1]] + n), np.uint64(0))


def signatures(docs: DataFrame) -> DataFrame:
    """(k1, k2, rid, sig): each row's class and signature; rid 0 and no signature for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minima = WordHasher(), Minima()
        for batch in batches:
            for a, b, values, bounds in _piece_sets(batch, hasher):
                rid = set_name(values, bounds).view(np.int64)
                full = np.flatnonzero(np.diff(bounds))
                sig = np.empty(b - a, object)
                if len(full):
                    for i, x in zip(full, minima(values, np.append(bounds[:-1][full], bounds[-1])), strict=True):
                        sig[i] = x.tobytes()
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(rid), pa.array(sig, pa.binary())], names=["k1", "k2", "rid", "sig"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, rid long, sig binary")


def _signature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Edges [m, 2] of a spanning forest over n rows; near(x, others) flags the others that x links with.

    Rows that are reached are compared no more, so a group of rows that are
    all near takes n comparisons, not their square.
    """
    left, edges = np.arange(n), [np.zeros((0, 2), np.int64)]
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = near(x, left)
            reached, left = left[hit], left[~hit]
            edges.append(np.stack([np.full(len(reached), x), reached], 1))
            stack += reached.tolist()
    return np.concatenate(edges)


def _alike(threshold: float):
    """Whether signatures whose bytes are equal where flagged may belong to a pair at the threshold."""
    return lambda equal: (equal.mean(-1) - 1 / 256) / (1 - 1 / 256) >= threshold - SLACK


def _agree(threshold: float):
    """Within blocks of a prefix's members: edges of a spanning forest of the pairs that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "ci", "cj"]
        alike = _alike(threshold)
        for t in by_group(batches, keys):
            bounds = group_bounds(t, keys)
            sig, rid, side, cross = _signature_matrix(t.column("sig")), t.column("rid").to_numpy(), t.column("side").to_numpy(), t.column("ci").to_numpy() != t.column("cj").to_numpy()
            size = np.diff(bounds)
            edges = [np.zeros((0, 2), np.int64)]
            two = bounds[:-1][(size == 2) & ~cross[bounds[:-1]]]
            if len(two):
                ok = alike(sig[two] == sig[two + 1])
                edges.append(rid[np.stack([two[ok], two[ok] + 1], 1)])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or (b - a == 2 and not cross[a]):
                    continue
                s, d = sig[a:b], side[a:b]

                def near(x: int, others: np.ndarray, s=s, d=d, across=bool(cross[a])) -> np.ndarray:
                    hit = d[others] != d[x] if across else np.ones(len(others), bool)
                    hit[hit] = alike(s[others[hit]] == s[x])
                    return hit

                edges.append(rid[a + forest(b - a, near)])
            found = np.concatenate(edges)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _beside_leader(threshold: float):
    """(key, rid, lead, near) of rows that carry sig and their bucket's leader's, lead_sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = _alike(threshold)
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                near = alike(_signature_matrix(t.column("sig")) == _signature_matrix(t.column("lead_sig")))
                yield pa.record_batch([*[batch.column(k) for k in range(3)], pa.array(near)], names=["key", "rid", "lead", "near"])

    return run


def candidates(classes: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(a, b): edges whose components hold the pairs that share a prefix of the depth for the target recall.

    A bucket of at most SIGNATURE_BLOCK rows is one block. Of a larger one all
    rows are held against its leader, the least; those that agree with it are
    joined by that, and only the others meet all of the bucket, in blocks. A
    bucket of near copies is thus read once, whatever its size.
    """
    prefix = f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(sig, t * {DEPTH} + 1, {depth_for(threshold, target)})))"
    keyed = classes.select("rid", F.explode(F.expr(prefix)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("lead")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    signed = classes.select("rid", "sig")
    one = F.lit(0)
    met = shared.where(F.col("n") <= SIGNATURE_BLOCK).select("rid", "key", one.alias("ci"), one.alias("cj"), one.alias("side"))
    found = met.join(signed, "rid").repartition("key").sortWithinPartitions("key", "ci", "cj").mapInArrow(_agree(threshold), "a long, b long")
    large = shared.where(F.col("n") > SIGNATURE_BLOCK)
    if large.isEmpty():
        return cut(found)
    leaders, _ = small_side(cut(large.select("key", "lead").distinct().join(signed.withColumnsRenamed({"rid": "lead", "sig": "lead_sig"}), "lead").drop("lead")), LEADERS_BROADCAST)
    beside = large.select("key", "rid", "lead").join(signed, "rid").join(leaders, "key")
    beside = cut(beside.select("key", "rid", "lead", "sig", "lead_sig").mapInArrow(_beside_leader(threshold), "key long, rid long, lead long, near boolean"))
    chunks = lambda n: F.ceil(n / SIGNATURE_BLOCK).cast("int")
    rest = beside.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("rest")).where("rest > 0")
    dealt = beside.join(rest.select("key", chunks(F.col("rest")).alias("_r"), chunks(F.col("n")).alias("_m")), "key")
    chunk = lambda k: F.pmod(F.xxhash64("rid", F.lit(17)), F.col(k)).cast("int")
    members = dealt.select("rid", "key", F.explode(F.expr("sequence(0, _r - 1)")).alias("ci"), (-1 - chunk("_m")).alias("cj"), F.lit(0).alias("side"))
    others = dealt.where("NOT near").select("rid", "key", chunk("_r").alias("ci"), F.explode(F.expr("sequence(-_m, -1)")).alias("cj"), F.lit(1).alias("side"))
    met = members.union(others).join(signed, "rid").repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
    return cut(found.union(met.mapInArrow(_agree(threshold), "a long, b long")).union(beside.where("near").select("lead", "rid")))


def _sets(docs: DataFrame) -> DataFrame:
    """(grp, rid, copies, shingles) of rows that carry grp, rid and copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, values, bounds in _piece_sets(batch, hasher):
                raw = [values[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                own = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("grp", "rid", "copies")]
                yield pa.record_batch([*own, pa.array(raw, pa.binary())], names=["grp", "rid", "copies", "shingles"])

    return docs.select("grp", "rid", "copies", "text").mapInArrow(run, "grp long, rid long, copies long, shingles binary")


def overlaps(sets: list[np.ndarray], cells: int = 1 << 25) -> np.ndarray:
    """How many values each two of the sets share, exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    values = np.concatenate(sets)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    many = times > 1
    place = np.cumsum(many) - 1
    kept = many[column]
    owner, column, width = owner[kept], place[column[kept]], int(many.sum())
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1, cells // max(n, 1))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((n, min(step, width - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = size
    return out


def _verify(threshold: float):
    """Exact links within blocks: (a, NULL, links) per class, and (a, b, 0) for a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "ci", "cj"]
        for t in by_group(batches, keys):
            bounds = group_bounds(t, keys)
            rid, side, copies = (t.column(c).to_numpy() for c in ("rid", "side", "copies"))
            cross = t.column("ci").to_numpy() != t.column("cj").to_numpy()
            raw = t.column("shingles").to_pylist()
            rows: list[tuple] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                keep = a + np.sort(np.unique(rid[a:b], return_index=True)[1])
                if len(keep) < 2:
                    continue
                sets = [np.frombuffer(raw[i], np.uint64) for i in keep]
                size = np.array([len(s) for s in sets], np.float64)
                shared = overlaps(sets).astype(np.float64)
                link = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
                link[np.arange(len(keep)), np.arange(len(keep))] = False
                if cross[a]:
                    link &= side[keep][:, None] != side[keep][None, :]
                links = link @ copies[keep]
                rows += [(int(rid[i]), None, int(n)) for i, n in zip(keep, links, strict=True) if n]
                rows += [(int(rid[keep[x]]), int(rid[keep[y]]), 0) for x, y in spanning(link)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: k1, k2 (its key), doc_id, class_id, n_links, class_key.

    class_id is the least doc_id that links reach; n_links counts the rows
    whose sets are at least `threshold` alike, copies included; class_key is
    equal for the rows of a class, and of no others.
    """
    keyed = docs.select("doc_id", "text").withColumns({
        "k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
        "k2": text_key(F.col("doc_id"), F.col("text")),
        "text": F.coalesce(F.col("text").cast("string"), F.lit("")),
    })
    signed = cut(signatures(keyed))
    worded = signed.where("rid <> 0")
    classes = worded.groupBy("rid").agg(F.min(F.struct("k1", "k2", "sig")).alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.select("rid", "first.k1", "first.k2", "first.sig", "copies"))
    groups = components(candidates(classes, threshold))
    chosen = cut(classes.drop("sig").join(groups.select(F.col("node").alias("rid"), F.col("component").alias("grp")), "rid"))
    side, _ = small_side(chosen, BROADCAST_ROWS)
    sets = _sets(keyed.join(side, ["k1", "k2"]))
    exact = cut(in_blocks(sets, "grp", "rid", SET_BLOCK).mapInArrow(_verify(threshold), "a long, b long, links long"))
    links = exact.where("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    linked = components(exact.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rid"), "component")
    about = classes.select("rid", "k1", "copies").join(links, "rid", "left").join(linked, "rid", "left")
    about = about.select("rid", "k1", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("class_key"))
    lowest = about.groupBy("class_key").agg(F.min("k1").alias("class_id"))
    about = about.drop("k1").join(lowest, "class_key")
    out = signed.select("k1", "k2", "rid").join(about, "rid", "left")
    return out.select(
        "k1", "k2",
        F.coalesce("class_id", "k1").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_key", F.xxhash64("k1", "k2")).alias("class_key"),
        F.col("rid").alias("set_key"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of near-duplicates: the least doc_id, then by hash; texts without words stay."""
    found = cut(join(docs, threshold))
    worded = found.where("set_key <> 0").groupBy("class_key").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    kept = worded.select("k.k1", "k.k2").union(found.where("set_key = 0").select("k1", "k2").distinct())
    again = found.where("set_key <> 0").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    kept = cut(kept.join(again.withColumn("again", F.lit(True)), ["k1", "k2"], "left"))
    side, _ = small_side(kept, BROADCAST_ROWS)
    k1, k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2")).join(side, ["k1", "k2"])
    if not again.isEmpty():  # rows that are repeated whole
        rows = rows.where("again IS NULL").union(rows.where("again").dropDuplicates(["k1", "k2"]))
    return rows.select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(table(spark, sf_dir, "documents"))
    return out.select(F.col("k1").alias("doc_id"), "class_id", "n_links")


ORACLE = {
    "op3_ngram_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS u(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
), reach(a, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.a
), class AS (SELECT a AS doc_id, min(c) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM class""",
}
