"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, everywhere in this subpackage.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Places among which a node's edges are spread.
SALTS = 8


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df from Parquet in the shared checkpoint folder, which goes when the driver ends.

    A table is as large as its files; a checkpoint keeps the size that was
    estimated for its plan, a product that squares in every round of joins and
    whose digits soon take longer than the work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """As cut; then a garbage collection, that Spark may delete the shuffle files that nothing refers to any more."""
    spark, df = df.sparkSession, cut(df)
    try:  # events that still wait hold the plan
        spark._jsc.sc().listenerBus().waitUntilEmpty(5000)
    except Py4JJavaError:
        pass  # a busy bus: the files go with a later collection
    spark._jvm.System.gc()
    return df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, in local mode alone, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return (named or known.get()).rstrip("/")


def small_side(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """df, hinted for broadcast only where its counted rows are at most max_rows.

    Beyond the bound the join that follows is an ordinary shuffle join, which
    adaptive execution splits where it is skewed. df should be cheap to count
    (a checkpoint).
    """
    ok = df.count() <= max_rows
    return (F.broadcast(df) if ok else df), ok


def text_key(*cols: Column) -> Column:
    """A 64-bit name of a row's content, nulls included and told apart from empty."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if n == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_bytes; a longer text stands alone, whole."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in a copy."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class WordHasher:
    """Words and their names for many texts at once, in numpy.

    A name is two numbers, 128 bits. A word of at most PACKED bytes is packed
    into them with its length, whole, and shuffled by a bijection, so different
    words have different names; a longer one goes by its BLAKE2 digest. Each
    half alone is a 64-bit hash of the word.
    """

    PACKED = 15

    def __init__(self, separators: Iterable[int] = SPACE_BYTES, fold_case: bool = False):
        self.is_space = np.zeros(256, bool)
        self.is_space[list(separators)] = True
        self.fold = np.arange(256, dtype=np.uint8) if fold_case else None
        if fold_case:
            self.fold[65:91] = self.fold[97:123]
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and each text's first word's index."""
        inside = ~self.is_space[raw]
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def names(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """High and low halves of the names of the words at the given places."""
        raw = raw if self.fold is None else self.fold[raw]
        n = ends - starts
        padded = np.append(raw, np.zeros(16, np.uint8))
        packed = np.lib.stride_tricks.sliding_window_view(padded, 16)[starts].view("<u8")
        high = packed[:, 0] & self.masks[np.minimum(n, 8)]
        low = packed[:, 1] & self.masks[np.clip(n - 8, 0, 7)] | n.astype(np.uint64) << np.uint64(56)
        for k in np.flatnonzero(n > self.PACKED):
            digest = hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=16).digest()
            high[k], low[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 255 << 56
        high ^= mix64(low)
        low ^= mix64(high)
        high ^= mix64(low)
        return high, low

    def wide(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(high and low halves of each word's name, each text's first word's index)."""
        starts, ends, first = self.spans(raw, offsets)
        return *self.names(raw, starts, ends), first

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the high halves of the words' names, byte starts, ends, each text's first word's index)."""
        starts, ends, first = self.spans(raw, offsets)
        return self.names(raw, starts, ends)[0], starts, ends, first


class RunNames:
    """128-bit names of runs of words, by a tree of mixed halves: no algebra ties the names of different runs.

    Runs are at least `width` words long and shorter than 2 x `width`.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, width: int):
        self.step = 1 << (width.bit_length() - 1)
        a, b = high, low
        self.levels = [a]  # high halves of the names of the runs of 1, 2, 4, ... words
        half = 1
        while half < self.step:
            n = max(len(a) - half, 0)
            a, b = self._join(a[:n], b[:n], a[half:], b[half:])
            self.levels.append(a)
            half *= 2
        self.high, self.low = a, b

    @staticmethod
    def _join(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = mix64(mix64(a1 ^ (b2 << np.uint64(1))) + b1)
        return high, mix64(mix64(a2 + high) ^ b2)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = end - start - self.step
        a, b = self.high[start], self.low[start]
        for k in (1, 2, 3):  # overlapping steps that cover the run
            at = start + (rest * k + 2) // 3
            a, b = self._join(a, b, self.high[at], self.low[at])
        return mix64(a + (end - start).astype(np.uint64)), b


def windows(names: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A name for each run of `width` consecutive entries (texts must be told apart by the caller)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) & (2**64 - 1) | 1)
    out = names[:n].copy()
    for k in range(1, width):
        out *= base
        out += names[k : n + k]
    return mix64(out)


def shingle_sets(names: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and where each text's begin.

    A text of fewer than `width` words, but at least one, has the one shingle
    of all its words; a text without words has none.
    """
    n = len(first) - 1
    counts = np.diff(first)
    grams = windows(names, width, 5)
    owner = np.repeat(np.arange(n), np.maximum(counts - width + 1, 0))
    at = np.concatenate([np.arange(first[i], first[i + 1] - width + 1) for i in np.flatnonzero(counts >= width)] or [np.zeros(0, np.int64)])
    values = grams[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, i in enumerate(short):
            extra[k] = windows(names[first[i] : first[i + 1]], int(counts[i]), 5 + int(counts[i]))[0]
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))


def by_group(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by keys, many small groups to a table.

    Each table holds complete groups only, so a caller may find the groups'
    bounds within it.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1] != t.column(k)[0] for k in keys):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last = np.flatnonzero(change)
        if len(last):
            yield pa.concat_tables([*held, t.slice(0, int(last[-1]))]).combine_chunks()
            held = [t.slice(int(last[-1]))]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    if t.num_rows:
        change[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def in_blocks(rows: DataFrame, key: str, member: str, block: int, wide: DataFrame | None = None) -> DataFrame:
    """Deal each group's rows to tasks that compare at most about 2 x block rows.

    A group of n rows is cut by a hash of `member` into ceil(n / block) chunks;
    every two chunks meet in one block (key, ci, cj), so that each pair of rows
    meets exactly once: within a chunk where ci = cj, else across. `side` is 0
    for rows of chunk ci, 1 for rows of cj. Groups of one row are left out.
    `wide`, a row per member, brings further columns once the rows are dealt, so
    that they travel no sooner.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(sizes, key).withColumn("_k", F.ceil(F.col("_n") / block).cast("int"))
    joined = joined.withColumn("_c", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_k")).cast("int"))
    dealt = joined.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.withColumns({
        "ci": F.least("_c", "_j").cast("int"),
        "cj": F.greatest("_c", "_j").cast("int"),
        "side": (F.col("_c") > F.col("_j")).cast("int"),
    })
    # Within a chunk's own block every row has side 0.
    dealt = dealt.drop("_n", "_k", "_c", "_j")
    if wide is not None:
        dealt = dealt.join(wide, member)
    return dealt.repartition(key, "ci", "cj").sortWithinPartitions(key, "ci", "cj")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for nodes that have an edge.

    Alternating large and small stars over a table of edges, each round written
    and read again. Minima are pre-aggregated before each shuffle, and the
    edges of a node meet its minimum in SALTS places, as the least node of a
    large component has an edge to each of its members.
    """

    def with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
        spread = low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = cut(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = with_low(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select("u", F.col("m").alias("v"))
        e = cut(with_low(e, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, out = len(adjacent), []
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            near = np.flatnonzero(adjacent[x] & left)
            left[near] = False
            out += [(x, int(y)) for y in near]
            stack += near.tolist()
    return out


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """df's columns of `like`, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


ArrowFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
