"""Exact removal of repeated word windows, found by recompression.

Texts are rewritten by rounds that are the same everywhere: a maximal run of
exactly two equal symbols becomes one symbol, then, in each pair round, a
symbol of the left class followed by one of the right class becomes one. Names
are hashes of what they stand for, so equal names are global without a table,
and whether two symbols join depends on them alone: equal substrings get equal
symbols but for their edges. For each window the edges that its surroundings
could change are known from the window's own words; among the symbols between
them the longest (then least) is the window's anchor. Equal windows have equal
anchors at equal offsets. Neighbouring windows with one anchor form a span.

Spark then counts anchors and spans: an anchor that occurs once proves its
windows unique; a span that occurs twice proves its windows repeated; only
windows of the remaining, partly shared anchors are compared one by one.
A window without a symbol between its edges is its own anchor.

Null and empty texts have no words. Repeated rows repeat each other's windows.
Rows are told apart by doc_id and text; a null doc_id is an id like others.
Words go by 128-bit names (their own bytes, or a BLAKE2 digest of a longer one),
windows and spans by names mixed from those in a tree, of which 96 bits are
kept; equal names are taken for equal words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import RunNames, WordHasher, mix64, pieces, table, text_key, utf8_buffer, written

WINDOW = 35
PAIR_ROUNDS = 4
PIECE_BYTES = 1 << 19
_SIDE = np.uint64(0xA24BAED4963EE407)
#: Anchors are called common by the spans in one row in SEEN, OFTEN or more; COMMON of them at most are spread, each to SALTS places.
SEEN, OFTEN, COMMON, SALTS = 64, 64, 1 << 14, 64


def left_class(symbols: np.ndarray, level: int) -> np.ndarray:
    return (mix64(symbols + np.uint64(0x1234567 * (level + 1))) >> np.uint64(40)) & np.uint64(1) == 0


def join_names(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix64(a * np.uint64(0x9FB21C651E98DF25) + mix64(b + np.uint64(level)) * np.uint64(3))


def symbols_of(names: np.ndarray, first: np.ndarray, rounds: int = PAIR_ROUNDS):
    """Recompression of many texts: (symbols, their starts, lo, hi).

    starts has one entry more, the number of words. lo[p]: the first symbol
    boundary at or after word p that depends on no word before p; hi[q]: the
    last one at or before q that depends on no word from q on.
    """
    n = len(names)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.arange(n + 1)
    sym = names.copy()
    lo, hi = np.arange(n + 1), np.arange(n + 1)
    for level in range(rounds + 1):
        m = len(sym)
        if m < 2:
            break
        own = owner[begins[:-1]]
        same_text = own[1:] == own[:-1]
        at = np.full(n + 1, 0, np.int64)  # symbol that begins at a boundary
        at[begins[:-1]] = np.arange(m)
        at[n] = m
        if level == 0:
            equal = np.concatenate([[False], same_text & (sym[1:] == sym[:-1]), [False]])
            run_start = np.flatnonzero(~equal[:-1])
            run_len = np.diff(np.append(run_start, m))
            run_of = np.repeat(np.arange(len(run_start)), run_len)
            joins = np.zeros(m, bool)
            joins[run_start[run_len == 2]] = True
            # Part of a run inside an edge: more than two equal symbols never join, whatever lies beyond.
            run_end = (run_start + run_len)[run_of]
            s = at[lo[:-1]]
            inside = run_end[s] - s
            drop = inside <= 2
            lo[:-1] = np.where(drop, begins[np.minimum(run_end[s], m)], lo[:-1])
            s = at[hi[1:]] - 1
            inside = s - run_start[run_of[s]] + 1
            hi[1:] = np.where(inside <= 2, begins[run_start[run_of[s]]], hi[1:])
        else:
            left = left_class(sym, level)
            joins = np.zeros(m, bool)
            joins[:-1] = left[:-1] & ~left[1:] & same_text
            s = at[lo]
            ok = s < m
            s1 = np.minimum(s, m - 1)
            lo = np.where(ok & ~left[s1], begins[s1 + 1], lo)
            s = at[hi]
            s1 = np.maximum(s - 1, 0)
            hi = np.where((s > 0) & left[s1], begins[s1], hi)
        taken = np.zeros(m, bool)
        taken[1:] = joins[:-1]
        keep = ~taken
        nxt = np.minimum(np.arange(m) + 1, m - 1)
        sym = np.where(joins, join_names(sym, sym[nxt], level), sym)[keep]
        begins = np.append(begins[:-1][keep], n)
    return sym, begins, lo, hi


def anchors(names: np.ndarray, low: np.ndarray, first: np.ndarray, width: int = WINDOW, rounds: int = PAIR_ROUNDS):
    """Spans of windows that share an anchor: (anchor, two halves of the span's name, text, first and last window start as word positions, sides).

    An anchor of m words leaves width - m words of a window to its sides, so
    equal windows of two spans share at least half of these on one of them.
    `sides` holds a 16-bit name of as many words (a power of two) before the
    anchor and one of those after it; 0 where the span does not reach so far.
    """
    n = len(names)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    last_of = first[1:][owner] if n else np.zeros(0, np.int64)
    start = np.flatnonzero(np.arange(n) + width <= last_of)
    if not len(start):
        z = np.zeros(0, np.int64)
        return *(np.zeros(0, np.uint64) for _ in range(3)), z, z, z, np.zeros(0, np.int32)
    sym, begins, lo, hi = symbols_of(names, first, rounds)
    m = len(sym)
    a, b = lo[start], hi[start + width]
    ai = np.searchsorted(begins, a)
    bi = np.searchsorted(begins, b)  # symbols [ai, bi)
    inside = (b > a) & (bi > ai)
    # Longest, then least: the leftmost least key of each range, from tables of doubling width.
    size = np.minimum(np.diff(begins), 63).astype(np.uint64)
    key = ((np.uint64(63) - size) << np.uint64(58)) | (mix64(sym) >> np.uint64(6))
    best = np.arange(m)
    tables = [best]
    while (1 << len(tables)) <= width:
        half = 1 << (len(tables) - 1)
        prev = tables[-1]
        other = np.append(prev[half:], np.full(min(half, m), m - 1))[:m]
        tables.append(np.where(key[other] < key[prev], other, prev))
    span = np.maximum(bi - ai, 1)
    level = np.floor(np.log2(span)).astype(np.int64)
    stack = np.stack(tables)
    p = stack[level, np.minimum(ai, m - 1)]
    q = stack[level, np.clip(bi - (1 << level), 0, m - 1)]
    pick = np.where(key[q] < key[p], q, p)
    pick = np.where(inside, pick, -1 - np.arange(len(start)))  # alone
    change = np.ones(len(start), bool)
    change[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
    i1 = start[change]
    i2 = start[np.append(np.flatnonzero(change)[1:], len(start)) - 1]
    chosen = pick[change]
    alone = chosen < 0
    runs = RunNames(names, low, width)
    whole, rest = runs(i1, i2 + width)
    safe = np.maximum(chosen, 0)
    name = np.where(alone, mix64(whole ^ _SIDE), mix64(sym[safe] + size[safe]))
    offset = np.where(alone, 0, begins[safe] - i1).astype(np.uint64)
    p, q = begins[safe], begins[safe + 1]
    need = np.maximum(width - (q - p) + 1, 2) // 2
    sides = []
    for fits, at in ((p - need >= i1, p), (q + need <= i2 + width, q)):
        value = np.zeros(len(i1), np.uint64)
        for k in range(len(runs.levels)):
            some = np.flatnonzero(fits & ~alone & (need >> k == 1))
            value[some] = runs.levels[k][at[some] - ((1 << k) if at is p else 0)] >> np.uint64(48) | np.uint64(1)
        sides.append(np.where(alone, np.uint64(1), value))
    return name, mix64(whole + offset), rest, owner[i1], i1 - first[owner[i1]], i2 - first[owner[i1]], (sides[0] << np.uint64(16) | sides[1]).astype(np.uint32).view(np.int32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _short(x: np.ndarray) -> pa.Array:
    """The high half of each number."""
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _parts(batch: pa.RecordBatch):
    """(rows a to b, their bytes, offsets within these) of a batch, piece by piece."""
    raw, offsets = utf8_buffer(batch.column(batch.schema.get_field_index("text")))
    for a, b in pieces(offsets, PIECE_BYTES):
        part = offsets[a : b + 1]
        yield a, b, raw[part[0] : part[-1]], part - part[0]


def _mark(k2: np.ndarray) -> np.ndarray:
    """A number for a row, of which the least stands for a span's occurrences."""
    return (k2.view(np.uint64) >> np.uint64(48)).astype(np.int32)


def count_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(s, u, v, c, r): anchors, their spans, how often each occurs, and the least mark of their rows; counted within pieces before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, _, raw, offsets in _parts(batch):
                s, u, v, who, *_ = anchors(*hasher.wide(raw, offsets), width)
                if not len(s):
                    continue
                r = _mark(batch.column(1).to_numpy())[who + a]
                v >>= np.uint64(32)
                v <<= np.uint64(32)
                order = np.lexsort((v, u, s))
                s, u, v, r = s[order], u[order], v[order], r[order]
                fresh = np.ones(len(s), bool)
                fresh[1:] = (s[1:] != s[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
                at = np.flatnonzero(fresh)
                c = np.diff(np.append(at, len(s)))
                yield pa.record_batch([_signed(s[at]), _signed(u[at]), _short(v[at]), pa.array(c, pa.int32()), pa.array(np.minimum.reduceat(r, at))], names=["s", "u", "v", "c", "r"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "s long, u long, v int, c int, r int")


def spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(k1, k2, s, u, v, i1, i2, lr): each row's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, _, raw, offsets in _parts(batch):
                s, u, v, who, i1, i2, lr = anchors(*hasher.wide(raw, offsets), width)
                if len(s):
                    rows = pa.array(who + a)
                    yield pa.record_batch(
                        [batch.column(0).take(rows), batch.column(1).take(rows), _signed(s), _signed(u), _short(v), pa.array(i1, pa.int32()), pa.array(i2, pa.int32()), pa.array(lr)],
                        names=["k1", "k2", "s", "u", "v", "i1", "i2", "lr"],
                    )

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, s long, u long, v int, i1 int, i2 int, lr int")


def common_anchors(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(s): anchors of so many different spans that their rows must be spread; at most COMMON of them.

    Told from one row in SEEN, which decides only where rows meet, never what
    is found: a common anchor that is missed here is one larger task.
    """
    some = count_spans(docs.where(F.pmod(F.xxhash64("k2", F.lit(29)), F.lit(SEEN)) == 0), width)
    often = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return often.orderBy(F.desc("n"), "s").limit(COMMON).select("s", F.lit(True).alias("common"))


def _window_rows(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, w, x, i, n) for the spans listed in each row's `open`; n counts 2 for a settled span's stand-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("open"))
            for a, b, raw, offsets in _parts(batch):
                own = listed.slice(a, b - a)
                n = np.asarray(own.value_lengths().fill_null(0))
                flat = own.flatten()
                if not len(flat):
                    continue
                names, low, first = hasher.wide(raw, offsets)
                i1, i2, times = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("i1", "i2", "n"))
                who = np.repeat(np.arange(b - a), n)
                size = (i2 - i1 + 1).astype(np.int64)
                of = np.repeat(np.arange(len(size)), size)
                i = i1[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                at = first[who[of]] + i
                w, x = RunNames(names, low, width)(at, at + width)
                rows = pa.array(who[of] + a)
                k1, k2 = (batch.column(batch.schema.get_field_index(k)).take(rows) for k in ("k1", "k2"))
                yield pa.record_batch([k1, k2, _signed(w), _short(x), pa.array(i, pa.int32()), pa.array(times[of], pa.int32())], names=["k1", "k2", "w", "x", "i", "n"])

    return docs.mapInArrow(run, "k1 long, k2 long, w long, x int, i int, n int")


def _stripped(docs: DataFrame, width: int, digest: bool, keep_text: bool) -> DataFrame:
    """n_words, n_removed and the kept words (or their sha256) of rows with `covered`, ranges of repeated windows."""
    keep = [c for c in docs.columns if c not in ("covered", "k1", "k2") and (keep_text or c != "text")]
    out = "kept_sha256" if digest else "kept"
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            covered = batch.column(batch.schema.get_field_index("covered"))
            kept_columns = [batch.schema.get_field_index(c) for c in keep]
            for a, b, raw, offsets in _parts(batch):
                starts, ends, first = hasher.spans(raw, offsets)
                own = covered.slice(a, b - a)
                n = np.asarray(own.value_lengths().fill_null(0))
                flat = own.flatten()
                gone = np.zeros(len(starts) + 1, np.int64)
                if len(flat):
                    base = first[np.repeat(np.arange(b - a), n)]
                    np.add.at(gone, base + flat.field("i1").to_numpy(zero_copy_only=False), 1)
                    np.add.at(gone, base + flat.field("i2").to_numpy(zero_copy_only=False) + width, -1)
                left = np.cumsum(gone)[:-1] == 0
                upto = np.concatenate([[0], np.cumsum(left)])
                n_left = upto[first[1:]] - upto[first[:-1]]
                # Bytes of kept words, and one space after each but the last of a text.
                raw = np.append(raw, np.uint8(0x20))
                k = np.flatnonzero(left)
                mark = np.zeros(len(raw) + 1, np.int8)
                mark[starts[k]] += 1
                mark[ends[k]] -= 1
                mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
                text_of = np.searchsorted(first, k, "right") - 1
                follows = np.zeros(len(k), bool)
                follows[:-1] = text_of[1:] == text_of[:-1]
                gaps = ends[k[follows]]
                mask[gaps] = True
                raw[gaps] = 0x20
                data = raw[mask].tobytes()
                bounds = np.zeros(b - a + 1, np.int64)
                size = (ends - starts)[k] + follows
                bounds[1:] = np.cumsum(np.bincount(text_of, weights=size, minlength=b - a)).astype(np.int64)
                texts = [data[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                value = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array([t.decode() for t in texts])
                words = np.diff(first)
                yield pa.record_batch(
                    [*[batch.column(c).slice(a, b - a) for c in kept_columns], pa.array(words, pa.int64()), pa.array(words - n_left, pa.int64()), value],
                    names=[*keep, "n_words", "n_removed", out],
                )

    return docs.mapInArrow(run, schema)


def strip_repeats(docs: DataFrame, width: int = WINDOW, digest: bool = False, keep_text: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept): docs' other columns as a struct, and the words left, joined by one space (or kept_sha256); with keep_text also text.

    Words are those of common.WORD_PATTERN. Every window is judged on the
    input, and all of its occurrences go.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    k1, k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(row.alias("row"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    # One shuffle by anchor: spans that occur twice, and whether some span of an anchor does not. The spans of a
    # common anchor are spread; it occurs again wherever it does, and its settled spans are compared in any case.
    counted = count_spans(keyed, width).join(F.broadcast(common_anchors(keyed, width)), "s", "left")
    counted = counted.withColumn("salt", F.when(F.col("common"), 1 + F.pmod("u", F.lit(SALTS))).otherwise(0).cast("int")).drop("common")
    counted = counted.repartition("s", "salt").groupBy("s", "salt", "u", "v").agg(F.sum("c").alias("c"), F.min("r").alias("r"))
    place = Window.partitionBy("s", "salt")
    state = counted.withColumns({"total": F.sum("c").over(place), "single": F.min("c").over(place) == 1}).where("salt > 0 OR total > 1")
    state = state.select("s", "u", "v", (F.col("c") > 1).alias("settled"), F.when((F.col("salt") > 0) | F.col("single"), F.col("r")).alias("r"))
    # Windows of unsettled spans are compared, with each other and with those of one occurrence of each settled span,
    # where another span has the same words on one side of the anchor.
    found = spans(keyed, width).join(state.withColumnRenamed("r", "least"), ["s", "u", "v"])
    found = written(found.select("k1", "k2", "s", "i1", "i2", "settled", (F.shiftrightunsigned("k2", 48) == F.col("least")).alias("compare"), "lr"))
    times = F.when(F.col("settled"), 2).otherwise(1)
    sides = F.array(F.struct(F.lit(0).alias("d"), F.shiftrightunsigned("lr", 16).alias("z")), F.struct(F.lit(1).alias("d"), F.col("lr").bitwiseAND(0xFFFF).alias("z")))
    sided = found.where("compare").select("*", F.explode(F.filter(sides, lambda x: x["z"] != 0)).alias("side"))
    met = sided.groupBy("s", "side").agg(F.sum(times).alias("n"), F.count_if(~F.col("settled")).alias("open")).where("n > 1 AND open > 0").select("s", "side")
    opened = sided.join(met, ["s", "side"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("i1", "i2", times.alias("n"))).alias("open"))
    dealt = keyed.repartition("k1", "k2")  # the texts are dealt once for both joins
    compared = _window_rows(dealt.join(opened, ["k1", "k2"]), width)
    repeated = compared.groupBy("w", "x").agg(F.sum("n").alias("n")).where("n > 1").select("w", "x")
    hit = compared.where("n = 1").join(repeated, ["w", "x"]).groupBy("k1", "k2").agg(F.collect_set("i").alias("hits"))
    single = F.transform("hits", lambda i: F.struct(i.alias("i1"), i.alias("i2")))
    settled = found.where("settled").groupBy("k1", "k2").agg(F.collect_set(F.struct("i1", "i2")).alias("settled"))
    none = F.array().cast("array<struct<i1:int,i2:int>>")
    ranges = settled.join(hit, ["k1", "k2"], "full")
    ranges = ranges.select("k1", "k2", F.concat(F.coalesce("settled", none), F.coalesce(single, none)).alias("covered"))
    return _stripped(dealt.join(ranges, ["k1", "k2"], "left"), width, digest, keep_text)


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return strip_repeats(docs, digest=True).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = {
    "op4_recompression": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM d, unnest(range(0, len(w) - 34)) AS u(i)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows JOIN repeated USING (h)
), words AS (
  SELECT doc_id, k, w[k + 1] AS word FROM d, unnest(range(0, len(w))) AS u(k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
