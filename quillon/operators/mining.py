"""Mining a dictionary of pair relations.

Adjacent pairs are counted with overlaps and within samples only. A pair's
score is its count times its lift, the count over what its two sides' own
counts would lead one to expect. The best pair becomes a rule, its occurrences
are replaced from left to right, and mining goes on.

Samples are rows with a symbol string `z` (quillon.functions.symbols). Counting,
scoring and replacing are column expressions; a whole dictionary is mined in
numpy on the executors, since a rule changes few counts, which column
expressions would have to count anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.symbols import FIRST_RULE, GAP, GAP_AT, char_of, chars, symbol_of
from quillon.plans.lineage import importable, shared_folder

#: Symbols are below 2^21, as code points are.
_SHIFT = 32
#: Symbols that the driver guesses from, and rules guessed beyond those that are asked for.
SAMPLE, SPARE = 1 << 22, 16
#: Symbols that are worked on at a time, and numbers of symbols up to which counts are plain arrays.
CHUNK, DENSE = 1 << 18, 1 << 10
#: Rules replayed, over all passes, before samples are written anew.
REPLAYED = 384


@dataclass(frozen=True)
class Rule:
    id: int
    left: int
    right: int
    frequency: int

    @property
    def pair(self) -> str:
        return char_of(self.left) + char_of(self.right)


@dataclass(frozen=True)
class Gate:
    """What a pair must reach; all bounds are inclusive."""

    min_frequency: int = 2
    min_lift: float = 1.0
    min_support: float = 0.0


def pair_counts(samples: DataFrame) -> DataFrame:
    """(left, right, n): overlapping adjacent pairs of all samples."""
    a = chars(F.col("z"))
    split = samples.select(a.alias("a")).where(F.size("a") > 1)
    n = F.size("a") - 1
    pairs = split.select(F.explode(F.arrays_zip(F.slice("a", F.lit(1), n).alias("l"), F.slice("a", F.lit(2), n).alias("r"))).alias("p"))
    counted = pairs.groupBy("p.l", "p.r").agg(F.count("*").alias("n"))
    return counted.select(symbol_of(F.col("l")).alias("left"), symbol_of(F.col("r")).alias("right"), "n")


def pair_frequency(samples: DataFrame, left: int, right: int) -> DataFrame:
    """(n) of one pair, overlaps included, without looking at the others."""
    z, a, b = F.col("z"), char_of(left), char_of(right)
    if left != right:
        own = F.length(z) - F.length(F.replace(z, F.lit(a + b), F.lit(b)))
    else:  # a run of k counts k - 1 times: symbols of the run less the runs
        one = F.length(z) - F.length(F.replace(z, F.lit(a), F.lit("")))
        runs = F.size(F.filter(F.split(F.concat(F.lit(char_of(0x10F000)), z), _quoted(a) + "+"), lambda x: F.lit(True))) - 1
        own = one - runs
    return samples.agg(F.coalesce(F.sum(own), F.lit(0)).cast("long").alias("n"))


def _quoted(x: str) -> str:
    return "\\Q" + x + "\\E"


def score_pairs(counts: DataFrame) -> DataFrame:
    """counts with left_n, right_n, total, support, expected, lift, score.

    Marginals come from the grouped pairs, rejected ones included.
    """
    by = lambda *c: Window.partitionBy(*[F.col(x) for x in c])
    out = counts.withColumns({"left_n": F.sum("n").over(by("left")), "right_n": F.sum("n").over(by("right"))})
    out = out.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    out = out.withColumns({"support": n / total, "expected": F.col("left_n").cast("double") * F.col("right_n").cast("double") / total})
    out = out.withColumn("lift", n / F.col("expected"))
    return out.withColumn("score", n * F.col("lift"))


def passing(scored: DataFrame, gate: Gate) -> DataFrame:
    return scored.where((F.col("n") >= gate.min_frequency) & (F.col("support") >= gate.min_support) & (F.col("lift") >= gate.min_lift))


def best_pair(samples: DataFrame, gate: Gate) -> DataFrame:
    """The passing pair of the highest score, ties to the smaller pair; at most one row."""
    return passing(score_pairs(pair_counts(samples)), gate).orderBy(F.desc("score"), "left", "right").limit(1)


def replace_pair(z: Column, left: int, right: int, symbol: int) -> Column:
    return F.replace(z, F.lit(char_of(left) + char_of(right)), F.lit(char_of(symbol)))


def apply_rules(z: Column, rules: list[Rule], known: Column | None = None) -> Column:
    """Every rule once, in order, over the whole symbol string; or only the first `known` of them."""
    if not rules:
        return z
    table = F.array(*[F.struct(F.lit(r.pair).alias("pair"), F.lit(char_of(r.id)).alias("to")) for r in rules])
    table = table if known is None else F.slice(table, F.lit(1), known)
    return F.aggregate(table, z, lambda acc, r: F.replace(acc, r["pair"], r["to"]))


def _laid_out(samples: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places between samples): all samples one after the other, with a place before, between and behind them."""
    text = "\0".join(["", *samples, ""])
    ends = np.cumsum(np.fromiter((len(z) + 1 for z in ["", *samples]), np.int64, len(samples) + 1)) - 1
    raw = text.encode("utf-16-le")
    z = np.frombuffer(raw, "<u2") if len(raw) == 2 * len(text) else np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (np.where(z < GAP_AT, z, z - GAP) if z.max() >= GAP_AT else z), ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole samples, about CHUNK symbols at a time."""
    for batch in batches:
        some, size = [], 0
        for z in batch.column(0).to_pylist():
            some.append(z)
            size += len(z)
            if size >= CHUNK:
                yield _laid_out(some)
                some, size = [], 0
        if some:
            yield _laid_out(some)


class _Line:
    """Samples one after the other, parted by `end`, as a linked list.

    Symbols stay where they are; a replaced pair leaves a hole at its second
    place. A symbol's places are found once, so a rule takes time by the places
    of its left symbol, not by the symbols in all. All symbols are
    below `end`.
    """

    def __init__(self, z: np.ndarray, ends: np.ndarray, end: int):
        self.z = z.astype(np.uint16 if end + 1 < 1 << 16 else np.uint32)
        self.z[ends] = end
        kind = np.int32 if len(z) < 1 << 31 else np.int64
        self.after, self.before = np.arange(1, len(z) + 1, dtype=kind), np.arange(-1, len(z) - 1, dtype=kind)
        self.end, self.places = end, {}
        if self.z.dtype == np.uint16:  # sorted in time in proportion
            order, first = np.argsort(self.z, kind="stable"), np.append(0, np.cumsum(np.bincount(self.z)))
            self.places = {k: order[first[k] : first[k + 1]] for k in np.flatnonzero(np.diff(first)).tolist()}

    def replace(self, left: int, right: int, symbol: int, tell: bool = True) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """Replace a pair from left to right: (places, places that follow one another, symbols left of places, right of places).

        Where places follow one another, neither is the other's neighbour.
        """
        at = self.places.get(left)
        if at is None:
            at = self.places[left] = np.flatnonzero(self.z == left)
        second = self.after[at]
        ok = np.flatnonzero(self.z[second] == right)
        ok = ok[self.z[at[ok]] == left]  # other rules may have taken some of the places
        hit, second = at[ok], second[ok]
        if 8 * len(hit) > len(at):
            self.places[left] = at[self.z[at] == left] if left == right else np.delete(at, ok)
        if left == right and len(hit):  # in a run of equal symbols every other place
            start = np.flatnonzero(np.append(True, second[:-1] != hit[1:]))
            odd = (np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0
            hit, second = hit[odd], second[odd]
        follow = self.after[second]
        out = None
        if tell:
            apart = follow[:-1] != hit[1:]
            before, behind = self.before[hit], follow
            if not apart.all():
                before, behind = before[np.append(True, apart)], behind[np.append(apart, True)]
            out = len(hit), len(hit) - len(behind), self.z[before], self.z[behind]
        self.z[hit] = symbol
        self.z[second] = self.end + 1
        self.after[hit] = follow
        self.before[follow] = hit
        if symbol in self.places:
            self.places[symbol] = np.union1d(self.places[symbol], hit)
        elif self.z.dtype == np.uint16:  # else they are looked for when they are needed
            self.places[symbol] = hit
        return out

    def samples(self) -> list[str]:
        z = self.z[self.z <= self.end].astype(np.uint32)
        ends = np.flatnonzero(z == self.end)
        z[ends] = 0
        text = np.where(z < GAP_AT, z, z + GAP).astype("<u4").tobytes().decode("utf-32-le")
        return [text[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@dataclass(frozen=True)
class Change:
    """What a rule does to the counts of pairs."""

    hits: int
    pairs: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, rule: Rule, end: int, hits: int, joins: int, lefts: tuple[np.ndarray, np.ndarray], rights: tuple[np.ndarray, np.ndarray]) -> Change:
        """From the places, those that follow one another, and how often which symbol stands left and right of places."""
        (u, lefts), (v, rights) = ((s[s != end].astype(np.int64), n[s != end].astype(np.int64)) for s, n in (lefts, rights))
        one = lambda a, b: np.array([a << _SHIFT | b], np.int64)
        pairs = [u << _SHIFT | rule.left, u << _SHIFT | rule.id, rule.right << _SHIFT | v, rule.id << _SHIFT | v, one(rule.right, rule.left), one(rule.id, rule.id), one(rule.left, rule.right)]
        return cls(hits, np.concatenate(pairs), np.concatenate([-lefts, lefts, -rights, rights, [-joins], [joins], [-hits]]))


def _stored(samples: DataFrame) -> tuple[DataFrame, str]:
    """(z) of the samples that have pairs, from a table in the session's shared folder, and its path."""
    path = f"{shared_folder(samples.sparkSession)}/{uuid.uuid4().hex}"
    samples.select("z").where(F.length("z") > 1).write.option("compression", "zstd").parquet(path)
    return samples.sparkSession.read.schema("z string").parquet(path), path


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _counted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of all samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0), np.int64)
        for z, ends in _chunks(batches):
            base = int(z.max()) + 2
            z = z.astype(np.int64)
            z[ends] = base - 1
            keys = z[:-1] * base + z[1:]
            if base <= DENSE:
                n = np.bincount(keys, minlength=base * base).reshape(base, base)[:-1, :-1]
                if len(n) > len(total):
                    n[: len(total), : len(total)] += total
                    total = n.copy()
                else:
                    total[: len(n), : len(n)] += n
                continue
            keys, n = np.unique(keys, return_counts=True)
            left, right = keys // base, keys % base
            ok = (left != base - 1) & (right != base - 1)
            yield pa.record_batch([pa.array((left << _SHIFT | right)[ok]), pa.array(n[ok])], names=["pair", "n"])
        left, right = np.nonzero(total)
        yield pa.record_batch([pa.array(left << _SHIFT | right), pa.array(total[left, right])], names=["pair", "n"])

    got = table.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return got.column("pair").to_numpy(), got.column("n").to_numpy()


def _changes(table: DataFrame, done: list[Rule], ahead: list[Rule], end: int) -> list[Change]:
    """What each rule of `ahead` changes, after those of `done` and the ones before it. All symbols are below `end`."""
    names = ["step", "side", "symbol", "n"]

    def rows(step, side, symbol, n) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.asarray(x), t) for x, t in zip((step, side, symbol, n), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = end < DENSE
        near = np.zeros((len(ahead), 2, end + 1 if dense else 0), np.int64)
        own = np.zeros((len(ahead), 2), np.int64)
        for z, ends in _chunks(batches):
            line = _Line(z, ends, end)
            for r in done:
                line.replace(r.left, r.right, r.id, tell=False)
            for k, r in enumerate(ahead):
                hits, joins, *sides = line.replace(r.left, r.right, r.id)
                own[k] += hits, joins
                for side, symbols in enumerate(sides):
                    if dense:
                        near[k, side] += np.bincount(symbols, minlength=end + 1)
                    elif len(symbols):
                        symbols, n = np.unique(symbols, return_counts=True)
                        yield rows(np.full(len(n), k), np.full(len(n), side), symbols, n)
        yield rows(*np.nonzero(near), near[near != 0])
        step, side = np.nonzero(own)
        yield rows(step, side + 2, np.zeros(len(step)), own[step, side])

    got = table.mapInArrow(run, "step int, side int, symbol long, n long").groupBy("step", "side", "symbol").agg(F.sum("n").alias("n")).toArrow()
    step, side, symbol, n = (got.column(c).to_numpy() for c in names)
    at = lambda k, s: (step == k) & (side == s)
    return [Change.of(r, end, int(n[at(k, 2)].sum()), int(n[at(k, 3)].sum()), *((symbol[at(k, s)], n[at(k, s)]) for s in (0, 1))) for k, r in enumerate(ahead)]


class Counts:
    """Counts of all pairs, on the driver: as many rows as distinct pairs, at most the square of the number of symbols, whatever the samples."""

    def __init__(self, pairs: np.ndarray = (), n: np.ndarray = ()):
        self.pairs, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pairs):
            self.pairs, place = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(self.pairs), np.int64)
            np.add.at(total, place, n)
            self.pairs, self.n = self.pairs[total > 0], total[total > 0]

    def plus(self, pairs: np.ndarray, n: np.ndarray) -> Counts:
        return Counts(np.concatenate([self.pairs, pairs]), np.concatenate([self.n, n]))

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs >> _SHIFT, self.pairs & ((1 << _SHIFT) - 1)

    def without(self, rule: Rule, hits: int) -> Counts:
        """The counts with a rule's symbol written out as its pair again."""
        left, right = self.sides()
        pairs = np.where(left == rule.id, rule.right, left) << _SHIFT | np.where(right == rule.id, rule.left, right)
        return Counts(pairs, self.n).plus(np.array([rule.left << _SHIFT | rule.right], np.int64), np.array([hits], np.int64))

    def named(self, names: dict[int, int]) -> Counts:
        """The counts with other numbers for some symbols."""
        if all(k == v for k, v in names.items()):
            return self
        known = np.array(sorted(names), np.int64)
        to = np.array([names[k] for k in sorted(names)], np.int64)

        def of(side: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, side), len(known) - 1)
            return np.where(known[at] == side, to[at], side)

        left, right = self.sides()
        return Counts(of(left) << _SHIFT | of(right), self.n)

    def best(self, gate: Gate) -> tuple[int, int, int] | None:
        """(left, right, count) of the passing pair of the highest score, ties to the smaller pair."""
        if not len(self.n):
            return None
        left, right = self.sides()
        n, total = self.n.astype(np.float64), float(self.n.sum())
        lift = n / (np.bincount(left, n)[left] * np.bincount(right, n)[right] / total)
        ok = (self.n >= gate.min_frequency) & (n / total >= gate.min_support) & (lift >= gate.min_lift)
        if not ok.any():
            return None
        k = int(np.argmax(np.where(ok, n * lift, -1.0)))  # pairs are in order
        return int(left[k]), int(right[k]), int(self.n[k])


def _some(table: DataFrame, symbols: int) -> list[str]:
    """Pieces of samples spread over the table, SAMPLE symbols or so in all, four times that at most; or all samples."""
    share = min(1.0, SAMPLE / max(symbols, 1))
    if share == 1:
        return [r.z for r in table.collect()]
    rows = table.count()
    within = max(share, 1 / 16) if 16 * share * rows >= 1024 else share  # of few samples, a piece of each
    rows = max(rows * share / within, 1)
    long = F.least(F.ceil(F.length("z") * within), F.lit(int(4 * SAMPLE / rows) + 64)).cast("int")
    start = F.pmod(F.xxhash64("z"), F.greatest(F.length("z") - long, F.lit(0)) + 1).cast("int")
    picked = table.sample(False, share / within, 7) if share < within else table
    return [r.z for r in picked.select(F.substring("z", start + 1, long).alias("z")).collect()]


def _mine(samples: DataFrame, first_id: int, budget: int, gate: Gate) -> list[Rule]:
    """Up to `budget` rules numbered from first_id, each of the samples as the earlier ones left them.

    Pairs are counted once; each later pass brings the changes that guessed
    rules make, each after the ones before it, from which _kept finds out which
    of them are the best pairs in turn. Guesses decide how many passes there
    are, not what is found. They come from mining on, on the driver, in some
    of the symbols. A pass replays the rules that earlier ones found; from time
    to time the samples are written anew, shorter.
    """
    if budget < 1:
        return []
    spark = samples.sparkSession
    importable(spark)
    table, path = _stored(samples)
    try:
        counts = Counts(*_counted(table))
        if not len(counts.n):
            return []
        highest = int(max(x.max() for x in counts.sides()))
        some = _some(table, int(counts.n.sum()) + table.count())
        done, found, replayed, ahead = [], [], 0, budget + SPARE
        while len(found) < budget:
            guess, end = _guesses(counts, some, found, gate, first_id + len(found), min(ahead, budget - len(found) + SPARE), highest)
            if not guess:
                break
            new, counts = _kept(counts, guess, _changes(table, done, guess, end), gate, budget - len(found), highest < first_id)
            found += new
            done += new
            ahead = max(3 * len(new), 16)
            replayed += len(done)
            if replayed >= REPLAYED and len(found) < budget:
                old, (table, path) = path, _stored(_rewritten(table, done, max(highest, first_id + len(found) - 1) + 1))
                _drop(spark, old)
                done, replayed = [], 0
        return found
    finally:
        _drop(spark, path)


def _guesses(counts: Counts, some: list[str], found: list[Rule], gate: Gate, next_id: int, most: int, highest: int) -> tuple[list[Rule], int]:
    """The next rules, the first one surely, the others by what they change in some of the symbols; and a number above all symbols."""
    end, out = max(highest + 1, next_id + most), []
    line = _Line(*_laid_out(some), end)
    pairs = len(line.z) - 2 * len(some) - 1
    for r in found:
        pairs -= line.replace(r.left, r.right, r.id)[0]
    share = float(counts.n.sum()) / max(pairs, 1)
    while len(out) < most and (best := counts.best(gate)):
        rule = Rule(next_id + len(out), *best)
        out.append(rule)
        hits, joins, *sides = line.replace(rule.left, rule.right, rule.id)
        change = Change.of(rule, end, hits, joins, *(np.unique(s, return_counts=True) for s in sides))
        counts = counts.plus(change.pairs, np.rint(change.n * share).astype(np.int64))
        gone = counts.pairs != (rule.left << _SHIFT | rule.right)
        counts = Counts(counts.pairs[gone], counts.n[gone])
    return out, end


def _apart(early: Rule, late: Rule) -> bool:
    """Whether two rules, of which the first does not use the second, do the same to any samples in either order."""
    return early.id not in (late.left, late.right) and early.right != late.left and early.left != late.right


def _kept(counts: Counts, guess: list[Rule], changes: list[Change], gate: Gate, budget: int, fresh: bool) -> tuple[list[Rule], Counts]:
    """(the best pairs in turn as far as the guesses tell, the counts after them), numbered anew in their order.

    `changes` hold for the guesses in their order. A guess that is not the best
    pair in its turn is left out for now: the counts without it are those with
    its symbol written out again, if every later guess that is taken before it
    does the same before it as after it. Where one does not, or the best pair is no
    guess, this ends. fresh: no guess's symbol is in the samples.
    """
    after, skipped, taken, names = counts, [], [], {}
    index = {(r.left, r.right): k for k, r in enumerate(guess)}
    reach, now = 0, counts  # guesses whose changes are in `after`; what is left of it without the skipped ones
    while len(taken) < budget and (best := now.named(names).best(gate)):
        numbers = {v: k for k, v in names.items()}
        k = index.get((numbers.get(best[0], best[0]), numbers.get(best[1], best[1])))
        if k is None or k < reach and k not in skipped:
            break
        left_out = [s for s in [*skipped, *range(reach, k)] if s != k]
        if not all(fresh and _apart(guess[s], guess[k]) for s in left_out if s < k):
            break
        for s in range(reach, k + 1):
            after = after.plus(changes[s].pairs, changes[s].n)
        reach, skipped = max(reach, k + 1), left_out
        names[guess[k].id] = guess[0].id + len(taken)
        taken.append(Rule(guess[0].id + len(taken), *best))
        now = after
        for s in reversed(skipped):
            now = now.without(guess[s], changes[s].hits)
    return taken, now.named(names)


def _rewritten(table: DataFrame, rules: list[Rule], end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, ends in _chunks(batches):
            line = _Line(z, ends, end)
            for r in rules:
                line.replace(r.left, r.right, r.id, tell=False)
            yield pa.record_batch([pa.array(line.samples(), pa.string())], names=["z"])

    return table.mapInArrow(run, "z string")


def train(samples: DataFrame, max_rules: int = 256, gate: Gate = Gate()) -> list[Rule]:
    """A dictionary of the samples alone."""
    return _mine(samples, FIRST_RULE, max_rules, gate)


def consolidate(trails: DataFrame, rules: list[Rule], max_new: int = 64, gate: Gate = Gate()) -> list[Rule]:
    """rules and what the trails add, mined as they are given: not encoded anew, and without a look at whether a pair has a rule."""
    return [*rules, *_mine(trails, FIRST_RULE + len(rules), max_new, gate)]


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    """A dictionary as rows (id, left, right, frequency)."""
    return spark.createDataFrame([(r.id, r.left, r.right, r.frequency) for r in rules], "id long, left long, right long, frequency long")


def load_rules(rows: list[tuple[int, int, int, int]]) -> list[Rule]:
    """A dictionary from rows in order; ids must be dense from 256 and refer to smaller ids only."""
    out = []
    for k, (i, left, right, frequency) in enumerate(rows):
        if i != FIRST_RULE + k or not (0 <= left < i and 0 <= right < i):
            raise ValueError(f"not a canonical dictionary at index {k}: id {i}, left {left}, right {right}")
        out.append(Rule(i, left, right, frequency))
    return out
