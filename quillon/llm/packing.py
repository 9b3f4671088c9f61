"""Order-preserving packing of documents into token sequences.

Documents are laid end to end in the order of their partition. Window cuts
are chosen by dynamic programming over the ends of documents and sentences,
minimising padding plus a penalty for each cut that truncates a document. A
window costs nothing to pad at a power of two, else it is padded to the full
length. The best earlier cut within reach comes from a monotone queue.

Nulls and empty texts are documents of their end token alone; repeated rows
are packed as often as they occur; an empty table gives no pieces. Columns of
the input other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

END_ID = 1
WINDOW = 2048
#: Costs in tokens of padding: a cut inside a document at a sentence's end, and inside a sentence.
SENTENCE_CUT, HARD_CUT = 6, 48
#: Sentences longer than this offer cuts inside.
LONG_SENTENCE = 512
#: Tokens gathered before a stretch is cut; the last window of a stretch goes on into the next.
STRETCH = 1 << 17

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Encoder:
    """The byte-level vocabulary, by way of its ranks file; ids equal the tokenizer file's."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers as P
        import tiktoken

        with open(P.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = "<|endoftext|>"
        self.coder = tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={self.special: len(ranks)})
        self.ends_sentence = np.zeros(len(ranks) + 1, bool)
        for word, k in ranks.items():
            self.ends_sentence[k] = bool(re.search(rb"[.!?\n][\"')\]]*$", word))

    def ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special={self.special}, disallowed_special=())


def choose_cuts(length: int, cuts: np.ndarray, penalty: np.ndarray, window: int = WINDOW, open_end: bool = False) -> list[int]:
    """The cuts of least total cost that part [0, length) into windows of at most `window`.

    cuts: increasing candidate positions, the last of which is length; the
    penalty of each. With open_end the last window's padding is not counted,
    as more tokens will follow.
    """
    at = cuts.tolist()
    pen = penalty.tolist()
    place = {0: 0}
    cost = [0.0]
    back = [-1]
    where = [0]
    queue = deque([(0.0, 0)])  # (cost - position's padding part, index), least first
    powers = [1 << k for k in range(window.bit_length()) if 64 <= 1 << k < window]
    for k, b in enumerate(at, 1):
        while where[queue[0][1]] < b - window:
            queue.popleft()
        least, j = queue[0]
        # Padding of [a, b) is window - b + a, so cost(a) + a orders the queue.
        best = least + window - b
        if open_end and b == length:
            x, best = k - 1, float("inf")
            while x >= 0 and where[x] >= b - window:
                if cost[x] < best:
                    best, j = cost[x], x
                x -= 1
        else:
            for p in powers:
                x = place.get(b - p)
                if x is not None and cost[x] < best:
                    best, j = cost[x], x
        best += pen[k - 1]
        cost.append(best)
        back.append(j)
        where.append(b)
        place[b] = k
        value = best + b
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, k))
    out, k = [], len(at)
    while k > 0:
        out.append(where[k])
        k = back[k]
    return out[::-1]


def split_tail(length: int, window: int = WINDOW, penalty: float = HARD_CUT) -> list[int]:
    """Lengths of the windows for a last stretch of `length` < window: powers of two where they save padding."""
    out, rest = [], length
    while rest:
        top = 1 << (rest.bit_length() - 1)
        if top == rest or window - rest <= penalty * bin(rest).count("1"):
            out.append(rest)
            break
        out.append(top)
        rest -= top
    return out


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a stretch of tokens may be cut, and each one's penalty; no two further apart than a window."""
    n = len(ids)
    pen = np.zeros(n + 1, np.float64)
    kind = np.zeros(n + 1, np.int8)
    kind[1:][ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]] = 1
    kind[doc_ends] = 2
    kind[n] = max(kind[n], 1)
    at = np.flatnonzero(kind)
    long = min(LONG_SENTENCE, window)
    gaps = np.flatnonzero(np.diff(at, prepend=0) > long)
    for g in gaps:
        a, b = (at[g - 1] if g else 0), at[g]
        kind[np.arange(a + max(long // 4, 1), b, max(long // 4, 1))] = 3
    at = np.flatnonzero(kind)
    pen = np.array([0, SENTENCE_CUT, 0, HARD_CUT], np.float64)[kind[at]]
    return at, pen


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], ends_sentence: np.ndarray, first_sequence: int, window: int = WINDOW, stretch: int = STRETCH) -> Iterator[tuple]:
    """Pieces of a stream of (doc_id, ids, end token included), stretch by stretch."""
    sequence = first_sequence
    held: list[list] = []  # [doc_id, ids, start already packed]
    size = 0

    def emit(cuts: list[int]):
        nonlocal sequence, held, size
        flat = [(d, ids, s, len(ids) - s) for d, ids, s in held]
        k = used = done = 0
        for cut in cuts:
            offset, length = 0, cut - done
            while done < cut:
                d, ids, s, n = flat[k]
                take = min(n - used, cut - done)
                part = ids[s + used : s + used + take]
                yield d, s + used, take, zlib.crc32(part.tobytes()), len(ids), sequence, offset, length
                offset += take
                used += take
                done += take
                if used == n:
                    k, used = k + 1, 0
            sequence += 1
        held = [[d, ids, s] for d, ids, s, _ in flat[k:]]
        if held and used:
            held[0][2] += used
        size -= done

    def cuts_of(open_end: bool) -> list[int]:
        parts = [ids[s:] for _, ids, s in held]
        flat = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        at, pen = candidates(flat, ends, ends_sentence, window)
        return choose_cuts(size, at, pen, window, open_end)

    for doc_id, ids in docs:
        held.append([doc_id, ids, 0])
        size += len(ids)
        if size >= stretch:
            if len(cuts := cuts_of(True)) > 1:
                yield from emit(cuts[:-1])
    if size:
        cuts = cuts_of(True)
        last = cuts[-2] if len(cuts) > 1 else 0
        tail = np.cumsum([last, *split_tail(cuts[-1] - last, window)])[1:].tolist()
        yield from emit(cuts[:-1] + tail)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of at most `window` tokens; one row per piece (PIECE_SCHEMA).

    Each input partition is packed on its own, in its order, without a
    shuffle. A sequence's id holds its partition's number, so a task that is
    run again gives the same ids. Padding is `window` - sequence_length, or 0
    where that length is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([END_ID], np.uint32)

        def stream():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, np.concatenate([encoder.ids(text.as_py() or ""), end]).astype("<u4", copy=False)

        rows: list[tuple] = []
        partition = TaskContext.get().partitionId()
        for row in pack_stream(stream(), encoder.ends_sentence, partition << 40, window):
            rows.append(row)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
