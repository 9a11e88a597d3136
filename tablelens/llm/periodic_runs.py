"""Periodic runs in texts by online dyadic square catching.

Words are appended to a stream, a chunk at a time.  Each completed block of 2^k
words has a catcher: while the next words of the stream arrive, the newest window of 2^k
words is compared (by rolling hash) with the block that may be its copy one period
before.  A hit is a square in the making: its period is the distance,
and the suffix comparisons to both sides say how far it reaches.  A stretch that
reaches the stream's end stays open and is carried on word by word by the next chunk; when it
breaks it is merged with all other squares of its period and, where long enough, reported as a run.

Why nothing is missed: a run of period q and length m >= max(least, 3 q) has ``m - q >= 2 q`` words that
recur one period on, so it holds an aligned block of the largest power of two up to q; each window
start meets one catcher per level (two at the lowest), so the work is n log n
comparisons however repetitive the text is.  Multiples of a known period
inside its stretch are dropped unread.  Hashes only nominate: every stretch is grown by comparing word ids.

Documents of a batch form one stream with a word between them that equals no
other; a long one is a stream of its own.  Nothing is shuffled.

Defined cases: null, empty and white texts have no words, no runs and an empty
rest; repeated rows are rows like others; null ids too; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import WORD_REGEX, text_of

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Words that are joined into one stream before its runs are asked for, and appended at a time.
STREAM, CHUNK = 1 << 18, 1 << 16


def _symbols(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    return (h ^ (h >> U(32))) * U(BASE)


class Grown:
    """An array that words are appended to."""

    def __init__(self, kind, first=()):
        self.held, self.n = np.zeros(1 << 10, kind), 0
        self.extend(np.array(first, kind))

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            held = np.zeros(max(2 * len(self.held), self.n + len(more)), self.held.dtype)
            held[:self.n] = self.held[:self.n]
            self.held = held
        self.held[self.n:self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self.held[:self.n]


class SquareCatcher:
    """Maximal runs of a stream of word ids: length >= max(``least``, 3 periods).

    The answer does not depend on how the stream is cut into chunks.
    """

    def __init__(self, least: int = 24):
        self.least = max(3, least)
        self.words, self.sums = Grown(np.int64), Grown(U, [0])
        self.up, self.down = Grown(U, [1]), Grown(U, [1])
        # the lowest block: every run with a period under twice its size recurs over 2 * size - 1 words or more
        self.lowest = 1 << (((2 * self.least + 2) // 3 + 1) // 2).bit_length() - 1
        self.compared: dict[int, int] = {}  # window starts done, by block size
        self.open: list[list[int]] = []  # (period, start, end): stretches that reach the end of the stream
        self.runs: list[tuple[int, int, int]] = []

    def append(self, ids: np.ndarray) -> None:
        before = self.words.n
        self._extend(ids)
        known = [self._carried(s, before) for s in self.open]
        size = self.lowest
        while size < self.words.n:
            self._catch(size, known)
            size *= 2
        self._settle(known, self.words.n)

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start, then period."""
        self._settle(self.open, -1)
        return sorted(self.runs)

    def _extend(self, ids: np.ndarray) -> None:
        n, new = self.words.n, len(ids)
        for powers, base in ((self.up, BASE), (self.down, pow(BASE, -1, 1 << 64))):
            short = n + new + 1 - powers.n
            if short > 0:
                powers.extend(np.multiply.accumulate(np.r_[powers.now[-1], np.full(short, base, U)])[1:])
        self.words.extend(np.asarray(ids, np.int64))
        sums = np.cumsum(_symbols(self.words.now[n:]) * self.up.now[n:n + new], dtype=U)
        self.sums.extend(sums + self.sums.now[-1])

    def _windows(self, size: int, begin: int, end: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start in [begin, end)."""
        sums = self.sums.held
        return (sums[begin + size:end + size] - sums[begin:end]) * self.down.held[begin:end]

    def _catch(self, size: int, known: list[list[int]]) -> None:
        """Compare the newest windows with the catchers of their level; grow what they catch."""
        begin, end = self.compared.get(size, 0), self.words.n - size + 1
        if begin >= end:
            return
        self.compared[size] = end
        base = max(0, (begin // size - 1) * size)
        hashes = self._windows(size, base, end)
        starts = np.arange(begin, end)
        found = []
        for back in (0, 1) if size == self.lowest else (1,):
            block = (starts // size - back) * size  # the lowest level also catches periods under the block's size
            block = np.where((block >= 0) & (block < starts), block, starts)
            hit = (hashes[block - base] == hashes[starts - base]) & (block < starts)
            found.append(np.stack([starts[hit] - block[hit], block[hit]]))
        period, block = np.concatenate(found, axis=1)
        order = np.lexsort((block, period))
        period, block = period[order], block[order]
        for stretch in known:
            if not len(period):
                return
            period, block = self._beyond(stretch, period, block, size)
        while len(period):
            stretch = self._stretch(int(period[0]), int(block[0]), size)
            if stretch is None:  # a collision of hashes
                period, block = period[1:], block[1:]
                continue
            known.append(stretch)
            period, block = self._beyond(stretch, period, block, size)

    @staticmethod
    def _beyond(stretch: list[int], period: np.ndarray, block: np.ndarray, size: int):
        """What a known stretch doesn't explain: it does where both copies lie in it and its period divides theirs."""
        p, start, end = stretch
        rest = (block < start) | (block + period + size > end) | (period % p != 0)
        return period[rest], block[rest]

    def _stretch(self, period: int, block: int, size: int) -> list[int] | None:
        """The whole stretch of this period around a block and its copy."""
        words = self.words.now
        if (words[block:block + size] != words[block + period:block + period + size]).any():
            return None
        start, step = block, 64
        while start:
            lo = max(0, start - step)
            differ = np.flatnonzero(words[lo:start] != words[lo + period:start + period])
            if len(differ):
                start = lo + int(differ[-1]) + 1
                break
            start, step = lo, 2 * step
        return [period, start, self._reach(period, block + period + size)]

    def _reach(self, period: int, end: int) -> int:
        """How far the suffix comparison goes on: the first word that breaks the period."""
        words, step = self.words.now, 64
        while end < len(words):
            hi = min(len(words), end + step)
            differ = np.flatnonzero(words[end:hi] != words[end - period:hi - period])
            if len(differ):
                return end + int(differ[0])
            end, step = hi, 2 * step
        return end

    def _carried(self, stretch: list[int], before: int) -> list[int]:
        period, start, end = stretch
        return [period, start, self._reach(period, end)] if end == before else stretch

    def _settle(self, known: list[list[int]], now: int) -> None:
        """Report the stretches that broke; those that reach ``now`` stay open."""
        self.open = [s for s in known if s[2] == now]
        self.runs += [(start, end - start, period) for period, start, end in known
                      if end != now and end - start >= max(self.least, 3 * period)]


def runs_of(documents: list[list[bytes]], least: int = 24) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, all in one stream."""
    names: dict[bytes, int] = defaultdict(itertools.count().__next__)
    catcher, begins, at = SquareCatcher(least), [], 0
    buffer: list[np.ndarray] = []
    held = 0
    for i, words in enumerate(documents):
        begins.append(at)
        ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        buffer += [ids, np.array([-2 - i])]  # between documents, a word that equals no other
        at += len(words) + 1
        held += len(words) + 1
        if held >= CHUNK or i + 1 == len(documents):
            ids = np.concatenate(buffer)
            for cut in range(0, len(ids), CHUNK):
                catcher.append(ids[cut:cut + CHUNK])
            buffer, held = [], 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    owner = np.array(begins)
    for start, length, period in catcher.finish():
        i = int(np.searchsorted(owner, start, side="right")) - 1
        out[i].append((start - begins[i], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period:start + length] = False
    return b" ".join(itertools.compress(words, stays.tolist()))


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(least: int):
    def out(ids: pa.Array, documents: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(documents, least)
        rest = [collapsed(w, r) for w, r in zip(documents, runs)]
        found = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in documents], pa.int64()), pa.array(found, _RUN_TYPE),
             pa.array(rest, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents, held, done = [], 0, 0
            for at in range(batch.num_rows):
                words = batch.column(1)[at].as_py().split()  # bytes part at exactly the contract's white space
                documents.append(words)
                held += len(words)
                if held >= STREAM or at + 1 == batch.num_rows:
                    yield out(batch.column(0).slice(done, at + 1 - done), documents)
                    documents, held, done = [], 0, at + 1
    return find


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period by start, then
    period), collapsed (the words that no run repeats, joined by one space)."""
    rows = docs.select(F.struct(F.col(id_col).alias("own_id")).alias("id"), text_of(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find(least), f"id {kind}, n_words long, runs {RUNS}, collapsed binary").select(
        F.col("id.own_id").alias("id"), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def cycle_tail(text: Column, start: Column, parts: Column) -> Column:
    """The text's words from number ``start mod n`` on as a cycle of their first
    1 + floor(rest / parts), joined by one space: a planted run for tests of the operator.  Texts without words stay."""
    words = F.regexp_extract_all(text, F.lit(WORD_REGEX), F.lit(0))
    n = F.size(words)
    at = (start % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - at) / parts)).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, at + 1, period), F.ceil((n - at) / period).cast("int")))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), at), F.slice(cycle, F.lit(1), n - at)), " ")).otherwise(text)
