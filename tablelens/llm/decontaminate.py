"""Benchmark decontamination with an FM-index per shard of training text.

Words are ids of the benchmark's vocabulary; a word outside it can be in no
match, so a document is cut there, and only stretches at least as long as the
shortest window enter the index.  Each task gathers stretches into shards of
bounded size, builds the Burrows-Wheeler transform with a wavelet matrix for its
ranks and suffix positions sampled at every ``SAMPLE``-th place of the text,
searches all windows backwards at once, locates their occurrences by stepping to
the next sampled position, and merges the spans per document.

The benchmark is the stated query set.  It is read in blocks of bounded size, one
broadcast at a time: a pass over all documents searches one block and writes the
spans and items of each document that it hits, and the passes' rows are merged by
the documents' row numbers.  A benchmark of one block needs one pass and no
shuffle.  The driver holds two blocks at most, a task the windows of one.

Defined cases: null and empty texts have no words and no hits; items without
words are never found; equal windows of several items count for each of them;
repeated documents get a row each; a very long text is a shard by itself; columns of any
other name stay out of the way (documents are carried as one struct); empty
tables give no rows or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

#: Fixed value: runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words in a shard's index before it is searched.
SHARD_WORDS = 1 << 20
#: Every so many places of a shard's text its suffix position is kept.
SAMPLE = 8
#: Characters of benchmark text in a broadcast block.
BLOCK_CHARS = 16 << 20


def words_of(text: str) -> list[str]:
    """Lower-cased (A-Z) words of a text."""
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


class Windows:
    """The distinct windows of a block of items, grouped by length."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.vocabulary: dict[str, int] = {}
        known: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(len(ids) - n, 0) + 1 if ids else 0):
                known.setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.items = [sorted(s) for s in known.values()]
        lengths = np.array([len(w) for w in known], np.int64)
        self.groups = [(int(m), np.flatnonzero(lengths == m),
                        np.array([w for w in known if len(w) == m], np.int64)) for m in np.unique(lengths)]
        self.shortest = int(lengths.min()) if len(lengths) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length they are ranked on."""
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.r_[0, np.diff(text[order]) != 0])
    step = 1
    while len(text) and rank[order[-1]] < len(text) - 1:
        later = np.zeros(len(text), np.int64)
        later[:-step or None] = rank[step:] + 1
        pair = rank * (len(text) + 1) + later
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of any symbol in a sequence: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            ones = (sequence >> shift) & 1
            before = np.r_[0, np.cumsum(ones)].astype(np.int32)
            zeros = len(sequence) - int(before[-1])
            self.levels.append((shift, before, zeros))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        begin = np.zeros(len(symbol), np.int64)
        for shift, before, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            begin = np.where(one, zeros + before[begin], begin - before[begin])
            upto = np.where(one, zeros + before[upto], upto - before[upto])
        return upto - begin


class FMIndex:
    """Full-text index of a sequence of ids; id 0 separates stretches."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.r_[text + 1, 0]  # a least symbol that is there once, so that steps back are right everywhere
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 2))]
        self.wavelet = WaveletMatrix(self.bwt, int(sigma + 1).bit_length())
        self.sampled = order % SAMPLE == 0
        self.sample_at = np.r_[0, np.cumsum(self.sampled)]
        self.samples = order[self.sampled]

    def back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, place)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each pattern, all patterns at once from their last symbol."""
        begin = np.zeros(len(patterns), np.int64)
        end = np.full(len(patterns), len(self.bwt), np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column] + 1
            begin, end = self.back(symbol, begin), self.back(symbol, end)
        return begin, np.maximum(begin, end)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order: steps back to a sampled one."""
        found, steps = np.empty(len(places), np.int64), np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))
        places = places.copy()
        while len(open_):
            hit = self.sampled[places[open_]]
            done = open_[hit]
            found[done] = self.samples[self.sample_at[places[done]]] + steps[done]
            open_ = open_[~hit]
            places[open_] = self.back(self.bwt[places[open_]], places[open_])
            steps[open_] += 1
        return found


def occurrences(text: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, window numbers) of all windows in a shard's text."""
    index = FMIndex(text, len(windows.vocabulary))
    for length, numbers, patterns in windows.groups:
        begin, end = index.search(patterns)
        count = end - begin
        which = np.repeat(np.arange(len(numbers)), count)
        places = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
        yield length, index.locate(places), numbers[which]


class _Shard:
    """Documents whose stretches are indexed together."""

    def __init__(self, windows: Windows):
        self.windows, self.docs, self.held = windows, [], 0
        self.texts: list[np.ndarray] = []
        self.origins: list[tuple[int, int, int]] = []  # length with separator, document, first word

    def add(self, words: list[str]) -> None:
        at, known = len(self.docs), self.windows
        self.docs.append(len(words))
        if not known.shortest or len(words) < known.shortest:
            return
        ids = np.fromiter((known.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        cut = np.flatnonzero(np.r_[True, ids == 0, True])  # a stretch lies between two cuts
        for i in np.flatnonzero(np.diff(cut) > known.shortest):
            stretch = ids[cut[i]:cut[i + 1] - 1]
            self.texts += [stretch, np.zeros(1, np.int64)]
            self.origins.append((len(stretch) + 1, at, int(cut[i])))
            self.held += len(stretch) + 1

    def spans(self) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, merged [begin, end) spans, items) of each document, in order."""
        marks: list[list[tuple[int, int]]] = [[] for _ in self.docs]
        items: list[set[str]] = [set() for _ in self.docs]
        if self.texts:
            lengths, docs, firsts = (np.array(x, np.int64) for x in zip(*self.origins))
            begins = np.cumsum(lengths) - lengths
            for length, found, numbers in occurrences(np.concatenate(self.texts), self.windows):
                stretch = np.searchsorted(begins, found, side="right") - 1
                starts = found - begins[stretch] + firsts[stretch]
                for doc, start, number in zip(docs[stretch].tolist(), starts.tolist(), numbers.tolist()):
                    marks[doc].append((start, start + length))
                    items[doc].update(self.windows.items[number])
        for n, spans, held in zip(self.docs, marks, items):
            yield n, merged(spans), held


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [begin, end) spans."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


RESULT = "n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<string>"


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    if not spans:
        return text
    words = list(WORD.finditer(text.translate(LOWER)))
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at:words[begin].start()])
        at = words[end - 1].end()
    return "".join([*kept, text[at:]])


def _shards(block, n: int):
    """Iterator of finished shards over batches of (row, text); a document's key is its place in the held rows."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], _Shard]]:
        windows = Windows(block.value, n)
        for batch in batches:
            begin, shard, texts = 0, _Shard(windows), []
            for at, text in enumerate(batch.column(1).to_pylist()):
                shard.add(words_of(text))
                texts.append(text)
                if shard.held >= SHARD_WORDS or at + 1 == batch.num_rows:
                    yield batch.column(0).slice(begin, at + 1 - begin), texts, shard
                    begin, shard, texts = at + 1, _Shard(windows), []
    return shards


SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _found(ids: pa.Array, rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.RecordBatch:
    """Rows of (words, spans, items), as ``RESULT`` has them."""
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([r[0] for r in rows], pa.int64()),
         pa.array([sum(e - b for b, e in r[1]) for r in rows], pa.int64()),
         pa.array([[{"begin": b, "end": e} for b, e in r[1]] for r in rows], SPAN),
         pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
        names=["id", "n_words", "n_hit", "spans", "items"])


def _scan(block, n: int):
    shards = _shards(block, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, shard in shards(batches):
            yield _found(ids, list(shard.spans()))
    return scan


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the passes found in each document, as one list of spans and one of items."""
    for batch in batches:
        words, spans, items = (c.to_pylist() for c in batch.columns[1:])
        rows = [(n, merged([(s["begin"], s["end"]) for part in a for s in part]), set(chain.from_iterable(b)))
                for n, a, b in zip(words, spans, items)]
        yield _found(batch.column(0), rows)


def _cut_rows(rows: pa.Array, texts: list[str], found: list[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [rows, pa.array([without(t, s) if s else None for t, (_, s) in zip(texts, found)], pa.string()),
         pa.array([bool(s) for _, s in found]),
         pa.array([sum(e - b for b, e in s) < w or not s for w, s in found])],
        names=["row", "cut", "hit", "left"])


def _cut(block, n: int):
    shards = _shards(block, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, shard in shards(batches):
            yield _cut_rows(rows, texts, [(n_words, spans) for n_words, spans, _ in shard.spans()])
    return cut


def _cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_cut`, from (row, text, n_words, spans)."""
    for batch in batches:
        spans = [[(s["begin"], s["end"]) for s in found or []] for found in batch.column(3).to_pylist()]
        yield _cut_rows(batch.column(0), batch.column(1).to_pylist(), list(zip(batch.column(2).to_pylist(), spans)))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters (or one item), one at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_of(text_col)).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item or "", text))
        size += len(text)
    yield block


def _passes(rows: DataFrame, blocks: Iterator[list[tuple[str, str]]], n: int) -> DataFrame:
    """(number, n_words, n_hit, spans, items) of a table of (number, text): a pass for each block, merged."""
    sc, found = rows.sparkSession.sparkContext, []
    for block in blocks:
        held = sc.broadcast(block)
        part = rows.mapInArrow(_scan(held, n), f"id long, {RESULT}")
        # the first pass counts words for all documents, later ones keep the documents that they hit
        found.append(materialise(part if not found else part.where("n_hit > 0"), "leaks"))
        held.destroy()
    both = reduce(DataFrame.unionByName, found).groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    merged_rows = both.select("id", "n_words", "spans", "items").mapInArrow(_merge, f"id long, {RESULT}")
    return merged_rows.withColumnRenamed("id", "number")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans of hit words, items found (sorted as strings)."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if second is None:
        block = docs.sparkSession.sparkContext.broadcast(first)
        return rows.mapInArrow(_scan(block, n), f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}")
    numbered = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = _passes(numbered.select("number", "text"), chain([first, second], blocks), n)
    return numbered.select("number", "id").join(found, "number").drop("number")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None,
                 item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """The documents, all columns, with the hit spans cut out of their texts (and ``length_col`` set to the characters
    left); documents of which no word is left go, others stay as they are."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of(text_col).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, cut string, hit boolean, left boolean"
    if second is None:
        block = docs.sparkSession.sparkContext.broadcast(first)
        done = rows.mapInArrow(_cut(block, n), schema)
    else:
        numbered = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
        found = _passes(numbered.select("number", "text"), chain([first, second], blocks), n)
        done = numbered.join(found, "number").select("row", "text", "n_words", "spans").mapInArrow(_cut_found, schema)
    done = done.where("left")
    new = {text_col: F.when(F.col("hit"), F.col("cut")).otherwise(F.col("row")[text_col])}
    if length_col:
        new[length_col] = F.when(F.col("hit"), F.char_length("cut").cast(docs.schema[length_col].dataType)
                                 ).otherwise(F.col("row")[length_col])
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
