"""Substring dedup with run-length indexes over the repetitive part of a corpus.

Every byte covered by a string of ``length`` bytes that also starts earlier goes.

1. *Anchors.*  Each window of ``length`` bytes picks its least k-gram hash
   (winnowing), so equal windows pick the same place in them.  Neighbouring windows with one pick
   form a context; (anchor, digest of the context) is one row per document.
2. *Equal contexts.*  Rows are exchanged by anchor and sorted; all but the first
   occurrence of a context go whole.  A first occurrence matters further only
   where its anchor has several contexts: those are the index's texts.
3. *Run-length index.*  Contexts of an anchor meet in one shard of bounded size, in corpus order.
   The shard's Burrows-Wheeler transform is kept as runs with a suffix sample at
   each run's border; between samples the matching statistics (the preceding suffix and the length
   shared with it) follow by stepping, so long matches are marked per run.
   A window goes if the class of equal windows that these matches chain has an earlier member.
4. *Crowded anchors.*  Of an anchor with over ``GROUP`` contexts (a common line
   with ever new neighbours) each window becomes a context of its own and step 2 settles it.
5. Spans meet their documents once and are merged and cut there.

Defined cases: null text counts as empty; texts shorter than ``length`` stay whole; a null
id comes after all others; rows of one id come in order of a hash of their
texts, and rows equal in both are one document with one answer; ids that are no integers
are ordered by their hash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Windows of a text handled at a time.
CHUNK = 1 << 18
#: Bits for the place of a byte in a text (Spark's texts have under 2 GB).
PLACE = 31
#: Contexts of one anchor that meet in an index, and bytes of a shard's text.
GROUP, SHARD_BYTES = 4096, 1 << 22
#: Stands between contexts; no byte of UTF-8.
BETWEEN = 0xFF


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Anchors:
    """Contexts of texts: runs of windows that pick the same k-gram."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.bits = length, gram, U(int(length).bit_length())
        size = CHUNK + length
        self.up = np.multiply.accumulate(np.r_[U(1), np.full(size, BASE, U)])
        self.down = np.multiply.accumulate(np.r_[U(1), np.full(size, pow(BASE, -1, 1 << 64), U)])

    def of(self, text: bytes) -> tuple[np.ndarray, ...]:
        """(anchor hash, context digest with its reach to both sides, place of the anchor, begin, end) in text order."""
        parts = [self._chunk(text[at:at + CHUNK + self.length - 1], at)
                 for at in range(0, len(text) - self.length + 1, CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.empty(0, t) for t in (U, U, int, int, int))

    def _chunk(self, text: bytes, at: int) -> tuple[np.ndarray, ...]:
        symbols = np.frombuffer(text, np.uint8).astype(U) + U(1)
        n, k, w = len(symbols), self.gram, self.length - self.gram + 1
        sums = np.zeros(n + 1, U)
        np.cumsum(symbols * self.up[:n], out=sums[1:])
        hashes = _mixed((sums[k:] - sums[:-k]) * self.down[:n - k + 1])
        least = (hashes & ~U((1 << 24) - 1)) | np.arange(len(hashes), dtype=U)  # ties: the leftmost
        step = 1
        while step * 2 <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:len(least) - (w - step)], least[w - step:])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        begin, end = first, np.r_[first[1:], len(least)] - 1 + self.length
        place = (least[first] & U((1 << 24) - 1)).astype(np.int64)
        digest = _mixed((sums[end] - sums[begin]) * self.down[begin])
        reach = ((place - begin).astype(U) << self.bits) | (end - place).astype(U)
        clear = ~U((1 << 2 * int(self.bits)) - 1)
        return hashes[place], (digest & clear) | reach, place + at, begin + at, end + at


def _again(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Whether the same context stands earlier in the text."""
    order = np.lexsort((np.arange(len(anchor)), context, anchor))
    same = np.r_[False, (np.diff(anchor[order]) == 0) & (np.diff(context[order]) == 0)]
    out = np.empty(len(anchor), bool)
    out[order] = same
    return out


def _occurrences(length: int, gram: int):
    """A row for the first place of each context in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
            held = 0
            for id_, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, context, place, _, _ = anchors.of(text)
                first = ~_again(anchor, context)
                n = int(first.sum())
                for column, values in zip(out, (anchor[first].view(np.int64), context[first].view(np.int64),
                                                np.full(n, id_, np.int64), (th << PLACE) + place[first])):
                    column.append(values)
                held += n
                if held >= 1 << 19:
                    yield _occurrence_batch(out)
                    out, held = [[np.empty(0, np.int64)] for _ in range(4)], 0
            yield _occurrence_batch(out)
    return run


def _occurrence_batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["anchor", "context", "id", "at"])


FOUND = "again boolean, anchor long, id long, th long, begin long, end long"


def _first_and_again(length: int):
    """Over rows sorted by (anchor, context, id, at): every repeat of a context, and
    the first occurrences of contexts whose anchor has several.  Holds one row
    between batches, whatever the size of a group."""
    bits = int(length).bit_length()
    mask = (1 << bits) - 1

    def found(again: bool, rows: np.ndarray) -> pa.RecordBatch:
        anchor, context, id_, at = rows
        place = at & ((1 << PLACE) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(anchor), again)), pa.array(anchor), pa.array(id_), pa.array(at >> PLACE),
             pa.array(place - (context >> bits & mask)), pa.array(place + (context & mask))],
            names=["again", "anchor", "id", "th", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((4, 0), np.int64)  # the first row of the last context
        waiting = False  # whether it is the only context of its anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            new_anchor = np.r_[True, rows[0, 1:] != rows[0, :-1]]
            new = new_anchor | np.r_[True, rows[1, 1:] != rows[1, :-1]]
            starts = np.flatnonzero(new)
            first = starts[np.cumsum(new) - 1]
            repeat = ~new & ((rows[2] != rows[2, first]) | (rows[3] != rows[3, first]))
            yield found(True, rows[:, repeat])
            group = np.cumsum(new_anchor[starts])
            several = np.bincount(group)[group] > 1
            emit = several.copy()
            if last.shape[1]:
                if not waiting:  # its group is known to have several contexts, and it has been given out
                    emit[group == group[0]] = True
                    emit[0] = False
            yield found(False, rows[:, starts[emit]])
            waiting = not several[-1] and not (group[-1] == group[0] and last.shape[1] and not waiting)
            last = rows[:, starts[-1:]]
    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and its inverse: ranked on seven bytes, then on twice as many each round.

    A byte takes nine bits, so the end of the text differs from every byte."""
    n = len(text)
    symbols = np.concatenate([text.astype(U) + U(1), np.zeros(6, U)])
    key = np.zeros(n, U)
    for i in range(7):
        key = (key << U(9)) | symbols[i:i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
    step = 7
    while rank[order[-1]] < n - 1:
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        step *= 2
    return order, rank


class RunLengthIndex:
    """Matching statistics of a text against itself from its run-compressed Burrows-Wheeler transform.

    ``phi`` of a place is the place whose suffix precedes it in suffix order.  Inside a run of equal
    BWT symbols both move back together, so the pair and the length they share are sampled only at the
    places of run heads; every other place follows from the next sample at or after it.
    """

    def __init__(self, text: np.ndarray, most: int):
        order, rank = suffix_array(text)
        symbols = text[order - 1].astype(np.int16)
        symbols[rank[0]] = -1  # nothing precedes the whole text: a run of its own, so both its borders are sampled
        heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        self.runs = len(heads)
        self.samples = np.unique(np.r_[order[heads] - 1, len(text) - 1] % len(text))
        before = rank[self.samples] - 1
        self.phi = np.where(before >= 0, order[before], -1)
        self.shared = np.where(before >= 0, _shared(text, self.samples, np.maximum(self.phi, 0), most), 0)

    def matches(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The places that share ``length`` or more with the suffix before them in order, and where that one starts."""
        at = np.searchsorted(self.samples, places)
        steps = self.samples[at] - places
        long_ = self.shared[at] + steps >= length
        here, there = places[long_], (self.phi[at] - steps)[long_]
        if len(there) and (there.min() < 0 or (here == there).any()):
            raise AssertionError("a sample is missing beside a run")
        return here, there


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes, up to ``most``."""
    padded = np.concatenate([text, np.arange(most, dtype=np.uint8)])
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for i in range(most):
        open_ = open_[(padded[a[open_] + i] == padded[b[open_] + i]) & (np.maximum(a[open_], b[open_]) + i < len(text))]
        if not len(open_):
            break
        out[open_] = i + 1
    return out


def repeated_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of every window that stands in an earlier context too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"".join(c + bytes([BETWEEN]) for c in contexts), np.uint8)
    windows = sizes - length + 1
    which = np.repeat(np.arange(len(contexts)), windows)
    places = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[which]
    here, there = RunLengthIndex(text, length).matches(places, length)
    parent = np.arange(len(text))
    parent[here] = there
    for _ in range(len(text).bit_length()):  # each link leads back in suffix order, so chains end, and they halve
        parent[here] = parent[parent[here]]
    if len(here) and (parent[parent[here]] != parent[here]).any():
        raise AssertionError("matches form a circle")
    least = np.arange(len(text))
    np.minimum.at(least, parent[here], here)
    gone = places[least[parent[places]] < places]
    context = np.searchsorted(begins, gone, side="right") - 1
    return context, gone - begins[context]


SPAN = "id long, th long, begin long, end long"


def _span_batch(id_, th, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (id_, th, begin, end)], names=["id", "th", "begin", "end"])


def _indexed(length: int):
    """Spans of repeated windows, over contexts sorted by (anchor, id, th, begin)."""
    def spans(rows: list[tuple]) -> pa.RecordBatch:
        context, place = repeated_windows([r[4] for r in rows], length)
        if not len(context):
            return _span_batch([], [], [], [])
        cut = np.flatnonzero(np.r_[True, (np.diff(context) != 0) | (np.diff(place) != 1)])
        until = np.r_[cut[1:], len(context)] - 1
        own = [rows[i] for i in context[cut].tolist()]
        begin = np.array([r[3] for r in own])
        return _span_batch([r[1] for r in own], [r[2] for r in own], begin + place[cut], begin + place[until] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= SHARD_BYTES and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield spans(rows)
    return run


def _windows(length: int):
    """Each window of the contexts as a context of its own, in the form of :func:`_occurrences`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, length)
        for batch in batches:
            for _, id_, th, begin, text in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, context, place, _, _ = anchors.of(text)
                yield _occurrence_batch([[anchor.view(np.int64)], [context.view(np.int64)],
                                         [np.full(len(anchor), id_, np.int64)], [(th << PLACE) + place + begin]])
    return run


def _cut(length: int, gram: int):
    """Merge the spans with those repeated inside the document, and cut them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                anchor, context, _, begin, end = anchors.of(text)
                own = _again(anchor, context)
                begin, end = begin[own], end[own]
                if spans.is_valid:
                    begin = np.r_[begin, spans.values.field(0).to_numpy()]
                    end = np.r_[end, spans.values.field(1).to_numpy()]
                out.append(merged(text, begin, end))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))]
                if out else [batch.column(0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def merged(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, maximal removed runs, and the bytes left."""
    if not len(begin):
        return len(text), 0, 0, text
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    apart = np.r_[True, begin[1:] > reach[:-1]]
    begin, end = begin[apart], reach[np.r_[np.flatnonzero(apart)[1:], len(reach)] - 1]
    kept = b"".join(text[a:b] for a, b in zip(np.r_[0, end], np.r_[begin, len(text)]))
    return len(text), len(text) - len(kept), len(begin), kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   gram: int = 32) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    text = text_of(text_col)
    integral = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col(id_col).cast("long") if integral else F.xxhash64(F.col(id_col))
    named = docs.select(F.col(id_col).alias("own_id"), F.coalesce(key, F.lit((1 << 63) - 1)).alias("id"),
                        F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).alias("th"), text.cast("binary").alias("text"))
    texts = named.select("id", "th", "text")

    places = texts.mapInArrow(_occurrences(length, gram), "anchor long, context long, id long, at long")
    found = materialise(places.repartition("anchor").sortWithinPartitions("anchor", "context", "id", "at")
                        .mapInArrow(_first_and_again(length), FOUND), "contexts")
    first = found.where("not again")
    # at most one row for GROUP contexts: written, so that the join below knows its size
    crowded = materialise(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
                          .select("anchor", F.lit(True).alias("crowded")), "crowded")
    cut = F.substring(F.col("text"), (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    contexts = materialise(first.join(crowded, "anchor", "left").join(texts, ["id", "th"]).select(
        "anchor", "id", "th", "begin", cut.alias("context"), "crowded"), "context_texts")
    shards = (contexts.where("crowded is null").drop("crowded").distinct().repartition("anchor")
              .sortWithinPartitions("anchor", "id", "th", "begin"))
    indexed = shards.mapInArrow(_indexed(length), SPAN)
    single = contexts.where("crowded").drop("crowded").mapInArrow(
        _windows(length), "anchor long, context long, id long, at long")
    single = (single.repartition("anchor", "context").sortWithinPartitions("anchor", "context", "id", "at")
              .mapInArrow(_first_and_again(length), FOUND))
    spans = (found.where("again").select("id", "th", "begin", "end").unionByName(indexed)
             .unionByName(single.where("again").select("id", "th", "begin", "end"))
             .groupBy("id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    joined = named.join(spans, ["id", "th"], "left").select(F.struct("own_id").alias("id"), "text", "spans")
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(length, gram), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
                             ).select(F.col("id.own_id").alias("id"), "n_bytes", "n_removed", "n_spans", "kept")
