"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's bits are cut into ``SEGMENTS`` segments and each segment is
counted.  Counts of two fingerprints differ, summed over the segments, by no
more than their bits do (Manhattan distance is a lower bound), so links lie
among pairs within that distance.  Of the two halves of the counts one is then
within ``distance // 2``, which is what the grid joins on: a fingerprint lies in the
cell of each half's counts and looks into the cells up to that many steps above.
Candidates are cut by the distance of all counts and then checked on the bits.

Equal fingerprints are one node.  A cell's pairs are never listed: a task links
the nodes of a cell (at most ``BLOCK`` a side, larger cells are split into
blocks and each two blocks meet in a task of their own) and gives out a spanning
forest, at most one link per node.  Components of the forest come from large-star
and small-star rounds, checkpointed to the shared folder.

Defined cases: null, empty and all-white texts have fingerprint 0, linked like any
other; fewer words than a shingle make one shingle of them all; a null id counts
after all others; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

SEED = 42
#: Segments of the 64 bits, two bits each; half of them are one side of the grid.
SEGMENTS = 32
#: Nodes on either side of one comparison.
BLOCK = 4096
#: Fixed value: white space of the contract, as bytes.
RUNS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: each bit is 1 if it is set in over half the shingles' hashes."""
    words = RUNS.findall(text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, width = b" ".join(words), max(1, min(shingle, len(words)))
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-1].tolist()]
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[b:e], SEED) for b, e in zip(begins, (ends[width - 1:] - 1).tolist())], np.uint64)
    set_ = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for at in range(0, len(bits), 255):  # sums of at most 255 fit the narrow type
        set_ += np.add.reduce(bits[at:at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py().encode(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])
    return run


def counts_of(fp: np.ndarray) -> np.ndarray:
    """Bits set in each segment, one row per fingerprint."""
    fp = fp.astype(np.int64).view(np.uint64)[:, None]
    shifts = np.arange(64 - 2, -2, -2, dtype=np.uint64)[None, :]
    two = (fp >> shifts) & np.uint64(3)
    return ((two & np.uint64(1)) + (two >> np.uint64(1))).astype(np.int64)


def _cells(reach: int):
    """Rows (cell, own, fp): a fingerprint's cell of each half, and the cells up to ``reach`` steps beside it."""
    width = SEGMENTS // 2
    steps = 2 * 4 ** np.arange(width, dtype=np.int64)
    moves = {(0,) * width}
    for _ in range(reach):
        moves |= {m[:i] + (m[i] + d,) + m[i + 1:] for m in moves for i in range(width) for d in (1, -1)}
    # of two cells one finds the other: the opposite move is left out
    moves = [np.array(m, np.int64) for m in sorted(moves) if next((x for x in m if x), 0) > 0]

    def rows(cell: np.ndarray, own: bool, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), own)), pa.array(fp)],
                                          names=["cell", "own", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for half, counts in enumerate(np.split(counts_of(fp), 2, axis=1)):
                cell = counts @ steps + half
                yield rows(cell, True, fp)
                for move in moves:
                    to = counts + move
                    at = np.flatnonzero(((to >= 0) & (to <= 2)).all(axis=1))
                    yield rows(cell[at] + int(move @ steps), False, fp[at])
    return run


def forest(fp: np.ndarray, left: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins the fingerprints numbered
    ``left`` to all others within ``distance`` bits."""
    component, links = np.arange(len(fp)), []
    bits = fp.view(np.uint64)
    for i in left.tolist():
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= distance)
        own = component[i]
        if (component[near] == own).all():
            continue
        others, first = np.unique(component[near], return_index=True)
        links += [(int(fp[i]), int(fp[j])) for other, j in zip(others, near[first]) if other != own]
        component[np.isin(component, others)] = own
    return links


def _linked(distance: int):
    """Forest links of each run of equal (cell, pair) in a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            cell, pair, own, fp = columns
            bounds = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(pair) != 0), True]) if len(cell) else []
            found = []
            for begin, end in zip(bounds[:-1], bounds[1:]):
                if end - begin > 1 and (left := np.flatnonzero(own[begin:end])).size:
                    found += forest(fp[begin:end], left, distance)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                               pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)])
                       for h, c in zip(held, batch.columns)]
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(last) - int(last[::-1].argmin() or len(last)) if not last.all() else 0
            held = [c[cut:] for c in columns]  # the last run may go on in the next batch
            yield links([c[:cut] for c in columns])
        yield links(held)
    return run


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` bits would."""
    cells = nodes.select("fp").mapInArrow(_cells(distance // 2), "cell long, own boolean, fp long")
    crowded = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
               .select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = F.transform(every, lambda j: F.struct((block * F.col("blocks") + j).cast("long").alias("pair"), F.lit(True).alias("left")))
    as_right = F.transform(every, lambda i: F.struct((i * F.col("blocks") + block).cast("long").alias("pair"), F.lit(False).alias("left")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("pair"), F.col("own").alias("left")))
    meetings = (F.when(F.col("blocks").isNull(), alone)
                .when(F.col("own"), F.concat(as_left, as_right)).otherwise(as_right))
    met = (cells.join(crowded, "cell", "left").select("cell", "fp", F.inline(meetings))
           .select("cell", "pair", "left", "fp")
           .repartition("cell", "pair").sortWithinPartitions("cell", "pair"))
    return met.mapInArrow(_linked(distance), "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link.

    Large-star and small-star rounds: every node's neighbours are tied to the
    least one, so paths halve; a round is an aggregation and a join.
    """
    edges = materialise(edges.select("a", "b"), "edges")
    before = None
    for _ in range(most_rounds):
        for small in (False, True):
            if small:
                around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            else:
                around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = around.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
            tied = around.join(least, "a")
            if small:
                tied = tied.select("b", "least").unionByName(tied.select(F.col("a").alias("b"), "least"))
            else:
                tied = tied.where("b > a").select("b", "least")
            edges = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        edges = materialise(edges, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.withColumn("component", F.col("node"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row per input row: id, fp (bits as a long), root (the component's least fingerprint), component_id (its least id)."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = materialise(texts.mapInArrow(
        _fingerprints(shingle), f"id {texts.schema['id'].dataType.simpleString()}, fp long"), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    tied = components(links(nodes, distance))
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialise(rooted.select("fp", "root").join(least, "root"), "components")
    return rows.join(named, "fp").select("id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             distance: int = 3) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the least id."""
    groups = materialise(near_duplicates(docs, id_col, text_col, shingle, distance), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("best"))
    times = groups.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    keys = best.select(F.col("best.id").alias("__id"), F.col("best.fp").alias("__fp"))
    keys = materialise(keys.join(times, F.col("__id").eqNullSafe(F.col("id"))).select(
        "__id", "__fp", ((F.col("times") > 1) | F.col("__id").isNull()).alias("__again")), "kept")
    single = docs.join(keys.where("not __again"), docs[id_col] == F.col("__id"), "left_semi")
    # ids that are null or there more than once do not name a row: those rows are told apart by fingerprint
    again = docs.join(keys.where("__again").select("__id").distinct(), docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
    packed = again.select(F.struct(*docs.columns).alias("id"), text_of(text_col).alias("text"))
    marked = packed.mapInArrow(_fingerprints(shingle), f"id {packed.schema['id'].dataType.simpleString()}, fp long")
    marked = marked.join(keys.where("__again"), (F.col("fp") == F.col("__fp")) & F.col("id")[id_col].eqNullSafe(F.col("__id")))
    kept = marked.groupBy("__id", "__fp").agg(F.first("id").alias("row")).select("row.*")
    return single.unionByName(kept)
