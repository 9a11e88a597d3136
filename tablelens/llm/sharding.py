"""Sharding by histogram sort (DataFrame functions only).

Rows are ordered by (hash of the text, id), so equal texts lie together, yet a
group of any size can be split between shards.  Splitters come from rounds of
exact histograms: each round sums the bytes of evenly spaced key ranges inside
the intervals that still hold an unsettled splitter, and narrows those, until
every splitter is within ``tolerance`` of its share or next to a single key.
A round's table is at most (shards - 1) x ``PROBES`` rows.  Rows are then
exchanged once.

Defined cases: null text has no bytes and the checksum of the empty text; a null
id sorts before all others; repeated rows share a key and so a shard, with slots
of their own; fewer rows than shards leave shards empty; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

#: Key ranges that each round probes inside an interval.
PROBES = 256
#: Bytes a row counts besides its text.
OVERHEAD = 16
LOWEST = -(1 << 63)


def sort_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """63-bit hash of the text, and the id as a long (hashed where it is no integer)."""
    integral = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    k = F.col(id_col).cast("long") if integral else F.xxhash64(F.col(id_col))
    return F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1), F.coalesce(k, F.lit(LOWEST))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32 and the sort key (h, k) of each row."""
    text = text_of(text_col)
    h, k = sort_key(docs, id_col, text_col)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), k.alias("k"))


def _histogram(rows: DataFrame, intervals: list[dict]) -> list[list]:
    """For each interval the non-empty probe ranges: (range, bytes, least h, greatest h, least k, greatest k)."""
    place = None
    for i, x in enumerate(intervals):
        inside = F.col("h").between(x["h"][0], x["h"][1])
        if x["by"] == "k":
            inside = inside & F.col("k").between(x["k"][0], x["k"][1])
        offset = F.col(x["by"]).cast("decimal(20,0)") - F.lit(x["lo"]).cast("decimal(20,0)")
        at = F.lit(i * PROBES) + F.floor(offset / F.lit(x["step"]).cast("decimal(20,0)")).cast("int")
        place = F.when(inside, at) if place is None else place.when(inside, at)
    found = (rows.withColumn("at", place).where(F.col("at").isNotNull()).groupBy("at")
             .agg(F.sum("size"), F.min("h"), F.max("h"), F.min("k"), F.max("k")).collect())
    out: list[list] = [[] for _ in intervals]
    for r in sorted(found):
        out[r[0] // PROBES].append((r[0] % PROBES, *r[1:]))
    return out


def _interval(least_h, most_h, least_k, most_k, below, wanted) -> dict:
    by = "h" if least_h < most_h else "k"
    lo, hi = (least_h, most_h) if by == "h" else (least_k, most_k)
    return {"by": by, "h": (least_h, most_h), "k": (least_k, most_k), "lo": lo, "step": (hi - lo) // PROBES + 1,
            "below": below, "wanted": wanted}


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """Keys (h, k) that begin shards 1 to ``shards`` - 1, in order."""
    total, *bounds = rows.agg(F.sum("size"), F.min("h"), F.max("h"), F.min("k"), F.max("k")).first()
    if not total or shards < 2:
        return []
    slack = total / shards * tolerance
    open_ = [_interval(*bounds, 0, [(i, total * i / shards) for i in range(1, shards)])]
    settled: dict[int, tuple[int, int]] = {}
    while open_:
        narrower = []
        for x, ranges in zip(open_, _histogram(rows, open_)):
            ends, below = [], x["below"]
            for r in ranges:
                below += r[1]
                ends.append(below)
            deeper: dict[int, list] = {}
            for i, goal in x["wanted"]:
                at = min(bisect_left(ends, goal), len(ends) - 1)  # the range that the goal falls in
                begin, end = ends[at] - ranges[at][1], ends[at]
                _, _, h0, h1, k0, k1 = ranges[at]
                single = h0 == h1 and k0 == k1
                if min(goal - begin, end - goal) <= slack or single:
                    if goal - begin <= end - goal:
                        edge = (h0, k0) if x["by"] == "k" else (h0, LOWEST)
                    else:  # just after this range's last key
                        edge = (h1, k1 + 1) if x["by"] == "k" else (h1 + 1, LOWEST)
                    settled[i] = edge
                else:
                    deeper.setdefault(at, []).append((i, goal))
            for at, wanted in deeper.items():
                _, n, h0, h1, k0, k1 = ranges[at]
                narrower.append(_interval(h0, h1, k0, k1, ends[at] - n, wanted))
        open_ = narrower
    return [settled[i] for i in sorted(settled)]


def shard_of(splits: list[tuple[int, int]], first: int = 0) -> Column:
    """The number of splitters at or below the row's key, by a balanced tree of comparisons."""
    if not splits:
        return F.lit(first)
    mid = len(splits) // 2
    h, k = splits[mid]
    before = (F.col("h") < F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("k") < F.lit(k)))
    return F.when(before, shard_of(splits[:mid], first)).otherwise(shard_of(splits[mid + 1:], first + mid + 1))


def _placed(rows: DataFrame, splits: list[tuple[int, int]], counted: DataFrame) -> DataFrame:
    """Add shard and slot to rows with a key; one exchange.  ``counted`` has the same keys, without the texts.

    Shards are ranges of keys: a slot is the rows in earlier parts of the shard plus the place in the own part.
    """
    part = F.shiftright("h", 51).cast("int")
    counts = (counted.groupBy(shard_of(splits).alias("shard"), part.alias("part"))
              .agg(F.count(F.lit(1)).alias("n")))  # at most 4096 + shards rows
    begins = counts.select("shard", "part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "k", "size")) - 1
    return (rows.withColumn("shard", shard_of(splits)).withColumn("part", part).withColumn("place", place)
            .join(F.broadcast(begins), ["shard", "part"]).withColumn("slot", F.col("before") + F.col("place")))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  tolerance: float = 0.001) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    rows = materialise(keyed(docs, id_col, text_col), "keys")
    return _placed(rows, splitters(rows, shards, tolerance), rows).select("id", "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                      tolerance: float = 0.001) -> DataFrame:
    """The documents with all their columns and their shard and slot (which take the place of columns so named)."""
    keys = materialise(keyed(docs, id_col, text_col).drop("id"), "keys")
    h, k = sort_key(docs, id_col, text_col)
    size = F.octet_length(text_of(text_col)) + F.lit(OVERHEAD)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.struct(*own).alias("row"), h.alias("h"), k.alias("k"), size.alias("size"))
    return _placed(rows, splitters(keys, shards, tolerance), keys).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = 0.001) -> None:
    """Write the documents into one folder per shard, in slot order within each file."""
    (sharded_documents(docs, shards, id_col, text_col, tolerance).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
