"""Exact dedup by a heavy-hitter split.

Every row is reduced to the SHA-256 of its text without white space.  A
Misra-Gries summary per partition, merged by one small aggregation, names every
digest that can hold ``2 / (k + 1)`` of the rows.  Those candidates are counted
exactly; the verified ones (at most ``(k + 1) / 2`` by their share) are broadcast
with their winners, so rows of hot groups are settled map-side and never
shuffled.  All other digests go through an ordinary aggregation and join.

Defined cases: null text counts as empty; null ids rank after all others; of
rows equal in text, length and id (repeated rows) one is kept; other columns of
the input are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import WHITE, materialise, text_of

#: Counters of a Misra-Gries summary; digests with 2 / (COUNTERS + 1) of all rows are found for certain.
COUNTERS = 1024


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(text, WHITE, "").cast("binary"), 256))


def misra_gries(k: int):
    """Summarise a partition of digests by at most ``k`` counters; a digest's counter
    falls short of its true count by at most rows / (k + 1)."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            counts = batch.column(0).value_counts()
            for digest, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                counters[digest] = counters.get(digest, 0) + n
            if len(counters) > k:
                cut = heapq.nlargest(k + 1, counters.values())[-1]
                counters = {d: n - cut for d, n in counters.items() if n > cut}
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(counters), pa.binary()), "n": pa.array(list(counters.values()), pa.int64())})
    return summarise


def _winner() -> tuple[Column, Column]:
    """Count and winner of a group: longest text, then smallest id, then first row."""
    first = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "row_id"))
    return F.count(F.lit(1)).alias("group_size"), first.alias("winner")


def heavy_groups(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, group_size, winner) of every digest with at least ``2 / (k + 1)`` of the rows: at most ``(k + 1) / 2``."""
    total = rows.count()
    guesses = (rows.select("digest").mapInArrow(misra_gries(k), "digest binary, n long")
               .groupBy("digest").agg(F.sum("n").alias("n")))
    candidates = guesses.orderBy(F.desc("n"), "digest").limit(k + 1).select("digest")
    return (rows.join(F.broadcast(candidates), "digest", "left_semi")
            .groupBy("digest").agg(*_winner())
            .where(F.col("group_size") * (k + 1) >= 2 * total))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary)."""
    text = text_of(text_col)
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), digest_of(text).alias("digest"), F.char_length(text).alias("n_chars"),
        F.monotonically_increasing_id().alias("row_id")), "digests")
    heavy = materialise(heavy_groups(rows, k), "heavy")
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*_winner()), "digest")
    return hot.unionByName(cold).select(
        "id", F.col("winner.id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("winner.row_id")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    kept = (dedup_groups(docs, id_col, text_col, k).where("kept")
            .select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    text = text_of(text_col)
    keyed = docs.withColumns({"__own": digest_of(text), "__chars": F.char_length(text)})
    found = keyed.join(kept, (F.col("__own") == F.col("__digest")) & F.col(id_col).eqNullSafe(F.col("__id")))
    # equal ids can carry equal texts of another length (or be repeated rows): the longest stays
    best = found.groupBy("__own").agg(F.max_by(F.struct(*[docs[c] for c in docs.columns]), F.col("__chars")).alias("__row"))
    return best.select("__row.*")
