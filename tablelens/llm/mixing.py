"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the mix, clamped at ``max_epochs``
times its size; what the clamp frees is shared again by weight among the rest
until no source is above its clamp.  A round is one aggregation over the table
of sources, and only two sums come to the driver.  A document then gets the
whole repetitions its source's rate allows, and the fractional repetition goes
to the documents first in a seeded order, up to the words that remain.

The running sum behind that order is kept per (source, one of 4096 hash
ranges), so a source with a third of all rows is spread over many tasks.

Defined cases: null text has size 0; a null source is a source of its own, after
all others; empty and all-white texts take 0 words; a source of size 0 has
target 0; repeated rows are rows of their own, taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import WORD_REGEX, materialise, text_of

#: Hash ranges that a source's documents are summed in.
RANGES = 4096


def in_order(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Number the rows from 0 in the given order, without one task that sees them all."""
    parts = materialise(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
                        .sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = parts.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return (parts.join(F.broadcast(before), part == F.col("__part"))
            .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
            .drop("__at", "__part", "__before"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table with ``size`` and ``weight`` per source."""
    cap = F.col("size") * F.lit(float(max_epochs))
    total, most = sources.agg(F.sum("size"), F.sum(cap)).first()
    left, clamped, level = min((total or 0) * share, most or 0.0), 0, 0.0
    below = F.lit(True)  # sources not clamped so far
    while True:
        weight = sources.where(below).agg(F.sum("weight")).first()[0]
        taken = sources.where(~below).agg(F.sum(cap)).first()[0] or 0.0
        if not weight:
            level = float("inf")
            break
        level = (left - taken) / weight
        below_now = F.col("weight") * F.lit(level) <= cap
        n = sources.where(~below_now).count()
        if n == clamped:
            break
        clamped, below = n, below_now
    fill = F.least(F.col("weight") * F.lit(level), cap) if level != float("inf") else cap
    return sources.withColumn("target", fill)


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[Column, Column, Column]:
    """Source key (null apart), seeded hash and size of a document."""
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return key, hashed, F.regexp_count(text_of(text_col), F.lit(WORD_REGEX)).cast("long")


def rates(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """For each source of (key, source, hashed, size): source_size, target, whole
    repetitions, and the last (hashed, size) that gets the fractional one (null: none does)."""
    rows = rows.withColumn("range", F.conv(F.substring("hashed", 1, 3), 16, 10).cast("int"))
    sums = materialise(rows.groupBy("key", "source", "range").agg(F.sum("size").alias("size")), "range_sums")
    sources = in_order(sums.groupBy("key", "source").agg(F.sum("size").alias("size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    targets = water_fill(materialise(sources.withColumn("weight", weight), "weights"), share, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    targets = materialise(targets.select("key", F.col("size").alias("source_size"), "target", whole.alias("whole")), "targets")

    begins = sums.select("key", "range", (F.sum("size").over(
        Window.partitionBy("key").orderBy("range")) - F.col("size")).alias("before"))
    begins = begins.join(targets.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")), "key")
    within = F.sum("size").over(Window.partitionBy("key", "range").orderBy("hashed", "size")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a document whose middle lies before the last word wanted is in: nearest to the target
    last = (rows.join(begins, ["key", "range"]).withColumn("upto", F.col("before") + within)
            .where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
            .groupBy("key").agg(F.max(F.struct("hashed", "size")).alias("last")))
    return materialise(targets.join(last, "key", "left"), "rates")


def _with_rates(rows: DataFrame, known: DataFrame) -> DataFrame:
    in_ = F.col("last").isNotNull() & (F.struct("hashed", "size") <= F.col("last"))
    return rows.join(known, "key").withColumn("repetitions", F.col("whole") + in_.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per input row: id, size, source_size, target, repetitions, taken (words).

    ``weights`` go round the sources in code-point order, null last.
    """
    key, hashed, size = _keys(docs, id_col, text_col, source_col, seed)
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                   key.alias("key"), size.alias("size"), hashed.alias("hashed")), "sizes")
    return _with_rates(rows, rates(rows.drop("id"), weights, share, max_epochs)).select(
        "id", "size", "source_size", "target", "repetitions", (F.col("repetitions") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
                    seed: int = 0) -> DataFrame:
    """The mix itself: every document as many times as it is repeated, with all its columns."""
    key, hashed, size = _keys(docs, id_col, text_col, source_col, seed)
    keyed = [key.alias("key"), size.alias("size"), hashed.alias("hashed")]
    rows = materialise(docs.select(F.col(source_col).cast("string").alias("source"), *keyed), "sizes")
    packed = docs.select(F.struct(*docs.columns).alias("row"), *keyed)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions")))
    return (_with_rates(packed, rates(rows, weights, share, max_epochs)).where("repetitions > 0")
            .select("row", again.alias("time")).select("row.*"))
