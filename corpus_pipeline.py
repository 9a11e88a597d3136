"""Training-data pipeline over ``documents``: each stage works on all that the one before it kept.

1. ``quality``: the classifier, taught by ``labels`` (held-out rows teach nothing); documents that score under 0.5 go.
2. ``near_dedup``: SimHash components (3-word shingles, 3 bits); the least doc_id of each stays.
3. ``decontaminate``: passages of 10 words shared with ``benchmark`` are cut out of the texts (``n_chars`` follows);
   documents of which nothing is left go.
4. ``mix``: sources to target weights, at most 2 epochs; a document is there as often as it is repeated.
5. ``shard``: 40 shards of near-equal bytes; ``shard`` and ``slot`` are added.

Null texts count as empty, null and repeated doc_ids are rows like others, and empty tables pass every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import materialise
from tablelens.llm.decontaminate import remove_leaks
from tablelens.llm.mixing import mixed_documents
from tablelens.llm.quality import fit_quality, held_out, score_quality
from tablelens.llm.sharding import sharded_documents
from tablelens.llm.simhash import keep_one
from tablelens.plans.common import load
from tablelens.session import ensure_shipped

SHARDS = 40
#: The classifier and SimHash components cannot be written in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_shipped(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def quality(spark, docs, sf_dir):
    weights = fit_quality(docs, load(spark, sf_dir, "labels"), "quality", ~held_out(F.col("doc_id")))
    return score_quality(docs, weights, column="__score").where("__score >= 0.5").drop("__score")


@_stage
def near_dedup(spark, docs, sf_dir):
    return keep_one(docs, shingle=3, distance=3)


@_stage
def decontaminate(spark, docs, sf_dir):
    return remove_leaks(docs, load(spark, sf_dir, "benchmark"),
                        length_col="n_chars" if "n_chars" in docs.columns else None)


@_stage
def mix(spark, docs, sf_dir):
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


@_stage
def shard(spark, docs, sf_dir):
    return sharded_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix),
          ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
