"""Retrieval and similarity over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.text import WHITESPACE_CLASS
from tablelens.operators import clean as C
from tablelens.operators import features as X
from tablelens.operators import neighbours as N
from tablelens.operators import similar as S
from tablelens.operators.ranks import attach_scalars
from tablelens.plans.common import load
from tablelens.plans.registry import register


@register("keyword_topk", f"""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '{WHITESPACE_CLASS}'), lambda x: x <> '')) AS qt FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '{WHITESPACE_CLASS}'), lambda x: x <> '')) AS dt FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(qt, dt)) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id AS qid, doc_id AS did, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
""")
def keyword_topk(spark, sf):
    return S.keyword_topk(load(spark, sf, "benchmark"), "item_id", "text", load(spark, sf, "documents"), "doc_id",
                          "text", k=2)


@register("vector_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS did, list_cosine_similarity(a.v, b.v) AS score
      FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM s)
SELECT qid, did, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def vector_topk(spark, sf):
    e = load(spark, sf, "embeddings")
    out = S.vector_topk(e, "vec_id", e, "vec_id", "embedding", k=5, exclude_self=True)
    return out.select("qid", "did", F.round("score", 6).alias("score"), "rank")


def _approximate(e, k=5):
    return N.quantised_topk(e.where(F.col("vec_id") % 100 == 0), "vec_id", e, "vec_id", "embedding", k=k, exclude_self=True)


@register("vector_neighbours")
def vector_neighbours(spark, sf):
    """V2: every hundredth vector against all."""
    return _approximate(load(spark, sf, "embeddings")).select("qid", "did", F.round("score", 6).alias("score"), "rank")


@register("vector_recall", """
SELECT count(*) AS asked, 5 * count(*) AS neighbours, true AS recall_reached, true AS few_pairs
FROM embeddings WHERE vec_id % 100 = 0
""")
def vector_recall(spark, sf):
    """V2 against V1: at least 0.9 of the exact neighbours, by exact scores of a tenth of all pairs (50 a query) at most."""
    e = load(spark, sf, "embeddings")
    asked, rows = e.where(F.col("vec_id") % 100 == 0), e.agg(F.count(F.lit(1)).alias("rows"))
    exact = S.vector_topk(asked, "vec_id", e, "vec_id", "embedding", k=5, exclude_self=True).select("qid", "did")
    got = _approximate(e).select("qid", "did", F.lit(1).alias("hit"))
    both = exact.join(got, ["qid", "did"], "left").agg(F.countDistinct("qid").alias("asked"), F.count(F.lit(1)).alias("neighbours"),
                                                       F.count("hit").alias("hits"))
    return attach_scalars(both, rows).select("asked", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("recall_reached"),
                                             (F.lit(50) <= 0.1 * F.col("rows")).alias("few_pairs"))


def part_features(spark, sf):
    p = load(spark, sf, "part").withColumn("item_key", F.col("p_partkey"))
    m = C.numeric_matrix(p.drop("p_name"), keep=["item_key"])
    cols = [c for c in m.columns if c != "item_key"]
    return X.standardize(m, cols), cols


@register("similar_items", """
WITH b AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
t AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
f AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS k, CAST(b.code AS DOUBLE) AS br, CAST(t.code AS DOUBLE) AS ty,
             CAST(p_size AS DOUBLE) AS sz, p_retailprice AS pr FROM part JOIN b USING (p_brand) JOIN t USING (p_type)),
z AS (SELECT p_partkey, [(k - avg(k) OVER ()) / stddev_pop(k) OVER (), (br - avg(br) OVER ()) / stddev_pop(br) OVER (),
                         (ty - avg(ty) OVER ()) / stddev_pop(ty) OVER (), (sz - avg(sz) OVER ()) / stddev_pop(sz) OVER (),
                         (pr - avg(pr) OVER ()) / stddev_pop(pr) OVER ()] AS v FROM f),
s AS (SELECT a.p_partkey AS item, b.p_partkey AS sim, list_cosine_similarity(a.v, b.v) AS score
      FROM z a, z b WHERE a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, sim) AS rank FROM s)
SELECT item, sim AS "similar", round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def similar_items(spark, sf):
    feats, cols = part_features(spark, sf)
    out = S.similar_items(feats, "item_key", cols, k=5)
    return out.select("item", "similar", F.round("score", 6).alias("score"), "rank")
