"""M1, M2, M10, M11, M13, M14, U1-U7, D5 on lineitem / embeddings / customer / labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import cluster as K
from tablelens.operators import model as M
from tablelens.operators import oversample as O
from tablelens.operators.clean import numeric_matrix
from tablelens.plans.common import load, r6
from tablelens.plans.registry import register
from tablelens.plans.sample_queries import hash_sql

_PREP_CACHE: dict = {}


def prepared(spark, sf, kind="clf"):
    key = (sf, kind, spark.sparkContext.applicationId)
    if key not in _PREP_CACHE:
        li = load(spark, sf, "lineitem")
        if kind == "clf":
            d = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                          "l_linestatus", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("target"))
        else:
            d = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                          F.col("l_extendedprice").alias("price"))
        _PREP_CACHE[key] = M.prepare_supervised(d, None, "auto", key_cols=["l_orderkey", "l_linenumber"])
    return _PREP_CACHE[key]


def searched(spark, sf):
    key = (sf, "search", spark.sparkContext.applicationId)
    if key not in _PREP_CACHE:
        _PREP_CACHE[key] = M.model_search(prepared(spark, sf))
    return _PREP_CACHE[key]


@register("model_search")
def model_search(spark, sf):
    table, _ = searched(spark, sf)
    return table


@register("model_search_regression")
def model_search_regression(spark, sf):
    table, _ = M.model_search(prepared(spark, sf, "reg"))
    return table


@register("model_compare")
def model_compare(spark, sf):
    prep = prepared(spark, sf)
    table, _ = searched(spark, sf)
    best = table.where("best").first()
    return M.model_compare(prep, best["model"], best["score"])


@register("cross_validation")
def cross_validation(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    return M.cross_validate(prepared(spark, sf), LogisticRegression(maxIter=50))


@register("learning_curve")
def learning_curve(spark, sf):
    from pyspark.ml.regression import LinearRegression
    return M.learning_curve(prepared(spark, sf, "reg"), LinearRegression(maxIter=50))


@register("importance")
def importance(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    prep = prepared(spark, sf)
    model = RandomForestClassifier(numTrees=30, maxDepth=6, seed=42).fit(prep.data.where(F.col("split") == "train"))
    return M.importance(prep, model)


@register("partial_dependence")
def partial_dependence(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    prep = prepared(spark, sf)
    model = LogisticRegression(maxIter=50).fit(prep.data.where(F.col("split") == "train"))
    return M.partial_dependence(prep, model)


def _emb_matrix(spark, sf):
    e = load(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("kmeans_segments")
def kmeans_segments(spark, sf):
    d, cols = _emb_matrix(spark, sf)
    scores, _, _ = K.kmeans_select(d, cols)
    return scores


_EMB_LONG = """
WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings)
"""


@register("segment_sizes", """
SELECT 'Segment ' || CAST(label + 1 AS VARCHAR) AS segment, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share
FROM embeddings GROUP BY label
""")
def segment_sizes(spark, sf):
    d, _ = _emb_matrix(spark, sf)
    s = K.segment_sizes(d, "label")
    return s.select("segment", r6(F.col("share")).alias("share"))


@register("defining_dims", _EMB_LONG + """,
m AS (SELECT i, label, avg(CAST(x AS DOUBLE)) AS mu FROM e GROUP BY 1, 2),
v AS (SELECT 'e' || CAST(i AS VARCHAR) AS label, i AS pos, coalesce(var_samp(mu), 0) AS sep FROM m GROUP BY i),
t AS (SELECT * FROM v ORDER BY sep DESC, pos LIMIT 6)
SELECT label, round(sep, 8) AS separation, round(greatest(0.08, sep / (SELECT max(sep) FROM v)), 6) AS value FROM t
""")
def defining_dims(spark, sf):
    d, cols = _emb_matrix(spark, sf)
    out = K.defining_dimensions(d, cols, "label")
    return out.select("label", F.round("separation", 8).alias("separation"), r6(F.col("value")).alias("value"))


def _planted_customers(spark, sf):
    c = load(spark, sf, "customer")
    planted = (F.col("c_custkey") % 250) == 0
    return c.select("c_custkey", F.when(planted, F.col("c_acctbal") * 8 + 60000).otherwise(F.col("c_acctbal"))
                    .alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"),
                    planted.cast("int").alias("planted"))


@register("isolation_forest")
def isolation_forest(spark, sf):
    c = _planted_customers(spark, sf)
    flags = K.isolation_forest(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])
    return flags.drop("scaled").join(c.select("c_custkey", "planted"), "c_custkey")


@register("anomaly_summary")
def anomaly_summary(spark, sf):
    c = _planted_customers(spark, sf)
    flags = K.isolation_forest(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])
    from tablelens.operators.ranks import attach_scalars
    drivers = K.anomaly_drivers(flags, ["c_acctbal", "c_nationkey"])
    return attach_scalars(drivers, K.anomaly_rate(flags))


@register("pca_projection")
def pca_projection(spark, sf):
    d, cols = _emb_matrix(spark, sf)
    variance, _, _ = K.pca(d, ["vec_id"], cols)
    return variance


@register("pca_loadings")
def pca_loadings(spark, sf):
    m = numeric_matrix(load(spark, sf, "customer").withColumn("key", F.col("c_custkey")), keep=["key"])
    cols = [c for c in m.columns if c != "key"]
    _, loadings, _ = K.pca(m, ["key"], cols)
    return loadings


def _smote_train(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars",
                                               F.size(F.split("text", r"\s+")).cast("double").alias("words"))
    lab = load(spark, sf, "labels").select("doc_id", "toxic")
    d = lab.join(docs, "doc_id")
    return d.where(F.conv(F.substring(F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), F.lit("42"))), 1, 8),
                          16, 10).cast("long") / 4294967296.0 >= 0.2)


@register("smote_balance", f"""
WITH t AS (SELECT toxic FROM labels JOIN documents USING (doc_id) WHERE {hash_sql('doc_id')} / 4294967296.0 >= 0.2),
c AS (SELECT toxic, count(*) AS n FROM t GROUP BY 1)
SELECT toxic, CAST(max(n) OVER () AS BIGINT) AS n FROM c
""")
def smote_balance(spark, sf):
    out, _ = O.smote(_smote_train(spark, sf), "toxic", ["n_chars", "words"], "doc_id")
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@register("smote_rows")
def smote_rows(spark, sf):
    out, _ = O.smote(_smote_train(spark, sf), "toxic", ["n_chars", "words"], "doc_id")
    return out.where(F.col("synthetic") == 1)
