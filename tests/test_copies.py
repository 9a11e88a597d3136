"""What supervised queries write of their rows: once, and only where they must."""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.functions.scalars import hash_int
from tablelens.operators import model as M
from tablelens.operators import neighbours as N
from tablelens.operators import ranks as R
from tablelens.operators import sample as S


def _rows(spark, n, rare):
    rows = spark.range(0, n, 1, 3).select(F.col("id").cast("string").alias("_key"), (F.col("id") % rare == 0).cast("double").alias("label"),
                                          F.when(F.col("id") % 5 == 1, "test").otherwise("train").alias("split"),
                                          (F.col("id") * 7 % 101).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    return rows.persist()


def test_balancing_writes_only_the_rows_it_makes(spark, monkeypatch):
    rows, written, real = _rows(spark, 300, 6), [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    held = R.shared_count()
    data, info = M.balanced(rows, ["a", "b"], ["0", "1"], True)
    made = info["after"]["1"] - info["before"]["1"]
    assert info["applied"] and [w.count() for w in written] == [made] and R.shared_count() == held
    assert data.count() == 300 + made and data.where("_key not like 'smote%'").exceptAll(rows.select(*data.columns)).count() == 0
    assert data.where("split = 'test'").count() == rows.where("split = 'test'").count()


def test_folds_shuffle_their_rows_once(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 40)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        folded = S.kfold(_rows(spark, 300, 6), ["_key"], 5, label="label")
        plan = folded._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        got = {r["_key"]: r["fold"] for r in folded.collect()}
        ranked = folded.withColumn("h", hash_int(["_key"], 42)).orderBy("label", "h", "_key").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        R.release_shared()
    at = {}
    for r in ranked:
        at[r["label"]] = at.get(r["label"], -1) + 1
        assert got[r["_key"]] == at[r["label"]] % 5


def test_split_keeps_no_rows_and_takes_the_least_hashes(spark, monkeypatch):
    rows = [(None if i % 7 == 0 else i % 3, None if i % 11 == 0 else i % 90) for i in range(400)]
    df = spark.createDataFrame(rows, "c int, k int")
    kept, real = [], R.shared
    monkeypatch.setattr(R, "shared", lambda t: kept.append(t) or real(t))
    for share in (0.0, 0.2, 0.5, 1.0):
        got = S.stratified_split(df, "c", ["k"], share).withColumn("h", hash_int(["k"], 42)).collect()
        for c in {r["c"] for r in got}:
            own = sorted([r for r in got if r["c"] == c], key=lambda r: (r["h"], r["k"] is not None, r["k"] or 0))
            want = math.ceil(len(own) * share)
            last = own[want - 1] if want else None  # rows of equal keys are on one side
            for i, r in enumerate(own):
                test = last is not None and (i < want or (r["h"], r["k"]) == (last["h"], last["k"]))
                assert r["split"] == ("test" if test else "train")
    assert kept and max(t.count() for t in kept) <= 4  # a row a class, never the table's
    R.release_shared()


def test_many_rows_are_fitted_a_fold_at_a_time(spark, monkeypatch):
    rows = _rows(spark, 300, 3).withColumn("features", array_to_vector(F.array("a", "b")))
    prep, told, real = M.Prepared(rows, ["a", "b"], True, ["0", "1"]), [], M.together
    monkeypatch.setattr(M, "together", lambda fn, items, at_once=M.AT_ONCE: told.append(at_once) or real(fn, items, at_once))
    few = M.cross_validate(prep, LogisticRegression(maxIter=5)).first()
    monkeypatch.setattr(M, "FIT_NUMBERS", 100)
    many = M.cross_validate(prep, LogisticRegression(maxIter=5)).first()
    assert told[0] >= M.AT_ONCE and told[1] <= 1 and few == many


def test_rows_that_ask_each_other_are_kept_once(spark, monkeypatch):
    d = spark.range(0, 300, 1, 2).select(F.col("id").alias("did"), F.array((F.col("id") * 37 % 301) * 1.0, (F.col("id") * 11 % 17) * 1.0).alias("payload"))
    monkeypatch.setattr(N, "ALL_PAIRS", 0)
    want = N.proven_topk(d.withColumnRenamed("did", "qid"), d, 4, "euclidean", True).collect()
    kept, real = [], N.shared
    monkeypatch.setattr(N, "shared", lambda t: kept.append(t) or real(t))
    assert sorted(N.proven_topk(None, d, 4, "euclidean", True).collect()) == sorted(want)
    assert sum(set(t.columns) >= {"payload"} and "list" not in t.columns for t in kept) == 0  # beside the listed rows
    assert sum("blocks" in t.columns for t in kept) == 2  # both sides of a search read how its lists are cut
    R.release_shared()
