"""Extremely randomised trees and the search by halving."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import extratrees as E
from tablelens.operators import model as M


def _frame(spark, x, y):
    rows = [(str(i), float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_key string, label double, x array<double>")
    return df.select("_key", "label", array_to_vector("x").alias("features"))


def _corners(n, seed=0):
    rng = np.random.RandomState(seed)
    x = np.c_[rng.normal(size=n), rng.normal(size=n), rng.randint(0, 2, n), np.ones(n)]
    return x, ((x[:, 0] > 0.3) ^ (x[:, 2] == 1)).astype(float)


def test_forest_of_classes_in_one_task_and_in_many(spark, monkeypatch):
    x, y = _corners(600)
    df = _frame(spark, x, y).repartition(3)
    one = E.ExtraTrees(2, trees=20).fit(df)
    monkeypatch.setattr(E, "HELD_VALUES", 0)
    monkeypatch.setattr(E, "HELD_SUMS", 64)  # several passes a level
    many = E.ExtraTrees(2, trees=20).fit(df)
    assert len(one._levels) == len(many._levels)
    for a, b in zip(one._levels, many._levels):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.sums == b.sums).all()
    told = many.transform(_frame(spark, *_corners(300, 1)))
    assert told.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.9
    imp = many.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and imp[3] == 0 and min(imp[0], imp[2]) > imp[1]


def test_sums_of_leaves_are_those_of_their_rows(spark):
    x, y = _corners(200)
    model = E.ExtraTrees(2, trees=3, depth=4).fit(_frame(spark, x, y))
    for t in range(3):
        for d, level in enumerate(model._levels):
            at, alive = E._places(model._levels[:d], t, x)
            want = np.zeros((1 << d, 2))
            np.add.at(want, (at[alive], y[alive].astype(int)), 1)
            assert (level.sums[t][want.sum(axis=1) > 0] == want[want.sum(axis=1) > 0]).all()


def test_forest_of_numbers(spark, monkeypatch):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(900, 3))
    y = 1e6 + 10 * x[:, 0] + np.abs(x[:, 1])
    monkeypatch.setattr(E, "HELD_VALUES", 0)
    told = E.ExtraTrees(0, trees=20).fit(_frame(spark, x[:600], y[:600])).transform(_frame(spark, x[600:], y[600:])).toPandas()
    assert 1 - ((told["label"] - told["prediction"]) ** 2).sum() / ((y[600:] - y[600:].mean()) ** 2).sum() > 0.85


def test_forest_of_numbers_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    """Ties of few rows are not left to the order of sums."""
    rng = np.random.RandomState(1)
    x = rng.randint(0, 50, (400, 4)).astype(float)
    df = _frame(spark, x, 0.1 * x[:, 0] + rng.normal(size=400) / 3).repartition(5)
    one = E.ExtraTrees(0, trees=20).fit(df)
    monkeypatch.setattr(E, "HELD_VALUES", 0)
    many = E.ExtraTrees(0, trees=20).fit(df)
    assert len(one._levels) == len(many._levels)
    for a, b in zip(one._levels, many._levels):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.sums == b.sums).all()


def test_forest_of_odd_tables(spark):
    empty = _frame(spark, np.zeros((1, 2)), [0]).where("label > 0")
    assert E.ExtraTrees(2).fit(empty).transform(empty).count() == 0
    same = _frame(spark, np.ones((20, 2)), [0, 1] * 10)
    assert {tuple(r["probability"]) for r in E.ExtraTrees(2, trees=5).fit(same).transform(same).collect()} == {(0.5, 0.5)}
    flat = _frame(spark, np.arange(20.0)[:, None], [7.0] * 20)
    assert {r["prediction"] for r in E.ExtraTrees(0, trees=5).fit(flat).transform(flat).collect()} == {7.0}


def test_search_by_halving_ends_on_all_rows(spark, monkeypatch):
    x, y = _corners(900)
    df = _frame(spark, x, y).withColumn("split", F.when(F.col("_key") % 5 == 0, "test").otherwise("train"))
    prep = M.Prepared(df, [f"f{i}" for i in range(4)], True, ["0", "1"])
    monkeypatch.setattr(M, "RUNG_ROWS", 60)
    table, best = M.model_search(prep)
    got = {r["model"]: r for r in table.collect()}
    assert set(got) == set(M.candidates(prep)) and sum(r["best"] for r in got.values()) == 1
    top = next(r for r in got.values() if r["best"])
    assert top["share"] == 1.0 and top["score"] > 0.9
    assert sorted(round(r["share"], 2) for r in got.values()) == [0.11, 0.11, 0.33, 1.0, 1.0]


def test_search_fits_every_candidate_on_all_rows_whatever_their_number(spark, monkeypatch):
    from pyspark.ml.regression import LinearRegression
    rows = spark.range(0, 75_100, 1, 4).select(F.col("id").cast("string").alias("_key"), (F.col("id") % 97).cast("double").alias("label"),
                                               F.when(F.col("id") < 100, "test").otherwise("train").alias("split"),
                                               array_to_vector(F.array((F.col("id") % 97) * 1.0, (F.col("id") % 7) * 1.0)).alias("features"))
    fitted = []

    class Counted:
        def fit(self, train):
            fitted.append(train.count())
            return LinearRegression(maxIter=3).fit(train)
    monkeypatch.setattr(M, "candidates", lambda prep, seed=42: {n: Counted() for n in "abc"})
    table, _ = M.model_search(M.Prepared(rows, ["f0", "f1"], False))
    assert fitted == [75_000] * 3 and [r["share"] for r in table.collect()] == [1.0] * 3


def test_rows_are_made_once_for_all_levels(spark, monkeypatch):
    """A scan a level reads what the first one kept: the rows are not made again for each."""
    monkeypatch.setattr(E, "HELD_VALUES", 0)
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def label(i):
        made.add(1)
        return float(i % 2)
    rows = spark.range(0, 200, 1, 2).withColumn("label", label("id"))
    rows = rows.withColumn("features", array_to_vector(F.array(F.col("id") * 1.0, (F.col("id") * 7 % 200) * 1.0)))
    model = E.ExtraTrees(2, trees=3, depth=6).fit(rows)
    assert len(model._levels) == 7
    once = rows.where("label is not null").select("label", "features")
    before = made.value
    once.write.format("noop").mode("overwrite").save()
    assert before <= 3 * (made.value - before)  # the quantiles, the classes, and one scan that is kept


def test_leaves_end_the_way_of_their_rows(monkeypatch):
    """Rows that are below a leaf count in no sum and are told what the leaf holds, in chunks of any size."""
    level = lambda feature, cut, sums: E._Level(np.array([feature]), np.array([cut], float), np.array([sums], float))
    levels = [level([0], [1.5], [[3, 3]]), level([-1, 1], [0, 0.5], [[2, 0], [1, 3]]),
              level([-1] * 4, [0] * 4, [[9, 9], [9, 9], [1, 0], [0, 3]])]
    x, y = np.array([[0, 0], [1, 1], [2, 0], [3, 1], [4, 1], [5, 1]], float), np.array([0, 0, 0, 1, 1, 1], float)
    for chunk in (1, 4, 100):
        monkeypatch.setattr(E, "CHUNK", chunk)
        assert E._outputs(levels, 2, x)[:, 1].tolist() == [0, 0, 0, 1, 1, 1]
        got = E._sums_left(x, y, 2, levels[:2], range(1), np.zeros((1, 4, 1), int), np.full((1, 4, 1), 4.0)).reshape(4, 2)
        assert got.tolist() == [[0, 0], [0, 0], [1, 0], [0, 2]]
