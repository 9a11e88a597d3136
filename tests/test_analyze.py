"""End-to-end: one call per task on seeded synthetic frames (shape asserts)."""

import numpy as np
import pandas as pd
import pytest

from tablelens.plans.analyze import analyze


def _df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_analyze_classification(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"x1": rng.normal(size=200), "x2": rng.normal(size=200), "cat": rng.choice(["a", "b"], 200)})
    pdf["y"] = (pdf.x1 + pdf.x2 > 0).astype(int)
    r = analyze(_df(spark, pdf), "y")
    assert r["task"] == "classification"
    m = {x["metric"]: x["value"] for x in r["metrics"].collect()}
    assert m["ROC-AUC"] > 0.8 and r["confusion"].count() == 4
    for k in ("roc", "pr", "calibration", "cv", "importance", "whatif", "statistics", "profile", "quality"):
        assert k in r, (k, r.skipped)
        assert r[k].count() > 0


def test_analyze_regression(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"x1": rng.normal(size=200), "x2": rng.normal(size=200)})
    pdf["price"] = 3 * pdf.x1 - 2 * pdf.x2 + 0.3 * rng.normal(size=200)
    r = analyze(_df(spark, pdf), "")
    assert r["task"] == "regression"
    m = {x["metric"]: x["value"] for x in r["metrics"].collect()}
    assert m["R2"] > 0.9 and "residuals" in r and "segments" in r


@pytest.mark.parametrize("task,expect", [("clustering", "segments"), ("anomaly", "scores"),
                                         ("dimreduction", "variance"), ("recommendation", "similar")])
def test_analyze_unsupervised(spark, task, expect):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame(rng.normal(size=(120, 3)), columns=["a", "b", "c"])
    pdf["name"] = [f"item {i}" for i in range(120)]
    r = analyze(_df(spark, pdf), "", task)
    assert r["task"] == task and r[expect].count() > 0


def test_analyze_timeseries_and_survival(spark):
    t = np.arange(120)
    rng = np.random.RandomState(0)
    ts = pd.DataFrame({"date": pd.date_range("2021-01-01", periods=120, freq="W").strftime("%Y-%m-%d"),
                       "sales": 10 + 0.3 * t + 4 * np.sin(2 * np.pi * t / 12) + rng.normal(size=120)})
    r = analyze(_df(spark, ts), "sales", "timeseries")
    assert r["forecast"].where("kind = 'forecast'").count() == 20
    tenure = rng.randint(1, 60, 300)
    sv = pd.DataFrame({"tenure": tenure, "monthly": rng.normal(50, 10, 300), "extra": rng.normal(size=300),
                       "churn": (rng.rand(300) < 1 / (1 + tenure / 15)).astype(int)})
    r = analyze(_df(spark, sv), "churn", "survival")
    assert r["km"].count() > 10 and r["median"].first()["median"] > 0 and "hazards" in r


def test_analyze_missing_target_raises(spark):
    with pytest.raises(ValueError):
        analyze(_df(spark, pd.DataFrame({"a": np.arange(20.0)})), "nope", "classification")
