"""Whole analyses of awkward tables: text only, rare classes, column names used
inside, NaN, repeated rows and text covariates."""

import numpy as np
import pandas as pd

from tablelens.plans.analyze import analyze


def test_reviews_are_classified_by_their_text(spark):
    rng = np.random.RandomState(0)
    words = {"positive": ["great", "love", "perfect", "happy"], "negative": ["bad", "broken", "refund", "slow"]}
    rows = [(" ".join(rng.choice(words[s] + ["product", "store", "bought", "item"], 6)) + f" n{i}", s)
            for i, s in enumerate(rng.choice(list(words), 300))]
    r = analyze(spark.createDataFrame(rows, "review string, sentiment string"), "sentiment", "nlp")
    metrics = {x["metric"]: x["value"] for x in r["metrics"].collect()}
    assert metrics["ROC-AUC"] > 0.95
    assert {x["label"] for x in r["importance"].collect()} & {w for ws in words.values() for w in ws}
    for name in ("tfidf_terms", "keywords", "sentiment", "topics"):
        assert r[name].count() > 0
    r.release()


def test_rare_class_and_columns_named_like_internal_ones(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)), columns=["x", "label", "split", "feature"])
    pdf["y"] = (pdf.x + pdf.label > 2.1).astype(int)
    pdf.loc[::17, "x"] = np.nan
    share = pdf.y.mean()
    assert share < 0.12
    r = analyze(spark.createDataFrame(pdf), "y")
    assert r.skipped == []
    counts = {x["label"]: x for x in r["imbalance"].collect()}
    assert counts["1"]["train_after"] == counts["0"]["train_after"] > counts["1"]["train_before"]
    assert {"x", "label"} & {x["label"] for x in r["importance"].collect()}
    assert {x["feature"] for x in r["whatif"].collect()} <= {None, "x", "label", "split", "feature", *(
        f"{a}_x_{b}" for a in ("x__", "label__", "split__", "feature__") for b in ("x__", "label__", "split__", "feature__"))}
    profile = {x["name"]: x["missing"] for x in r["profile"].collect()}
    assert profile["x"] == 6.0 and profile["label"] == 0.0


def test_repeated_rows_are_not_multiplied(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"a": np.r_[rng.normal(size=60), np.full(40, 0.5)], "b": np.r_[rng.normal(size=60), np.full(40, -0.5)]})
    df = spark.createDataFrame(pdf)
    r = analyze(df, task="anomaly")
    assert r["scores"].count() == 100 and r["rate"].first()["rows"] == 100 and r["drivers"].count() == 2
    assert r["scatter"].count() == 100
    named = spark.createDataFrame(pdf.assign(name=[f"item {i}" for i in range(100)]))
    near = analyze(named, task="recommendation")["similar"].collect()
    assert len({x["item"] for x in near}) == 100 and len(near) == 500
    assert all(x["item_row"] != x["similar_row"] and x["similar"].startswith("item ") for x in near)


def test_text_covariates_have_hazards(spark):
    rng = np.random.RandomState(0)
    plan = rng.choice(["basic", "premium"], 300)
    tenure = rng.randint(1, 60, 300)
    pdf = pd.DataFrame({"tenure": tenure, "plan": plan, "monthly": np.where(rng.rand(300) < 0.1, np.nan, rng.normal(50, 10, 300)),
                        "churn": (rng.rand(300) < np.where(plan == "basic", 0.7, 0.2)).astype(int)})
    r = analyze(spark.createDataFrame(pdf), "churn", "survival")
    hazards = {x["label"]: x for x in r["hazards"].collect()}
    assert hazards["plan"]["sign"] == -1 and hazards["plan"]["hr"] < 0.6


def test_gradient_vanishes_at_the_hazards(spark, monkeypatch):
    from tablelens.operators import survival as V
    monkeypatch.setattr(V, "TIES", 7)  # ties in several pieces
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"t": rng.randint(1, 6, 400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["e"] = (rng.rand(400) < 1 / (1 + np.exp(-pdf.a))).astype(int)
    got = V.cox_ph(spark.createDataFrame(pdf), "t", "e", ["a", "b"]).collect()
    assert all(abs(x["gradient"]) < 1e-6 for x in got) and got[0]["hr"] > 1.2


def test_long_series_use_all_points(spark):
    from tablelens.operators.series import holt_winters
    n = 5000
    pdf = pd.DataFrame({"k": "s", "t": np.arange(n), "y": 10 + 0.01 * np.arange(n) + np.sin(2 * np.pi * np.arange(n) / 12)})
    got = holt_winters(spark.createDataFrame(pdf), ["k"], "t", "y").toPandas()
    assert (got.kind == "history").sum() == 60 and (got.kind == "forecast").sum() == 24
    assert got.period.iloc[0] == 12 and got.direction.iloc[0] == "rising"
