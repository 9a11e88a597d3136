"""End-to-end shape / invariant tests per task, on seeded synthetic frames
(the reference's own test strategy)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean as C


def _df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_task_kind_detection(spark):
    a = _df(spark, pd.DataFrame({"y": ["a", "b", "a"]}))
    b = _df(spark, pd.DataFrame({"y": [0, 1, 0, 1]}))
    c = _df(spark, pd.DataFrame({"y": np.linspace(0, 1, 50)}))
    assert C.task_kind(a, "y") == "classification"
    assert C.task_kind(b, "y") == "classification"
    assert C.task_kind(c, "y") == "regression"


def test_clean_dirty_frame(spark):
    pdf = pd.DataFrame({" id ": [1, 2, 3, 4, 5], "name": ["a", "b", "c", "d", "e"],
                        "val": [1.0, None, 3.0, 4.0, 5.0], "target": [1.0, 2.0, None, 4.0, 5.0]})
    df = C.trim_column_names(_df(spark, pdf))
    assert "id" in df.columns
    df, ids = C.drop_id_columns(df, "target")
    assert set(ids) == {"id", "name"}
    assert C.drop_missing_target(df, "target").count() == 4


def test_auto_target(spark):
    assert C.auto_target(_df(spark, pd.DataFrame({"a": [1], "churn": [0]}))) == "churn"
    assert C.auto_target(_df(spark, pd.DataFrame({"a": [1, 2], "b": [3, 4]}))) == "b"


def test_numeric_matrix_all_numeric(spark):
    pdf = pd.DataFrame({"n": [1.0, None, 3.0, 4.0], "c": ["x", "y", "x", None], "id": [1, 2, 3, 4]})
    m = C.numeric_matrix(_df(spark, pdf))
    assert "id" not in m.columns and all(t == "double" for _, t in m.dtypes)
    assert m.where(F.col("n").isNull()).count() == 0
    assert sorted(r["c"] for r in m.collect()) == [-1.0, 0.0, 0.0, 1.0]
    assert sorted(r["n"] for r in m.collect()) == [1.0, 3.0, 3.0, 4.0]  # median imputation


def test_significance_detects_region(spark):
    from tablelens.operators.stats import statistics
    rng = np.random.RandomState(0)
    region = rng.choice(["N", "S"], 300)
    y = np.where(region == "N", rng.rand(300) < 0.8, rng.rand(300) < 0.2).astype(int)
    pdf = pd.DataFrame({"region": region, "noise": rng.normal(size=300), "y": y})
    out = {r["feature"]: r for r in statistics(_df(spark, pdf), "y", True).collect()}
    assert out["region"]["significant"] and out["region"]["test"] == "chi-square"
    assert out["region"]["p"] < 1e-6


def test_classification_end_to_end(spark):
    from tablelens.operators import model as M
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"x1": rng.normal(size=200), "x2": rng.normal(size=200), "cat": rng.choice(["a", "b"], 200)})
    pdf["y"] = (pdf.x1 + pdf.x2 > 0).astype(int)
    prep = M.prepare_supervised(_df(spark, pdf), "y")
    assert prep.is_classification and prep.binary
    table, best = M.model_search(prep)
    assert table.where("best").first()["score"] > 0.8
    bars = M.importance(prep, best).collect()
    assert 1 <= len(bars) <= 6 and all(0.04 <= b["value"] <= 1 for b in bars)


def _scored_by(spark, x, y, classes):
    from pyspark.ml.functions import array_to_vector
    from tablelens.operators import model as M
    rows = [(str(i), float(b), "test", [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_key string, label double, split string, x array<double>")
    df = df.select("_key", "label", "split", array_to_vector("x").alias("features"))
    return M.Prepared(df, [f"f{i}" for i in range(x.shape[1])], bool(classes), classes)


def test_permutation_importance_of_a_rare_class(spark):
    from hashlib import md5
    from types import SimpleNamespace
    from pyspark.ml.linalg import Matrices, Vectors
    from tablelens.operators import model as M
    n, d = 6000, 8
    rng = np.random.RandomState(0)
    turn = sorted(range(n), key=lambda i: md5(f"{i}#42".encode()).hexdigest()[:8])
    x, y = rng.normal(size=(n, d)), np.zeros(n)
    y[turn[-3:]] = 1  # the last ones by the samples' hash
    x[turn[-3:], d - 1] += 12
    model = SimpleNamespace(coefficientMatrix=Matrices.dense(1, d, [0.1] * 6 + [0.0, 2.0]), interceptVector=Vectors.dense([-9.0]))
    imp = M.permutation_importance(_scored_by(spark, x, y, ["0", "1"]), model)
    assert imp.argmax() == d - 1 and imp[d - 2] == 0 and (imp[:6] < 0.05).all()
    assert 0.1 < imp[d - 1] < 1


def test_permutation_importance_of_numbers_and_classes(spark):
    from types import SimpleNamespace
    from pyspark.ml.linalg import Matrices, Vectors
    from tablelens.operators import model as M
    rng = np.random.RandomState(0)
    x = rng.normal(size=(9000, 2))
    line = SimpleNamespace(coefficients=Vectors.dense([3.0, 1.0]), intercept=0.0)
    imp = M.permutation_importance(_scored_by(spark, x, 3 * x[:, 0] + x[:, 1], []), line)
    assert imp == pytest.approx([1.8, 0.2], rel=0.05)  # twice the feature's share of the variance
    w = np.array([[2.0, 0.0], [-1.0, 1.0], [-1.0, -1.0]])
    three = SimpleNamespace(coefficientMatrix=Matrices.dense(3, 2, w.ravel(order="F").tolist()), interceptVector=Vectors.dense([0.0] * 3))
    imp = M.permutation_importance(_scored_by(spark, x, (x @ w.T).argmax(axis=1), ["a", "b", "c"]), three)
    other = [np.c_[rng.permutation(x[:, 0]), x[:, 1]], np.c_[x[:, 0], rng.permutation(x[:, 1])]]
    want = [((x @ w.T).argmax(axis=1) != (o @ w.T).argmax(axis=1)).mean() for o in other]
    assert imp == pytest.approx(want, abs=0.03)


def test_regression_end_to_end(spark):
    from tablelens.operators import model as M
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"x1": rng.normal(size=200), "x2": rng.normal(size=200)})
    pdf["y"] = 3 * pdf.x1 - 2 * pdf.x2 + 0.3 * rng.normal(size=200)
    prep = M.prepare_supervised(_df(spark, pdf), "y")
    assert not prep.is_classification
    table, _ = M.model_search(prep)
    assert table.where("best").first()["score"] > 0.9


def test_missing_target_raises(spark):
    from tablelens.operators import model as M
    with pytest.raises(ValueError):
        M.prepare_supervised(_df(spark, pd.DataFrame({"a": [1.0] * 20})), "nope")


def test_clustering_shape(spark):
    from tablelens.operators.cluster import kmeans_select, segment_sizes
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame(rng.normal(size=(120, 3)), columns=["x", "y", "z"])
    scores, k, lab = kmeans_select(_df(spark, pdf), ["x", "y", "z"])
    assert 2 <= k <= 8 and scores.count() == 7
    assert sum(r["share"] for r in segment_sizes(lab).collect()) == pytest.approx(1.0)


def test_clustering_of_copies(spark):
    from tablelens.operators.cluster import euclidean_silhouette, kmeans_select
    spots = [(0.0, 0.0), (0.0, 10.0), (10.0, 0.0)]
    pdf = pd.DataFrame([s for s in spots for _ in range(2500)], columns=["x", "y"])
    scores, k, lab = kmeans_select(_df(spark, pdf), ["x", "y"])
    assert k == 3 and scores.where("k = 3").first()["silhouette"] == pytest.approx(1.0)
    assert euclidean_silhouette(lab, ["x", "y"]).first()["value"] == pytest.approx(1.0)


def test_euclidean_silhouette_is_of_all_rows(spark):
    from tablelens.operators.cluster import euclidean_silhouette
    rng = np.random.RandomState(0)
    x = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(40, 2)) + 3, [[9.0, 9.0]], np.repeat([[1.0, 1.0]], 60, axis=0)])
    cluster = np.r_[np.zeros(150), np.ones(40), 2, np.zeros(60)].astype(int)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    apart = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    want = []
    for i, c in enumerate(cluster):
        inner = apart[i, cluster == c].sum() / max((cluster == c).sum() - 1, 1)
        outer = min(apart[i, cluster == o].mean() for o in range(3) if o != c)
        want.append((outer - inner) / max(inner, outer) if (cluster == c).sum() > 1 else 0.0)
    lab = _df(spark, pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "cluster": cluster}))
    assert euclidean_silhouette(lab, ["a", "b"]).first()["value"] == pytest.approx(np.mean(want), abs=1e-6)


def test_anomaly_planted_rows_rank_top(spark):
    from tablelens.operators.cluster import isolation_forest
    rng = np.random.RandomState(0)
    x = rng.normal(size=(200, 2))
    x[:9] += 8
    pdf = pd.DataFrame({"k": range(200), "x": x[:, 0], "y": x[:, 1]})
    s = isolation_forest(_df(spark, pdf), ["k"], ["x", "y"]).toPandas().sort_values("score", ascending=False)
    assert set(range(9)) <= set(s.head(10)["k"])
    assert s[s.k < 9]["flag"].all()


def test_pca_shape(spark):
    from tablelens.operators.cluster import pca
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame(rng.normal(size=(150, 4)), columns=list("abcd")).assign(k=range(150))
    var, load, proj = pca(_df(spark, pdf), ["k"], list("abcd"))
    v = [r["ratio"] for r in var.collect()]
    assert len(v) == 4 and sum(v) == pytest.approx(1.0) and v == sorted(v, reverse=True)
    assert proj.count() == 150


def test_recommender_excludes_self(spark):
    from tablelens.operators.similar import similar_items
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(50), "p": rng.normal(size=50), "q": rng.normal(size=50)})
    out = similar_items(_df(spark, pdf), "id", ["p", "q"], k=5).toPandas()
    assert len(out) == 250 and (out.item != out.similar).all()


def test_time_series_forecast(spark):
    from tablelens.operators.series import holt_winters
    t = np.arange(120)
    rng = np.random.RandomState(0)
    y = 10 + 0.3 * t + 4 * np.sin(2 * np.pi * t / 12) + rng.normal(size=120)
    pdf = pd.DataFrame({"s": "a", "date": pd.date_range("2021-01-01", periods=120, freq="W"), "sales": y})
    out = holt_winters(_df(spark, pdf), ["s"], "date", "sales").toPandas()
    fc = out[out.kind == "forecast"]
    assert len(fc) == 20 and out["period"].iloc[0] == 12 and out["direction"].iloc[0] == "rising"
    assert out["mae"].iloc[0] < 3


def test_survival_km_and_cox(spark):
    from tablelens.operators import survival as V
    rng = np.random.RandomState(0)
    tenure = rng.randint(1, 60, 300)
    churn = (rng.rand(300) < 1 / (1 + tenure / 15)).astype(int)
    pdf = pd.DataFrame({"tenure": tenure, "monthly": rng.normal(50, 10, 300), "churn": churn,
                        "noise": rng.normal(size=300)})
    df = _df(spark, pdf)
    ev, dur = V.choose_columns(df, "churn")
    assert (ev, dur) == ("churn", "tenure")
    curve = V.kaplan_meier(V.survival_frame(df, dur, ev)).toPandas().sort_values("t")
    assert curve["s"].iloc[0] == 1.0 and (np.diff(curve["s"]) <= 1e-12).all()
    hr = V.cox_ph(df, "tenure", "churn", ["monthly", "noise"]).collect()
    assert len(hr) == 2 and all(r["hr"] > 0 for r in hr)


def test_smote_balances_and_stays_in_bounds(spark):
    from tablelens.operators.oversample import smote
    rng = np.random.RandomState(0)
    x = rng.normal(size=400)
    y = (rng.rand(400) < 0.08).astype(int)
    pdf = pd.DataFrame({"k": [str(i) for i in range(400)], "x": x, "x2": x * 2 + 1, "y": y})
    out, info = smote(_df(spark, pdf), "y", ["x", "x2"], "k")
    counts = out.groupBy("y").count().toPandas().set_index("y")["count"]
    assert info["applied"] and counts[0] == counts[1]
    syn = out.where("synthetic = 1").toPandas()
    mins = pdf[pdf.y == 1]
    assert syn.x.between(mins.x.min() - 1e-9, mins.x.max() + 1e-9).all()


def test_chart_specs_drop_invalid(spark):
    from tablelens.operators.charts import run_chart_specs
    df = _df(spark, pd.DataFrame({"g": list("aabbc") * 10, "v": range(50)}))
    specs = [{"type": "nope"}, {"type": "bar", "source": {"kind": "aggregate", "groupby": "zz"}},
             {"type": "bar", "source": {"kind": "aggregate", "groupby": "g", "of": "v", "agg": "sum"}},
             "junk"]
    cards = run_chart_specs(df, specs)
    assert len(cards) == 1 and cards[0].count() == 3


def test_cox_sums_do_not_depend_on_batches(spark):
    """Gradient near 0 at the result, with many ties and with a time of its own for every row."""
    from tablelens.operators.survival import cox_ph
    rng = np.random.default_rng(8)
    for times in (12, 10 ** 9):
        x = rng.normal(size=(600, 2))
        t = np.floor(rng.exponential(1 / np.exp(0.7 * x[:, 0]), 600) * times / 6) + 1
        pdf = pd.DataFrame({"t": t, "e": (rng.random(600) < 0.7).astype(int), "a": x[:, 0], "b": x[:, 1]})
        df = _df(spark, pdf)
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        found = []
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(sorted(map(tuple, cox_ph(df, "t", "e", ["a", "b"]).collect())))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert np.allclose([r[1:3] for r in found[0]], [r[1:3] for r in found[1]], rtol=1e-6)
        assert all(abs(r[3]) < 1e-3 for r in found[0]) and 0.4 < found[0][0][1] < 1.0


def test_profiles_of_odd_columns(spark):
    from tablelens.operators.clean import distinct_counts, drop_constant_columns
    from tablelens.operators.profile import column_stats, constant_columns
    df = spark.createDataFrame([(1, None, "a", [1], {"k": 1}, float("nan")), (1, None, None, [1], {"k": 1}, 2.0), (1, None, "a", [1], {"k": 2}, 2.0)],
                               "one int, none int, gap string, list array<int>, map map<string,int>, nan double")
    assert {r["name"] for r in constant_columns(df).collect()} == {"one", "none", "list"}
    got = {r["name"]: (r["missing_n"], r["unique"]) for r in column_stats(df).collect()}
    assert got == {"one": (0, 1), "none": (3, 0), "gap": (1, 1), "list": (0, 1), "map": (0, 2), "nan": (1, 1)}
    assert drop_constant_columns(df).columns == ["map"]
    assert column_stats(df.limit(0)).count() == 0
    many = spark.range(5000).selectExpr("id", "id % 3 AS few", "id % 20 AS near")
    counts = distinct_counts(many, ["id", "few", "near"], upto=10)
    assert counts["id"] > 10 and counts["few"] == 3 and counts["near"] == 20


def test_kmeans_agrees_with_the_evaluator_and_between_plans(spark, monkeypatch):
    """The silhouettes are those of Spark's evaluator; one task and many give the same; more starts are no worse."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    from tablelens.operators import cluster as U
    rng = np.random.RandomState(3)
    spots = rng.uniform(-10, 10, size=(5, 3))
    x = np.vstack([rng.normal(size=(80, 3)) + s for s in spots] + [np.repeat([[1.0, 2.0, 3.0]], 40, axis=0)])
    x = (x - x.mean(axis=0)) / x.std(axis=0)  # standardised, so that the evaluator sees the same columns
    df = _df(spark, pd.DataFrame(x, columns=["a", "b", "c"])).repartition(5, "a")
    scores, k, lab = U.kmeans_select(df, ["a", "b", "c"])
    scored = {r["k"]: r["silhouette"] for r in scores.collect()}
    assert set(scored) == set(range(2, 9)) and lab.columns == ["a", "b", "c", "cluster"]
    seen = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(lab)
    assert scored[k] == max(scored.values())
    assert ClusteringEvaluator(featuresCol="f", predictionCol="cluster").evaluate(seen) == pytest.approx(scored[k], abs=1e-9)
    monkeypatch.setattr(U, "HELD_VALUES", 0)
    again, k2, lab2 = U.kmeans_select(df, ["a", "b", "c"])
    assert k2 == k and {r["k"]: r["silhouette"] for r in again.collect()} == pytest.approx(scored, abs=1e-9)
    assert sorted(map(tuple, lab2.collect())) == sorted(map(tuple, lab.collect()))


def test_kmeans_of_odd_tables(spark):
    from tablelens.operators.cluster import kmeans_select
    same = _df(spark, pd.DataFrame({"a": [1.0] * 9, "b": [2.0] * 9}))
    scores, k, lab = kmeans_select(same, ["a", "b"])
    assert k == 2 and {r["silhouette"] for r in scores.collect()} == {0.0} and lab.count() == 9
    gaps = spark.createDataFrame([(0.0, None), (0.1, 0.0), (9.0, 8.0), (9.1, float("nan")), (9.2, 8.1)], "a double, b double")
    scores, k, lab = kmeans_select(gaps, ["a", "b"], k_max=3)
    assert lab.where("cluster IS NULL").count() == 0 and scores.count() == 2
    with pytest.raises(ValueError):
        kmeans_select(same.limit(2), ["a", "b"])
    with pytest.raises(ValueError):
        kmeans_select(same, ["a"])


def test_permutation_auc_of_many_blocks(spark, monkeypatch):
    """Counts by bins agree with the AUC of all pairs, which one block gives."""
    from types import SimpleNamespace
    from pyspark.ml.linalg import Matrices, Vectors
    from tablelens.operators import model as M
    rng = np.random.RandomState(2)
    n = 9000
    x = np.c_[rng.normal(size=(n, 2)), rng.randint(0, 3, n)]
    y = (x @ [1.5, -0.5, 0.4] + rng.logistic(size=n) > 1).astype(float)
    model = SimpleNamespace(coefficientMatrix=Matrices.dense(1, 3, [1.5, -0.5, 0.4]), interceptVector=Vectors.dense([-1.0]))
    prep = _scored_by(spark, x, y, ["0", "1"])
    apart = []

    def auc(s):
        order = s.argsort(kind="stable")
        rank = pd.Series(s).rank().to_numpy()
        p = y.sum()
        return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p)) if len(order) else 0.0
    whole = auc(x @ [1.5, -0.5, 0.4])
    for j, c in enumerate([1.5, -0.5, 0.4]):
        drops = []
        for _ in range(20):
            moved = x.copy()
            moved[:, j] = rng.permutation(moved[:, j])
            drops.append(whole - auc(moved @ [1.5, -0.5, 0.4]))
        apart.append(np.mean(drops))
    for scores in (4_000_000, 1):  # blocks of 8,192 and of 256 rows
        monkeypatch.setattr(M, "BLOCK_SCORES", scores)
        assert M.permutation_importance(prep, model, repeats=8) == pytest.approx(apart, abs=0.008)


def test_a_distinct_date_text_is_parsed_once(spark, monkeypatch):
    """Dates are told by the distinct texts of columns that look like dates; nulls and repeats count as rows."""
    from tablelens.operators import clean as C
    rows = [("2024-01-%02d" % (i % 9 + 1) if i % 10 else None, "a-%d" % (i % 7), "2024/02/03" if i % 4 else "no-day") for i in range(200)]
    df = spark.createDataFrame(rows, "day string, code string, mixed string")
    seen, parse = [], C.parse_datetime_text
    monkeypatch.setattr(C, "parse_datetime_text", lambda c: seen.append(c._jc.toString()) or parse(c))
    assert C.date_like_columns(df) == ["day"]
    assert seen == ["v"]
