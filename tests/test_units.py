"""Unit tests of the shared primitives and helpers."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelens.functions import pvalues as PV
from tablelens.functions.text import whitespace_tokens, word_tokens
from tablelens.operators import ranks as R


def test_pvalues_known_values():
    assert PV.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert PV.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-5)
    assert PV.f_upper(4.0, 2, 20) == pytest.approx(0.03457, abs=1e-4)
    assert PV.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-5)
    assert PV.chi2_upper(10.0, 3) == pytest.approx(0.018566, abs=1e-5)


def test_prefix_sum_matches_window(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "k": rng.normal(size=2000), "v": rng.integers(0, 5, 2000)})
    df = spark.createDataFrame(pdf)
    got = R.prefix_sum(df, "k", ["v"], ["g"]).toPandas().sort_values(["g", "k"])
    pdf = pdf.sort_values(["g", "k"])
    pdf["cum_v"] = pdf.groupby("g")["v"].cumsum()
    assert np.array_equal(got["cum_v"].to_numpy(), pdf["cum_v"].to_numpy())
    desc = R.prefix_sum(df, "k", ["v"], descending=True).toPandas().sort_values("k", ascending=False)
    assert np.array_equal(desc["cum_v"].to_numpy(), desc["v"].cumsum().to_numpy())


def test_prefix_sum_text_keys(spark):
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w, 1) for w in words], "k string, one int")
    got = R.prefix_sum(df, "k", ["one"]).toPandas().sort_values("k")
    assert got["cum_one"].tolist() == list(range(1, 501))


@pytest.mark.parametrize("held", [0, 1 << 21])
def test_exact_quantiles_match_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD_VALUES", held)
    rng = np.random.default_rng(1)
    x = np.round(rng.exponential(size=999), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["p"]: r["q"] for r in R.exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-12)


def test_midranks_match_pandas(spark):
    x = [3, 1, 2, 2, 5, 3, 3]
    df = spark.createDataFrame([(v,) for v in x], "x int")
    mr = {r["x"]: r["midrank"] for r in R.midranks(df, "x").collect()}
    assert [mr[v] for v in x] == pd.Series(x).rank().tolist()


def test_tokenisers_match_python(spark):
    texts = ["Hello  world\tfoo\nbar", " lead and trail ", "Ünïcode wörds ça-va 2x a_b", "x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ws = [sorted(r[0]) for r in df.select(whitespace_tokens(F.col("t"))).collect()]
    assert ws == [sorted(set(t.lower().split())) for t in texts]
    wt = [r[0] for r in df.select(word_tokens(F.col("t"))).collect()]
    assert wt == [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]


def test_sample_skew_matches_pandas(spark):
    from tablelens.operators.features import skew_table
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert skew_table(df, ["x"]).first()["skew"] == pytest.approx(pd.Series(x).skew(), rel=1e-9)


def test_hash_unit_is_portable(spark):
    import duckdb
    from tablelens.functions.scalars import hash_unit
    df = spark.range(50).select(F.col("id"), hash_unit(["id"], 42).alias("u"))
    got = {r["id"]: r["u"] for r in df.collect()}
    ref = duckdb.sql("SELECT range AS id, CAST(concat('0x', substr(md5(concat_ws('#', range, '42')), 1, 8)) AS BIGINT)"
                     " / 4294967296.0 AS u FROM range(50)").fetchall()
    for i, u in ref:
        assert got[i] == pytest.approx(u, abs=0)


def test_blocked_topk_matches_brute_force(spark):
    from tablelens.operators.similar import blocked_topk, unit_vectors
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "id long, v array<double>")
    u = unit_vectors(df, "id", "v")
    got = blocked_topk(u.withColumnRenamed("id", "qid"), u.withColumnRenamed("id", "did"), 3, "cosine",
                       exclude_self=True, q_block=64, d_chunk=50).toPandas()
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -np.inf)
    for q in range(0, 300, 37):
        want = list(np.argsort(-s[:, q], kind="stable")[:3])
        have = got[got.qid == q].sort_values("rank")["did"].tolist()
        assert have == want


def test_keyword_topk_fills_k_with_zero_scores(spark):
    from tablelens.operators.similar import keyword_topk
    q = spark.createDataFrame([(1, "oversample imbalanced minority class SMOTE")], "id long, text string")
    docs = [(i, f"doc number {i} about nothing") for i in range(1, 70)] + \
           [(70, "Use SMOTE to oversample the minority class when classes are imbalanced")]
    d = spark.createDataFrame(docs, "id long, text string")
    got = keyword_topk(q, "id", "text", d, "id", "text", k=2).orderBy("rank").collect()
    assert [r["did"] for r in got] == [70, 1] and got[0]["score"] > 0 and got[1]["score"] == 0


def test_bucketed_path_matches_window(spark, monkeypatch):
    """Many buckets, with more of them than are looked at together."""
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(R, "HELD_VALUES", 0)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "k": rng.normal(size=3000), "v": rng.integers(0, 5, 3000)})
    df = spark.createDataFrame(pdf)
    got = R.prefix_sum(df, "k", ["v"], ["g"]).toPandas().sort_values(["g", "k"])
    pdf = pdf.sort_values(["g", "k"])
    assert np.array_equal(got["cum_v"].to_numpy(), pdf.groupby("g")["v"].cumsum().to_numpy())
    desc = R.prefix_sum(df, "k", ["v"], descending=True).toPandas().sort_values("k", ascending=False)
    assert np.array_equal(desc["cum_v"].to_numpy(), desc["v"].cumsum().to_numpy())
    words = spark.createDataFrame([(f"w{i:04d}", 1) for i in range(700)], "k string, one int")
    assert R.prefix_sum(words, "k", ["one"]).toPandas().sort_values("k")["cum_one"].tolist() == list(range(1, 701))
    x = np.round(rng.exponential(size=999), 2)
    q = {r["p"]: r["q"] for r in R.exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x",
                                                     [0.1, 0.5, 0.9]).collect()}
    assert all(q[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-12) for p in (0.1, 0.5, 0.9))


def test_null_groups_stay(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 2)
    monkeypatch.setattr(R, "HELD_VALUES", 0)
    df = spark.createDataFrame([(None if i % 2 else "a", float(i), 1) for i in range(10)], "g string, k double, v int")
    got = sorted((str(r["g"]), r["k"], r["cum_v"]) for r in R.prefix_sum(df, "k", ["v"], ["g"]).collect())
    assert got == sorted([("a", float(i), i // 2 + 1) for i in range(0, 10, 2)] + [("None", float(i), i // 2 + 1) for i in range(1, 10, 2)])
    q = {r["g"]: r["q"] for r in R.exact_quantiles(df, "k", [0.5], ["g"]).collect()}
    assert q == {"a": 4.0, None: 5.0}


def test_quantiles_of_large_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD_VALUES", 0)
    monkeypatch.setattr(R, "WHOLE_BELOW", 10)  # brackets also where a rank is a large share
    rng = np.random.default_rng(7)
    x = np.r_[np.round(rng.exponential(size=30000), 3), np.full(9000, 0.7), np.nan]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["p"]: r["q"] for r in R.exact_quantiles(df, "x", probs).collect()}
    assert all(got[p] == pytest.approx(float(np.nanquantile(x, p)), rel=1e-12) for p in probs)


def test_shapiro_wilk_of_published_values():
    # men's weights of the 1965 paper, W 0.79; and what the exact law of n = 3 and symmetry ask for
    w, p = PV.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=1e-4)
    assert PV.shapiro_wilk(np.array([2.0, 2.0, 2.0, 2.0])) == (1.0, 1.0)
    assert PV.shapiro_wilk(np.array([1.0, 2.0, 3.0]))[1] == pytest.approx(1.0)
    assert PV.shapiro_wilk(np.array([0.0, 0.0, 1.0])) == pytest.approx((0.75, 0.0), abs=1e-7)
    rng = np.random.default_rng(1)
    for n in (4, 5, 6, 11, 12, 50, 700, 4999):
        x = rng.normal(size=n)
        assert PV._order_weights(n) @ PV._order_weights(n) == pytest.approx(1.0)
        assert PV.shapiro_wilk(5 - 3 * x) == pytest.approx(PV.shapiro_wilk(x))
    share = np.mean([[PV.shapiro_wilk(rng.normal(size=n))[1] < 0.05 for n in (8, 40, 300)] for _ in range(1500)], axis=0)
    assert np.abs(share - 0.05).max() < 0.02  # the test's level
    assert all(PV.shapiro_wilk(rng.exponential(size=n))[1] < 1e-4 for n in (100, 1000))


def test_shapiro_gate_picks_the_test(spark):
    from tablelens.operators import stats as S
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"y": np.repeat(["a", "b"], 300), "bell": np.r_[rng.normal(size=300), rng.normal(size=300) + 0.4],
                        "long": np.r_[rng.exponential(size=300), rng.exponential(size=300) * 1.5], "gap": 1.0})
    pdf.loc[10:590, "gap"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r["test"] for r in S.statistics(df, "y", True).collect()}
    assert got == {"bell": "Welch t-test", "long": "Mann-Whitney U"}  # none of a column without two values
    cells = S.value_cells(df, ["bell", "long", "gap"], [], "y").drop("v")
    found = {(r["feature"], r["grp"]): r for r in S.shapiro_wilk(cells).collect()}
    for name, group in pdf.groupby("y"):
        r = found[("bell", name)]
        assert r["n"] == 300 and (r["w"], r["p"]) == pytest.approx(PV.shapiro_wilk(group["bell"].to_numpy()))
    assert found[("gap", "a")]["w"] == 1.0 and found[("gap", "a")]["n"] == 10
    big = spark.range(5000).selectExpr("'f' AS feature", "cast(id AS double) AS x", "'g' AS grp", "1L AS c")
    row = S.shapiro_wilk(big).collect()[0]
    assert row["w"] is None and row["normal"] is False and row["n"] == 5000
    assert S.shapiro_wilk(cells.limit(0)).count() == 0


def test_rows_meet_their_group_where_they_lie(spark, monkeypatch):
    """Few groups are no few tasks: neither quantiles nor a split deal the rows by group."""
    from tablelens.operators import ranks
    from tablelens.operators.sample import stratified_split
    monkeypatch.setattr(ranks, "HELD_VALUES", 0)
    merged = []
    plain = ranks.null_safe
    monkeypatch.setattr(ranks, "null_safe", lambda *a: merged.append(plain(*a)) or merged[-1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(0, 4000, 1, 5).selectExpr("id", "nullif(id % 3, 2) AS g", "double(id) AS v")
        q = {r["g"]: r["q"] for r in ranks.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
        assert q == {0: 1999.5, 1: 1999.0, None: 2000.0}
        assert "BroadcastHashJoin" in merged[0]._jdf.queryExecution().sparkPlan().toString()
        split = stratified_split(df, "g", ["id"])
        assert split.rdd.getNumPartitions() == 5
        assert {(r["g"], r["n"]) for r in split.where("split = 'test'").groupBy("g").agg(F.count("id").alias("n")).collect()} == \
            {(0, 267), (1, 267), (None, 267)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_quantile_brackets_are_generated_code(spark, monkeypatch):
    """Every value meets its group's brackets by plain expressions (no interpreted lambdas); NULL is a group."""
    import numpy as np

    from tablelens.operators import ranks
    monkeypatch.setattr(ranks, "HELD_VALUES", 0)
    monkeypatch.setattr(ranks, "WHOLE_BELOW", 100)
    rng = np.random.default_rng(3)
    values = {g: np.round(rng.normal(size=n), 2) for g, n in (("a", 20_000), (None, 9_000), ("b", 7))}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("c", None), ("b", float("nan"))]
    found = ranks.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.25, 0.5, 1.0], ["g"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r["g"], r["p"]): r["q"] for r in found.collect()}
    ranks.release_shared()
    assert got.keys() == {(g, p) for g in values for p in (0.0, 0.25, 0.5, 1.0)}
    for (g, p), q in got.items():
        assert abs(q - np.quantile(values[g], p)) < 1e-12
