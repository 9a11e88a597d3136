"""Holt-Winters of long series as a composition of affine maps, against a run point by point."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import series as S


def run(y, m, a, b, g):
    """One-step errors, level, trend and season, a point at a time."""
    level = y[:m].mean() if m > 1 else y[0]
    trend = (y[m:2 * m].mean() - level) / m if m > 1 else y[1] - y[0]
    season, errors = list(y[:m] - level) if m > 1 else [0.0], []
    for t, value in enumerate(y):
        s = season[t % m]
        errors.append(value - level - trend - s)
        new = a * (value - s) + (1 - a) * (level + trend)
        level, trend = new, b * (new - level) + (1 - b) * trend
        season[t % m] = g * (value - new) + (1 - g) * s if m > 1 else 0.0
    return np.array(errors), level, trend, season


def expected(y, m, horizon):
    grid = itertools.product(S._GRID, S._GRID, S._GRID if m > 1 else [0.0])
    with np.errstate(all="ignore"):
        runs = [run(y, m, *p) for p in grid]
        sse = np.nan_to_num([float((r[0] ** 2).sum()) for r in runs], nan=np.inf)
    errors, level, trend, season = runs[int(np.argmin(sse))]
    ahead = [level + (h + 1) * trend + season[(len(y) + h) % m] for h in range(horizon)]
    return np.r_[y[-60:], ahead], np.abs(errors).mean()


def some_series(n, seed):
    r = np.random.RandomState(seed)
    return 10 + 0.03 * np.arange(n) + 4 * np.sin(2 * np.pi * np.arange(n) / 12) + r.randn(n)


@pytest.mark.parametrize("m", [1, 7, 12])
def test_a_step_is_the_affine_map_of_its_matrix(m):
    y = some_series(50, 1)
    shape = (S._grid(m).shape[1], 2 + (m if m > 1 else 0))
    start = np.random.RandomState(2).randn(1, *shape)
    whole, sums = S.run_lanes([y], start, m)
    zero, _ = S.run_lanes([y], np.zeros((1, *shape)), m)
    power = np.linalg.matrix_power(S._step_matrix(m), len(y))
    assert np.allclose(whole[0], (power @ start[0][:, :, None])[:, :, 0] + zero[0])
    halves, first = S.run_lanes([y[:23]], start, m)
    ends, second = S.run_lanes([y[23:]], halves, m)
    assert np.allclose(ends, whole) and np.allclose(first + second, sums)


@pytest.mark.parametrize("segment", [16, 100, 8192])
def test_many_and_long_series(spark, segment):
    sizes = {"a": 12, "b": 27, "c": 28, "d": 59, "e": 60, "long": 700, "short": 11, None: 90}
    rows = [(k, i, float(v)) for j, (k, n) in enumerate(sizes.items()) for i, v in enumerate(some_series(n, j))]
    pdf = pd.DataFrame(rows, columns=["k", "t", "y"]).sample(frac=1, random_state=3)
    df = spark.createDataFrame(pdf, "k string, t long, y double").repartition(4)
    got = S.holt_winters(df, ["k"], "t", "y", segment=segment).toPandas()
    assert set(got["k"].map(lambda k: None if pd.isna(k) else k)) == set(sizes) - {"short"}
    for j, (k, n) in enumerate(sizes.items()):
        if n < 12:
            continue
        own = got[got["k"].isna() if k is None else got["k"] == k].sort_values("idx")
        period = 12 if n >= 60 else 7 if n >= 28 else 1
        m, horizon = period if n > 2 * period else 1, max(6, min(24, n // 6))
        value, mae = expected(some_series(n, j), m, horizon)
        assert np.allclose(own["value"], value) and np.allclose(own["mae"], mae)
        assert (own["period"] == m).all() and (own["kind"] == "forecast").sum() == horizon


def test_one_series_is_run_in_many_tasks(spark):
    n = 60_000
    df = spark.range(n).selectExpr("'s' as k", "id as t", "10 + sin(id * 0.5236) + pmod(hash(id), 100) / 200D as y")
    got = S.holt_winters(df, ["k"], "t", "y", segment=1024).toPandas().sort_values("idx")
    y = df.orderBy("t").toPandas()["y"].to_numpy()
    state, sums = S.run_lanes([y], np.repeat(S.first_state(y, 12)[None, None], 125, axis=1), 12)
    assert np.allclose(got["mae"], sums[0, S.ERRORS, int(np.argmin(np.nan_to_num(sums[0, S.SQUARES], nan=np.inf)))] / n)
    assert np.allclose(got["value"][:60], y[-60:]) and len(got) == 84
