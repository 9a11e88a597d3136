"""Survival analysis.

Kaplan–Meier is two running sums over distinct durations: the at-risk count
(from the largest duration down) and the running log-survival (from the
smallest up), both through the bucketed prefix sum — no single-task window.
Cox proportional hazards runs Newton steps whose gradient and Hessian are
reduced from per-time aggregates; only p x p numbers reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_input, is_numeric_type, to_number
from tablelens.operators.ranks import attach_scalars, prefix_sum, shared

# Column names read as a duration.
DURATION_NAMES = ["time", "duration", "tenure", "days", "months", "age", "lifetime", "t"]


def _q(c: str):
    return F.col(f"`{c}`")


def choose_columns(df: DataFrame, target: str | None = None) -> tuple[str, str]:
    """``(event_col, duration_col)``.  Event: the target, else the first
    column with exactly two distinct values.  Duration: a column with a
    duration-like name that is >80 % numeric, else the first column >80 %
    numeric with >90 % of its numbers non-negative."""
    from tablelens.operators.clean import distinct_counts

    cols = df.columns
    event = target if target in cols else None
    if event is None:
        dc = distinct_counts(df, cols, upto=2)
        event = next((c for c in cols if dc[c] == 2), None)
    if event is None:
        raise ValueError("no column tells events from censored rows: name one with two values as the target")
    cand = [c for c in cols if c != event]
    num = {c: (_q(c).cast("double") if is_numeric_type(df.schema[c].dataType) else to_number(_q(c))) for c in cand}
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(cand) for x in (
        F.count(num[c]).alias(f"v{i}"), F.count(F.when(num[c] >= 0, 1)).alias(f"p{i}"))]).first()
    n = r["_n"] or 1
    ok = {c: r[f"v{i}"] / n > 0.8 for i, c in enumerate(cand)}
    for c in cand:
        if c.lower() in DURATION_NAMES and ok[c]:
            return event, c
    for i, c in enumerate(cand):
        if ok[c] and r[f"v{i}"] and r[f"p{i}"] / r[f"v{i}"] > 0.9:
            return event, c
    raise ValueError("no column holds durations (numbers from 0 up)")


def event_indicator(df: DataFrame, event: str) -> F.Column:
    """Numeric event: value > 0; text event: equals the largest label."""
    if is_numeric_type(df.schema[event].dataType):
        return (_q(event).cast("double") > 0).cast("int")
    top = df.agg(F.max(_q(event).cast("string"))).first()[0]
    return (_q(event).cast("string") == F.lit(top)).cast("int")


def survival_frame(df: DataFrame, duration: str, event: str) -> DataFrame:
    """``T double, E int`` with missing or negative durations removed."""
    t = _q(duration).cast("double") if is_numeric_type(df.schema[duration].dataType) else to_number(_q(duration))
    return df.select(t.alias("T"), event_indicator(df, event).alias("E")) \
             .where(F.col("T").isNotNull() & (F.col("T") >= 0) & F.col("E").isNotNull())


def with_survival(df: DataFrame, duration: str, event: str) -> DataFrame:
    """The table with ``_T`` and ``_E``, without rows that have neither time nor event."""
    t = _q(duration).cast("double") if is_numeric_type(df.schema[duration].dataType) else to_number(_q(duration))
    return (df.withColumn("_T", t).withColumn("_E", event_indicator(df, event))
            .where(F.col("_T").isNotNull() & (F.col("_T") >= 0) & F.col("_E").isNotNull()))


def kaplan_meier(tf: DataFrame) -> DataFrame:
    """``t, at_risk, events, s`` for every distinct duration plus t = 0."""
    tf = shared(tf)
    g = tf.groupBy("T").agg(F.sum("E").cast("long").alias("events"), F.count(F.lit(1)).alias("c"))
    risk = prefix_sum(g, "T", ["c"], descending=True).withColumnRenamed("cum_c", "at_risk")
    d, n = F.col("events"), F.col("at_risk")
    risk = risk.withColumn("lg", F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0))) \
               .withColumn("zero", F.when((d >= n) & (d > 0), 1).otherwise(0).cast("long"))
    cum = prefix_sum(risk, "T", ["lg", "zero"])
    s = F.when(F.col("cum_zero") > 0, F.lit(0.0)).otherwise(F.exp("cum_lg"))
    curve = cum.select(F.col("T").alias("t"), "at_risk", "events", s.alias("s"))
    start = tf.agg(F.min("T").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("m") > 0) \
              .select(F.lit(0.0).alias("t"), F.col("n").alias("at_risk"), F.lit(0).cast("long").alias("events"),
                      F.lit(1.0).alias("s"))
    return curve.unionByName(start)


def km_thinned(curve: DataFrame, m: int = 40) -> DataFrame:
    """U13 output: every step-th point (step = len // m) in time order."""
    from tablelens.operators.sample import thin
    return thin(curve, "t", m)


def km_median(curve: DataFrame) -> DataFrame:
    """Median survival: the first t with S <= 0.5, else the last t."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("s") <= 0.5, F.col("t"))), F.max("t")).alias("median"))


def event_rate(tf: DataFrame) -> DataFrame:
    """``subjects, events, event_rate, censored``."""
    return tf.agg(F.count(F.lit(1)).alias("subjects"), F.sum("E").cast("long").alias("events"),
                  F.avg("E").alias("event_rate")).withColumn("censored", 1 - F.col("event_rate"))


# ------------------------------------------------------------------------ Cox

#: Places of a tie that are summed at a time.
TIES = 1 << 16


def _weighted(pdf: pd.DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.array(pdf["z"].tolist(), dtype=float).reshape(len(pdf), len(beta))
    xb = z @ beta
    return z, xb, np.exp(xb)


def _part_sums(beta: np.ndarray):
    """Of each part: the sums of w, w z and w z z' over its rows."""
    p = len(beta)

    def run(batches):
        part, sums = None, np.zeros(1 + p + p * p)
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            z, _, w = _weighted(pdf, beta)
            sums += np.r_[w.sum(), w @ z, (z.T @ (w[:, None] * z)).ravel()]
        if part is not None:
            yield pd.DataFrame({"part": [part], "sums": [sums.tolist()]})
    return run


def _efron(d: int, risk: np.ndarray, tied: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """What the ``d`` tied events of a time add (without their own covariates)."""
    ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
    r1, t1 = risk[1:1 + p], tied[1:1 + p]
    r2, t2 = risk[1 + p:].reshape(p, p), tied[1 + p:].reshape(p, p)
    for at in range(0, d, TIES):
        frac = np.arange(at, min(at + TIES, d)) / d
        den = risk[0] - frac * tied[0]
        ll -= np.log(den).sum()
        a0, a1 = (1 / den).sum(), (frac / den).sum()
        b0, b1, b2 = (1 / den ** 2).sum(), (frac / den ** 2).sum(), (frac ** 2 / den ** 2).sum()
        g -= r1 * a0 - t1 * a1
        h -= (r2 * a0 - t2 * a1) - (np.outer(r1, r1) * b0 - (np.outer(r1, t1) + np.outer(t1, r1)) * b1
                                    + np.outer(t1, t1) * b2)
    return ll, g, h


def _gram(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return z.T @ (weight[:, None] * z)


def _segments(z, xb, w, t, e) -> dict[str, np.ndarray]:
    """Sums over the rows of each time, in the order of the rows."""
    cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    we = np.where(e, w, 0.0)
    return {"cut": cut, "of": np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(t)])), "d": np.add.reduceat(e.astype(np.int64), cut),
            "r0": np.add.reduceat(w, cut), "r1": np.add.reduceat(w[:, None] * z, cut), "t0": np.add.reduceat(we, cut),
            "t1": np.add.reduceat(we[:, None] * z, cut), "we": we}


def _part_terms(beta: np.ndarray, later: dict[int, np.ndarray]):
    """Likelihood, gradient and Hessian of a part, read from the latest time down;
    ``later`` has the sums of all parts with later times.

    A batch is handled by cumulative sums of w and w z over its times; what its times take of w z z' is one
    product of matrices, each row weighted by the times it is at risk at.  Only the last time of a batch is
    carried on, as sums, as its ties may go on in the next."""
    p = len(beta)

    def run(batches):
        ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
        risk, tied, d, time = None, np.zeros(1 + p + p * p), 0, None

        def close():
            nonlocal ll, g, h
            if d:
                more = _efron(d, risk, tied, p)
                ll, g, h = ll + more[0], g + more[1], h + more[2]
        for pdf in batches:
            if not len(pdf):
                continue
            if risk is None:
                risk = later[int(pdf["part"].iloc[0])].copy()
            z, xb, w = _weighted(pdf, beta)
            t, e = pdf["T"].to_numpy(), pdf["E"].to_numpy().astype(bool)
            ll, g = ll + xb[e].sum(), g + z[e].sum(axis=0)
            same = int(np.searchsorted(t != time, True)) if time is not None else 0  # rows that go on with the carried time
            for rows in (slice(0, same), slice(same, len(t))):
                if rows.start == rows.stop:
                    continue
                zi, wi, ei = z[rows], w[rows], e[rows]
                s = _segments(zi, xb[rows], wi, t[rows], ei)
                if rows.start == same:  # new times: the carried one is complete, and so are all but the last here
                    close()
                    tied, d, m = np.zeros(1 + p + p * p), 0, len(s["cut"]) - 1
                    more = _complete(s, zi, wi, risk, m, p)
                    ll, g, h = ll + more[0], g + more[1], h + more[2]
                    time = t[rows][-1]
                risk = risk + np.r_[wi.sum(), wi @ zi, _gram(zi, wi).ravel()]
                last = s["cut"][-1]
                tied = tied + np.r_[s["t0"][-1], s["t1"][-1], _gram(zi[last:], s["we"][last:]).ravel()]
                d += int(s["d"][-1])
        close()
        if risk is not None:
            yield pd.DataFrame({"ll": [ll], "g": [g.tolist()], "h": [h.ravel().tolist()]})
    return run


def _complete(s: dict, z: np.ndarray, w: np.ndarray, risk: np.ndarray, m: int, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """What the first ``m`` times of a batch add (without their own covariates), by Efron's weights of their ties."""
    d = s["d"][:m]
    if not d.any():
        return 0.0, np.zeros(p), np.zeros((p, p))
    r0, r1 = risk[0] + np.cumsum(s["r0"])[:m], risk[1:1 + p] + np.cumsum(s["r1"], axis=0)[:m]
    t0, t1 = s["t0"][:m], s["t1"][:m]
    owner = np.repeat(np.arange(m), d)
    frac = (np.arange(len(owner)) - np.repeat(np.cumsum(d) - d, d)) / d[owner]
    den = r0[owner] - frac * t0[owner]
    a0, a1, b0, b1, b2 = (np.bincount(owner, x, m) for x in (1 / den, frac / den, 1 / den ** 2, frac / den ** 2, frac ** 2 / den ** 2))
    at_risk = np.r_[np.cumsum(a0[::-1])[::-1], 0.0]  # of a row: the complete times from its own on
    second = risk[1 + p:].reshape(p, p) * a0.sum() + _gram(z, w * at_risk[np.minimum(s["of"], m)])
    second -= _gram(z, s["we"] * np.r_[a1, 0.0][np.minimum(s["of"], m)])
    cross = r1.T @ (b1[:, None] * t1)
    first = _gram(r1, b0) - cross - cross.T + _gram(t1, b2)
    return -float(np.log(den).sum()), -(a0 @ r1 - a1 @ t1), first - second


def _likelihood(rows: DataFrame, beta: np.ndarray, penalizer: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised log-likelihood, gradient and Hessian: two passes over the sorted
    parts, and p x p numbers per part to the driver."""
    p = len(beta)
    sums = {r["part"]: np.array(r["sums"]) for r in rows.mapInPandas(_part_sums(beta), "part int, sums array<double>").collect()}
    later, running = {}, np.zeros(1 + p + p * p)
    for part in sorted(sums):  # parts are in order of falling time
        later[part] = running.copy()
        running += sums[part]
    found = rows.mapInPandas(_part_terms(beta, later), "ll double, g array<double>, h array<double>").collect()
    ll = sum(r["ll"] for r in found) - 0.5 * penalizer * float(beta @ beta)
    g = np.sum([r["g"] for r in found], axis=0) - penalizer * beta
    h = np.sum([np.reshape(r["h"], (p, p)) for r in found], axis=0) - penalizer * np.eye(p)
    return ll, g, h


@finite_input
def cox_ph(df: DataFrame, duration: str, event: str, features: list[str], penalizer: float = 0.1,
           max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """Cox proportional hazards, Efron ties, ridge ``penalizer`` on
    standardised covariates (lifelines' convention: 0.5 * penalizer * ||b||^2),
    by Newton steps that are halved while they lower the likelihood.  Rows with
    a missing covariate are left out of all sums alike.  Output ``feature, coef,
    hr, gradient`` on the original scale; ``gradient`` (of the standardised
    covariate, at the returned coefficients) is about 0 at the optimum."""
    base = df.select(_q(duration).cast("double").alias("T"), _q(event).cast("int").alias("E"),
                     *[_q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).dropna()
    stats = base.agg(*[F.avg(f"x{i}") for i in range(len(features))],
                     *[F.stddev_pop(f"x{i}") for i in range(len(features))]).first()
    p = len(features)
    mu, sd = np.array([v or 0.0 for v in stats[:p]]), np.array([v or 1.0 for v in stats[p:]])
    z = F.array(*[(F.col(f"x{i}") - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i in range(p)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (base.select("T", "E", z.alias("z")).repartitionByRange(parts, F.desc("T")).sortWithinPartitions(F.desc("T"))
            .withColumn("part", F.spark_partition_id()).persist())
    try:
        beta = np.zeros(p)
        ll, g, h = _likelihood(rows, beta, penalizer)
        for _ in range(max_iter):
            step = np.linalg.solve(-h, g)
            for _ in range(20):
                tried = _likelihood(rows, beta + step, penalizer)
                if tried[0] >= ll - 1e-12 * abs(ll):
                    break
                step = step / 2
            gain, (ll, g, h), beta = abs(tried[0] - ll), tried, beta + step
            if gain < tol and np.abs(step).max() < 1e-7:
                break
    finally:
        rows.unpersist()
    found = [(f, float(c), float(math.exp(c)), float(v)) for f, c, v in zip(features, beta / sd, g)]
    return df.sparkSession.createDataFrame(found, "feature string, coef double, hr double, gradient double")


def hazard_bars(hr: DataFrame, top: int = 6) -> DataFrame:
    """Top ``top`` hazard ratios by |HR - 1|: ``label, value, sign, hr``."""
    t = hr.orderBy(F.desc(F.abs(F.col("hr") - 1)), "feature").limit(top)
    lmax = t.agg(F.max(F.abs(F.log("hr"))).alias("_l"))
    return attach_scalars(t, lmax).select(
        F.col("feature").alias("label"),
        F.greatest(F.lit(0.08), F.least(F.lit(1.0), F.abs(F.log("hr")) / F.coalesce(F.nullif("_l", F.lit(0.0)),
                                                                                    F.lit(1.0)))).alias("value"),
        F.when(F.col("hr") > 1, 1).otherwise(-1).alias("sign"), F.bround("hr", 2).alias("hr"))
