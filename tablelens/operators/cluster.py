"""Unsupervised tasks (U1-U7): k-means segments, isolation-forest outliers, PCA.

Inputs go through the shared numeric matrix (C12) and population-sigma
standardisation (E3).  Isolation Forest grows its 200 small trees in parallel
(one group of at most ``sample_size`` rows per tree, drawn by hash) and scores
every row with the broadcast forest — the forest size is fixed by
(trees x 2^height), not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_input
from tablelens.operators.features import standardize
from tablelens.operators.ranks import attach_scalars


def _q(c: str):
    return F.col(f"`{c}`")


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


# ----------------------------------------------------------------- k-means

#: Rows, about, whose exact Euclidean silhouette the verdict is the mean of; each is held against all rows.
SILHOUETTE_ROWS = 2000
#: Rows that starting centres are drawn from; values of a table that one task clusters by itself (with the same steps).
START_ROWS, HELD_VALUES = 2048, 1 << 22
#: Squared way of all centres of a run below which it has ended, and rows whose distances are there at once.
TOLERANCE, CHUNK = 1e-4, 4096


def _row_unit(seed: int) -> Column:
    """A hash of the row's number (equal rows have hashes of their own) in [0, 1)."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(2 ** 31)) / F.lit(2.0 ** 31)


def _scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """The table with its standardised columns as the array ``__x``; a missing value is the mean."""
    scaled = [f"{c}__z" for c in cols]
    z = standardize(df, cols, suffix="__z")
    return z.withColumn("__x", F.array(*[F.coalesce(_q(c).cast("double"), F.lit(0.0)) for c in scaled])).drop(*scaled)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for at in range(0, len(x), CHUNK):
            yield x[at:at + CHUNK]


def _picks(x: np.ndarray, centres: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the nearest centre for each row and run; one product serves all runs."""
    far = (centres ** 2).sum(axis=1) - 2 * x @ centres.T
    return np.stack([b + far[:, b:e].argmin(axis=1) for b, e in zip(np.r_[0, ends[:-1]], ends)], axis=1)


def _tally(x: np.ndarray, centres: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each centre: the sum of its rows, of their squared lengths, and their count."""
    member = np.zeros((len(x), len(centres)))
    member[np.arange(len(x))[:, None], _picks(x, centres, ends)] = 1
    return member.T @ np.c_[x, (x ** 2).sum(axis=1), np.ones(len(x))]


def _lloyd(total, centres: np.ndarray, ends: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves the centres of all runs, a scan a round, until each run has ended; the centres and their tallies."""
    sizes, centres = np.diff(np.r_[0, ends]), centres.copy()
    run = np.repeat(np.arange(len(ends)), sizes)
    tally, moving = np.zeros((len(centres), centres.shape[1] + 2)), np.ones(len(ends), bool)
    for left in reversed(range(rounds)):
        at = np.flatnonzero(moving[run])
        here, upto = centres[at], np.cumsum(sizes[moving])
        tally[at] = total(lambda x: _tally(x, here, upto))  # noqa: B023 - used in this round only
        n = tally[at, -1:]
        moved = np.where(n > 0, tally[at, :-2] / np.maximum(n, 1), here)
        moving &= np.bincount(run[at], ((moved - here) ** 2).sum(axis=1), len(ends)) > TOLERANCE
        if not left or not moving.any():
            break
        centres[at] = np.where(moving[run[at]][:, None], moved, here)
    return centres, tally


def _silhouettes(x: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over the rows, for each fit, of the squared-Euclidean silhouette, from the clusters' tallies."""
    out, length, at = np.zeros((len(fits), 1)), (x ** 2).sum(axis=1), np.arange(len(x))
    for i, (centres, tally) in enumerate(fits):
        own, n = _picks(x, centres, np.array([len(centres)]))[:, 0], tally[:, -1]
        if (n > 0).sum() < 2:  # all rows are equal
            continue
        size = np.maximum(n, 1)
        mean = np.where(n > 0, np.maximum(length[:, None] + tally[:, -2] / size - 2 * x @ (tally[:, :-2] / size[:, None]).T, 0), np.inf)
        inner = mean[at, own] * n[own] / np.maximum(n[own] - 1, 1)
        mean[at, own] = np.inf
        outer = mean.min(axis=1)
        out[i] = np.where(n[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).sum()
    return out


def _fits(total, n: int, centres: np.ndarray, ends: np.ndarray, ks: list[int], starts: int, rounds: int) -> list[tuple]:
    """(k, silhouette, centres) of the best start of each k."""
    centres, tally = _lloyd(total, centres, ends, rounds)
    s, q, m = tally[:, :-2], tally[:, -2], tally[:, -1]
    cost = np.add.reduceat(q - 2 * (centres * s).sum(axis=1) + m * (centres ** 2).sum(axis=1), np.r_[0, ends[:-1]])
    best = [i * starts + int(cost[i * starts:(i + 1) * starts].argmin()) for i in range(len(ks))]
    fits = [(centres[ends[r] - k:ends[r]], tally[ends[r] - k:ends[r]]) for k, r in zip(ks, best)]
    value = total(lambda x: _silhouettes(x, fits))[:, 0] / n
    return [(k, float(v), c) for k, v, (c, _) in zip(ks, value, fits)]


def _start(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: every next centre is a row drawn by its squared distance to the centres so far."""
    picked = [int(rng.integers(len(rows)))]
    apart = ((rows - rows[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        weight = apart if apart.sum() > 0 else np.ones(len(rows))
        picked.append(int(rng.choice(len(rows), p=weight / weight.sum())))
        apart = np.minimum(apart, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
    return rows[picked]


def _summed(z: DataFrame, width: int):
    """``total(fn)``: the matrix ``fn(rows)`` summed over all rows, a row of it a task before the exchange."""
    def total(fn):
        def part(batches):
            found = None
            for x in _matrices(batches, width):
                found = fn(x) if found is None else found + fn(x)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.tolist())], names=["i", "v"])
        sums = z.select("__x").mapInArrow(part, "i int, v array<double>")
        wide = len(fn(np.zeros((1, width)))[0])
        rows = sums.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(wide)]).alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in rows])  # a row per centre
    return total


@finite_input
def kmeans_select(df: DataFrame, cols: list[str], k_max: int = 8, seed: int = 42, starts: int = 10, rounds: int = 100):
    """k = 2..k_max (fewer when rows are few) on standardised columns, ``starts`` runs of each, and the best
    silhouette of all rows (squared-Euclidean, as Spark's evaluator; :func:`euclidean_silhouette` is for the verdict).
    Returns ``(scores DataFrame(k, silhouette), best_k, labelled DataFrame)``, labelled with the raw columns.

    All runs of all k move together: a round is one scan, whose distances come from one product of the rows with
    all centres that still move; one more scan gives the silhouettes of the best start of every k.  Starting centres are
    k-means++ draws from ``START_ROWS`` rows by a hash of their number; all rows take part in everything after that.
    A missing value counts as its column's mean; a cluster that loses its rows keeps its centre; equal rows give 0."""
    if len(cols) < 2:
        raise ValueError("clustering takes two numeric columns or more")
    width = len(cols)
    z = _scaled(df, cols).cache()
    try:
        n = z.count()
        ks = list(range(2, min(k_max + 1, n)))
        if not ks:
            raise ValueError("clustering takes three rows or more")
        drawn = z.select("__x", _row_unit(seed).alias("__u")).orderBy("__u", "__x").limit(START_ROWS).collect()
        rows = np.array([r["__x"] for r in drawn])
        centres = np.vstack([_start(rows, k, np.random.default_rng([seed, k, s])) for k in ks for s in range(starts)])
        ends = np.cumsum(np.repeat(ks, starts))
        if n * width <= HELD_VALUES:
            def alone(batches):
                parts = list(_matrices(batches, width))
                for k, value, c in _fits(lambda fn: sum(map(fn, parts)), n, centres, ends, ks, starts, rounds):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value]), pa.array([c.ravel().tolist()])],
                                                     names=["k", "value", "centres"])
            held = z.select("__x").coalesce(1).mapInArrow(alone, "k int, value double, centres array<double>").collect()
            found = [(r["k"], r["value"], np.array(r["centres"]).reshape(-1, width)) for r in held]  # a row per k
        else:
            found = _fits(_summed(z, width), n, centres, ends, ks, starts, rounds)
    finally:
        z.unpersist()
    best, _, at = max(found, key=lambda f: (f[1], -f[0]))

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(_picks(np.array(x.tolist(), dtype=float).reshape(-1, width), at, np.array([len(at)]))[:, 0])
    out = df.sparkSession.createDataFrame([f[:2] for f in found], "k int, silhouette double")
    return out, best, z.withColumn("cluster", nearest("__x")).drop("__x")


def euclidean_silhouette(labelled: DataFrame, cols: list[str], cluster_col: str = "cluster", seed: int = 42) -> DataFrame:
    """P6's input: ``value``, the mean Euclidean silhouette on standardised columns.

    The mean is over about ``SILHOUETTE_ROWS`` rows, drawn by a hash of their number, or all of a smaller table; the
    distances of each are summed over ALL rows of every cluster, so its value is exact."""
    spark = labelled.sparkSession
    z = _scaled(labelled, cols).select(F.col(cluster_col).cast("int").alias("cluster"), F.col("__x").alias("x")).cache()
    try:
        sizes = {r["cluster"]: r["count"] for r in z.groupBy("cluster").count().collect()}  # a row per cluster
        n = sum(sizes.values())
        if len(sizes) < 2:
            return spark.createDataFrame([(0.0,)], "value double")
        drawn = (z.where(_row_unit(seed) < min(1.0, SILHOUETTE_ROWS / n)).groupBy("cluster", "x")
                 .agg(F.count(F.lit(1)).alias("w")).orderBy("cluster", "x").collect())  # SILHOUETTE_ROWS of them, about
        ids = sorted(sizes)
        points = np.array([r["x"] for r in drawn])
        held = spark.sparkContext.broadcast((points, (points ** 2).sum(axis=1), ids))

        def distances(batches):
            p, norm, known = held.value
            sums = np.zeros((len(known), len(p)))
            for pdf in batches:
                for at in range(0, len(pdf), 1000):
                    part = pdf.iloc[at:at + 1000]
                    q = np.array(part["x"].tolist(), dtype=float)
                    apart = np.maximum((q ** 2).sum(axis=1)[:, None] + norm[None, :] - 2 * q @ p.T, 0)
                    apart[apart < 1e-12 * (1 + norm[None, :])] = 0  # equal rows, by rounding
                    member = part["cluster"].to_numpy()[None, :] == np.array(known)[:, None]
                    sums += member.astype(float) @ np.sqrt(apart)
            yield pd.DataFrame({"cluster": known, "sums": sums.tolist()})
        sums = (z.mapInPandas(distances, "cluster int, sums array<double>").select("cluster", F.posexplode("sums"))
                .groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect())  # clusters x drawn rows
    finally:
        z.unpersist()
    total = np.zeros((len(points), len(ids)))
    for r in sums:
        total[r["pos"], ids.index(r["cluster"])] = r["s"]
    count = np.array([sizes[c] for c in ids], dtype=float)
    own = np.array([ids.index(r["cluster"]) for r in drawn])
    at = np.arange(len(points))
    inner = total[at, own] / np.maximum(count[own] - 1, 1)
    outer = total / count
    outer[at, own] = np.inf
    outer = outer.min(axis=1)
    score = np.where(count[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
    value = float(np.average(score, weights=[r["w"] for r in drawn]))
    return spark.createDataFrame([(value,)], "value double")


def segment_sizes(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """``segment, share`` — 'Segment i' numbered from cluster id 0."""
    g = labelled.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("c"))
    tot = g.agg(F.sum("c").alias("_n"))
    return attach_scalars(g, tot).select(
        F.concat(F.lit("Segment "), (F.col(cluster_col) + 1).cast("string")).alias("segment"),
        (F.col("c") / F.col("_n")).alias("share"))


def defining_dimensions(labelled: DataFrame, cols: list[str], cluster_col: str = "cluster",
                        top: int = 6) -> DataFrame:
    """Variance across clusters of each column's cluster mean (raw units):
    ``label, separation, value`` with value = separation / max, floored at 0.08."""
    means = labelled.groupBy(cluster_col).agg(*[F.avg(_q(c)).alias(c) for c in cols])
    row = means.agg(*[F.var_samp(_q(c)).alias(c) for c in cols])
    st = F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(_q(c), F.lit(0.0)).alias("separation"),
                            F.lit(i).alias("pos")) for i, c in enumerate(cols)])
    x = row.select(F.explode(st).alias("s")).select("s.*")
    t = x.orderBy(F.desc("separation"), "pos").limit(top)
    mx = x.agg(F.max("separation").alias("_m"))
    return attach_scalars(t, mx).select(
        "label", "separation",
        F.greatest(F.lit(0.08), F.col("separation") / F.coalesce(F.nullif("_m", F.lit(0.0)), F.lit(1.0))).alias("value"))


# --------------------------------------------------------- isolation forest

def _avg_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, height_limit: int):
    """One isolation tree as parallel arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= height_limit or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            return i
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    adj = [_avg_path(float(n)) for n in size]  # c(n) added at a leaf holding n samples
    return feat, thr, left, right, adj


def _path_lengths(x: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, adj = (np.asarray(a) for a in tree)
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = feat[node] >= 0
    while active.any():
        f = feat[node[active]]
        go_left = x[active, f] < thr[node[active]]
        node[active] = np.where(go_left, left[node[active]], right[node[active]])
        depth[active] += 1
        active = feat[node] >= 0
    return depth + adj[node]


def isolation_forest(df: DataFrame, key_cols: list[str], cols: list[str], n_trees: int = 200,
                     sample_size: int = 256, seed: int = 42) -> DataFrame:
    """U4: anomaly ``score`` in (0, 1) (2^(-E[h]/c(psi))) and ``flag`` = score > 0.5
    (scikit-learn's contamination='auto') for EVERY row, on standardised columns,
    which are there as the array ``scaled``."""
    spark = df.sparkSession
    z = standardize(df.select(*key_cols, *cols), cols)
    n = z.count()
    psi = min(sample_size, n)
    vec = F.array(*[_q(c).cast("double") for c in cols])

    # Tree samples only need a deterministic hash (no cross-engine oracle): Spark's
    # native xxhash64 is far cheaper per row than md5 over concatenated text.
    def unit(*cs):
        return F.pmod(F.xxhash64(*[F.col(k) for k in key_cols], *cs, F.lit(seed)), F.lit(2 ** 31)) / F.lit(2.0 ** 31)

    # every tree draws its rows by a hash of its own from one pool, the least
    # hashes of all rows, that would hold a sample of its own for each tree
    pool = min(n, n_trees * psi)
    trees = F.array(*[F.lit(t) for t in range(n_trees)])
    drawn = (z.where(unit() <= F.lit(2.0 * pool / max(n, 1))).orderBy(unit(), *key_cols).limit(pool)
             .select(F.explode(trees).alias("tree"), *key_cols, vec.alias("x")))
    picked = (drawn.withColumn("h", unit(F.col("tree"))).where(F.col("h") <= F.lit(3.0 * psi / max(pool, 1)))
              .select("tree", "h", "x"))
    height = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(psi)
        t = int(pdf["tree"].iloc[0])
        x = np.vstack([np.asarray(v, dtype=float) for v in pdf["x"]])
        f, th, le, ri, adj = _grow(x, np.random.default_rng(seed + t), height)
        return pd.DataFrame({"tree": [t], "feat": [f], "thr": [th], "left": [le], "right": [ri], "adj": [adj]})

    forest = picked.groupBy("tree").applyInPandas(
        grow, "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, adj array<double>")
    model = [tuple(np.asarray(a) for a in r[1:])
             for r in forest.orderBy("tree").collect()]  # n_trees x 2^height nodes at most
    bc = spark.sparkContext.broadcast(model)
    c = _avg_path(psi)
    schema = ", ".join(f"`{k}` {z.schema[k].dataType.simpleString()}" for k in key_cols) + ", x array<double>, score double"

    def score(it):
        trees = bc.value
        for pdf in it:
            x = np.vstack([np.asarray(v, dtype=float) for v in pdf["x"]]) if len(pdf) else np.zeros((0, len(cols)))
            h = np.mean([_path_lengths(x, t) for t in trees], axis=0) if len(pdf) else np.zeros(0)
            out = pdf[[*key_cols, "x"]].copy()
            out["score"] = np.power(2.0, -h / c) if c > 0 else 0.5
            yield out

    scored = z.select(*key_cols, vec.alias("x")).mapInPandas(score, schema)
    return scored.withColumn("flag", (F.col("score") > 0.5).cast("int")).withColumnRenamed("x", "scaled")


def anomaly_drivers(flags: DataFrame, cols: list[str], top: int = 6) -> DataFrame:
    """``label, separation, value``: |mean(flagged) - mean(normal)| / sigma per
    column from one conditional aggregate over the scored rows (no join, so
    repeated rows count once each); value = separation / max, floor 0.08."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col("scaled")[i]
        aggs += [F.avg(F.when(F.col("flag") == 1, x)).alias(f"a{i}"), F.avg(F.when(F.col("flag") == 0, x)).alias(f"b{i}"),
                 F.stddev_pop(x).alias(f"s{i}")]
    row = flags.agg(*aggs)
    st = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(i).alias("pos"),
                            F.coalesce(F.abs(F.col(f"a{i}") - F.col(f"b{i}")) /
                                       F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1e-9)),
                                       F.lit(0.0)).alias("separation")) for i, c in enumerate(cols)])
    x = row.select(F.explode(st).alias("s")).select("s.*")
    t = x.orderBy(F.desc("separation"), "pos").limit(top)
    mx = x.agg(F.max("separation").alias("_m"))
    return attach_scalars(t, mx).select(
        "label", "separation",
        F.greatest(F.lit(0.08), F.col("separation") / F.coalesce(F.nullif("_m", F.lit(0.0)), F.lit(1.0))).alias("value"))


def anomaly_rate(flags: DataFrame) -> DataFrame:
    """``rows, flagged, rate``."""
    return flags.agg(F.count(F.lit(1)).alias("rows"), F.sum("flag").cast("long").alias("flagged"),
                     F.avg("flag").alias("rate"))


# --------------------------------------------------------------------- PCA

def pca(df: DataFrame, key_cols: list[str], cols: list[str], k: int = 5):
    """PCA on population-standardised columns.  Returns ``(variance
    DataFrame(component, ratio), loadings DataFrame(label, value) of |PC1| top 6,
    projection DataFrame(keys, pc1, pc2))``."""
    if len(cols) < 2:
        raise ValueError("a projection takes two numeric columns or more")
    spark = df.sparkSession
    k = min(k, len(cols))
    z = _assembled(standardize(df.select(*key_cols, *cols), cols), cols)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(z)
    var = model.explainedVariance.toArray().tolist()
    variance = spark.createDataFrame([(f"PC{i + 1}", float(v)) for i, v in enumerate(var)],
                                     "component string, ratio double")
    load = np.abs(model.pc.toArray()[:, 0])
    order = np.argsort(-load, kind="stable")[:6]
    mx = load.max() or 1.0
    loadings = spark.createDataFrame([(cols[i], float(max(0.08, load[i] / mx))) for i in order],
                                     "label string, value double")
    proj = model.transform(z).select(*key_cols, vector_to_array("pcs").alias("p")) \
                .select(*key_cols, F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"))
    return variance, loadings, proj
