"""Model evaluation on a GIVEN prediction / score column.

Curves are cumulative sums over distinct scores (descending) through the
bucketed prefix sum; neighbours for sklearn's ``drop_intermediate`` come from
equi-joins on the running index, so nothing is ranked in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.ranks import attach_scalars, exact_quantiles, prefix_sum, shared


def _q(c: str):
    return F.col(f"`{c}`")


def _binary(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    return df.select((_q(y) == F.lit(positive)).cast("int").alias("y"), _q(score).cast("double").alias("s")) \
             .where(F.col("y").isNotNull() & F.col("s").isNotNull())


# ------------------------------------------------------------- classification

def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """M5: ``actual, predicted, count`` over the full label grid (labels = union
    of actual and predicted values; a class label set is small)."""
    a, p = _q(y).cast("string"), _q(pred).cast("string")
    cells = df.groupBy(a.alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    labels = (cells.select(F.col("actual").alias("label")).union(cells.select("predicted")).where("label is not null")
              .agg(F.array_sort(F.collect_set("label")).alias("labels")))  # the class names, once each
    grid = (labels.select(F.explode("labels").alias("actual"), "labels")
            .select("actual", F.explode("labels").alias("predicted")))
    return grid.join(cells, ["actual", "predicted"], "left") \
               .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class(df: DataFrame, y: str, pred: str) -> DataFrame:
    """M6: ``label, precision, recall, f1, support``; empty denominators give 0."""
    cm = confusion(df, y, pred)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"),
                                                                 F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    npred = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("npred"))
    j = tp.join(sup, "label").join(npred, "label")
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("label", prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                    f1.cast("double").alias("f1"), F.col("support").cast("long"))


def classification_metrics(df: DataFrame, y: str, pred: str, positive=None, score: str | None = None) -> DataFrame:
    """M3: ``metric, value`` rows: Accuracy, Precision, Recall, F1 (binary for
    ``positive``, else macro over the label union) and ROC-AUC when a score is
    given for a binary target."""
    spark = df.sparkSession
    acc = df.agg(F.avg((_q(y).cast("string") == _q(pred).cast("string")).cast("double")).alias("value")) \
            .select(F.lit("Accuracy").alias("metric"), "value")
    pc = per_class(df, y, pred)
    if positive is not None:
        sel = pc.where(F.col("label") == F.lit(str(positive)))
        prf = sel.select(F.explode(F.array(
            F.struct(F.lit("Precision").alias("metric"), F.col("precision").alias("value")),
            F.struct(F.lit("Recall").alias("metric"), F.col("recall").alias("value")),
            F.struct(F.lit("F1").alias("metric"), F.col("f1").alias("value")))).alias("s")).select("s.*")
    else:
        m = pc.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"))
        prf = m.select(F.explode(F.array(
            F.struct(F.lit("Precision").alias("metric"), F.col("p").alias("value")),
            F.struct(F.lit("Recall").alias("metric"), F.col("r").alias("value")),
            F.struct(F.lit("F1").alias("metric"), F.col("f").alias("value")))).alias("s")).select("s.*")
    out = acc.unionByName(prf)
    if score is not None and positive is not None:
        out = out.unionByName(roc_auc(df, y, score, positive).select(F.lit("ROC-AUC").alias("metric"),
                                                                      F.col("auc").alias("value")))
    del spark
    return out


def _score_counts(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    b = _binary(df, y, score, positive)
    return b.groupBy("s").agg(F.sum("y").cast("long").alias("pos"),
                              F.sum(1 - F.col("y")).cast("long").alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """ROC-AUC from midranks: (R_pos - P(P+1)/2) / (P N), ties counted half."""
    sc = _score_counts(df, y, score, positive).withColumn("t", F.col("pos") + F.col("neg"))
    r = prefix_sum(sc, "s", ["t"]).withColumn("mr", F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2.0)
    g = r.agg(F.sum(F.col("pos") * F.col("mr")).alias("R"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(((F.col("R") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N"))).alias("auc"))


def _curve_points(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """Per distinct score, descending: running tp / fp (inclusive), the running
    index ``i`` (1..m) and the totals P, N."""
    sc = shared(_score_counts(df, y, score, positive).withColumn("one", F.lit(1).cast("long")))
    c = prefix_sum(sc, "s", ["pos", "neg", "one"], descending=True)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("m"))
    return shared(attach_scalars(c, tot).select("s", "pos", "neg", F.col("cum_pos").alias("tp"),
                                                F.col("cum_neg").alias("fp"), F.col("cum_one").alias("i"),
                                                "P", "N", "m"))


def _thin_in_plan(curve: DataFrame, idx: str, m: int) -> DataFrame:
    """Keep rows whose 0-based index is a multiple of max(1, len // m); the
    length is a one-row aggregate of the same plan (no extra action)."""
    n = curve.agg(F.count(F.lit(1)).alias("_len"))
    step = F.greatest(F.lit(1), F.floor(F.col("_len") / m))
    return attach_scalars(curve, n).where((F.col(idx) % step) == 0).drop("_len")


def roc_curve(df: DataFrame, y: str, score: str, positive, thin_to: int | None = 40,
              drop_intermediate: bool = True) -> DataFrame:
    """M7: ``k, x (fpr), y (tpr)`` like scikit-learn ``roc_curve`` (a (0, 0) start,
    collinear points dropped), then thinned by stride to about ``thin_to`` points."""
    pts = _curve_points(df, y, score, positive)
    if drop_intermediate:
        prev = pts.select((F.col("i") + 1).alias("i"), F.col("tp").alias("tp_prev"), F.col("fp").alias("fp_prev"))
        nxt = pts.select((F.col("i") - 1).alias("i"), F.col("tp").alias("tp_next"), F.col("fp").alias("fp_next"))
        j = pts.join(prev, "i", "left").join(nxt, "i", "left")
        tp0, fp0 = F.coalesce("tp_prev", F.lit(0)), F.coalesce("fp_prev", F.lit(0))
        d2_tp = F.col("tp_next") - 2 * F.col("tp") + tp0
        d2_fp = F.col("fp_next") - 2 * F.col("fp") + fp0
        keep = (F.col("i") == 1) | F.col("tp_next").isNull() | (d2_tp != 0) | (d2_fp != 0)
        pts = j.where(keep).select(*pts.columns)
    start = pts.sparkSession.createDataFrame([(0.0, 0.0)], "x double, y double").withColumn("k", F.lit(0).cast("long"))
    kept = pts.withColumn("one", F.lit(1).cast("long"))
    kept = prefix_sum(kept, "i", ["one"]).select(
        F.col("cum_one").alias("k"), (F.col("fp") / F.col("N")).alias("x"), (F.col("tp") / F.col("P")).alias("y"))
    curve = shared(start.unionByName(kept))
    if thin_to:
        curve = _thin_in_plan(curve, "k", thin_to)
    return curve.select("k", "x", "y")


def pr_curve(df: DataFrame, y: str, score: str, positive, thin_to: int | None = 40) -> DataFrame:
    """M8: ``k, x (recall), y (precision)`` like scikit-learn (>= 1.3)
    ``precision_recall_curve``: every distinct threshold in increasing order,
    ending with the point (recall 0, precision 1); thinned by stride."""
    pts = _curve_points(df, y, score, positive)
    body = pts.select((F.col("m") - F.col("i")).cast("long").alias("k"), (F.col("tp") / F.col("P")).alias("x"),
                      F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("y"))
    last = pts.agg(F.max("m").cast("long").alias("k")).select("k", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    curve = shared(body.unionByName(last))
    if thin_to:
        curve = _thin_in_plan(curve, "k", thin_to)
    return curve


def average_precision(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision."""
    pts = _curve_points(df, y, score, positive)
    return pts.agg(F.sum(F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def calibration(df: DataFrame, y: str, score: str, positive, n_bins: int = 8) -> DataFrame:
    """M9: quantile-binned calibration ``bin, x (mean score), y (positive rate)``;
    inner edges are exact quantiles, bin = number of inner edges below the score."""
    b = _binary(df, y, score, positive)
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = sorted(r["q"] for r in exact_quantiles(b, "s", probs).collect())
    arr = F.array(*[F.lit(float(e)) for e in edges])
    binned = b.withColumn("bin", F.size(F.filter(arr, lambda e: e < F.col("s"))))
    return binned.groupBy("bin").agg(F.avg("s").alias("x"), F.avg("y").alias("y"))


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """M4: ``metric, value`` rows: R2, RMSE, MAE, MAPE (%, rows with |y| < 1e-9 skipped)."""
    yy, pp = _q(y).cast("double"), _q(pred).cast("double")
    g = df.agg(F.count(F.lit(1)).alias("n"), F.var_pop(yy).alias("vy"), F.avg((yy - pp) ** 2).alias("mse"),
               F.avg(F.abs(yy - pp)).alias("mae"),
               F.avg(F.when(F.abs(yy) >= 1e-9, F.abs((yy - pp) / yy))).alias("mape"))
    return g.select(F.explode(F.array(
        F.struct(F.lit("R2").alias("metric"), (1 - F.col("mse") / F.col("vy")).alias("value")),
        F.struct(F.lit("RMSE").alias("metric"), F.sqrt("mse").alias("value")),
        F.struct(F.lit("MAE").alias("metric"), F.col("mae").alias("value")),
        F.struct(F.lit("MAPE").alias("metric"), (F.col("mape") * 100).alias("value")))).alias("s")).select("s.*")


def residual_sample(df: DataFrame, key_cols: list[str], y: str, pred: str, n: int = 200) -> DataFrame:
    """``actual, pred`` for a deterministic sample of ``n`` rows."""
    from tablelens.operators.sample import hash_sample_n
    return hash_sample_n(df, key_cols, n).select(*key_cols, _q(y).alias("actual"), _q(pred).alias("pred"))


def whatif_score(scenarios: DataFrame, key_cols: list[str], curves: DataFrame, baseline: float,
                 probability: bool = False) -> DataFrame:
    """Additive surrogate ``baseline + sum_f (interp_f(x_f) - baseline)``.

    ``curves``: ``feature, i, x, pred`` (a few points per feature);
    ``scenarios``: key columns plus one column per feature.  Linear
    interpolation inside the curve, clamped to the end values outside; the sum
    is clamped to 0..1 for probabilities.  The lookup is an equi-join on the
    feature name with a range filter on the segment (fan-out = points per curve)."""
    feats = [r[0] for r in curves.select("feature").distinct().collect()]
    long = scenarios.select(*key_cols, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                                      F.col(f"`{f}`").cast("double").alias("v"))
                                                             for f in feats])).alias("s")).select(*key_cols, "s.*")
    a = curves.select("feature", "i", F.col("x").alias("x0"), F.col("pred").alias("p0"))
    b = curves.select("feature", (F.col("i") - 1).alias("i"), F.col("x").alias("x1"), F.col("pred").alias("p1"))
    seg = a.join(b, ["feature", "i"])
    ends = curves.groupBy("feature").agg(F.min_by("pred", "i").alias("p_first"), F.min("x").alias("x_first"),
                                         F.max_by("pred", "i").alias("p_last"), F.max("x").alias("x_last"))
    seg = seg.join(ends, "feature")
    j = long.join(seg, "feature")
    inside = (F.col("v") >= F.col("x0")) & (F.col("v") <= F.col("x1"))
    span = F.col("x1") - F.col("x0")
    t = (F.col("v") - F.col("x0")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    val = (F.when(F.col("v") <= F.col("x_first"), F.col("p_first"))
            .when(F.col("v") >= F.col("x_last"), F.col("p_last"))
            .when(inside, F.col("p0") + t * (F.col("p1") - F.col("p0"))))
    per = j.withColumn("val", val).where(F.col("val").isNotNull()) \
           .groupBy(*key_cols, "feature").agg(F.min_by("val", "i").alias("val"))
    tot = per.groupBy(*key_cols).agg((F.lit(baseline) + F.sum(F.col("val") - F.lit(baseline))).alias("score"))
    if probability:
        tot = tot.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    return tot


# Verdict cut-offs (excellent, good, fair; below fair = weak) and labels.
VERDICT_CUTS = {"auc": (0.85, 0.72, 0.60), "lift": (0.20, 0.10, 0.03), "r2": (0.75, 0.50, 0.25),
                "silhouette": (0.50, 0.35, 0.20)}
VERDICT_LABELS = {"excellent": "Strong predictive signal", "good": "Solid predictive signal",
                  "fair": "Moderate signal", "weak": "Near-chance — weak signal"}
CLUSTER_LABELS = {"excellent": "Well-separated segments", "good": "Reasonably distinct segments",
                  "fair": "Overlapping segments", "weak": "Weak segmentation"}


def verdict(scores: DataFrame, kind: str, value_col: str = "value") -> DataFrame:
    """``level, label`` from a one-row score table.  ``kind``: ``auc``,
    ``lift`` (accuracy minus the majority share), ``r2`` or ``silhouette``."""
    hi, mid, lo = VERDICT_CUTS[kind]
    v = F.col(value_col)
    level = F.when(v >= hi, "excellent").when(v >= mid, "good").when(v >= lo, "fair").otherwise("weak")
    labels = CLUSTER_LABELS if kind == "silhouette" else VERDICT_LABELS
    lab = F.create_map(*[x for k, t in labels.items() for x in (F.lit(k), F.lit(t))])
    return scores.select(level.alias("level")).select("level", lab[F.col("level")].alias("label"))
