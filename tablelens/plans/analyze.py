"""One call per task: ``analyze(df, target, task) -> {result name: DataFrame}``.

The user-facing entry of the library, mirroring the reference's engine
signature (table + optional target + task name -> result tables).  It only
composes operators; every result is a lazy DataFrame except the few scalars
decisions need.  Optional results that fail degrade to absent keys (listed in
``skipped``) while the core results of each task always raise on error.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from tablelens.functions.scalars import finite_table, is_numeric_type
from tablelens.operators import agg as G
from tablelens.operators import charts as CH
from tablelens.operators import clean as C
from tablelens.operators import cluster as U
from tablelens.operators import evaluate as V
from tablelens.operators import model as M
from tablelens.operators import profile as P
from tablelens.operators import series as TS
from tablelens.operators import similar as SIM
from tablelens.operators import stats as S
from tablelens.operators import survival as SV
from tablelens.operators import text as TX
from tablelens.operators.features import standardize
from tablelens.operators.ranks import release_shared, shared_count
from tablelens.session import cut_lineage

TASKS = ("auto", "classification", "regression", "nlp", "clustering", "anomaly", "dimreduction",
         "timeseries", "survival", "recommendation")

log = logging.getLogger("tablelens")


class _Results(dict):
    def __init__(self):
        super().__init__()
        self.skipped: list[str] = []
        self._held = shared_count()

    def release(self) -> None:
        """Free what was persisted for these results, once they have been read."""
        release_shared(self._held)

    def optional(self, name: str, fn):
        try:
            self[name] = fn()
        except ValueError as exc:  # what operators raise where a result has no meaning; bugs are not caught
            log.warning("optional result %s skipped: %s", name, exc)
            self.skipped.append(name)


def analyze(df: DataFrame, target: str | None = None, task: str = "auto", key_cols: list[str] | None = None):
    """Run one analysis task.  ``key_cols`` identify rows (rows are numbered, and
    the numbered table is checkpointed, when absent).  Returns a dict of result DataFrames (plus ``task`` and
    ``fixes`` entries) with a ``skipped`` attribute naming optional results that
    could not be produced."""
    task = (task or "auto").lower()
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    df = finite_table(C.trim_column_names(df))
    if task == "clustering":
        return _clustering(df)
    if task == "anomaly":
        return _anomaly(df, key_cols)
    if task == "dimreduction":
        return _pca(df, target, key_cols)
    if task == "timeseries":
        return _timeseries(df, target)
    if task == "survival":
        return _survival(df, target)
    if task == "recommendation":
        return _recommend(df, key_cols)
    return _supervised(df, target, task, key_cols)


def _keyed(df: DataFrame, key_cols: list[str] | None) -> tuple[DataFrame, list[str]]:
    if key_cols:
        return df, key_cols
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id())), ["_row"]


# ------------------------------------------------------------------ supervised

def _supervised(df: DataFrame, target: str | None, task: str, key_cols: list[str] | None):
    r = _Results()
    target = (target or "").strip() or C.auto_target(df)
    if target not in df.columns:
        M.check_preconditions(df, target, task)
    df, key_cols = _keyed(df, key_cols)
    prep = M.prepare_supervised(df, target, task, key_cols)
    df = df.drop("_row")
    r["task"], r["fixes"] = ("classification" if prep.is_classification else "regression"), prep.log
    data = prep.data
    table, best = M.model_search(prep)
    r["model_compare"] = table
    test = data.where(col("split") == "test")
    pred = best.transform(test)
    if prep.is_classification:
        from pyspark.ml.functions import vector_to_array
        scored = pred.select("_key", "label", "prediction", vector_to_array("probability").alias("proba"))
        pos = 1.0 if prep.binary else None
        if prep.binary:
            scored = scored.withColumn("p", col("proba")[1])
        r["metrics"] = V.classification_metrics(scored, "label", "prediction", pos, "p" if prep.binary else None)
        r["confusion"] = V.confusion(scored, "label", "prediction")
        r["per_class"] = V.per_class(scored, "label", "prediction")
        if prep.binary:
            r.optional("roc", lambda: V.roc_curve(scored, "label", "p", 1.0))
            r.optional("pr", lambda: V.pr_curve(scored, "label", "p", 1.0))
            r.optional("calibration", lambda: V.calibration(scored, "label", "p", 1.0))
    else:
        r["metrics"] = V.regression_metrics(pred, "label", "prediction")
        r.optional("residuals", lambda: V.residual_sample(pred, ["_key"], "label", "prediction"))
    r.optional("verdict", lambda: _verdict(prep, r["metrics"], df, target))
    est = type(best)  # a fresh estimator of the selected family for CV / learning curve
    r.optional("cv", lambda: M.cross_validate(prep, _fresh(best, est)))
    r.optional("learning", lambda: M.learning_curve(prep, _fresh(best, est)))
    r.optional("importance", lambda: M.importance(prep, best))
    if not prep.is_classification or prep.binary:
        r.optional("whatif", lambda: M.partial_dependence(prep, best))
    raw = df.where(F.col(f"`{target}`").isNotNull())
    drivers = [x["label"] for x in r["importance"].collect() if x["label"] in df.columns] if "importance" in r else []
    r.optional("statistics", lambda: S.statistics(raw, target, prep.is_classification, ranked=drivers))
    r.optional("profile", lambda: P.profile_columns(df, target))
    r.optional("quality", lambda: P.quality_score(df))
    numeric = lambda cs: [c for c in cs if c in df.columns and c != target and is_numeric_type(df.schema[c].dataType)]
    rest = numeric(prep.shown.get(f, f) for f in prep.features)
    num = numeric(drivers) + [c for c in rest if c not in drivers]  # the strongest drivers of the target first
    if len(num) >= 2:
        r.optional("corr", lambda: S.corr_pairs(df, num[:6]))
    if num:
        r.optional("hist", lambda: G.histogram(df, num[0], 8))
        r.optional("box", lambda: G.box_summary(df, num[0], target if prep.is_classification else None))
    if prep.is_classification and prep.binary:
        pos_label = prep.classes[1]
        few = {c for c, k in C.distinct_counts(df, [c for c in df.columns if c != target], upto=8).items() if k <= 8}
        seg = next((c for c in [*drivers, *df.columns] if c in few), None)
        if seg:
            r.optional("segments", lambda: G.segment_rate(df, seg, target, pos_label))
    elif num:
        r.optional("segments", lambda: G.quartile_means(df, num[0], target))
    rates = prep.is_classification and prep.binary and "segments" in r
    r.optional("findings", lambda: P.quality_findings(
        df, target if prep.is_classification else None, prep.classes[1] if rates else None, r.get("corr"),
        r.get("importance"), r["segments"] if rates else None))
    r.optional("headline", lambda: G.headline_stats(df, target, prep.is_classification))
    if prep.is_classification:
        r.optional("imbalance", lambda: _imbalance(df, target, prep))
    if prep.text_col and df.where(F.col(f"`{prep.text_col}`").isNotNull()).limit(10).count() == 10:
        keyed = df.select(F.lit(0).alias("_doc"), F.col(f"`{prep.text_col}`").alias("_text"))
        r.optional("tfidf_terms", lambda: TX.tfidf_top_terms(keyed, "_doc", "_text"))
        r.optional("keywords", lambda: TX.keywords(keyed, "_doc", "_text"))
        r.optional("sentiment", lambda: TX.sentiment(keyed, "_text"))
        r.optional("topics", lambda: TX.lda_topics(keyed, "_doc", "_text"))
    return r


def _imbalance(df: DataFrame, target: str, prep) -> DataFrame:
    """G10 with D6: class distribution, and the training rows of each class before and after oversampling."""
    rows = [(c, prep.imbalance["before"].get(c, 0), prep.imbalance["after"].get(c, 0)) for c in prep.classes]
    trained = df.sparkSession.createDataFrame(rows, "label string, train_before long, train_after long")
    return G.class_distribution(df, target).join(trained, "label")


def _verdict(prep, metrics: DataFrame, df: DataFrame, target: str) -> DataFrame:
    """P6 on the headline metric: ROC-AUC (binary), accuracy lift over the
    majority share (multiclass) or R^2."""
    from tablelens.operators.ranks import attach_scalars
    if prep.binary:
        return V.verdict(metrics.where(col("metric") == "ROC-AUC"), "auc")
    if prep.is_classification:
        acc = metrics.where(col("metric") == "Accuracy").select(col("value").alias("acc"))
        maj = G.class_distribution(df, target).agg(F.max("share").alias("maj"))
        return V.verdict(attach_scalars(acc, maj).select((col("acc") - col("maj")).alias("value")), "lift")
    return V.verdict(metrics.where(col("metric") == "R2"), "r2")


def _fresh(model, _est):
    """A new, unfitted estimator with the fitted model's parameters."""
    from tablelens.operators.extratrees import ExtraTreesModel
    from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                           LogisticRegressionModel, RandomForestClassificationModel,
                                           RandomForestClassifier)
    from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                       RandomForestRegressionModel, RandomForestRegressor)
    pairs = {LogisticRegressionModel: LogisticRegression, RandomForestClassificationModel: RandomForestClassifier,
             GBTClassificationModel: GBTClassifier, LinearRegressionModel: LinearRegression,
             RandomForestRegressionModel: RandomForestRegressor, GBTRegressionModel: GBTRegressor}
    if isinstance(model, ExtraTreesModel):
        return model.estimator
    est = pairs[type(model)]()
    keep = {p.name for p in est.params}
    return est.setParams(**{p.name: v for p, v in model.extractParamMap().items()
                            if p.name in keep and p.name not in ("featuresCol", "labelCol", "predictionCol",
                                                                  "probabilityCol", "rawPredictionCol")})


# ---------------------------------------------------------------- unsupervised

def _clustering(df: DataFrame):
    r = _Results()
    m = C.numeric_matrix(df)
    cols = m.columns
    scores, _, labelled = U.kmeans_select(m, cols)
    r["task"], r["silhouette"] = "clustering", scores
    r["segments"] = U.segment_sizes(labelled)
    r["verdict"] = V.verdict(U.euclidean_silhouette(labelled, cols), "silhouette")
    r["dimensions"] = U.defining_dimensions(labelled, cols)
    return r


def _anomaly(df: DataFrame, key_cols):
    r = _Results()
    keyed, kc = _keyed(df, key_cols)
    m = C.numeric_matrix(keyed, keep=kc)
    cols = [c for c in m.columns if c not in kc]
    if not cols:
        raise ValueError("no column can be scored for outliers")
    flags = cut_lineage(U.isolation_forest(m, kc, cols))  # read by every result below
    r["task"], r["scores"] = "anomaly", flags
    r["rate"] = U.anomaly_rate(flags)
    r.optional("drivers", lambda: U.anomaly_drivers(flags, cols))
    if len(cols) > 1:
        pair = flags.select(*kc, F.col("scaled")[0].alias("fx"), F.col("scaled")[1].alias("fy"), "flag")
        r.optional("scatter", lambda: CH.score_scatter(pair, kc, "fx", "fy", "flag", 160))
    r.optional("score_hist", lambda: G.histogram(flags, "score", 8))
    return r


def _pca(df: DataFrame, target, key_cols):
    r = _Results()
    keyed, kc = _keyed(df, key_cols)
    m = C.numeric_matrix(keyed, drop=target, keep=kc)
    cols = [c for c in m.columns if c not in kc]
    var, load, proj = U.pca(m, kc, cols)
    r["task"], r["variance"], r["loadings"], r["projection"] = "dimreduction", var, load, proj
    r.optional("scatter", lambda: CH.score_scatter(proj.withColumn("c", F.lit(0)), kc, "pc1", "pc2", "c", 180))
    return r


def _timeseries(df: DataFrame, target):
    r = _Results()
    value, date = TS.pick_columns(df, target)
    if date is None:
        t = F.monotonically_increasing_id()  # file order, as the reference uses row order
    elif df.schema[date].dataType.simpleString() == "string":
        t = C.parse_datetime_text(col(f"`{date}`"))
    else:
        t = col(f"`{date}`")
    series = df.select(F.lit("series").alias("series"), t.alias("t"),
                       col(f"`{value}`").cast("double").alias("y")).where(col("y").isNotNull() & col("t").isNotNull())
    # one point for each time, so that the series is as long as its time range and not as the table
    series = series.groupBy("series", "t").agg(F.avg("y").alias("y"))
    if series.limit(12).count() < 12:
        raise ValueError("a forecast takes 12 points in time, at least")
    r["task"] = "timeseries"
    r["forecast"] = TS.holt_winters(series, ["series"], "t", "y")
    r["plan"] = TS.series_plan(series, ["series"])
    return r


def _survival(df: DataFrame, target):
    r = _Results()
    event, duration = SV.choose_columns(df, target)
    tf = SV.survival_frame(df, duration, event)
    if tf.limit(10).count() < 10:
        raise ValueError("a survival curve takes 10 rows, at least")
    curve = SV.kaplan_meier(tf)
    r["task"], r["km"] = "survival", SV.km_thinned(curve)
    r["median"], r["event_rate"] = SV.km_median(curve), SV.event_rate(tf)
    timed = SV.with_survival(df, duration, event)
    feats = C.numeric_matrix(timed.drop(event, duration), keep=["_T", "_E"])  # imputed and encoded covariates
    counts = C.distinct_counts(feats, [c for c in feats.columns if c not in ("_T", "_E")], upto=1)
    cols = [c for c, k in counts.items() if k > 1]
    if len(cols) > 1 and tf.limit(41).count() > 40:
        r.optional("hazards", lambda: SV.hazard_bars(SV.cox_ph(feats, "_T", "_E", cols)))
    return r


def _recommend(df: DataFrame, key_cols):
    """U16: neighbours of every row by its numbers, shown by name: the key column
    if one is given, else the first text column, else the row's number."""
    r = _Results()
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    texts = [c for c in df.columns if not is_numeric_type(df.schema[c].dataType)]
    name = (key_cols or texts or ["_row"])[0]
    m = C.numeric_matrix(rows.drop(name) if name != "_row" else rows, keep=["_row"])
    cols = [c for c in m.columns if c != "_row"]
    if not cols:
        raise ValueError("items have no numbers to be compared by")
    near = SIM.similar_items(standardize(m, cols), "_row", cols, k=5)
    names = rows.select(F.col("_row").alias("_id"), F.col(f"`{name}`").cast("string").alias("_name"))
    named = near
    for c in ("item", "similar"):
        named = (named.join(names, F.col(c) == F.col("_id")).withColumn(f"{c}_row", F.col(c)).withColumn(c, F.col("_name"))
                 .drop("_id", "_name"))
    r["task"] = "recommendation"
    r["similar"] = named.select("item", "similar", "score", "rank", "item_row", "similar_row")
    r.optional("spread", lambda: C.variance_table(m, cols))
    return r


__all__ = ["analyze", "TASKS"]
