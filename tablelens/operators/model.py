"""Supervised modelling (M1, M2, M10, M11, M13, M14, M16) on MLlib.

The reference searches boosted-tree libraries under a wall-clock budget; here
a fixed, deterministic grid of candidates (MLlib's, and extremely randomised
trees) is fitted on all of the hash-split training rows and scored on the
held-out rows.  Feature
preparation follows the reference's order (clean -> dates -> impute/encode ->
engineered features -> width cap) with every statistic computed by Spark.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.scalars import finite_table, hash_unit, is_datetime_type, is_numeric_type, is_string_type
from tablelens.operators import clean as C
from tablelens.operators import evaluate as V
from tablelens.operators import features as X
from tablelens.operators import text as TX
from tablelens.operators.extratrees import ExtraTrees
from tablelens.operators.ranks import exact_quantiles, medians, release_shared, shared_count
from tablelens.operators.sample import kfold, random_split, stratified_split
from tablelens.session import cut_lineage


def _q(c: str):
    return F.col(f"`{c}`")


# Columns of the prepared table and of predictions; features so named are renamed inside.
RESERVED = ["_key", "label", "split", "features", "feature", "x", "fold", "prediction", "probability",
            "rawPrediction", "tfidf"]
#: Classes of a target, at most; a target with more is an id or a number.
MOST_CLASSES = 1000


@dataclass
class Prepared:
    data: DataFrame                 # _key, label, features (vector), split, + raw feature columns
    features: list[str]             # names of the raw feature columns in data
    is_classification: bool
    classes: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    shown: dict = field(default_factory=dict)           # feature -> the user's column name
    terms: list[str] = field(default_factory=list)      # vocabulary of the TF-IDF part of the feature vector
    text_col: str | None = None                         # the column that the vocabulary is of
    imbalance: dict | None = None                       # class counts before and after oversampling

    @property
    def names(self) -> list[str]:
        """What each place of the feature vector stands for."""
        return [self.shown.get(f, f) for f in self.features] + self.terms

    @property
    def binary(self) -> bool:
        return self.is_classification and len(self.classes) == 2


def row_key(df: DataFrame) -> F.Column:
    """Deterministic content key for tables without one."""
    return F.xxhash64(*[_q(c) for c in df.columns])


def check_preconditions(df: DataFrame, target: str | None, task: str) -> None:
    """Refuse inputs the task cannot use (raises ``ValueError``)."""
    if task in ("classification", "regression", "auto", "nlp"):
        if not target or target not in df.columns:
            raise ValueError(f"no column is named {target!r}; the table has " + ", ".join(df.columns[:12]))
        usable = C.finite_target(df, target) if task == "regression" else C.drop_missing_target(df, target)
        if usable.limit(8).count() < 8:
            raise ValueError("a model needs 8 rows with a target, at least")


def longest_text(df: DataFrame, exclude: list[str]) -> tuple[str | None, list[str]]:
    """The high-cardinality text column with the longest texts, and all such columns."""
    found = sorted(C.high_card_text(df.drop(*exclude)).collect(), key=lambda r: (-(r["mean_len"] or 0.0), r["column_name"]))
    names = [r["column_name"] for r in found]
    return (names[0] if names else None), names


def prepare_supervised(df: DataFrame, target: str | None = None, task: str = "auto",
                       key_cols: list[str] | None = None, max_features: int | None = None,
                       engineer: bool = True, vocab_size: int = 300, balance: bool = True) -> Prepared:
    """Clean, encode, split and assemble a table for supervised models.

    In an NLP task (or where text is the only signal) the longest high-cardinality
    text becomes TF-IDF features; in others such columns are dropped.  ``balance``
    oversamples a rare class among the training rows (D5).  ``max_features``
    keeps that many columns of the highest variance."""
    log: list[str] = []
    held = shared_count()
    df = finite_table(C.trim_column_names(df))
    target = (target or "").strip() or C.auto_target(df)
    check_preconditions(df, target, task)
    key = F.concat_ws("#", *[_q(k).cast("string") for k in key_cols]) if key_cols else row_key(df).cast("string")
    df = df.withColumn("_key", key)
    st = C.numeric_text_stats(df.drop("_key"), [target])
    coerce = {r["column_name"] for r in st.where((F.col("valid") >= 0.8 * F.col("n")) & (F.col("valid") > 0))
              .collect()}
    work = df.select("_key", *[(C.to_number(_q(c)).alias(c) if c in coerce else _q(c))
                               for c in df.columns if c != "_key"])
    ids = [] if task == "nlp" else C.id_like_columns(work.drop("_key"), target)
    if key_cols:
        ids = sorted(set(ids) | set(key_cols) - {target})
    work = work.drop(*ids)
    if ids:
        log.append("dropped identifier column(s): " + ", ".join(ids))
    work = C.drop_missing_target(work, target)
    is_clf = (task == "classification") or (task in ("auto", "nlp") and C.task_kind(work, target) == "classification")
    feats = [c for c in work.columns if c not in ("_key", target)]
    text_col, hc = longest_text(work, ["_key", target])
    if not (hc and (task == "nlp" or set(feats) <= set(hc))):
        text_col = None
    if text_col is not None:
        log.append(f"text column {text_col!r} as TF-IDF features")
    dropped = sorted(c for c in hc if c != text_col)
    if dropped:
        log.append("dropped high-cardinality text column(s): " + ", ".join(dropped))
    work = work.drop(*dropped)
    if text_col is not None:
        work = work.withColumnRenamed(text_col, "__text")
    feats = [c for c in feats if c not in hc]
    shown = {f"{c}__": c for c in feats if c in RESERVED}
    work = work.withColumnsRenamed({c: safe for safe, c in shown.items()})
    feats = [f"{c}__" if c in RESERVED else c for c in feats]
    passed = ["_key", *(["__text"] if text_col is not None else [])]
    dates = [c for c in feats if is_datetime_type(work.schema[c].dataType)]
    dates += C.date_like_columns(work.select(*[c for c in feats if c not in dates]))
    if dates:
        work = C.date_parts(work, dates)
    feats = [c for c in work.columns if c not in (*passed, target)]
    text = [c for c in feats if is_string_type(work.schema[c].dataType)]
    other = [c for c in feats if c not in text and not is_numeric_type(work.schema[c].dataType)]
    work = work.drop(*other)
    feats = [c for c in feats if c not in other]
    # read by the medians, the engineered features and the split: dates are parsed and texts encoded once
    encoded = work = C.label_encode(work, text).persist()
    num = [c for c in feats if c not in text]
    med = medians(work, num)
    work = work.select(*passed, _q(target), *[F.coalesce(_q(c).cast("double"), F.lit(med.get(c)), F.lit(0.0)).alias(c)
                                               if c in num else _q(c).cast("double").alias(c) for c in feats])
    if engineer and feats and text_col is None:
        before = set(work.columns)
        work = X.log_features(work, [c for c in feats if c in num])
        work = X.interaction_feature(work, feats)
        new = [c for c in work.columns if c not in before]
        feats += new
        if new:
            log.append("engineered features: " + ", ".join(new))
    if max_features and len(feats) > max_features:
        v = C.variances(work, feats)
        feats = sorted(feats, key=lambda c: (-v[c], feats.index(c)))[:max_features]
    classes: list[str] = []
    if is_clf:
        counts = work.groupBy(_q(target).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1)
        sizes = {r["c"]: r["n"] for r in counts.collect()}  # a row per class
        if len(sizes) > MOST_CLASSES:
            raise ValueError(f"the target has over {MOST_CLASSES} classes")
        classes = sorted(sizes)
        idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        work = work.withColumn("label", idx[_q(target).cast("string")])
        share = test_share(sum(sizes.values()), len(classes))
        split = (stratified_split(work, "label", ["_key"], share) if min(sizes.values()) >= 2
                 else random_split(work, ["_key"], share))
    else:
        work = C.finite_target(work, target).withColumn("label", _q(target).cast("double"))
        split = random_split(work, ["_key"])
    inputs, terms = list(feats), []
    if text_col is not None:
        split, terms = TX.tfidf_vectors(split, "__text", vocab_size)
        inputs.append("tfidf")
    # The prepared table is read by every fit, fold and diagnostic: write it once to
    # the shared checkpoint folder, which also cuts the (deep) preparation lineage.
    data = cut_lineage(split.select("_key", "label", "split", *(["tfidf"] if terms else []), *[_q(c) for c in feats]))
    encoded.unpersist()
    release_shared(held)
    imbalance = None
    if is_clf:
        data, imbalance = balanced(data, feats, classes, balance and not terms)
        if imbalance["applied"]:
            log.append("oversampled the rarest class of the training rows (SMOTE)")
    data = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(data)
    return Prepared(data, feats, is_clf, classes, log, shown, terms, text_col, imbalance)


def test_share(rows: int, classes: int) -> float:
    """A fifth for the test, more where that would not hold a row of each class."""
    return 0.2 if int(rows * 0.2) >= classes else min(0.4, classes / max(rows, 1) + 0.05)


def balanced(data: DataFrame, feats: list[str], classes: list[str], oversample: bool) -> tuple[DataFrame, dict]:
    """Training rows with the rarest class oversampled where it is rare; counts before and after by class name."""
    from tablelens.operators.oversample import smote
    train = data.where(F.col("split") == "train")
    name = lambda counts: {classes[int(k)]: int(v) for k, v in counts.items()}
    if not (oversample and feats):
        counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}  # a row per class
        return data, {"applied": False, "before": name(counts), "after": name(counts)}
    held = shared_count()
    rows, info = smote(train, "label", feats, "_key")
    out = {"applied": info["applied"], "minority_share": info["minority_share"], "before": name(info["before"]),
           "after": name(info["after"])}
    if info["applied"]:
        columns = [F.col("_key").cast("string").alias("_key"), "label", F.lit("train").alias("split"), *[_q(c) for c in feats]]
        # only what was made is written: the rows that were there are
        made = cut_lineage(rows.where("synthetic = 1").select(*columns))
        release_shared(held)
        data = data.where(F.col("split") != "train").select(*made.columns).unionByName(
            rows.where("synthetic = 0").select(*columns)).unionByName(made)
    return data, out


# ------------------------------------------------------------------ search

def candidates(prep: Prepared, seed: int = 42) -> dict:
    """M1 grid: a fixed, deterministic list of estimators."""
    if prep.is_classification:
        c = {"Logistic Regression (L2)": LogisticRegression(maxIter=100, regParam=0.01),
             "Logistic Regression (L1)": LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=1.0),
             "Random Forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed)}
        if prep.binary:
            c["Gradient-Boosted Trees"] = GBTClassifier(maxIter=30, maxDepth=5, seed=seed)
        return c | {"Extra Trees": ExtraTrees(len(prep.classes), seed=seed)}
    return {"Elastic Net": LinearRegression(maxIter=100, regParam=0.01, elasticNetParam=0.5),
            "Random Forest": RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed),
            "Gradient-Boosted Trees": GBTRegressor(maxIter=30, maxDepth=5, seed=seed),
            "Extra Trees": ExtraTrees(0, seed=seed)}


def baselines(prep: Prepared, seed: int = 42) -> dict:
    """M2 baselines."""
    if prep.is_classification:
        return {"Logistic Regression": LogisticRegression(maxIter=300),
                "Random Forest": RandomForestClassifier(numTrees=120, seed=seed),
                "Naive Bayes": NaiveBayes(modelType="gaussian")}
    return {"Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
            "Random Forest": RandomForestRegressor(numTrees=120, seed=seed)}


def score_predictions(prep: Prepared, pred: DataFrame) -> tuple[str, float]:
    """Headline metric on predictions: ROC-AUC (binary), accuracy, or R^2."""
    if prep.is_classification:
        if prep.binary:
            p = pred.select("label", vector_to_array("probability")[1].alias("p"))
            return "ROC-AUC", float(V.roc_auc(p, "label", "p", 1.0).first()["auc"])
        return "Accuracy", float(pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
    m = V.regression_metrics(pred, "label", "prediction").where(F.col("metric") == "R2").first()["value"]
    return "R2", float(m)


def fit_and_score(prep: Prepared, estimators: dict, train: DataFrame | None = None,
                  test: DataFrame | None = None) -> list[dict]:
    train = train if train is not None else prep.data.where(F.col("split") == "train")
    test = test if test is not None else prep.data.where(F.col("split") == "test")

    def one(item):
        name, est = item
        model = est.fit(train)
        metric, value = score_predictions(prep, model.transform(test))
        return {"model": name, "score": value, "metric": metric, "fitted": model}
    return together(one, estimators.items())


#: Fits that run side by side; they are many small jobs that leave executors idle one at a time.  Each keeps its rows while
#: it lasts, so fits of many rows, whose tasks leave no executor idle, run side by side only up to as many numbers.
AT_ONCE, FIT_NUMBERS = 4, 1 << 26


def together(fn, items, at_once: int = AT_ONCE) -> list:
    """Results of ``fn`` for all items, in order; independent Spark jobs overlap."""
    with ThreadPoolExecutor(max(1, min(at_once, AT_ONCE))) as pool:
        return list(pool.map(fn, items))


#: None, or training rows of the smallest sample of a search by halving, at least: an option that a caller sets.  The
#: shares are those of the training rows that it goes through.
RUNG_ROWS, RUNG_SHARES = None, (1 / 9, 1 / 3, 1.0)


def model_search(prep: Prepared, seed: int = 42) -> tuple[DataFrame, object]:
    """M1: ``model, score, metric, best, share`` and the best fitted model.

    All candidates are fitted on all training rows and scored on all test rows, whatever the table's size.  ``share``: of
    the training rows in a model's last fit, 1 unless ``RUNG_ROWS`` is set.  Then all are fitted on a sample of the training
    rows, the better half goes on to a sample three times as large that holds the first, and the rest to all rows, on which
    the best is chosen; samples under ``RUNG_ROWS`` rows are passed over."""
    data = prep.data.withColumn("_u", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(2 ** 31)) / F.lit(2.0 ** 31)).cache()
    try:
        train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
        left, last = candidates(prep), {}
        order, n = list(left), train.count() if RUNG_ROWS else 0
        for share in (s for s in RUNG_SHARES if s == 1.0 or RUNG_ROWS and s * n >= RUNG_ROWS):
            res = fit_and_score(prep, left, train if share == 1.0 else train.where(F.col("_u") < share), test)
            res.sort(key=lambda r: (-r["score"], order.index(r["model"])))
            last |= {r["model"]: r | {"share": share} for r in res}
            left = {r["model"]: left[r["model"]] for r in res[:-(-len(res) // 2)]}
    finally:
        data.unpersist()
    rows = [(m, last[m]["score"], last[m]["metric"], m == res[0]["model"], last[m]["share"]) for m in order]
    table = prep.data.sparkSession.createDataFrame(rows, "model string, score double, metric string, best boolean, share double")
    return table, res[0]["fitted"]


def model_compare(prep: Prepared, best_name: str, best_score: float) -> DataFrame:
    """M2: baselines on the same held-out rows plus the selected model."""
    res = fit_and_score(prep, baselines(prep))
    if res:
        res.append({"model": "K-Nearest Neighbors", "metric": res[0]["metric"],
                    "score": score_predictions(prep, nearest_neighbours(prep))[1]})
    metric = res[0]["metric"] if res else ("ROC-AUC" if prep.is_classification else "R2")
    rows = [(r["model"], r["score"], r["metric"], False) for r in res]
    rows.append((f"{best_name} (auto-selected)", best_score, metric, True))
    return prep.data.sparkSession.createDataFrame(rows, "model string, score double, metric string, best boolean") \
               .orderBy(F.desc("score"))


def cross_validate(prep: Prepared, estimator, k: int | None = None) -> DataFrame:
    """K-fold CV on the training rows (stratified folds for classes):
    ``k, metric, mean, std`` (population std) and ``scores``."""
    train = prep.data.where(F.col("split") == "train")
    n, wide = train.count(), max(1, len(prep.names))
    k = k or (5 if n >= 250 else 3)
    held = shared_count()
    folded = cut_lineage(kfold(train.select("_key", "label", "features"), ["_key"], k,
                               label="label" if prep.is_classification else None, n_rows=n).select("label", "features", "fold"))
    release_shared(held)

    def one(f):
        model = estimator.fit(folded.where(F.col("fold") != f))
        return score_predictions(prep, model.transform(folded.where(F.col("fold") == f)))
    found = together(one, range(k), FIT_NUMBERS // (n * wide + 1))
    metric, scores = found[0][0], [v for _, v in found]
    import statistics as st
    row = (k, metric, float(st.fmean(scores)), float(st.pstdev(scores)), scores)
    return prep.data.sparkSession.createDataFrame([row], "k int, metric string, mean double, std double, "
                                                         "scores array<double>")


def learning_curve(prep: Prepared, estimator, sizes=(0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 3) -> DataFrame:
    """For each share of the training rows, mean train and validation score
    over ``folds`` folds; nested hash thresholds keep smaller sets inside larger."""
    train = prep.data.where(F.col("split") == "train").withColumn("_u", hash_unit(["_key"], 7))
    folded = kfold(train, ["_key"], folds, seed=43).cache()

    def one(part):
        s, f = part
        fit_rows = folded.where((F.col("fold") != f) & (F.col("_u") < s))
        model = estimator.fit(fit_rows)
        return (score_predictions(prep, model.transform(fit_rows))[1],
                score_predictions(prep, model.transform(folded.where(F.col("fold") == f)))[1])
    try:
        found = dict(zip(parts := [(s, f) for s in sizes for f in range(folds)], together(one, parts)))
        counts = folded.where(F.col("fold") != 0).agg(*[F.count(F.when(F.col("_u") < s, 1)) for s in sizes]).first()
    finally:
        folded.unpersist()
    mean = lambda s, i: sum(found[s, f][i] for f in range(folds)) / folds
    rows = [(int(n), mean(s, 0), mean(s, 1)) for s, n in zip(sizes, counts)]
    return prep.data.sparkSession.createDataFrame(rows, "n long, train double, val double")


#: Scores that a block of permuted rows has, about, and training rows that neighbours are looked for among, at most.
BLOCK_SCORES = 4_000_000


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Features, labels and keys of ``n`` rows by hash of the key: bounded, and read on the driver."""
    from tablelens.operators.sample import hash_sample_n
    got = hash_sample_n(rows.select("_key", "label", "features"), ["_key"], n).collect()
    x = np.array([r["features"].toArray() for r in got]) if got else np.zeros((0, 0))
    return x, np.array([r["label"] for r in got]), [r["_key"] for r in got]


def nearest_neighbours(prep: Prepared, k: int = 5) -> DataFrame:
    """M2: predictions of the test rows by their ``k`` nearest of all training rows."""
    from tablelens.operators.neighbours import proven_topk
    rows = cut_lineage(prep.data.select(F.monotonically_increasing_id().alias("row"), "label", "split",
                                        vector_to_array("features").alias("payload")))
    test, train = rows.where(F.col("split") == "test"), rows.where(F.col("split") == "train")
    near = proven_topk(test.select(F.col("row").alias("qid"), "payload"), train.select(F.col("row").alias("did"), "payload"),
                       k, "euclidean")
    votes = near.join(train.select(F.col("row").alias("did"), F.col("label").alias("vote")), "did").groupBy("qid")
    if not prep.is_classification:
        told = votes.agg(F.avg("vote").alias("prediction")).withColumn("p", F.array(F.lit(0.0)))
    else:
        told = votes.agg(*[F.avg((F.col("vote") == c).cast("double")).alias(f"c{c}") for c in range(len(prep.classes))])
        told = told.select("qid", F.array(*[f"c{c}" for c in range(len(prep.classes))]).alias("p"))
        told = told.withColumn("prediction", (F.array_position("p", F.array_max("p")) - 1).cast("double"))
    return (test.join(told, test.row == told.qid).select("label", "prediction", array_to_vector("p").alias("probability")))


#: Places between which the scores of rows of different blocks are told apart: shares of all scores, and as many beyond each end.
SCORE_BINS, OUTER_BINS = 4096, 1024


def _pairs_in_order(pos: np.ndarray, neg: np.ndarray) -> float:
    """(positive, negative) pairs with the positive above, from counts by rising score; equal ones count half."""
    return float((pos * (np.cumsum(neg) - neg / 2.0)).sum())


def permutation_importance(prep: Prepared, model, repeats: int = 4, seed: int = 42) -> np.ndarray:
    """Drop of a linear model's score on all test rows when one feature's values
    are permuted, mean over ``repeats``.

    Rows are dealt to tasks by a hash of their number (not of their values), and values are permuted inside blocks of
    bounded size, which are random parts of the rows.  Only sums leave a task: of accuracy and R2 as they are; for the
    ROC-AUC, the counts of positives and negatives by bins of the score for each permutation.  Pairs inside a block are
    counted exactly, so a table of one block has its exact AUC; of the pairs of different blocks only those in one
    bin, about one in ``SCORE_BINS``, count half, which bounds the error by half their share."""
    test = prep.data.where(F.col("split") == "test").select("label", vector_to_array("features").alias("x"))
    if prep.is_classification:
        coef, base = model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray())
    else:
        coef, base = model.coefficients.toArray()[None, :], np.array([model.intercept])
    used = np.flatnonzero((coef != 0).any(axis=0)).tolist()  # the score does not depend on the others
    out = np.zeros(coef.shape[1])
    n, var = test.agg(F.count(F.lit(1)), F.var_pop("label")).first()
    if not n or not used:
        return out
    is_clf, ranked = prep.is_classification, prep.is_classification and len(coef) == 1
    held = int(np.clip(BLOCK_SCORES // (len(used) * repeats), 256, 8192))
    tasks = min(-(-n // held), int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = test.withColumn("row", F.monotonically_increasing_id())
    tried = 1 + len(used) * repeats
    edges = np.zeros(0)
    if ranked and n > held:
        whole = F.aggregate(F.zip_with("x", F.array(*map(F.lit, coef[0].tolist())), lambda a, c: a * c), F.lit(float(base[0])), lambda s, t: s + t)
        marks = rows.agg(F.percentile_approx(whole, [i / SCORE_BINS for i in range(SCORE_BINS + 1)], 4 * SCORE_BINS)).first()[0]
        span = (marks[-1] - marks[0]) or 1.0
        beyond = span * np.arange(1, OUTER_BINS + 1) / OUTER_BINS
        edges = np.unique(np.r_[marks[0] - beyond, marks, marks[-1] + beyond])

    def blocks(batches):
        kept = pd.DataFrame()
        for pdf in batches:
            kept = pd.concat([kept, pdf], ignore_index=True) if len(kept) else pdf
            while len(kept) >= 2 * held:
                yield kept.iloc[:held]
                kept = kept.iloc[held:].reset_index(drop=True)
        for part in np.array_split(np.arange(len(kept)), max(1, round(len(kept) / held))):
            yield kept.iloc[part]

    def scored(batches):
        counts = np.zeros((tried, 2, len(edges) + 1), np.int64)
        exact, draw = np.zeros(tried), np.random.default_rng([seed, TaskContext.get().partitionId()])
        for block in blocks(batches):
            if not len(block):
                continue
            x, y = np.array(block["x"].tolist(), dtype=float), block["label"].to_numpy()
            logits = x @ coef.T + base
            moves = [(None, 0), *((j, r) for j in used for r in range(repeats))]
            for which, (j, _) in enumerate(moves):
                got = logits if j is None else logits + np.outer(draw.permutation(x[:, j]) - x[:, j], coef[:, j])
                if not ranked:
                    exact[which] += (got.argmax(axis=1) == y).sum() if is_clf else -((got[:, 0] - y) ** 2).sum()
                    continue
                values, at = np.unique(got[:, 0], return_inverse=True)
                bins = np.searchsorted(edges, got[:, 0], side="right")
                own = np.stack([np.bincount(bins[y == c], minlength=len(edges) + 1) for c in (1, 0)])
                exact[which] += _pairs_in_order(*(np.bincount(at[y == c], minlength=len(values)) for c in (1, 0))) - _pairs_in_order(*own)
                counts[which] += own
        which, bins = np.nonzero(counts.sum(axis=1))
        yield pd.DataFrame({"which": np.r_[np.arange(tried), which], "bin": np.r_[np.full(tried, -1), bins], "s": np.r_[exact, np.zeros(len(which))],
                            "pos": np.r_[np.zeros(tried, np.int64), counts[which, 0, bins]],
                            "neg": np.r_[np.zeros(tried, np.int64), counts[which, 1, bins]]})
    sums = (rows.repartition(tasks, "row").sortWithinPartitions("row").mapInPandas(scored, "which int, bin int, s double, pos long, neg long")
            .groupBy("which", "bin").agg(*[F.sum(c).alias(c) for c in ("s", "pos", "neg")]))
    upto = F.sum("neg").over(Window.partitionBy("which").orderBy("bin"))  # a row per bin
    found = (sums.withColumn("pairs", F.col("s") + F.col("pos") * (upto - F.col("neg") / 2.0)).groupBy("which")
             .agg(F.sum("pairs").alias("s"), F.sum("pos").alias("p")).collect())  # a row per permutation
    scale = {True: lambda p: max(p * (n - p), 1), False: lambda p: n if is_clf else n * (var or 1.0)}[ranked]
    value = {r["which"]: r["s"] / scale(r["p"]) for r in found}
    for i, j in enumerate(used):
        out[j] = value[0] - np.mean([value[1 + i * repeats + r] for r in range(repeats)])
    return np.maximum(out, 0)


def importance(prep: Prepared, model, top: int = 6) -> DataFrame:
    """``label, value, sign`` — tree importances, or the permutation importance
    of linear models, scaled by the top one, floored at 0.04; sign from the
    correlation with the target (A4; 1 for terms of a text)."""
    if hasattr(model, "featureImportances"):
        imp = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix") or hasattr(model, "coefficients"):
        imp = permutation_importance(prep, model).tolist()
    else:
        raise ValueError("this model has neither importances nor coefficients")
    from tablelens.operators.stats import direction_signs
    signs = ({r["feature"]: r["sign"] for r in direction_signs(prep.data, prep.features, "label").collect()}
             if prep.features else {})
    order = sorted(range(len(imp)), key=lambda i: (-imp[i], i))[:top]
    mx = imp[order[0]] if order and imp[order[0]] > 0 else 1.0
    safe = prep.features + prep.terms
    rows = [(prep.names[i], float(max(0.04, min(1.0, imp[i] / mx))), int(signs.get(safe[i], 1))) for i in order]
    return prep.data.sparkSession.createDataFrame(rows, "label string, value double, sign int")


def partial_dependence(prep: Prepared, model, n_feats: int = 4, grid: int = 11) -> DataFrame:
    """For the ``n_feats`` highest-variance features, ``grid`` points from the
    5th to the 95th percentile with every other feature at its median, plus the
    all-median baseline.  ``feature, x, pred`` (feature NULL = baseline)."""
    if prep.terms or not prep.features:
        raise ValueError("partial dependence is of columns; the features are terms of a text")
    spark = prep.data.sparkSession
    med = medians(prep.data, prep.features)
    var = C.variances(prep.data, prep.features)
    top = sorted(prep.features, key=lambda c: (-var[c], prep.features.index(c)))[:n_feats]
    long = prep.data.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _q(c).alias("v")) for c in top]))
                            .alias("s")).select("s.k", "s.v")
    q = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(long, "v", [0.05, 0.95], ["k"]).collect()}
    rows = [(None, None, *[med[c] for c in prep.features])]
    for c in top:
        lo, hi = q[(c, 0.05)], q[(c, 0.95)]
        if hi <= lo:
            continue
        for i in range(grid):
            x = lo + (hi - lo) * i / (grid - 1)
            vals = [x if f == c else med[f] for f in prep.features]
            rows.append((c, x, *vals))
    schema = "feature string, x double, " + ", ".join(f"`{f}` double" for f in prep.features)
    g = spark.createDataFrame(rows, schema)
    g = VectorAssembler(inputCols=prep.features, outputCol="features").transform(g)
    p = model.transform(g)
    pred = vector_to_array("probability")[1] if prep.binary else F.col("prediction")
    names = F.create_map(*[F.lit(v) for f in prep.features for v in (f, prep.shown.get(f, f))])
    return p.select(names[F.col("feature")].alias("feature"), "x", pred.alias("pred"))
