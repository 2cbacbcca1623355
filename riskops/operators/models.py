"""Learning pipelines on Spark ML.

Everything trains and scores on the cluster: feature engineering lives inside
the ``PipelineModel`` (so the saved model and the scoring path cannot drift
apart), and evaluation goes through the exact DataFrame metrics of
:mod:`riskops.operators.evaluate`.  Only metric rows and model metadata reach
the driver.

Boosters of the reference (XGBoost / LightGBM / CatBoost) map to
``GBTClassifier``; parity of their numbers is not possible, so tests assert
"better than chance" and determinism by seed instead.
"""

from __future__ import annotations

import datetime as _dt
import math
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Imputer, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskops.functions.exprs import any_contains, spread, uniform
from riskops.operators import evaluate as E
from riskops.operators import trees
from riskops.operators.resample import class_weights, stratified_folds, stratified_split, with_class_weight
from riskops.operators.retrieval import CHUNK_SENTINEL, term_statistics
from riskops.session import scratch_path, written
from riskops.sources import commits


def _safe(name: str) -> str:
    return "f_" + "".join(ch if ch.isalnum() else "_" for ch in name)


def feature_stages(features: Sequence[str], scale: bool = False, impute: bool = True) -> list:
    """Median imputation, assembly and optional z-scaling.

    The in-pipeline median uses ``relativeError=1e-4``: a zero error makes the
    quantile summary keep every sample, which at cluster scale would gather a
    whole column on the driver.  (The summary returns a sample value within
    1e-4 of the median rank; on the 0-10 scales that is the median itself.  The
    standalone F1 operator computes the exact interpolated median.)
    """
    stages = []
    cols = list(features)
    safe = [_safe(c) for c in cols]
    stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS {s}" for c, s in zip(cols, safe)) + " FROM __THIS__"))
    if impute:
        stages.append(Imputer(inputCols=safe, outputCols=[s + "_i" for s in safe], strategy="median", relativeError=1e-4))
        safe = [s + "_i" for s in safe]
    stages.append(VectorAssembler(inputCols=safe, outputCol="features_raw" if scale else "features",
                                  handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return stages


#: Most rows of a partition that a learner works on (a forest keeps a row's draws for each of its trees beside it), and least that pay for a task.
TRAIN_ROWS, TASK_ROWS = 400_000, 1000


def dealt(df: DataFrame, anew: bool = True) -> DataFrame:
    """The rows in equal parts, one for each core at least: a table of a few short files is read by as few tasks otherwise.

    Without ``anew`` a frame that has as many parts keeps them; a frame too short to be dealt stays as it is.
    """
    n = df.count()
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS), -(-n // TRAIN_ROWS))
    if parts < 2:
        return df
    return df.repartition(parts) if anew else spread(df, parts)


def _fit(stages: list, t: DataFrame) -> PipelineModel:
    """Fit with the training frame dealt to all cores and persisted for the fit only: the weight sum, the imputer,
    the scaler and the learner each read it, and the fitted model does not reference it.
    (A persisted block lost with an executor is recomputed from the lineage.)"""
    t = dealt(t, anew=False).persist()
    try:
        return Pipeline(stages=stages).fit(t)
    finally:
        t.unpersist()


def _weighted(train: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, str | None]:
    if not balanced:
        return train, None
    return with_class_weight(train, label, "w"), "w"


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "y", balanced: bool = True, C: float = 1.0,
                 max_iter: int = 100) -> PipelineModel:
    """balanced, scaled, L2 logistic regression.

    scikit-learn minimises 0.5||w||^2 + C * sum(w_i loss_i); Spark averages the
    weighted loss, so ``regParam = 1 / (C * sum(w))`` gives the same optimum.
    """
    t, wcol = _weighted(train, label, balanced)
    sw = t.agg(F.sum(F.col(wcol) if wcol else F.lit(1.0)).alias("s")).first()["s"] or 1.0
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * sw), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, **({"weightCol": wcol} if wcol else {}))
    return _fit([*feature_stages(features, scale=True), lr], t)


def _class_weights(train: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, dict | None]:
    """The rows that have a label and the balanced weight by class, or all rows and none."""
    if not balanced:
        return train, None
    t = train.where(F.col(label).isNotNull())
    return t, {float(r.label): r.weight for r in class_weights(t, label).collect()}  # one row a class


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "y", num_trees: int = 300,
               balanced: bool = True, max_depth: int = 10, seed: int = 42) -> PipelineModel:
    """F8: random forest with balanced class weights.

    ``RandomForestClassifier`` holds the settings; the trees are grown by :mod:`riskops.operators.trees`, all of
    them together, a level at a time.
    """
    t, weights = _class_weights(train, label, balanced)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                seed=seed, maxMemoryInMB=512, cacheNodeIds=True)
    t = dealt(t, anew=False)
    ready = _fit(feature_stages(features), t)
    return PipelineModel([*ready.stages, trees.fit_forest(rf, ready.transform(t), weights)])


def fit_gbt(train: DataFrame, features: Sequence[str], label: str = "y", max_iter: int = 250, max_depth: int = 4,
            step_size: float = 0.05, subsample: float = 0.8, balanced: bool = False, seed: int = 42,
            id_col: str | None = None, validation: float = 0.1, patience: int = 20) -> PipelineModel:
    """gradient-boosted trees standing in for XGBoost / LightGBM / CatBoost.

    With ``id_col``, a part ``validation`` of the rows (by u of the id) is held out, and the model ends at
    the round with the least loss on it.  Rounds are grown up to a first limit, then up to twice as many, until the
    best lies ``patience`` rounds behind or ``max_iter`` is reached.  The same rows give the same model.
    """
    t, weights = _class_weights(train, label, balanced)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth, stepSize=step_size, maxIter=max_iter,
                        subsamplingRate=subsample, seed=seed, checkpointInterval=50)
    t = dealt(t, anew=False)
    if not id_col:
        ready = _fit(feature_stages(features), t)
        return PipelineModel([*ready.stages, trees.fit_boosted(gbt, ready.transform(t), weights=weights)])
    t = t.withColumn("_held_out", F.coalesce(uniform("early_stop", id_col) < validation, F.lit(False)))
    ready = _fit(feature_stages(features), t.where("NOT _held_out"))
    return PipelineModel([*ready.stages, trees.fit_boosted(gbt, ready.transform(t), "_held_out", 3 * patience, patience, weights)])


def class_index(model: PipelineModel, name: str | None = None, default: int = 1) -> int:
    """Index of the class called ``name`` (e.g. 'depressed') if the pipeline indexed string labels."""
    if name:
        for st in model.stages:
            labels = getattr(st, "labels", None)
            if labels:
                low = [str(x).strip().lower() for x in labels]
                if name.lower() in low:
                    return low.index(name.lower())
    return default


def score_model(model: PipelineModel, df: DataFrame, out: str = "p", class_name: str | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """probability of the positive class (by name when labels were indexed) and risk percent."""
    idx = class_index(model, class_name)
    s = model.transform(df)
    p = vector_to_array(F.col("probability")).getItem(idx)
    cols = list(keep) if keep is not None else [c for c in df.columns]
    return s.select(*cols, p.alias(out), (p * 100.0).alias("risk_percent_model"))


def split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: str = "split", label: str = "y") -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the stratified split (E13), from one written table."""
    d = written(dealt(stratified_split(df, id_col, label, test_size, seed)), "split")
    return d.where("split = 'train'").drop("split"), d.where("split = 'test'").drop("split")


def evaluate_scored(scored: DataFrame, label: str = "y", score: str = "p", threshold: float = 0.5) -> dict:
    """E2 + E3 + E5 on a scored table: one small row of metrics."""
    m = E.classification_metrics(scored, score, label, threshold).first()
    auc = E.roc_auc(scored, score, label).first()["roc_auc"]
    brier = E.brier_score(scored, score, label).first()["brier_score"]
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"], "f1": m["f1"],
            "roc_auc": auc, "brier_score": brier}


Learner = Callable[[DataFrame, Sequence[str], str], PipelineModel]


def model_comparison(spark, rows: Sequence[Mapping]) -> DataFrame:
    """One row per model / feature set (metric dicts collected from bounded evaluations)."""
    keys = ["model", "feature_set", "n_features", "train_auc", "test_auc", "accuracy", "precision", "recall",
            "f1", "brier_score"]
    data = [tuple(r.get(k) for k in keys) for r in rows]
    schema = ("model string, feature_set string, n_features int, train_auc double, test_auc double, accuracy double, "
              "precision double, recall double, f1 double, brier_score double")
    return spark.createDataFrame(data, schema)


def group_holdout(df: DataFrame, features: Sequence[str], learner: Learner, fold_col: str = "fold",
                  label: str = "y", id_col: str = "row_id") -> DataFrame:
    """refit on the group-safe training folds, AUC on group fold 0."""
    train, test = df.where(F.col(fold_col) != 0), df.where(F.col(fold_col) == 0)
    m = learner(train, features, label)
    te = evaluate_scored(score_model(m, test, keep=[id_col, label]), label)
    return model_comparison(df.sparkSession, [{"model": "group_holdout", "feature_set": "fold0",
                                               "n_features": len(features), "test_auc": te["roc_auc"],
                                               **{k: te[k] for k in ("accuracy", "precision", "recall", "f1",
                                                                     "brier_score")}}])


def cross_calibrated(df: DataFrame, features: Sequence[str], learner: Learner, id_col: str, label: str = "y",
                     folds: int = 3, method: str = "isotonic") -> Callable[[DataFrame], DataFrame]:
    """K-fold calibration by ``isotonic`` or ``sigmoid``; returns a scorer that adds ``p_calibrated``.

    Each pair is a model of all folds but one and a calibrator of its scores on the one left out
    (stratified folds).  The scorer runs the k pairs one after the other on the same rows and averages: no
    joins, so equal or null ids do no harm.
    """
    d = written(dealt(stratified_folds(df, id_col, label, folds, "cal_fold")), "calibration")
    pairs = []
    for f in range(folds):
        m = learner(d.where(F.col("fold") != f), features, label)
        held = written(score_model(m, d.where(F.col("fold") == f), keep=[label]), "held-out")
        pairs.append((m, (isotonic if method == "isotonic" else sigmoid)(held, "p", label)))

    def scorer(x: DataFrame) -> DataFrame:
        out = x
        for i, (m, calibrate) in enumerate(pairs):
            out = calibrate(score_model(m, out, out=f"_p{i}", keep=out.columns).drop("risk_percent_model"), f"_p{i}", f"_c{i}")
        avg = sum((F.col(f"_c{i}") for i in range(len(pairs))), F.lit(0.0)) / len(pairs)
        return out.select(*x.columns, avg.alias("p_calibrated"))

    return scorer


Calibrator = Callable[[DataFrame, str, str], DataFrame]


def isotonic(scored: DataFrame, score: str = "p", label: str = "y") -> Calibrator:
    """The non-decreasing fit of the label on the score.

    Rows of one score are one weighted point (their mean), so the fit runs over the different scores;
    pools are formed in ranges of the score and merged.
    """
    points = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.avg(F.col(label).cast("double")).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_n"))
    model = IsotonicRegression(featuresCol=score, labelCol="_mean", weightCol="_n", predictionCol="_iso").fit(points)

    def apply(x: DataFrame, score: str, out: str) -> DataFrame:
        m = model.copy()
        return m.setFeaturesCol(score).setPredictionCol(out).transform(x)

    return apply


def logit(score: str) -> F.Column:
    eps = 1e-12
    return F.log(F.greatest(F.col(score), F.lit(eps)) / F.greatest(1 - F.col(score), F.lit(eps)))


def sigmoid(scored: DataFrame, score: str = "p", label: str = "y") -> Calibrator:
    """Platt scaling: a one-feature logistic regression on the score's logit, applied as a column expression."""
    lr = LogisticRegression(featuresCol="_f", labelCol=label, regParam=0.0)
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(label, logit(score).alias("_logit"))
    m = Pipeline(stages=[VectorAssembler(inputCols=["_logit"], outputCol="_f"), lr]).fit(rows).stages[-1]
    slope, intercept = float(m.coefficients[0]), float(m.intercept)

    def apply(x: DataFrame, score: str, out: str) -> DataFrame:
        return x.withColumn(out, 1 / (1 + F.exp(-(logit(score) * slope + intercept))))

    return apply


def save_versioned(model: PipelineModel, base_dir: str, prefix: str = "risk_model") -> tuple[str, str]:
    """``<base>/<prefix>_v<utc timestamp>``, then the pointer ``<base>/latest.json`` in one step.

    A reader finds the version before or this one, never a half-written model.
    """
    version = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    folder = f"{prefix}_v{version}"
    path = os.path.join(base_dir, folder)
    model.write().save(path)
    commits.publish(SparkSession.getActiveSession(), base_dir, version, folder)
    return version, path


def load_latest(spark: SparkSession, base_dir: str) -> PipelineModel | None:
    """The model that was published last; None if there is none."""
    found = commits.latest(spark, base_dir)
    return PipelineModel.load(os.path.join(base_dir, found["folder"])) if found else None


def retrain_from_feedback(base: DataFrame, feedback_rows: DataFrame, features: Sequence[str], label: str = "y",
                          id_col: str = "prediction_id", min_feedback: int = 50, num_trees: int = 300,
                          model_dir: str | None = None) -> DataFrame:
    """F16: gate (D16) -> union (D14) -> forest (F8) -> versioned save (A8) -> registry row."""
    spark = base.sparkSession
    n_fb = feedback_rows.count()
    schema = ("status string, version string, path string, feedback_rows long, training_rows long, accuracy double, "
              "roc_auc double")
    if n_fb < min_feedback:
        return spark.createDataFrame([("skipped", None, None, n_fb, None, None, None)], schema)
    data = base.unionByName(feedback_rows, allowMissingColumns=True)
    train, test = split(data, id_col, label=label)
    m = fit_forest(train, features, label, num_trees=num_trees, balanced=False)
    met = evaluate_scored(score_model(m, test, keep=[id_col, label]), label)
    model_dir = model_dir or scratch_path(spark, "models")
    version, path = save_versioned(m, model_dir)
    return spark.createDataFrame([("retrained", version, path, n_fb, data.count(), met["accuracy"], met["roc_auc"])],
                                 schema)


# ------------------------------------------------------------------ G6 text classifier

TEXT_TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def fit_text_classifier(train: DataFrame, text_col: str = "text", label: str = "label", vocab_size: int = 8000,
                        balanced: bool = True, C: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """TF-IDF of uni- and bigrams (the ``vocab_size`` most frequent, ties by term), smooth idf + 1, L2 norm, and a
    balanced, L2-penalised logistic regression (multinomial for more than two labels) on string labels.

    Rows without text or label are dropped.  The pipeline is made of Spark ML stages, so it persists:
    labels are indexed in alphabetical order, the idf is an element-wise product.  As in F7,
    ``regParam = 1 / (C * sum of weights)``.
    """
    t = train.where(F.col(text_col).isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    t, wcol = _weighted(written(dealt(t, anew=False), "text-train"), label, balanced)
    top = term_statistics(t.select(F.lower(text_col).alias("t"))).orderBy(
        (F.col("term") == CHUNK_SENTINEL).desc(), F.col("cnt").desc(), "term").limit(vocab_size + 1).collect()  # bounded by vocab_size
    n, terms = top[0].df, top[1:]
    weight = t.agg(F.sum(F.col(wcol) if wcol else F.lit(1.0))).first()[0]
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(t)
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TEXT_TOKEN_PATTERN, gaps=False, toLowercase=True)
    ng = NGram(n=2, inputCol="_tok", outputCol="_bi")
    merge = SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__")
    count = CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="_terms", outputCol="_tf")
    idf = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense([math.log((1 + n) / (1 + r.df)) + 1 for r in terms]))
    norm = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    lr = LogisticRegression(featuresCol="features", labelCol="_y", family="binomial" if len(index.labels) <= 2 else "multinomial", maxIter=max_iter,
                            tol=1e-9, standardization=False, regParam=1.0 / (C * weight), **({"weightCol": wcol} if wcol else {}))
    ready = PipelineModel([index, tok, ng, merge, count, idf, norm])
    known = written(ready.transform(t).select("_y", "features", *([wcol] if wcol else [])), "text-features")
    return PipelineModel([*ready.stages, lr.fit(known)])


def text_predictions(model: PipelineModel, df: DataFrame, id_col: str, text_col: str = "text", label: str | None = None) -> DataFrame:
    """(id, predicted[, actual]): the label with the highest probability."""
    labels = model.stages[0].labels
    s = PipelineModel(model.stages[1:]).transform(df.withColumn(text_col, F.coalesce(text_col, F.lit(""))))
    names = F.array(*map(F.lit, labels))
    return s.select(id_col, names[F.col("prediction").cast("int")].alias("predicted"), *([F.col(label).cast("string").alias("actual")] if label else []))


def label_confusion(predicted: DataFrame) -> DataFrame:
    """(actual, predicted, n) over all labels that occur, zero cells kept."""
    n = predicted.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = n.select(F.explode(F.array("actual", "predicted")).alias("l")).distinct().orderBy("l").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # the labels
    cells = labels.select(F.explode("ls").alias("actual"), "ls").select("actual", F.explode("ls").alias("predicted"))
    return cells.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_report(confusion: DataFrame) -> DataFrame:
    """Per label precision, recall, F1 and support (zero division gives 0), accuracy, macro and weighted averages."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    each = confusion.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), hit.alias("hit")),
                                              F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    each = each.select("s.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit, given, support = F.col("hit"), F.col("given"), F.col("support")
    each = each.select("label", ratio(hit, given).alias("precision"), ratio(hit, support).alias("recall"), ratio(2 * hit, given + support).alias("f1_score"), "support", "hit")
    names = ["precision", "recall", "f1_score"]
    row = lambda name, *cols: each.agg(*cols, F.sum("support").alias("support")).select(F.lit(name).alias("label"), *names, "support")
    total = F.sum("hit") / F.sum("support")
    return (each.drop("hit").unionByName(row("accuracy", *(total.alias(c) for c in names)))
            .unionByName(row("macro avg", *(F.avg(c).alias(c) for c in names)))
            .unionByName(row("weighted avg", *((F.sum(F.col(c) * support) / F.sum("support")).alias(c) for c in names))))


def text_risk_scores(model: PipelineModel, df: DataFrame, id_col: str, text_col: str, positive_index: int = 1,
                     factor_terms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Model percent (rounded to 1) of the positive class per message, plus keyword factors (G5 input)."""
    model = PipelineModel([st for st in model.stages if not isinstance(st, StringIndexerModel)])  # messages have no label
    s = model.transform((df.withColumnRenamed(text_col, "text") if text_col != "text" else df).withColumn("text", F.coalesce("text", F.lit(""))))
    pct = F.bround(vector_to_array("probability").getItem(positive_index) * 100.0, 1)
    cols = [id_col, pct.alias("model_percent")]
    if factor_terms:
        low = F.lower(F.col("text"))
        facs = [F.when(any_contains(low, ts), F.lit(f)) for f, ts in factor_terms.items()]
        cols.append(F.array_compact(F.array(*facs)).alias("model_factors"))
    return s.select(*cols)
