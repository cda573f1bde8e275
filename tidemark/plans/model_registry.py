"""The modelling jobs over the feature tables of a folder.

The 7-day label has a single positive on the small test tables, so these jobs use the same label at a
horizon of 90 days. The feature tables are staged once per session and state of the folder, the way the
feature run hands one written table to the modelling step; a folder whose files have changed is read anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, scoring_config, training_config
from tidemark.functions.staging import new_path, stage
from tidemark.operators import metrics
from tidemark.operators.model import feature_importances, score
from tidemark.operators.prep import PrepModel, encode_ordinals, fit_prep, hash_split, label_distribution
from tidemark.operators.resample import smote, undersample
from tidemark.plans.feature_table import feature_table
from tidemark.plans.model_run import Evaluation, ModelParams, Trained, evaluate, keys_with, train_model
from tidemark.plans.registry import Query, Run
from tidemark.schema import COLUMNS, IMPUTED

HORIZON = 90
LABEL = f"executed_flag_{HORIZON}"
# The smallest test tables hold fewer positives than the neighbours asked for.
PARAMS = ModelParams(label=LABEL, lenient=True)
TABLES = ("customer", "documents", "conversations", "events", "lineitem", "nation", "orders", "part", "region")

_staged: dict[tuple, DataFrame] = {}
_trained: dict[tuple, Trained] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """The session, and name, size and time of every file of the tables."""
    jvm = spark.sparkContext._jvm
    found = []
    for table in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return (spark.sparkContext.applicationId, folder, *sorted(found))


def labelled_features(spark: SparkSession, folder: str, cfg: FeatureConfig) -> DataFrame:
    """The 70 columns and the 90-day label, staged on first use."""
    key = (*_state(spark, folder), cfg)
    if key not in _staged:
        run = Run(spark, folder, cfg)
        _staged[key] = stage(feature_table(run.src, cfg, horizon=HORIZON), "labelled")
    return _staged[key]


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    cfg = training_config()
    return encode_ordinals(labelled_features(spark, folder, cfg), cfg.words)


def trained(spark: SparkSession, folder: str) -> Trained:
    key = _state(spark, folder)
    if key not in _trained:
        cfg = training_config()
        _trained[key] = train_model(labelled_features(spark, folder, cfg), cfg.words, PARAMS)
    return _trained[key]


def _rounded(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Six digits; adding 0 turns a negative zero into zero."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})


def _bigint(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _prepared(rows: DataFrame) -> PrepModel:
    """Rating levels are declared: which of them occur depends on the scale of the test tables."""
    return fit_prep(rows, keys=keys_with(LABEL), declared={"prd_comp_grade_level": range(4)})


def mean_impute(rows: DataFrame) -> DataFrame:
    return _rounded(_prepared(rows).impute(rows).select("cust_id", *IMPUTED), IMPUTED)


def one_hot_drop_first(rows: DataFrame) -> DataFrame:
    prep = _prepared(rows)
    return _bigint(prep.one_hot(rows), prep.dummies)


def standardize(rows: DataFrame) -> DataFrame:
    prep = _prepared(rows)
    return _rounded(prep.standardize(rows), prep.centers)


def design_matrix(rows: DataFrame) -> DataFrame:
    prep = _prepared(rows)
    return _bigint(_rounded(prep.transform(rows), prep.centers), prep.dummies)


def smote_oversample(rows: DataFrame) -> DataFrame:
    prep = _prepared(rows)
    matrix = stage(prep.transform_matrix(rows), "matrix")
    grown = smote(matrix, LABEL, "cust_id", prep.features, PARAMS.over_ratio, PARAMS.neighbors, PARAMS.seed, lenient=PARAMS.lenient)
    return _bigint(_rounded(grown, prep.features), ["is_synthetic"])


def undersample_to_ratio(rows: DataFrame) -> DataFrame:
    return undersample(rows.select("cust_id", LABEL), LABEL, "cust_id", PARAMS.under_ratio, PARAMS.seed, PARAMS.lenient)


def train_test_split(rows: DataFrame) -> DataFrame:
    return _bigint(hash_split(rows, "cust_id", PARAMS.test_percent, PARAMS.seed).select("cust_id", "is_test"), ["is_test"])


def fixed_scores(rows: DataFrame) -> DataFrame:
    """A score both engines compute alike, with ties: the fraction of 97 left by the page views."""
    return rows.select("cust_id", LABEL, (F.col("pv") % 97 / F.lit(97.0)).alias("score"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    return _bigint(metrics.threshold_sweep(fixed_scores(rows)), ["predicted"])


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return _bigint(metrics.confusion_matrix(threshold_sweep(rows), LABEL, by=["threshold"]), ["actual"])


def classification_report(rows: DataFrame) -> DataFrame:
    matrix = metrics.confusion_matrix(threshold_sweep(rows), LABEL, by=["threshold"])
    report = metrics.classification_report(matrix, by=["threshold"])
    return _rounded(report, ("precision", "recall", "f1_score"))


def auc(rows: DataFrame) -> DataFrame:
    """By rank of the score, and by the hard classes at 0.5."""
    hard = metrics.auc_hard(threshold_sweep(rows).filter(F.col("threshold") == 0.5), LABEL)
    ranked = metrics.auc_rank(fixed_scores(rows), LABEL)
    both = ranked.select(F.lit("rank").alias("method"), "auc").unionByName(hard.select(F.lit("hard").alias("method"), "auc"))
    return _rounded(both, ["auc"])


def held_out_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out customers of the training cohort with score and class."""
    fitted = trained(spark, folder)
    return score(fitted.model, fitted.test, ("cust_id", LABEL))


def later_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scoring cohort under the model fitted on the training cohort, saved and loaded again."""
    path = new_path(spark, "model")
    trained(spark, folder).model.write().save(path)
    cfg = scoring_config()
    later = encode_ordinals(labelled_features(spark, folder, cfg), cfg.words)
    return score(PipelineModel.load(path), later, ("cust_id", LABEL))


def _kept_promises(scored: DataFrame) -> DataFrame:
    """What any forest's scores must be, as flags that SQL can state: in range, and in agreement with the class."""
    sound, agrees = F.col("score").between(0, 1), F.col("predicted") == (F.col("score") > 0.5).cast("bigint")
    return scored.select(
        "cust_id", LABEL, sound.cast("bigint").alias("score_in_range"), agrees.cast("bigint").alias("class_follows_score")
    )


def rf_fit_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _kept_promises(held_out_scores(spark, folder))


def score_later_day(spark: SparkSession, folder: str) -> DataFrame:
    return _kept_promises(later_scores(spark, folder))


def later_evaluation(spark: SparkSession, folder: str) -> Evaluation:
    """The fitted model's own scores on the later day, through all measures."""
    cfg = scoring_config()
    return evaluate(trained(spark, folder).model, labelled_features(spark, folder, cfg), cfg.words, LABEL)


def evaluate_later_day(spark: SparkSession, folder: str) -> DataFrame:
    """Actual rows of each class at each threshold, and whether the report's parts agree with the confusion matrix."""
    found = later_evaluation(spark, folder)
    matrix = found.confusion.withColumn("support", F.col("predicted_0") + F.col("predicted_1"))
    right = F.when(F.col("actual") == 1, F.col("predicted_1")).otherwise(F.col("predicted_0"))
    recall = found.report.filter(F.col("class").isin("0", "1")).select("threshold", F.col("class").cast("int").alias("actual"), "recall")
    both = matrix.join(recall, ["threshold", "actual"]).join(found.auc_hard, "threshold")
    recalls = F.coalesce(F.try_divide(right.cast("double"), F.col("support").cast("double")), F.lit(0.0))
    return both.select(
        "threshold",
        F.col("actual").cast("bigint").alias("actual"),
        F.col("support").cast("bigint").alias("support"),
        (F.abs(F.col("recall") - recalls) < 1e-9).cast("bigint").alias("recall_agrees"),
        F.coalesce(F.col("auc").between(0, 1), F.lit(True)).cast("bigint").alias("auc_in_range"),
    )


def importances(spark: SparkSession, folder: str) -> DataFrame:
    return feature_importances(spark, trained(spark, folder).model)


def feature_importance_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of the model, and whether the ranking is sound: dense, sorted, not negative, and one in sum."""
    ranked = importances(spark, folder)
    checks = ranked.agg(
        (F.count_distinct("position") == F.max("position")).alias("dense"),
        (F.min("importance") >= 0).alias("positive"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("whole"),
        F.array_sort(F.collect_list(F.struct("position", "importance"))).alias("all"),
    )
    falling = F.forall(F.sequence(F.lit(1), F.size("all") - 1), lambda i: F.element_at("all", i)["importance"] >= F.element_at("all", i + 1)["importance"])
    sound = checks.select((F.col("dense") & F.col("positive") & F.col("whole") & falling).cast("bigint")).first()[0]
    return ranked.select("feature", F.lit(sound).cast("bigint").alias("ranking_sound"))


def _on_rows(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(training_rows(spark, folder))


MODEL_QUERIES: dict[str, Query] = {
    "label_distribution": _on_rows(lambda rows: label_distribution(rows, LABEL)),
    "encode_ordinals": _on_rows(lambda rows: rows.select("cust_id", "sex", "age_group")),
    "mean_impute": _on_rows(mean_impute),
    "one_hot_drop_first": _on_rows(one_hot_drop_first),
    "standardize": _on_rows(standardize),
    "design_matrix": _on_rows(design_matrix),
    "smote_oversample": _on_rows(smote_oversample),
    "undersample_to_ratio": _on_rows(undersample_to_ratio),
    "train_test_split": _on_rows(train_test_split),
    "rf_fit_predict": rf_fit_predict,
    "score_later_day": score_later_day,
    "evaluate_later_day": evaluate_later_day,
    "threshold_sweep": _on_rows(threshold_sweep),
    "confusion_matrix": _on_rows(confusion_matrix),
    "classification_report": _on_rows(classification_report),
    "auc": _on_rows(auc),
    "feature_importance_rank": feature_importance_rank,
}
