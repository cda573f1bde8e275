"""Prepare, rebalance and fit on one feature table, then score another with the fitted model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Vocabulary
from tidemark.functions.staging import Stage, stage
from tidemark.operators import metrics
from tidemark.operators.model import fit_forest, score
from tidemark.operators.prep import PrepModel, encode_ordinals, fit_prep, hash_split
from tidemark.operators.resample import smote, undersample
from tidemark.schema import KEYS


@dataclass(frozen=True)
class ModelParams:
    label: str = "executed_flag_7"
    test_percent: int = 20
    over_ratio: float = 0.2
    neighbors: int = 5
    under_ratio: float = 0.6
    trees: int = 100
    depth: int = 30
    seed: int = 42
    # Small tables: accept ratios that are out of reach and fewer neighbours than asked for.
    lenient: bool = False


@dataclass(frozen=True)
class Trained:
    prep: PrepModel
    model: PipelineModel
    test: DataFrame


def keys_with(label: str) -> tuple[str, ...]:
    return KEYS if label in KEYS else (*KEYS, label)


def rebalanced(train: DataFrame, prep: PrepModel, params: ModelParams, keep: Stage = stage) -> DataFrame:
    """The prepared training rows after over- and undersampling."""
    # Scaled inputs with no missing value: distances need every coordinate.
    matrix = keep(prep.transform_matrix(train), "matrix")
    over = keep(
        smote(matrix, params.label, "cust_id", prep.features, params.over_ratio, params.neighbors, params.seed, keep, params.lenient),
        "oversampled",
    )
    return undersample(over, params.label, "cust_id", params.under_ratio, params.seed, params.lenient)


def train_model(features: DataFrame, words: Vocabulary, params: ModelParams, keep: Stage = stage) -> Trained:
    """Split first, then fit the preparation and rebalance on the training part only."""
    coded = hash_split(encode_ordinals(features, words), "cust_id", params.test_percent, params.seed)
    train, test = coded.filter(F.col("is_test") == 0), coded.filter(F.col("is_test") == 1)
    prep = fit_prep(train, keys=keys_with(params.label))
    balanced = keep(rebalanced(train, prep, params, keep), "balanced")
    kept = keys_with(params.label)
    model = fit_forest(
        balanced, prep.features, params.label, [prep.as_stage(kept)], params.trees, params.depth, params.seed
    )
    return Trained(prep, model, test)


@dataclass(frozen=True)
class Evaluation:
    """Quality of a model on one cohort; the first three have a row or more for each threshold."""

    confusion: DataFrame
    report: DataFrame
    auc_hard: DataFrame
    auc_rank: DataFrame


def evaluate(
    model: PipelineModel,
    features: DataFrame,
    words: Vocabulary,
    label: str,
    thresholds: Sequence[float] = (0.5, 0.4, 0.3),
    keep: Stage = stage,
) -> Evaluation:
    """Scores a later cohort's feature table once and measures the classes at every threshold, and the ranking."""
    scored = keep(score(model, encode_ordinals(features, words), ("cust_id", label)).drop("predicted"), "scored")
    swept = metrics.threshold_sweep(scored, "score", thresholds)
    matrix = metrics.confusion_matrix(swept, label, by=["threshold"])
    return Evaluation(
        matrix,
        metrics.classification_report(matrix, by=["threshold"]),
        metrics.auc_hard(swept, label, by=["threshold"]),
        metrics.auc_rank(scored, label),
    )
