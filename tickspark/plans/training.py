"""From ticks to labelled training rows, folds and models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.operators import clean, cv, gaps, labels, metrics
from tickspark.operators.bars import tick_bars
from tickspark.operators.index import with_row_index
from tickspark.plans.features import FeatureConfig, feature_table
from tickspark.schema import FILTER_FEATURES
from tickspark.session import materialize


@dataclass(frozen=True)
class ModelConfig:
    """Boosted trees."""

    features: tuple[str, ...] = FILTER_FEATURES
    max_depth: int = 4
    rounds: int = 20
    step: float = 0.1
    seed: int = 42
    validation_parts: int = 5


def labelled_events(
    features: DataFrame, barriers: labels.Barriers = labels.Barriers(), weights: str = "return_based"
) -> DataFrame:
    """Event rows of a feature table with labels, weights and a dense position per symbol."""
    anchored = gaps.event_anchors(features).filter("is_rising_edge").select(
        "symbol", "bar_idx", F.col("fvg_event").cast("int").alias("direction")
    )
    with_side = labels.barrier_vol(features, barriers.vol_rows).join(
        anchored, ["symbol", "bar_idx"], "left"
    )
    labelled = labels.meta_label(labels.triple_barrier(with_side, barriers))
    weighted = labels.sample_weights(labelled, weights)
    return with_row_index(
        weighted, order=("open_time", "bar_idx"), slice_seconds=86_400, name="pos"
    )


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fit_meta(train: DataFrame, cfg: ModelConfig = ModelConfig()):
    """Weighted boosted trees that stop early on a held-out part.

    The last of ``validation_parts`` stretches of each symbol is held out, and what its labels overlap is left
    out (:func:`cv.purged_tail`).  Returns None when the rows to train on hold only one class.  Only the
    features of the model are read, moved and written, whatever else ``train`` holds.
    """
    needed = dict.fromkeys(["symbol", "pos", "bar_idx", "holding_bars", "meta_label", "sample_weight", *cfg.features])
    parted = materialize(cv.purged_tail(train.select(*needed), cfg.validation_parts), "fit")
    classes = parted.filter("role = 'train'").agg(F.min("meta_label"), F.max("meta_label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return None
    rows = assemble(parted, cfg.features).select(
        "features", F.col("meta_label").cast("double").alias("label"), "sample_weight",
        (F.col("role") == "validation").alias("is_validation"),
    )
    booster = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="sample_weight",
        validationIndicatorCol="is_validation", maxDepth=cfg.max_depth, maxIter=cfg.rounds,
        stepSize=cfg.step, seed=cfg.seed,
    )
    return booster.fit(rows)


def score(df: DataFrame, model, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Probability of success in ``score``; 0.5 without a model."""
    if model is None:
        return df.withColumn("score", F.lit(0.5))
    scored = model.transform(assemble(df, cfg.features))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def cross_validate(
    samples: DataFrame, k: int = 3, cfg: ModelConfig = ModelConfig(), embargo_pct: float = 0.01
) -> DataFrame:
    """Out-of-fold scores of purged folds.

    The folds are written once; each of the ``k`` models reads its part.
    """
    folds = materialize(cv.purged_kfold(samples, k, embargo_pct=embargo_pct), "folds")
    out = None
    for fold in range(k):
        part = folds.filter(F.col("fold") == fold)
        model = fit_meta(part.filter(F.col("role") == "train"), cfg)
        tested = score(part.filter(F.col("role") == "test"), model, cfg)
        out = tested if out is None else out.unionByName(tested)
    return out


def evaluate(scored: DataFrame) -> DataFrame:
    """Ranking and threshold metrics per fold."""
    rows = scored.withColumns({"y": F.col("meta_label"), "weight": F.col("sample_weight")})
    return metrics.ranking_metrics(rows, ["fold"]).join(metrics.metrics_at(rows, ["fold"], 0.5), "fold")


def training_rows(
    ticks: DataFrame, n: int = 100, cfg: FeatureConfig = FeatureConfig(),
    barriers: labels.Barriers = labels.Barriers(), weights: str = "return_based",
) -> DataFrame:
    """Ticks to bars, features and labelled events in one lineage."""
    bars = tick_bars(clean.valid_quotes(ticks), n)
    features = materialize(feature_table(bars, cfg, written_bars=True), "features")
    return labelled_events(features, barriers, weights)
