"""Whole runs: in one session, in three sessions with tables between them, over folds, and for a tuner."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.prepare import extent, lifted, quantized, scaled, shift_vectors
from nearfold.operators import knn, metrics, predict, split, tune
from nearfold.plans.config import KnnConfig


def points(rows: DataFrame, config: KnnConfig) -> DataFrame:
    """(id, coords, ...) from (id, features, ...): scaled once, cut to integers."""
    return rows.withColumn("coords", quantized(scaled(F.col("features"), list(config.scale or (1.0,) * config.dimension)))).drop("features")


def above_zero(r: DataFrame, s: DataFrame, config: KnnConfig) -> tuple[DataFrame, DataFrame]:
    """Both sets with the joint minimum of each coordinate subtracted, so that codes keep their order.

    ValueError if a shifted coordinate would not fit into ``config.bits``.
    """
    least, most = extent(r.select("coords").unionByName(s.select("coords")), config.dimension)
    check_fit(least, most, config)
    return tuple(x.withColumn("coords", lifted(F.col("coords"), least)) for x in (r, s))


def check_fit(least: list[int], most: list[int], config: KnnConfig) -> None:
    widest = max(h - m for m, h in zip(least, most)) + (config.max_shift if config.shifts > 1 else 0)
    if widest >> config.bits:
        raise ValueError(f"coordinates up to {widest} need more than {config.bits} bits")


def edges(r: DataFrame, s: DataFrame, config: KnnConfig) -> DataFrame:
    vectors = shift_vectors(config.shifts, config.dimension, config.seed, config.max_shift)
    return knn.approximate_knn(r, s, config.k, vectors, config.dimension, config.bits, config.curve, config.partitions, config.epsilon)


def run(r: DataFrame, s: DataFrame, config: KnnConfig) -> DataFrame:
    """Predictions for R (id, features) from S (id, features, label or value)."""
    r, s = above_zero(points(r, config), points(s, config), config)
    found = edges(r, s, config)
    if config.task == "classify":
        return predict.classify(found, s, list(range(1, config.classes + 1)))
    return predict.regress(found, s)


def phase1(r: DataFrame, s: DataFrame, config: KnnConfig, path: str) -> None:
    """Code both sets and write them."""
    r, s = above_zero(points(r, config), points(s, config), config)
    keep = [c for c in ("label", "value") if c in s.columns]
    r.select("id", "coords").write.mode("overwrite").parquet(f"{path}/r")
    s.select("id", "coords", *keep).write.mode("overwrite").parquet(f"{path}/s")


def phase2(spark: SparkSession, config: KnnConfig, path: str) -> None:
    """Find neighbours among what phase 1 wrote and write the edges."""
    edges(spark.read.parquet(f"{path}/r"), spark.read.parquet(f"{path}/s"), config).write.mode("overwrite").parquet(f"{path}/edges")


def phase3(spark: SparkSession, config: KnnConfig, path: str) -> DataFrame:
    """Predict from what phase 2 wrote."""
    found, s = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/s")
    return predict.classify(found, s, list(range(1, config.classes + 1))) if config.task == "classify" else predict.regress(found, s)


def score(predicted: DataFrame, truth: DataFrame, config: KnnConfig) -> DataFrame:
    """One row: accuracy and F-measure, or RMSE and R squared."""
    if config.task == "classify":
        pairs = metrics.joined(predicted, truth, "label")
        return metrics.accuracy(pairs).crossJoin(metrics.f_measure(pairs).select("f_measure"))
    pairs = metrics.joined(predicted, truth, "value")
    return metrics.rmse(pairs).crossJoin(metrics.r_squared(pairs, truth, "value"))


def cross_validate(rows: DataFrame, order: list[str], config: KnnConfig) -> DataFrame:
    """One row for each fold, with its scores."""
    folded = split.with_fold(rows, order, config.folds).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for fold in range(config.folds):
        r, s = split.fold_pair(folded, fold)
        out.append(score(run(r, s, config), r, config).select(F.lit(fold).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, out)


def tuned(rows: DataFrame, order: list[str], config: KnnConfig, search: tune.Search = tune.Search()) -> tuple[KnnConfig, float, list[float]]:
    """The settings whose feature scales score best over all folds, their score, and the best of each generation.

    The score is the mean accuracy of a classification, and the mean RMSE, which is to be small, of a regression.
    Scales are whole numbers up to ``config.scale_domain``; each candidate is one cross-validation over all rows.
    """
    metric = "accuracy" if config.task == "classify" else "rmse"
    worst = 0.0 if config.task == "classify" else float("inf")
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def rate(genes: tune.Genes) -> float:
        scores = cross_validate(kept, order, replace(config, scale=tuple(float(g) for g in genes)))
        mean = metrics.fold_average(scores, [metric]).first()[metric]
        return worst if mean is None else float(mean)

    best, value, history = tune.genetic(rate, config.scale_domain, replace(search, larger_is_better=config.task == "classify"))
    kept.unpersist()
    return replace(config, scale=tuple(float(g) for g in best)), value, history
