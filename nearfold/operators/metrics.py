"""Quality of predictions. Inputs are (rid, predicted) and (id, real); each result is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(predicted: DataFrame, truth: DataFrame, real: str) -> DataFrame:
    return predicted.select(F.col("rid").alias("id"), "predicted").join(truth.select("id", F.col(real).alias("real")), "id")


def accuracy(pairs: DataFrame) -> DataFrame:
    """100 * correct / ids."""
    return pairs.agg(F.round(100 * F.sum((F.col("predicted") == F.col("real")).cast("int")) / F.count_distinct("id"), 6).alias("accuracy"))


def f_measure(pairs: DataFrame, positive: int = 2) -> DataFrame:
    """precision, recall, f_measure of one class against all others; null where undefined."""
    said, is_so = F.col("predicted") == positive, F.col("real") == positive
    count = lambda c: F.sum(c.cast("int"))
    c = pairs.agg(count(said & is_so).alias("tp"), count(said & ~is_so).alias("fp"), count(~said & is_so).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f_measure"))


def _kept(exclude_zero: bool) -> Column:
    return F.col("real") != 0 if exclude_zero else F.lit(True)


def rmse(pairs: DataFrame, exclude_zero: bool = False) -> DataFrame:
    """Root of the mean squared error; ``exclude_zero`` leaves out rows whose real value is 0."""
    return pairs.filter(_kept(exclude_zero)).agg(F.round(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("real"), 2))), 6).alias("rmse"))


def r_squared(pairs: DataFrame, truth: DataFrame, real: str, variant: str = "standard", exclude_zero: bool = False) -> DataFrame:
    """Coefficient of determination.

    ``standard``: 1 - residual / total sum of squares around the mean of the rows compared.
    ``explained``: 1 - sum (predicted - mean)^2 / sum (real - mean)^2 with the mean of all of ``truth``.
    """
    rows = pairs.filter(_kept(exclude_zero))
    mean = (rows.agg(F.avg("real").alias("mean")) if variant == "standard" else truth.agg(F.avg(real).alias("mean")))
    both = rows.crossJoin(F.broadcast(mean))
    error = F.col("real") - F.col("predicted") if variant == "standard" else F.col("predicted") - F.col("mean")
    return both.agg(F.round(1 - F.try_divide(F.sum(F.pow(error, 2)), F.sum(F.pow(F.col("real") - F.col("mean"), 2))), 6).alias("r_squared"))


def fold_average(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of metrics over folds."""
    return scores.agg(*(F.round(F.avg(m), 6).alias(m) for m in metrics), F.count("*").alias("folds"))


def phase_times(log: DataFrame) -> DataFrame:
    """Summed seconds by phase and thread of a (phase, thread, seconds) log."""
    return log.groupBy("phase", "thread").agg(F.sum("seconds").alias("seconds"))
