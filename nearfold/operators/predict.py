"""Predictions from neighbour edges: distance-weighted votes and means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vote weights are summed as whole multiples of 1e-9, so that sums don't depend on their order.
UNIT = 1_000_000_000


def votes(edges: DataFrame, s: DataFrame) -> DataFrame:
    """(rid, label, votes): weights (max - d) / (max - min) of each rid's edges, 1 where all are equal, by label."""
    own = Window.partitionBy("rid")
    d = F.sqrt(F.col("d2").cast("double"))
    near = edges.join(s.select(F.col("id").alias("sid"), "label"), "sid").select("rid", "label", d.alias("d"), F.min(d).over(own).alias("lo"), F.max(d).over(own).alias("hi"))
    weight = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("d")) / (F.col("hi") - F.col("lo")))
    return near.groupBy("rid", "label").agg(F.sum(F.round(weight * UNIT).cast("bigint")).alias("votes"), F.count("*").alias("n"))


def classify(edges: DataFrame, s: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """(rid, predicted, n_neighbors) and p_<label> for each of ``labels``; ties go to the smallest label."""
    cast = votes(edges, s)
    best = F.max_by("label", F.struct("votes", (-F.col("label")).alias("low"))).alias("predicted")
    shares = [F.round(F.coalesce(F.sum(F.when(F.col("label") == c, F.col("votes"))), F.lit(0)) / F.sum("votes"), 6).alias(f"p_{c}") for c in labels or []]
    return cast.groupBy("rid").agg(best, F.sum("n").alias("n_neighbors"), *shares)


def probabilities(edges: DataFrame, s: DataFrame) -> DataFrame:
    """(rid, label, probability) for the labels among each rid's neighbours."""
    total = F.sum("votes").over(Window.partitionBy("rid"))
    return votes(edges, s).select("rid", "label", F.round(F.col("votes") / total, 6).alias("probability"))


def regress(edges: DataFrame, s: DataFrame, digits: int = 6) -> DataFrame:
    """(rid, predicted, n_neighbors): the mean value of each rid's neighbours."""
    near = edges.join(s.select(F.col("id").alias("sid"), "value"), "sid")
    return near.groupBy("rid").agg(F.round(F.avg("value"), digits).alias("predicted"), F.count("*").alias("n_neighbors"))
