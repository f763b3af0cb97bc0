"""From raw values to points: repair, scaling, quantising, shifted copies."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = -9999.0


def repaired(value: Column) -> Column:
    """A number; anything that isn't one, NaN, null and values of at most -9999 become 0."""
    x = F.try_cast(value, "float") if hasattr(F, "try_cast") else value.try_cast("float")
    return F.when(~F.isnan(x) & (x > MISSING), x).otherwise(F.lit(0.0).cast("float"))


def scaled(features: Column, scale: list[float], shift: int = 0, compound: bool = False) -> Column:
    """Features times their factors, once; ``compound`` applies them shift + 1 times, as old results have it."""
    power = shift + 1 if compound else 1
    return F.zip_with(features, F.array(*(F.lit(float(s) ** power) for s in scale)), lambda x, s: x.cast("double") * s)


def quantized(features: Column, factor: float = 10.0) -> Column:
    """Features times ``factor``, cut towards zero."""
    return F.transform(features, lambda x: (x.cast("double") * F.lit(factor)).cast("bigint"))


def lifted(coords: Column, least: list[int]) -> Column:
    """Coordinates less their minima, so that none is negative."""
    return F.zip_with(coords, F.array(*(F.lit(m).cast("bigint") for m in least)), lambda c, m: c - m)


def complete(coords: Column, dimension: int) -> Column:
    """Whether a point has all its coordinates; one that hasn't is near nothing and nothing is near it."""
    return coords.isNotNull() & (F.size(coords) == dimension) & ~F.exists(coords, lambda c: c.isNull())


def extent(points: DataFrame, dimension: int, coords: str = "coords") -> tuple[list[int], list[int]]:
    """Minima and maxima of the coordinates, 0 where there are none."""
    bound = [f(F.get(F.col(coords), F.lit(k))).alias(f"{n}{k}") for n, f in (("l", F.min), ("h", F.max)) for k in range(dimension)]
    row = [int(x) if x is not None else 0 for x in points.agg(*bound).first()]
    return row[:dimension], row[dimension:]


def minima(points: DataFrame, dimension: int, coords: str = "coords") -> list[int]:
    return extent(points, dimension, coords)[0]


def rebalanced(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt evenly, over ``partitions`` or as adaptive execution sees fit."""
    return rows.repartition(partitions) if partitions else rows.hint("rebalance")


def shift_vectors(count: int, dimension: int, seed: int, most: int = 10000) -> list[list[int]]:
    """Random shift vectors in 0..most; the first is zero."""
    r = random.Random(seed)
    return [[0] * dimension, *([r.randint(0, most) for _ in range(dimension)] for _ in range(count - 1))]


def shift_frame(spark: SparkSession, vectors: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vectors)], "shift int, vector array<bigint>")


def shifted(points: DataFrame, vectors: list[list[int]]) -> DataFrame:
    """One copy of every row for each shift vector: columns shift and moved (shifted coordinates)."""
    copies = F.array(*(F.struct(F.lit(i).alias("shift"), F.array(*(F.lit(int(x)).cast("bigint") for x in v)).alias("vector")) for i, v in enumerate(vectors)))
    out = points.withColumn("__copy", F.explode(copies))
    return out.select(*points.columns, F.col("__copy.shift").alias("shift"), F.zip_with("coords", F.col("__copy.vector"), lambda c, s: c + s).alias("moved"))


def squared_distance(a: Column, b: Column, dimension: int) -> Column:
    """Exact squared Euclidean distance of integer points, unrolled so that it compiles."""
    total = (a[0] - b[0]) * (a[0] - b[0])
    for k in range(1, dimension):
        total = total + (a[k] - b[k]) * (a[k] - b[k])
    return total
