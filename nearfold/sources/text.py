"""Delimited text in and out, in the layouts that earlier tools of this kind exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.prepare import repaired


def read_rows(spark: SparkSession, path: str, dimension: int, value_at: int | None = None, class_at: int | None = None, header: bool = True, separator: str = ",") -> DataFrame:
    """(id, features, value, label) from lines id, f1..fd, ...; value and class by position after the id.

    Fields that aren't numbers, NaN, missing ones and values of at most -9999 become 0.
    """
    last = max([dimension, *(p + 1 for p in (value_at, class_at) if p is not None)])
    schema = ", ".join(["c0 string", *(f"c{i} string" for i in range(1, last + 1))])
    rows = spark.read.schema(schema).csv(path, header=header, sep=separator, enforceSchema=True)
    at = lambda p: repaired(F.trim(F.col(f"c{p + 1}"))) if p is not None else F.lit(None).cast("float")
    return rows.select(
        F.trim("c0").alias("id"), F.array(*(repaired(F.trim(F.col(f"c{i}"))) for i in range(1, dimension + 1))).alias("features"), at(value_at).alias("value"), F.floor(at(class_at) + 0.5).cast("int").alias("label")
    )


def write_rows(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV lines id, features..., value, label; replaces what is there. ``files`` = 1 writes one file.

    All rows have as many features as the longest; what a shorter one lacks is an empty field.
    """
    size = rows.agg(F.max(F.size("features")).alias("n")).first().n or 0
    flat = rows.select("id", *(F.get("features", F.lit(i)).alias(f"f{i + 1}") for i in range(max(0, size))), "value", "label")
    (flat.coalesce(files) if files else flat).write.mode("overwrite").csv(path, header=True)


def read_shifts(spark: SparkSession, path: str) -> list[list[int]]:
    """Shift vectors, one line of blank-separated integers each, in the order of the file."""
    lines = spark.read.text(path, wholetext=True).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("t")).first().t
    return [[int(x) for x in line.split()] for line in (lines or "").splitlines() if line.strip()]


def write_shifts(spark: SparkSession, vectors: list[list[int]], path: str) -> None:
    spark.createDataFrame([("\n".join(" ".join(map(str, v)) for v in vectors),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_ranges(bounds: DataFrame, path: str) -> None:
    """Ranges as a small table, for a later session."""
    bounds.coalesce(1).write.mode("overwrite").parquet(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def classification_lines(predicted: DataFrame, truth: DataFrame, labels: list[int]) -> DataFrame:
    """``id:label | Result c | Class 1 probability p | ...``, one text line for each row."""
    both = predicted.join(truth.select(F.col("id").alias("rid"), "label"), "rid")
    shares = [F.concat(F.lit(f" | Class {c} probability "), F.col(f"p_{c}").cast("string")) for c in labels]
    return both.select(F.concat(F.col("rid").cast("string"), F.lit(":"), F.col("label").cast("string"), F.lit(" | Result "), F.col("predicted").cast("string"), *shares).alias("value"))


def regression_lines(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``id:value | Result: v``."""
    both = predicted.join(truth.select(F.col("id").alias("rid"), "value"), "rid")
    return both.select(F.concat(F.col("rid").cast("string"), F.lit(":"), F.col("value").cast("string"), F.lit(" | Result: "), F.col("predicted").cast("string")).alias("value"))


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(rid, real, predicted) of result lines of either kind, from all files of a directory."""
    line = F.col("value")
    real, result = F.regexp_extract(line, r"^[^:]*:(\S+)", 1), F.regexp_extract(line, r"Result:? (\S+)", 1)
    return spark.read.text(path).select(F.regexp_extract(line, r"^([^:]*):", 1).alias("rid"), real.try_cast("double").alias("real"), result.try_cast("double").alias("predicted"))
