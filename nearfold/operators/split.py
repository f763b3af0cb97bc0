"""Splits of a table into query rows R and training rows S."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Distinct values of a text column, about, by which an order is cut.
SAMPLE = 10_000


def by_condition(rows: DataFrame, in_r: Column) -> tuple[DataFrame, DataFrame]:
    """R where the condition holds, S everywhere else, null included."""
    held = F.coalesce(in_r, F.lit(False))
    return rows.filter(held), rows.filter(~held)


def id_date(identifier: Column) -> Column:
    """The date in an id laid out as meter (11), separator, yyyy, separator, MM, separator, dd."""
    return F.concat_ws("-", F.substring(identifier, 13, 4), F.substring(identifier, 18, 2), F.substring(identifier, 21, 2)).try_cast("date")


def numbered(rows: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """Rows with their position ``rn`` (from 1) and the count ``n`` in a total order.

    The order is cut at quantiles of its first column, or for a column that is neither a number nor a time at those of
    about ``SAMPLE`` of its distinct values, drawn by hash; each part is numbered by itself and the sizes of those
    before, counted beforehand, are added. Cuts only balance the work.
    """
    kind = dict(rows.dtypes)[order[0]]
    first = F.unix_micros(order[0]) if kind == "timestamp" else F.col(order[0])
    if kind in ("timestamp", "tinyint", "smallint", "int", "bigint", "float", "double"):
        bounds = rows.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)]).alias("b")).first().b
    else:
        drawn = rows.filter(F.pmod(F.xxhash64(first), F.lit(max(1, rows.count() // SAMPLE))) == 0).select(first.alias("b")).distinct()
        known = sorted(r.b for r in drawn.filter("b IS NOT NULL").collect())
        bounds = [known[i * len(known) // parts] for i in range(1, parts)] if known else None
    part = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(bounds)))), lambda b: b < first)) if bounds else F.lit(0)
    # Sizes come by way of the driver: from a join on the part with counts of the same rows, Spark may derive a filter
    # of the counts by a column that they don't have, and fail.
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = rows.withColumn("__part", part).withColumn("__own", own)
    start = F.get(F.array(*(F.lit(x).cast("bigint") for x in before)), F.col("__part"))
    return placed.withColumns({"n": F.lit(sum(sizes.values())).cast("bigint"), "rn": F.col("__own") + start}).drop("__part", "__own")


def positional(rows: DataFrame, order: list[str], share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """S: the first ``share`` of the rows in order; R: the rest."""
    placed = numbered(rows, order)
    cut = F.floor(F.col("n") * share)
    return placed.filter(F.col("rn") > cut).drop("rn", "n"), placed.filter(F.col("rn") <= cut).drop("rn", "n")


def with_fold(rows: DataFrame, order: list[str], folds: int) -> DataFrame:
    """Rows with ``fold``: contiguous parts of floor(n / folds) rows from 0; the tail is null, always in S."""
    placed = numbered(rows, order)
    size = F.floor(F.col("n") / folds)
    fold = F.floor(F.try_divide(F.col("rn") - 1, size)).cast("int")
    return placed.withColumn("fold", F.when(fold < folds, fold)).drop("rn", "n")


def fold_pair(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """R and S of one fold."""
    r, s = by_condition(folded, F.col("fold") == fold)
    return r.drop("fold"), s.drop("fold")


def chain(r: DataFrame, s: DataFrame, predicted: DataFrame, positive: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows for a regression after a classification: R predicted positive, S labelled so."""
    chosen = predicted.filter(F.col("predicted") == positive).select(F.col("rid").alias("id"))
    return r.join(chosen, "id", "left_semi"), s.filter(F.col("label") == positive)


def final_series(r: DataFrame, regression: DataFrame) -> DataFrame:
    """(id, value): every row of R with its prediction, 0.0 where it has none."""
    return r.select("id").join(regression.select(F.col("rid").alias("id"), "predicted"), "id", "left").select("id", F.coalesce("predicted", F.lit(0.0)).alias("value"))
