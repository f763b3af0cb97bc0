"""k-nearest-neighbour joins: for every row of R, near rows of S.

R and S have (id, coords): a key and an array of integer coordinates. Results are edges
(rid, sid, d2, rank) with the exact squared distance d2; ties go to the smaller sid. Rows whose point is
null, of another dimension or lacks a coordinate are near nothing and have no neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import curves
from nearfold.functions.prepare import complete, extent, shifted, squared_distance
from nearfold.operators import cells
from nearfold.operators.ranges import quantile_bounds, sampled_bounds
from nearfold.sources.tables import materialize


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each rid (``row_number`` under a limit, which Spark cuts before the shuffle)."""
    order = Window.partitionBy("rid").orderBy("d2", "sid")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("rid", "sid", "d2", "rank")


def exact_knn(r: DataFrame, s: DataFrame, k: int, dimension: int) -> DataFrame:
    """The true k nearest. The ground truth for ``approximate_knn``.

    Points are measured in the cells where neighbours can be (``cells``); what is shuffled grows with |R| + |S| as long as a
    neighbourhood reaches few cells, which in many dimensions it doesn't. The points and each row's nearest within
    its own cell are written to the shared folder. Where a distance might exceed a BIGINT, all pairs are measured instead.
    """
    whole = complete(F.col("coords"), dimension)
    at = F.col("coords").cast("array<bigint>").alias("coords")
    kind = [dict(x.dtypes)["id"] for x in (r, s)]
    left = r.filter(whole).select(F.col("id").alias("rid"), F.lit(None).cast(kind[1]).alias("sid"), at, F.lit(True).alias("is_r"))
    right = s.filter(whole).select(F.lit(None).cast(kind[0]).alias("rid"), F.col("id").alias("sid"), at, F.lit(False).alias("is_r"))
    points = materialize(left.unionByName(right))
    low, high = extent(points, dimension)
    if sum((h - x + 1) ** 2 for x, h in zip(low, high)) < 1 << 63:
        return nearest(cells.exact(points, k, dimension), k)
    left, right = points.filter("is_r").select("rid", F.col("coords").alias("rc")), points.filter("NOT is_r").select("sid", F.col("coords").alias("sc"))
    return nearest(left.crossJoin(right).select("rid", "sid", squared_distance(F.col("rc"), F.col("sc"), dimension).alias("d2")), k)


def coded(points: DataFrame, vectors: list[list[int]], dimension: int, bits: int, curve: str = "z") -> DataFrame:
    """Shifted copies with their curve code z; ``coords`` stay unshifted.

    A coordinate that ``bits`` can't hold counts as the nearest that they can, in the code only.
    """
    most = F.lit((1 << min(bits, 62)) - 1).cast("bigint")
    moved = shifted(points, vectors).withColumn("moved", F.transform("moved", lambda c: F.least(F.greatest(c, F.lit(0).cast("bigint")), most)))
    if curve == "hilbert":
        moved = moved.withColumn("moved", curves.hilbert_transpose(F.col("moved"), dimension, bits))
    encode = curves.gray_encode if curve == "gray" else curves.z_encode
    return moved.withColumn("z", encode(F.col("moved"), dimension, bits)).drop("moved")


def s_ranks(both: DataFrame, partitions: int, epsilon: float | None = None) -> DataFrame:
    """Each row's number of S rows up to it on its shift's curve (S before R at equal codes, then by id).

    Each shift is cut into ``partitions`` at quantiles of its codes, those of samples drawn for ``epsilon`` where it is
    given; rows are ranked within a part, and the S rows of the parts before are added. Ranks are the same for any cuts,
    but with more than one no shift is one task. ``both`` is read several times.
    """
    order = ["z", "is_r", "id"]
    is_s = (~F.col("is_r")).cast("bigint")
    if partitions == 1:
        return both.withColumn("srank", F.sum(is_s).over(Window.partitionBy("shift").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    bounds = sampled_bounds(both, partitions, epsilon) if epsilon else quantile_bounds(both, partitions)
    placed = both.join(F.broadcast(bounds), "shift", "left").withColumn("pid", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("z"))), F.lit(0))).drop("bounds")
    sizes = placed.groupBy("shift", "pid").agg(F.sum(is_s).alias("n"))
    before = sizes.select("shift", "pid", F.coalesce(F.sum("n").over(Window.partitionBy("shift").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum(is_s).over(Window.partitionBy("shift", "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("srank", within).join(F.broadcast(before), ["shift", "pid"]).withColumn("srank", F.col("srank") + F.col("before")).drop("before", "pid")


def candidates(r: DataFrame, s: DataFrame, k: int, vectors: list[list[int]], dimension: int, bits: int, curve: str = "z", partitions: int | None = None, epsilon: float | None = None) -> DataFrame:
    """Distinct (rid, sid, d2): for every R row and shift, the k S rows before it on the curve and the k after it.

    ``partitions``: parts of each shift's curve, as many as the session's shuffle partitions by default. The coded
    copies are written to the shared folder once where there are several, as cuts, counts and ranks all read them.
    """
    if partitions is None:
        partitions = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = complete(F.col("coords"), dimension)
    tagged = r.filter(whole).select("id", "coords", F.lit(True).alias("is_r")).unionByName(s.filter(whole).select("id", "coords", F.lit(False).alias("is_r")))
    both = coded(tagged, vectors, dimension, bits, curve)
    ranked = s_ranks(materialize(both) if partitions > 1 else both, partitions, epsilon)
    # The 2k ranks wanted lie in two blocks of 2k ranks at most, so R is copied twice, not 2k times.
    block = lambda rank: F.floor(rank / (2 * k)).cast("bigint")
    low, high = F.col("srank") - (k - 1), F.col("srank") + k
    left = ranked.filter("is_r").select("shift", F.col("id").alias("rid"), F.col("coords").alias("rc"), low.alias("low"), high.alias("high"), F.explode(F.array_distinct(F.array(block(low), block(high)))).alias("block"))
    right = ranked.filter("NOT is_r").select("shift", "srank", block(F.col("srank")).alias("block"), F.col("id").alias("sid"), F.col("coords").alias("sc"))
    met = left.join(right, ["shift", "block"]).filter("srank BETWEEN low AND high").select("rid", "sid", squared_distance(F.col("rc"), F.col("sc"), dimension).alias("d2"))
    # Dealt by rid once, pairs of several shifts are made one and ranked without another shuffle.
    return met.repartition("rid").groupBy("rid", "sid").agg(F.min("d2").alias("d2")) if len(vectors) > 1 else met


def approximate_knn(r: DataFrame, s: DataFrame, k: int, vectors: list[list[int]], dimension: int, bits: int, curve: str = "z", partitions: int | None = None, epsilon: float | None = None) -> DataFrame:
    """The k nearest among the curve neighbours over all shifts; fewer where S has fewer rows."""
    return nearest(candidates(r, s, k, vectors, dimension, bits, curve, partitions, epsilon), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true neighbours found."""
    hit = truth.select("rid", "sid").join(found.select("rid", "sid", F.lit(1).alias("hit")), ["rid", "sid"], "left")
    return hit.agg(F.count("*").alias("true_pairs"), F.count("hit").alias("found_pairs"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
