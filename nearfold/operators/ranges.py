"""Samples, quantile ranges of curve codes, and routing of rows to them.

Results of the join don't depend on these: ranges only balance its work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_rate(rows: int, epsilon: float) -> float:
    """min(1, 1 / (epsilon^2 rows)); ValueError if that draws less than one row."""
    if rows < 1 or epsilon <= 0:
        raise ValueError("need rows and a positive epsilon")
    rate = min(1.0, 1.0 / (epsilon * epsilon * rows))
    if rate * rows < 1:
        raise ValueError("the sample would be empty: lower epsilon")
    return rate


def bernoulli(rows: DataFrame, rates: dict[int, float], source: str, seed: int) -> DataFrame:
    """Each row with its source's rate, independently."""
    return rows.sampleBy(source, rates, seed)


def hash_sample(rows: DataFrame, key: str, rate: float, buckets: int = 10007, factor: int = 7919) -> DataFrame:
    """A repeatable sample by key, which SQL can draw too."""
    return rows.filter(F.pmod(F.col(key) * factor, F.lit(buckets)) < F.lit(math.ceil(rate * buckets)))


def estimator_index(i: int, rows: int, rate: float, partitions: int) -> int:
    """The rank in a sample that stands for quantile i / partitions, at least 1."""
    rank = math.ceil(i / partitions * rows)
    low, high = math.floor(rank * rate), math.ceil(rank * rate)
    nearer = low if abs(int(low / rate) - rank) < abs(int(high / rate) - rank) else high
    return max(1, nearer)


def padding(k: int, epsilon: float, rows: int) -> int:
    """Sample positions by which ranges of S reach beyond those of R."""
    return math.ceil(k / (epsilon * epsilon * rows))


def range_bounds(sample: DataFrame, ranks: list[int], code: str = "z") -> DataFrame:
    """(shift, pid, low, high): half-open ranges [low, high) from the codes at these ranks of each shift's sample.

    The first range has no low, the last no high. A sample of fewer rows uses its last one.
    """
    order = Window.partitionBy("shift").orderBy(code)
    ranked = sample.select("shift", F.col(code).alias("code"), F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy("shift")).alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("pid"), F.lit(r).alias("want")) for i, r in enumerate(ranks))))
    ends = ranked.select("shift", "code", "rank", "n", wanted.alias("w")).filter(F.col("rank") == F.least("w.want", "n")).select("shift", F.col("w.pid").alias("pid"), F.col("code").alias("high"))
    by_pid = Window.partitionBy("shift").orderBy("pid")
    last = len(ranks) - 1
    return ends.select("shift", "pid", F.lag("high").over(by_pid).alias("low"), F.when(F.col("pid") < last, F.col("high")).alias("high"))


def padded_bounds(bounds: DataFrame, s_sample: DataFrame, reach: int, code: str = "z") -> DataFrame:
    """Ranges of S for ranges of R: each end moved outwards by ``reach`` rows of S's sample."""
    order = Window.partitionBy("shift").orderBy("code")
    s = s_sample.select("shift", F.col(code).alias("code")).withColumns({"below": F.lag("code", reach).over(order), "above": F.lead("code", reach).over(order)})
    none = F.lit(None).cast("int")
    both = s.select("shift", "code", F.lit(1).alias("is_s"), F.struct("below", "above").alias("near"), none.alias("pid"), none.alias("end"))
    for k, end in enumerate(("low", "high")):
        both = both.unionByName(bounds.filter(F.col(end).isNotNull()).select("shift", F.col(end).alias("code"), F.lit(0).alias("is_s"), F.lit(None).alias("near"), "pid", F.lit(k).alias("end")))
    # Downwards along the codes, the last row of S met is the first one at or above a bound.
    down = Window.partitionBy("shift").orderBy(F.desc("code"), F.desc("is_s")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("near", F.last("near", ignorenulls=True).over(down)).filter("is_s = 0")
    found = met.groupBy("shift", "pid").agg(F.max(F.when(F.col("end") == 0, F.col("near.below"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("near.above"))).alias("high"))
    return bounds.select("shift", "pid").join(found, ["shift", "pid"], "left")


def in_range(code: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (code >= low)) & (high.isNull() | (code < high))


def route(rows: DataFrame, bounds: DataFrame, code: str = "z") -> DataFrame:
    """Rows with the pid of every range that holds their code (padded ranges overlap, so maybe several)."""
    r, b = rows.alias("r"), F.broadcast(bounds).alias("b")
    return r.join(b, (F.col("r.shift") == F.col("b.shift")) & in_range(F.col(f"r.{code}"), F.col("b.low"), F.col("b.high"))).select("r.*", "b.pid")


def sampled_bounds(coded: DataFrame, partitions: int, epsilon: float, seed: int = 17) -> DataFrame:
    """(shift, bounds) as ``quantile_bounds`` gives them, from independent samples of R and S.

    ``coded`` has is_r, shift and z. Each set is drawn at the rate that its size and ``epsilon`` give; the ranks of the
    cuts in the samples are those of ``estimator_index``. The driver gets two counts.
    """
    n = {r.is_r: r["count"] for r in coded.groupBy("is_r", "shift").count().collect()}
    rates = {flag: sample_rate(rows, epsilon) for flag, rows in n.items()}
    drawn = bernoulli(coded, rates, "is_r", seed)
    rows, mean = sum(n.values()), sum(n[f] * rates[f] for f in n) / max(1, sum(n.values()))
    ranks = [estimator_index(i, rows, mean, partitions) for i in range(1, partitions + 1)] if rows else []
    ends = range_bounds(drawn.select("shift", "z"), ranks) if rows else coded.select("shift", F.col("z").alias("high")).limit(0)
    return ends.filter("high IS NOT NULL").groupBy("shift").agg(F.array_sort(F.collect_set("high")).alias("bounds"))


def partitioned(rows: DataFrame, partitions: int, code: str = "z") -> DataFrame:
    """Routed rows, those of one range in one partition, in order of their codes, then ids."""
    return rows.repartition(partitions, "shift", "pid").sortWithinPartitions("shift", "pid", code, "id")


def quantile_bounds(coded: DataFrame, partitions: int, code: str = "z", accuracy: int = 10000) -> DataFrame:
    """(shift, bounds): ascending inner bounds of about equal parts of each shift's codes, found in one pass.

    Codes that are strings are cut at the exact quantiles of a hash sample instead.
    """
    if dict(coded.dtypes)[code] == "bigint":
        cuts = [i / partitions for i in range(1, partitions)] or [0.5]
        return coded.groupBy("shift").agg(F.array_distinct(F.percentile_approx(code, cuts, accuracy)).alias("bounds"))
    drawn = coded.filter(F.pmod(F.xxhash64(code), F.lit(64)) == 0).select("shift", code)
    part = F.ntile(partitions).over(Window.partitionBy("shift").orderBy(code))
    return drawn.withColumn("part", part).groupBy("shift", "part").agg(F.max(code).alias("c")).groupBy("shift").agg(F.sort_array(F.collect_list("c")).alias("bounds"))
