"""Tables written once and read again, which cut lineage and outlive executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.sources.tables import materialize, release, shared_dir

__all__ = ["doc_key", "fresh", "keep_keys", "materialize", "release", "shared_dir", "table"]


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name`` with as many underscores as it takes to clash with no column; Spark minds no case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key() -> Column:
    """doc_id as BIGINT; null where it is no whole number."""
    return F.col("doc_id").try_cast("bigint").alias("doc_id")


#: Rows of one BIGINT that may be broadcast (about 64 MB); larger key sets are joined by a shuffle.
BROADCAST_KEYS = 4_000_000


def keep_keys(df: DataFrame, keys: DataFrame, columns: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a materialized table of keys, broadcast only after its rows are counted."""
    if keys.count() * (len(columns) if isinstance(columns, list) else 1) <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, columns, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
