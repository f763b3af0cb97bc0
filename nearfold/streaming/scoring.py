"""Predictions for a stream of query rows against a fixed training set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from nearfold.functions.prepare import extent, lifted
from nearfold.operators import predict
from nearfold.plans import sessions
from nearfold.plans.config import KnnConfig


@dataclass(frozen=True)
class Scorer:
    """Scores one micro-batch after another against S, a stored table, which is scaled and cut to integers once.

    Query rows beyond the bounds of S have their true distances; only their place on the curve is that of the bound.
    """

    s: DataFrame
    config: KnnConfig
    path: str

    @cached_property
    def training(self) -> tuple[DataFrame, list[int]]:
        """S above zero, and the minima that were subtracted."""
        s = sessions.points(self.s, self.config)
        least, most = extent(s.select("coords"), self.config.dimension)
        sessions.check_fit(least, most, self.config)
        return s.withColumn("coords", lifted(F.col("coords"), least)).persist(StorageLevel.MEMORY_AND_DISK), least

    def predictions(self, batch: DataFrame) -> DataFrame:
        s, least = self.training
        placed = sessions.points(batch, self.config).withColumn("coords", lifted(F.col("coords"), least))
        found = sessions.edges(placed, s, self.config)
        return predict.classify(found, s, list(range(1, self.config.classes + 1))) if self.config.task == "classify" else predict.regress(found, s)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Write the batch's predictions to a folder of its own, so that a repeated batch replaces itself."""
        self.predictions(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def score_stream(rows: DataFrame, s: DataFrame, config: KnnConfig, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, yet to be started, that scores a stream of (id, features) into ``path``."""
    return rows.writeStream.foreachBatch(Scorer(s, config, path)).option("checkpointLocation", checkpoint)
