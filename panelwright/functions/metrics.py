"""What a run did: rows by stage, and the time it took."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RunMetrics:
    """Counts the rows of a frame by the values of a column while an action runs over it, at the cost of some additions a row.

    ``over`` gives the frame to act on (once), ``timed`` runs the action, ``table`` has the figures afterwards. Nothing is
    computed twice: the counts are those of the rows that the action itself saw.
    """

    def __init__(self, name: str, values: Sequence[str], column: str = "error_stage"):
        self.name, self.values, self.column = name, tuple(values), column
        self.observation = Observation(name)
        self.seconds: float | None = None

    def over(self, df: DataFrame) -> DataFrame:
        counts = [F.count_if(F.col(self.column) == v).alias(f"v{i}") for i, v in enumerate(self.values)]
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *counts)

    def timed(self, action: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.seconds = time.perf_counter() - began

    @property
    def rows(self) -> int:
        return self.observation.get["rows"]

    def counts(self) -> dict[str, int]:
        found = self.observation.get
        return {v: found[f"v{i}"] for i, v in enumerate(self.values)}

    def table(self, spark: SparkSession) -> DataFrame:
        """``run``, ``stage``, ``rows``, ``seconds`` (of the whole run): a row per value that occurred."""
        rows = [(self.name, v, n, self.seconds) for v, n in self.counts().items() if n]
        return spark.createDataFrame(rows, "run string, stage string, rows long, seconds double")
