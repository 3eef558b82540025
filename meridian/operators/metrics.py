"""What each stage of a run has seen, measured while the run goes on: no pass of its own."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class StageMetrics:
    """Rows and present values of watched frames, and seconds of timed steps."""

    def __init__(self):
        self._watched: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watch(self, stage: str, df: DataFrame, *columns: str) -> DataFrame:
        """``df``, whose rows, and non-null values of each column, are counted as they pass."""
        self._watched[stage] = seen = Observation(stage)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))

    def timed(self, stage: str, action):
        """The result of ``action()``; its seconds are kept."""
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.seconds[stage] = time.perf_counter() - began

    def report(self) -> dict[str, dict[str, int]]:
        """Counts of each watched stage; waits for an action over it."""
        return {stage: dict(seen.get) for stage, seen in self._watched.items()}
