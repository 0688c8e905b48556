"""Stages kept by what they depend on.

The name of a stage's folder is a hash of its settings, of the inputs' version and of the hashes of all stages before it. A stage whose folder is complete is read,
not run; a changed setting gives new folders to that stage and the ones after it and to no others. A folder counts only when a marker table written after it is there, so a run that died
half way is run again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from snapspan.plans.session import checkpoint_folder


class Stages:
    """``ran`` and ``read`` list the stages that were built and those found."""

    def __init__(self, spark: SparkSession, name: str, version: object, folder: str | None = None):
        self.spark, self.folder = spark, f"{(folder or checkpoint_folder(spark)).rstrip('/')}/{name}"
        self.hash = self._hash("", version)
        self.ran: list[str] = []
        self.read: list[str] = []

    @staticmethod
    def _hash(before: str, settings: object) -> str:
        return hashlib.sha1(json.dumps([before, settings], sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _kept(self, path: str) -> DataFrame | None:
        try:
            self.spark.read.parquet(f"{path}.done")
            return self.spark.read.parquet(path)
        except AnalysisException:
            return None

    def keep(self, name: str, settings: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, from its folder if it is there and complete, else built and written."""
        self.hash = self._hash(self.hash, [name, settings])
        path = f"{self.folder}/{name}-{self.hash}"
        known = self._kept(path)
        if known is not None:
            self.read.append(name)
            return known
        build().write.mode("overwrite").parquet(path)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
        self.ran.append(name)
        return self.spark.read.parquet(path)
