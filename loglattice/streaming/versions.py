"""State tables kept as immutable versions in a shared folder.

A version is a Parquet folder; it exists once its commit file does. Creating
that file fails if another writer was first, so a version is committed by one
writer only. Readers pin one version: later commits don't change what they see.
A commit may carry a note (a watermark, a cursor), which counts with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.session import created_alone, listed, read_text, removed


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[int]:
        return sorted(int(n) for n in listed(self.spark, f"{self.path}/_committed") if n.isdigit())

    def latest(self) -> int | None:
        done = self.committed()
        return done[-1] if done else None

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.latest() if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.path}/v{version}")

    def note(self, version: int | None = None) -> str:
        """What was noted with a version; empty where there is none."""
        version = self.latest() if version is None else version
        return "" if version is None else read_text(self.spark, f"{self.path}/_committed/{version}")

    def write(self, df: DataFrame, version: int, note: str = "") -> None:
        """Writes and commits a version; an uncommitted left-over of it is replaced, a committed one is kept as it is."""
        if version in self.committed():
            return
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        created_alone(self.spark, f"{self.path}/_committed/{version}", note)

    def drop_before(self, version: int) -> None:
        """Deletes versions older than one, commit file first, so that none is read half."""
        for old in self.committed():
            if old < version:
                for name in (f"_committed/{old}", f"v{old}"):
                    removed(self.spark, f"{self.path}/{name}")
