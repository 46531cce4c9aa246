"""An index under construction: additions in folders of their own, listed by manifests that are published last.

A manifest names every addition so far, with its figures.  The newest one counts; an addition
that fails, or whose driver is lost, is named by none and so has no effect.  Of two that are made at once from the same state one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandtally.config import ConfigError, IndexFormatError, SketchConfig
from strandtally.operators import sketch
from strandtally.sources import files

FORMAT, VERSION = "blocked-counting-sketch-log", 1


class IndexLog:
    def __init__(self, spark: SparkSession, path: str):
        """Opens a log."""
        self.spark, self.path = spark, path.rstrip("/")
        state = self.state()
        if state.get("format") != FORMAT or state.get("version") != VERSION:
            raise IndexFormatError("unknown format or version")
        try:
            self.config = SketchConfig(**state["config"])
        except (KeyError, TypeError, ConfigError) as error:
            raise IndexFormatError(f"bad configuration: {error}") from error

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: SketchConfig) -> IndexLog:
        if cls._numbers(spark, path):
            raise FileExistsError(path)
        cls._publish(spark, path.rstrip("/"), 0, {"format": FORMAT, "version": VERSION, "config": config.as_dict(), "additions": []})
        return cls(spark, path)

    @staticmethod
    def _numbers(spark: SparkSession, path: str) -> list[int]:
        return [int(n[len("manifest-") : -len(".json")]) for n in files.names(spark, path) if n.startswith("manifest-") and n.endswith(".json")]

    @staticmethod
    def _publish(spark: SparkSession, path: str, number: int, state: dict) -> None:
        files.publish(spark, f"{path}/manifest-{number:08d}.json", json.dumps(state))

    def state(self) -> dict:
        """The newest manifest, with its number."""
        numbers = self._numbers(self.spark, self.path)
        if not numbers:
            raise IndexFormatError(f"no index log at {self.path}")
        try:
            state = json.loads(files.read_text(self.spark, f"{self.path}/manifest-{max(numbers):08d}.json"))
        except ValueError as error:
            raise IndexFormatError("bad manifest") from error
        if not isinstance(state, dict):
            raise IndexFormatError("bad manifest")
        return state | {"number": max(numbers)}

    def add(self, reads: DataFrame) -> dict:
        """Counts reads(record_id, sequence), in one pass; returns the figures of sketch.TOTALS."""
        before = self.state()
        name = f"addition-{uuid.uuid4().hex}"
        own = f"{self.path}/{name}"
        try:
            sketch.increments(reads, self.config).write.parquet(own)
            report = sketch.totals(self._read([name])).first().asDict()
            number = before.pop("number") + 1
            self._publish(self.spark, self.path, number, before | {"additions": [*before["additions"], {"name": name, **report}]})
        except BaseException:
            files.delete(self.spark, own)
            raise
        return report

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], sketch.INCREMENTS)
        return self.spark.read.schema(sketch.INCREMENTS).parquet(*[f"{self.path}/{n}" for n in names])

    def increments(self) -> DataFrame:
        """All additions so far."""
        return self._read([a["name"] for a in self.state()["additions"]])

    def total(self, name: str) -> int:
        return sum(a[name] for a in self.state()["additions"])
