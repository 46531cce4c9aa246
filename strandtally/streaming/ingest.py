"""Incremental ingest: each micro-batch's increments are a folder of their own, so a replayed batch replaces itself.

    path/batches/batch_id=N      increments of a batch
    path/compacted/upto=N        the sum of all batches up to N

A compaction appears whole (its folder is renamed to its name last) and replaces the batches up to its number, whether
these are deleted or not, and whether one is replayed or not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandtally.config import SketchConfig
from strandtally.operators import sketch
from strandtally.sources import files


def ingest(reads: DataFrame, path: str, checkpoint: str, config: SketchConfig, available_now: bool = True) -> StreamingQuery:
    """Starts counting a streaming reads(record_id, sequence) into increments under path."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, config)

    writer = reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def add_batch(batch: DataFrame, number: int, path: str, config: SketchConfig) -> None:
    """A batch's increments, in place of those of an earlier try; nothing if a compaction holds it."""
    if number > compacted_upto(batch.sparkSession, path):
        sketch.increments(batch, config).write.mode("overwrite").parquet(f"{path}/batches/batch_id={number}")


def compacted_upto(spark: SparkSession, path: str) -> int:
    """The last batch of the newest compaction, -1 without one."""
    return max((int(n.removeprefix("upto=")) for n in files.names(spark, f"{path}/compacted") if n.startswith("upto=")), default=-1)


def increments_upto(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The increments of all batches, or of those up to one: the newest compaction that isn't beyond it, and the batches after that."""
    found = [int(n.removeprefix("upto=")) for n in files.names(spark, f"{path}/compacted") if n.startswith("upto=")]
    base = max((n for n in found if last is None or n <= last), default=-1)
    rows = spark.createDataFrame([], sketch.INCREMENTS)
    if base >= 0:
        rows = spark.read.schema(sketch.INCREMENTS).parquet(f"{path}/compacted/upto={base}")
    batches = [int(n.removeprefix("batch_id=")) for n in files.names(spark, f"{path}/batches") if n.startswith("batch_id=")]
    own = [n for n in batches if n > base and (last is None or n <= last)]
    if own:
        rows = rows.unionByName(spark.read.schema(sketch.INCREMENTS).parquet(*[f"{path}/batches/batch_id={n}" for n in sorted(own)]))
    return rows


def ingested(spark: SparkSession, path: str, config: SketchConfig) -> DataFrame:
    """(block, slot, cnt): the counters over all batches so far."""
    return sketch.counters(sketch.packed(increments_upto(spark, path), config), config)


def ingested_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: the figures of all batches so far."""
    return sketch.totals(increments_upto(spark, path))


def compact(spark: SparkSession, path: str, upto: int, config: SketchConfig, delete: bool = True) -> None:
    """Sums the batches up to a number into one folder, and deletes what that replaces.  The sums stay unsaturated, so that later batches add to them."""
    rows = increments_upto(spark, path, upto)
    draft = f"{path}/.draft-{uuid.uuid4().hex}"
    sketch.summed_increments(rows, config).write.parquet(draft)
    files.make(spark, f"{path}/compacted")
    files.rename(spark, draft, f"{path}/compacted/upto={upto}")
    if delete:
        for name in files.names(spark, f"{path}/batches"):
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= upto:
                files.delete(spark, f"{path}/batches/{name}")
        for name in files.names(spark, f"{path}/compacted"):
            if name.startswith("upto=") and int(name.removeprefix("upto=")) < upto:
                files.delete(spark, f"{path}/compacted/{name}")
