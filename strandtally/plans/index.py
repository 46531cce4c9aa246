"""Builder and index objects: increments in a log, counters packed by part, saved as Parquet that is bucketed by part."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.config import ConfigError, IndexFormatError, SketchConfig
from strandtally.operators import abundance as ab
from strandtally.operators import sketch, spectrum
from strandtally.operators.kmers import sample_limit, sampled_windows
from strandtally.plans.log import IndexLog
from strandtally.sources import files
from strandtally.sources.fastx import read_fastx, records

FORMAT, VERSION = "blocked-counting-sketch", 2


class IndexBuilder:
    """Collects reads in a log (see IndexLog); an addition takes effect as a whole or, if its input fails, not at all.

    Without a path the log is in the cluster's shared folder; with one it can be opened again, and added to.
    """

    def __init__(self, spark: SparkSession, config: SketchConfig | None = None, path: str | None = None):
        self.spark = spark
        self.log = IndexLog.create(spark, path or files.shared_dir(spark), config or SketchConfig())
        self.config = self.log.config

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexBuilder:
        out = cls.__new__(cls)
        out.spark, out.log = spark, IndexLog(spark, path)
        out.config = out.log.config
        return out

    @property
    def inserted_kmers(self) -> int:
        return self.log.total("inserted_kmers")

    @property
    def inserted_smers(self) -> int:
        return self.log.total("inserted_smers")

    @property
    def threads(self) -> int:
        return self.config.threads

    def set_threads(self, n: int) -> None:
        """Checked and kept in the configuration; Spark decides how many tasks run."""
        self.config = replace(self.config, threads=n)

    def clear_threads(self) -> None:
        self.config = replace(self.config, threads=SketchConfig().threads)

    def add(self, reads: DataFrame) -> dict:
        """Adds reads(record_id, sequence); returns records_processed, records_indexed, chunks, inserted_kmers, inserted_smers, super_kmers."""
        return self.log.add(reads)

    def add_sequence(self, sequence: str) -> int:
        reads = self.spark.createDataFrame([(0, sequence)], "record_id long, sequence string")
        return self.add(reads)["inserted_kmers"]

    def add_file(self, path: str) -> dict:
        return self.add(records(self.spark, path))

    def into_index(self) -> SketchIndex:
        """The counters so far, written: later additions don't change this index."""
        own = f"{self.log.path}/index-{self.log.state()['number']:08d}"
        if not files.names(self.spark, own):
            SketchIndex(self.spark, self.config, sketch.packed(self.log.increments(), self.config), self.inserted_kmers).save(own)
        return SketchIndex.load(self.spark, own)

    def drop(self) -> None:
        """Deletes the log, and indexes made from it that aren't saved elsewhere."""
        files.delete(self.spark, self.log.path)


class SketchIndex:
    """Frozen counters, packed by part (part, counters), with their configuration.

    inserted_kmers is None where it wasn't counted; buckets: how many the counters are stored in, by part.
    """

    def __init__(self, spark: SparkSession, config: SketchConfig, packed: DataFrame, inserted_kmers: int | None = None, buckets: int | None = None):
        self.spark, self.config, self.packed, self.inserted_kmers, self.buckets = spark, config, packed, inserted_kmers, buckets
        self.threads: int | None = None

    @classmethod
    def build(cls, spark: SparkSession, reads: DataFrame, config: SketchConfig | None = None) -> SketchIndex:
        """Without totals, so no action runs: a lazy plan from reads to counters."""
        config = config or SketchConfig()
        return cls(spark, config, sketch.packed(sketch.increments(reads, config), config))

    @property
    def counters(self) -> DataFrame:
        """(block, slot, cnt): the occupied counters."""
        return sketch.counters(self.packed, self.config)

    def set_threads(self, n: int) -> None:
        if n <= 0:
            raise ConfigError("threads must be positive")
        self.threads = n

    def clear_threads(self) -> None:
        self.threads = None

    def save(self, path: str) -> None:
        """Counters bucketed by part, then the metadata: without these a folder is no index."""
        parts = self.config.counter_slots // sketch.part_slots(self.config)
        buckets = min(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"saving_{hashlib.md5(path.encode()).hexdigest()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # of a save that was cut
        rows = self.packed.repartition(buckets, "part")
        rows.write.bucketBy(buckets, "part").sortBy("part").format("parquet").option("path", f"{path}/counters").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        meta = {"format": FORMAT, "version": VERSION, "config": self.config.as_dict(), "inserted_kmers": self.inserted_kmers, "buckets": buckets}
        files.publish(self.spark, f"{path}/meta.json", json.dumps(meta))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SketchIndex:
        if "meta.json" not in files.names(spark, path):
            raise IndexFormatError(f"no index at {path}")
        try:
            meta = json.loads(files.read_text(spark, f"{path}/meta.json"))
        except ValueError as error:
            raise IndexFormatError("metadata can't be read") from error
        if not isinstance(meta, dict) or meta.get("format") != FORMAT or meta.get("version") != VERSION:
            raise IndexFormatError("unknown format or version")
        try:
            config, buckets = SketchConfig(**meta["config"]), int(meta["buckets"])
        except (KeyError, TypeError, ValueError) as error:
            raise IndexFormatError(f"bad configuration: {error}") from error
        if not any(n.startswith("part-") for n in files.names(spark, f"{path}/counters")):
            # nothing was counted, so there are no files
            if meta.get("inserted_kmers"):
                raise IndexFormatError(f"no counters at {path}")
            return cls(spark, config, spark.createDataFrame([], sketch.PACKED), meta.get("inserted_kmers"))
        try:
            found = spark.read.parquet(f"{path}/counters").dtypes
        except Exception as error:
            raise IndexFormatError(f"no counters at {path}") from error
        if found != [("part", "int"), ("counters", "binary")]:
            raise IndexFormatError("bad counters")
        # the bucketing is known to the catalogue alone; the table is external, so dropping it leaves the files
        name = f"strandtally_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = path if ":" in path or path.startswith("/") else f"{spark._jvm.java.io.File(path).getAbsolutePath()}"
        spark.sql(f"CREATE TABLE {name} (part INT, counters BINARY) USING parquet CLUSTERED BY (part) SORTED BY (part) INTO {buckets} BUCKETS LOCATION '{place}/counters'")
        packed = spark.table(name)
        size = sketch.part_slots(config)
        bad = (F.col("part") < 0) | (F.col("part") >= config.counter_slots // size) | (F.octet_length("counters") != size * config.counter_bits // 8)
        out = packed.agg(F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias("bad"), F.count("*").alias("n"), F.count_distinct("part").alias("parts")).first()
        if out["bad"] or out["n"] != out["parts"]:
            raise IndexFormatError("counters don't fit the configuration")
        return cls(spark, config, packed, meta.get("inserted_kmers"), buckets)

    def estimates(self, reads: DataFrame) -> DataFrame:
        return sketch.kmer_estimates(reads, self.packed, self.config, self.buckets)

    def abundances(self, reads: DataFrame) -> DataFrame:
        known = sketch.window_estimates(reads, self.packed, self.config, self.buckets)
        return known.unionByName(ab.unknown_windows(reads, self.config.k))

    def summaries(self, reads: DataFrame) -> DataFrame:
        return ab.summary_of_counts(reads, sketch.window_estimates(reads, self.packed, self.config, self.buckets, summed_up=True), self.config.k)

    def report(self, reads: DataFrame) -> DataFrame:
        return ab.query_report(reads, self.estimates(reads), self.config.k)

    def stream_stats(self, reads: DataFrame) -> DataFrame:
        return ab.stream_stats(self.estimates(reads))

    def spectrum(self, reads: DataFrame) -> DataFrame:
        return spectrum.spectrum(self.estimates(reads))

    def counter_histogram(self, most: int | None = None) -> DataFrame:
        """With `most`, values above it stand together, so that there are at most most + 2 rows."""
        return sketch.counter_histogram(self.packed, self.config, most)

    def filter_only_spectrum(self, most: int = 255, hint: int | None = None) -> DataFrame:
        return spectrum.filter_only_spectrum(self.spark, self.counter_histogram(most), self.config.n_hashes, most, hint)

    def count_hint(self, most: int = 255) -> int:
        return spectrum.count_hint(spectrum.collected(self.counter_histogram(most)), self.config.n_hashes, most)

    def sampled_spectrum(self, reads: DataFrame, size: int = 1_000_000, seed: int = 1) -> DataFrame:
        return self.sampled(reads, size, seed)[0]

    def sampled(self, reads: DataFrame, size: int = 1_000_000, seed: int = 1) -> tuple[DataFrame, dict]:
        """The sampled spectrum, and figures: total_inserted_kmers and sampled_kmers.  Warns if the index holds another number of k-mers than it is sampled from."""
        if size <= 0:
            raise ValueError("sample size must be positive")
        k = self.config.k
        limit, total = sample_limit(reads, k, size, seed)
        if self.inserted_kmers is not None and self.inserted_kmers != total:
            warnings.warn(f"the sample is drawn from {total} windows, but {self.inserted_kmers} k-mers were indexed", stacklevel=2)
        sample = sampled_windows(reads, k, size, seed, (limit, total))
        found = spectrum.sampled_spectrum(self.estimates(spectrum.sampled_reads(sample, k)), total)
        return found, {"total_inserted_kmers": total, "sampled_kmers": min(size, total)}
