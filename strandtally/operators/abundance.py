"""Abundance by window, by record and over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.operators.kernel import Scan, per_scan
from strandtally.operators.kmers import windows


def abundance_windows(reads: DataFrame, estimates: DataFrame, k: int) -> DataFrame:
    """(record_id, kmer_index, abundance): null where the window isn't ACGT alone.

    estimates: (kmer, estimate) of at least the k-mers of reads.
    """
    every = windows(reads, k)
    known = every.where("kmer is not null").join(estimates.select("kmer", "estimate"), "kmer").select("record_id", "kmer_index", F.col("estimate").alias("abundance"))
    return known.unionByName(every.where("kmer is null").select("record_id", "kmer_index", F.lit(None).cast("long").alias("abundance")))


def unknown_windows(reads: DataFrame, k: int) -> DataFrame:
    """(record_id, kmer_index, abundance): the windows that aren't ACGT alone, abundance null."""

    def fn(ids: pa.Array, s: Scan) -> list:
        at = np.flatnonzero(s.own & ~s.known)
        return [ids.take(pa.array(s.read[at])), s.place[at], pa.nulls(len(at), pa.int64())]

    return per_scan(reads, k, "record_id long, kmer_index long, abundance long", fn)


def summary_of_counts(reads: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """What sequence_summary() says, from found(record_id, abundance, n): how many windows have an abundance, in any number of rows."""
    sizes = F.greatest(F.octet_length(F.coalesce("sequence", F.lit(""))) - (k - 1), F.lit(0)).cast("long")
    none = F.lit(None).cast("long")
    both = found.select("record_id", "abundance", "n", none.alias("windows")).unionByName(reads.select("record_id", none.alias("abundance"), none.alias("n"), sizes.alias("windows")))
    valid = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    mean = F.sum((F.col("abundance") * F.col("n")).cast("decimal(38,0)")).cast("double") / F.sum("n")
    by = both.groupBy(F.col("record_id").alias("_record")).agg(F.sum("windows").alias("total_windows"), valid.alias("valid_kmers"), mean.alias("mean_abundance"), F.percentile("abundance", F.lit(0.5), F.coalesce("n", F.lit(0))).alias("median_abundance"))
    rows = reads.select("record_id", F.length(F.coalesce("sequence", F.lit(""))).cast("long").alias("length"))
    return rows.join(by, F.col("record_id").eqNullSafe(F.col("_record")), "left").select("record_id", "length", "total_windows", "valid_kmers", "mean_abundance", "median_abundance")


def sequence_summary(reads: DataFrame, abundance: DataFrame) -> DataFrame:
    """(record_id, length, total_windows, valid_kmers, mean_abundance, median_abundance); the last two null without valid windows.  Windows of equal ids, null ids among them, are taken together."""
    by = abundance.groupBy("record_id").agg(F.count("*").alias("total_windows"), F.count("abundance").alias("valid_kmers"), F.avg("abundance").alias("mean_abundance"), F.median("abundance").alias("median_abundance"))
    sizes = reads.select("record_id", F.length(F.coalesce("sequence", F.lit(""))).cast("long").alias("length"))
    zero = F.lit(0).cast("long")
    by = by.withColumnRenamed("record_id", "_record")
    return sizes.join(by, F.col("record_id").eqNullSafe(F.col("_record")), "left").select("record_id", "length", F.coalesce("total_windows", zero).alias("total_windows"), F.coalesce("valid_kmers", zero).alias("valid_kmers"), "mean_abundance", "median_abundance")


def query_report(reads: DataFrame, estimates: DataFrame, k: int) -> DataFrame:
    """One row: records_processed, total_windows, valid_kmers, positive_estimates, estimate_checksum."""
    size = F.length(F.coalesce("sequence", F.lit("")))
    total = reads.agg(F.count("*").alias("records_processed"), F.coalesce(F.sum(F.greatest(size - k + 1, F.lit(0))), F.lit(0)).cast("long").alias("total_windows"))
    return total.crossJoin(F.broadcast(stream_stats(estimates))).withColumnRenamed("queried_kmers", "valid_kmers")  # one row each


def stream_stats(estimates: DataFrame) -> DataFrame:
    """One row: queried_kmers, positive_estimates, estimate_checksum, from (kmer, n, estimate)."""
    return estimates.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("queried_kmers"),
        F.coalesce(F.sum(F.when(F.col("estimate") > 0, F.col("n"))), F.lit(0)).cast("long").alias("positive_estimates"),
        F.coalesce(F.sum((F.col("n") * F.col("estimate")).cast("decimal(38,0)")), F.lit(0)).cast("long").alias("estimate_checksum"),
    )
