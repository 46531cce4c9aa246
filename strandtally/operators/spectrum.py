"""Spectra: exact or estimated, without keys from the counters alone, and from a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.functions import dna

METHOD = "compound_poisson_counter_deconvolution"


def spectrum(estimates: DataFrame, column: str = "estimate") -> DataFrame:
    """(estimated_count, kmers), ascending."""
    return estimates.groupBy(F.col(column).alias("estimated_count")).agg(F.count("*").alias("kmers")).orderBy("estimated_count")


def spectrum_totals(estimates: DataFrame) -> DataFrame:
    """(estimated_count, kmers, windows): the spectrum with the windows that its k-mers have, from (kmer, n, estimate)."""
    return estimates.groupBy(F.col("estimate").alias("estimated_count")).agg(F.count("*").alias("kmers"), F.sum("n").alias("windows"))


def deconvolve(histogram: Sequence[tuple[int, int]], n_hashes: int, most: int) -> list[float]:
    """Expected numbers of keys of abundance 1..most from (counter value, counters).

    The counters are taken as a compound Poisson distribution; its logarithm's
    power series gives the rates.  Values above `most` count in the total only.
    Empty if `most` is 0 or no counter is empty; zeros if there are no counters.
    """
    if most <= 0:
        return []
    total = sum(n for _, n in histogram)
    if not total:
        return [0.0] * most
    share = [0.0] * (most + 1)
    for value, n in histogram:
        if value <= most:
            share[value] += n / total
    if not share[0]:
        return []
    q = [x / share[0] for x in share]
    c = [0.0] * (most + 1)
    for n in range(1, most + 1):
        c[n] = q[n] - sum(j * c[j] * q[n - j] for j in range(1, n)) / n
    return [max(0.0, total * x / n_hashes) for x in c[1:]]


MOST = (1 << 63) - 1


def half_away(x: float) -> int:
    """Rounded half away from zero, within a BIGINT."""
    if abs(x) >= MOST:
        return MOST if x > 0 else -MOST
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def count_hint(histogram: Sequence[tuple[int, int]], n_hashes: int, most: int = 255) -> int:
    return max(1, half_away(sum(deconvolve(histogram, n_hashes, most))))


def filter_only(histogram: Sequence[tuple[int, int]], n_hashes: int, most: int, hint: int) -> list[tuple[int, int]]:
    """(abundance, keys) for 1..most, scaled to the hint; where deconvolution finds nothing, the positive counters are scaled."""
    found = deconvolve(histogram, n_hashes, most)
    total = sum(found)
    if total > 0:
        return [(i + 1, half_away(x * hint / total)) for i, x in enumerate(found)]
    held = dict(histogram)
    positive = sum(n for v, n in histogram if v > 0)
    return [(v, half_away(hint * held.get(v, 0) / positive) if positive else 0) for v in range(1, most + 1)]


def collected(histogram: DataFrame) -> list[tuple[int, int]]:
    """A histogram on the driver; it should be one of counter_histogram() with a limit, whose rows that bounds."""
    return sorted((r["counter_value"], r["counters"]) for r in histogram.collect())


def filter_only_spectrum(spark: SparkSession, histogram: DataFrame, n_hashes: int, most: int = 255, hint: int | None = None) -> DataFrame:
    """(estimated_count, estimated_kmers, method, kmer_count_hint); without a hint, the one of abundances up to `most`."""
    rows = collected(histogram)
    hint = count_hint(rows, n_hashes, most) if hint is None else hint
    out = [(v, n, METHOD, hint) for v, n in filter_only(rows, n_hashes, most, hint)]
    return spark.createDataFrame(out, "estimated_count long, estimated_kmers long, method string, kmer_count_hint long")


def sampled_reads(sample: DataFrame, k: int) -> DataFrame:
    """reads(record_id, sequence): a read of k bases for each row of the sample, so that only its k-mers are probed."""
    return sample.select("record_id", dna.kmer_text(F.col("kmer"), k).alias("sequence"))


def sampled_spectrum(estimates: DataFrame, total: int) -> DataFrame:
    """(estimated_count, sampled_kmers, linear_scaled_windows, estimated_distinct_kmers), from the sample's (kmer, n, estimate); total: the windows that it is drawn from."""
    rows = estimates.groupBy(F.col("estimate").alias("estimated_count")).agg(F.sum("n").alias("sampled_kmers"))
    # a row for each abundance: the size of the sample is their sum
    size = F.sum("sampled_kmers").over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("linear_scaled_windows", F.round(F.col("sampled_kmers") * F.lit(float(total)) / size).cast("long"))
    distinct = F.when(F.col("estimated_count") > 0, F.round(F.col("linear_scaled_windows") / F.col("estimated_count"))).otherwise(0).cast("long")
    return rows.select("estimated_count", "sampled_kmers", "linear_scaled_windows", distinct.alias("estimated_distinct_kmers")).orderBy("estimated_count")
