"""Text outputs: spectra as TSV, reports as CSV.  Small tables are written as one file."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six_places(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string("%.6f", x.cast("double")))


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """Fields with a separator, quote or line end are quoted, quotes doubled; nulls are blank."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("sep", sep).option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_spectrum(spectrum: DataFrame, path: str | None = None) -> None:
    """(estimated_count, kmers) as TSV; to standard output without a path (a row for each abundance: at most the counter's maximum)."""
    rows = spectrum.select("estimated_count", "kmers").orderBy("estimated_count")
    if path is not None:
        write_csv(rows, path, "\t", single=True)
        return
    print("estimated_count\tkmers")
    for r in rows.toLocalIterator():
        print(f"{r['estimated_count']}\t{r['kmers']}")


def fast_rows(summary: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each record, in input order."""
    rows = summary.join(names.select("record_id", "name"), "record_id").orderBy("record_id")
    return rows.select(F.col("name").alias("sequence"), "length", "total_windows", "valid_kmers", six_places(F.col("mean_abundance")).alias("mean_abundance"), six_places(F.col("median_abundance")).alias("median_abundance"))


def slow_rows(abundance: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each window, in input order."""
    rows = abundance.join(names.select("record_id", "name"), "record_id").orderBy("record_id", "kmer_index")
    return rows.select(F.col("name").alias("sequence"), "kmer_index", "abundance")


def metrics_line(row: dict) -> str:
    line = "\t".join(f"{k}: {v}" for k, v in row.items())
    print(line, file=sys.stderr)
    return line
