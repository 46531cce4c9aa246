"""Column functions on DNA text."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = string.ascii_lowercase + string.ascii_uppercase + " "
BLOCK = 512
AS_BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2 + "G"


def is_acgt(x: Column) -> Column:
    return x.rlike("^[ACGTacgt]+$")


def reverse_complement(x: Column) -> Column:
    return F.translate(F.reverse(x), "ACGT", "TGCA")


def canonical(x: Column) -> Column:
    """The lexicographically smaller of a k-mer and its reverse complement."""
    return F.least(x, reverse_complement(x))


def kmer_code(x: Column) -> Column:
    """Two bits a base, A < C < G < T; up to 31 bases fit a BIGINT."""
    return F.conv(F.translate(x, "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_text(code: Column, k: int) -> Column:
    """The k bases of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def text_as_dna(x: Column) -> Column:
    """Ordinary text as DNA: letters and blanks become bases, all else N."""
    return F.regexp_replace(F.translate(x, LETTERS, AS_BASES), "[^ACGT]", "N")


def valid_runs(x: Column, k: int) -> Column:
    """array<struct<run_start,run>>: the maximal runs of ACGT (in either case, made upper) of at least k bases.

    Runs are placed in blocks of BLOCK, whose first places are summed up before, as an array that grows is copied at each step.
    """
    runs = F.regexp_extract_all(x, F.lit("([ACGTacgt]+)"), F.lit(1))
    gaps = F.split(x, "[ACGTacgt]+", -1)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(runs)).alias("gaps"), runs.alias("runs"))
    rows = F.transform(rows, lambda r: F.struct(r["gaps"].alias("gaps"), r["runs"].alias("runs")))
    none = F.array().cast("array<struct<run_start:int,run:string>>")

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gaps"])
        own = F.when(F.length(row["runs"]) >= k, F.array(F.struct(start.alias("run_start"), F.upper(row["runs"]).alias("run")))).otherwise(none)
        return F.struct((start + F.length(row["runs"])).alias("at"), F.concat(state["out"], own).alias("out"))

    def placed(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def size_of(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, row: n + F.length(row["gaps"]) + F.length(row["runs"]))

    def starts(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.transform(blocks, size_of), zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks_of(rows: Column) -> Column:
        firsts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda first: F.slice(rows, first, F.lit(BLOCK)))

    return bound(bound(rows, blocks_of), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), placed)))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is evaluated once however often use names it."""
    return F.transform(F.array(x), use)[0]


def record_name(header: Column, index: Column) -> Column:
    """The header's first token; without one, record_<1-based index>."""
    token = F.regexp_extract(header, r"^(\S+)", 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.concat(F.lit("record_"), index.cast("string")))
