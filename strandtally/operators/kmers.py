"""Windows, k-mers, minimizers and segments of reads(record_id, sequence)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.config import SketchConfig
from strandtally.functions import dna
from strandtally.functions.hashing import mix64
from strandtally.operators.kernel import Scan, over_scans, per_scan
from strandtally.operators.packing import HELD_RECORDS, Layout, Opened, Records, cut, lanes, summed, whole_parts

#: parts of an exact count: enough for some thousand tasks, and few enough that a task's records of a part fill a row
PARTS = 1 << 12


def valid_runs(reads: DataFrame, k: int) -> DataFrame:
    """(record_id, run_start, run): built-in functions alone."""
    return reads.select("record_id", F.inline(dna.valid_runs(F.coalesce(F.col("sequence"), F.lit("")), k)))


def windows(reads: DataFrame, k: int) -> DataFrame:
    """(record_id, kmer_index, kmer): a row for each window; kmer is the canonical code, null where the window isn't ACGT alone."""

    def fn(ids: pa.Array, s: Scan) -> list:
        return [ids.take(pa.array(s.read[s.own])), s.place[s.own], pa.array(s.canonical(k)[s.at[s.own]].astype(np.int64), mask=~s.valid[s.own])]

    return per_scan(reads, k, "record_id long, kmer_index long, kmer long", fn)


def valid_windows(reads: DataFrame, k: int) -> DataFrame:
    """One row: n, the number of windows that are ACGT alone."""
    return per_scan(reads, k, "n long", lambda _, s: [np.array([s.valid.sum()], dtype=np.int64)]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def sample_ranks(ids: pa.Array, s: Scan, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid windows and their places in the order in which they are sampled: a hash of seed, read and window, below 2**63.  Null ids hash as -1."""
    at = np.flatnonzero(s.valid)
    own = ids.fill_null(-1).to_numpy().astype(np.int64)[s.read[at]]
    mixed = mix64((own + seed).view(np.uint64))
    return at, mix64(mixed ^ s.place[at].astype(np.uint64)) >> np.uint64(1)


def _coarse(rank: np.ndarray) -> np.ndarray:
    """The leading bits of a rank as a float: 64 steps for each power of two."""
    return (rank.astype(np.float64).view(np.int64) >> (52 - 6)).astype(np.int64)


def sample_limit(reads: DataFrame, k: int, size: int, seed: int = 1) -> tuple[int, int]:
    """(limit, number of valid windows): at least `size` windows (or all) have a coarse rank up to the limit, and about a 64th more than that.

    One pass; what reaches the driver is a row for each step, some 4,000 at most.
    """

    def fn(ids: pa.Array, s: Scan) -> list:
        return list(np.unique(_coarse(sample_ranks(ids, s, seed)[1]), return_counts=True))

    rows = per_scan(reads, k, "step long, n long", fn).groupBy("step").agg(F.sum("n").alias("n")).collect()
    seen, limit = 0, -1
    for r in sorted(rows, key=lambda r: r["step"]):
        if seen < size:
            limit = r["step"]
        seen += r["n"]
    return limit, seen


def sampled_windows(reads: DataFrame, k: int, size: int, seed: int = 1, found: tuple[int, int] | None = None) -> DataFrame:
    """(record_id, kmer_index, kmer): a uniform sample without replacement of valid windows, those that rank first, whatever the partitioning.

    Windows beyond a limit found in a pass before (by sample_limit, unless that is given) never leave the kernel, so the task that ranks the rest has little more than the sample.
    """
    if size <= 0:
        raise ValueError("sample size must be positive")
    limit, total = found or sample_limit(reads, k, size, seed)

    def fn(ids: pa.Array, s: Scan) -> list:
        at, rank = sample_ranks(ids, s, seed)
        some = _coarse(rank) <= limit
        at, rank = at[some], rank[some]
        return [ids.take(pa.array(s.read[at])), s.place[at], s.canonical(k)[s.at[at]].astype(np.int64), rank.view(np.int64)]

    rows = per_scan(reads, k, "record_id long, kmer_index long, kmer long, _rank long", fn)
    return (rows.orderBy("_rank", "record_id", "kmer_index").limit(size) if size < total else rows).drop("_rank")


def minimizer_width(k: int) -> int:
    """The minimizers by which exact counts are dealt: some two thirds of k, so that there are many and runs are long."""
    return max(1, min(k, 2 * k // 3))


def dealt(reads: DataFrame, k: int, m: int, parts: int) -> DataFrame:
    """(part, records, counts): packed super-k-mers by the hash of their minimizer, equal ones of a task summed."""
    layout = Layout(k, m)

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        records = Records(layout)
        for _, s in own:
            first, size, hashes = cut(s, m)
            if len(first):
                records.add((hashes % np.uint64(parts)).astype(np.int32), np.zeros(len(first), np.int64), size, lanes(s, first, size, layout))
            if records.n >= HELD_RECORDS:
                yield records.rows()
        if records.n:
            yield records.rows()

    return over_scans(reads, k, "part int, records binary, counts binary", make)


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n): exact counts of canonical k-mers.

    What is exchanged is packed super-k-mers, by minimizer; they are taken apart and counted where they arrive, a few parts
    at a time.  A part holds at most the k-mers of its minimizers, however often they occur, as counts are summed as they come.
    """
    m = minimizer_width(k)
    layout = Layout(k, m)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        for whole, rows in whole_parts(batches):
            records, n = opened(rows, layout)
            keys, record, _ = records.codes(k)
            keys, sums, _ = summed(keys, n[record])
            if held:
                keys, sums, _ = summed(np.concatenate([held[0], keys]), np.concatenate([held[1], sums]))
            held = None if whole else (keys, sums)
            if whole:
                for at in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000].view(np.int64)), pa.array(sums[at : at + 200_000])], names=["kmer", "n"])

    return dealt(reads, k, m, PARTS).repartition("part").sortWithinPartitions("part").mapInArrow(count, "kmer long, n long")


def opened(rows: list[pa.RecordBatch], layout: Layout, column: int = 1) -> tuple[Opened, np.ndarray]:
    """The records of some rows, and their counts (the column after them)."""
    records, counts = (b"".join(x for row in rows for x in row.column(i).to_pylist()) for i in (column, column + 1))
    return Opened(np.frombuffer(records, np.uint8), layout), np.frombuffer(counts, np.uint32).astype(np.int64)


def smers(reads: DataFrame, s: int) -> DataFrame:
    """(smer, n): exact counts of canonical s-mers over the valid windows of that width."""
    return kmer_counts(reads, s).withColumnRenamed("kmer", "smer")


def minimizers(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(record_id, kmer_index, minimizer_position, minimizer_hash) of valid windows; the hash as signed BIGINT."""

    def fn(ids: pa.Array, s: Scan) -> list:
        position, hashes = s.minimizers(config.m)
        v = s.valid
        return [ids.take(pa.array(s.read[v])), s.place[v], (position - s.at + s.place)[v], hashes[v].view(np.int64)]

    return per_scan(reads, config.k, "record_id long, kmer_index long, minimizer_position long, minimizer_hash long", fn)


def super_kmers(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(record_id, first_window, n_windows, block).  A super-k-mer that a cut of its read divides is put out once, when it has ended."""

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        held: list[pa.Array | np.ndarray] | None = None
        for ids, s in own:
            first, size, hashes, carried = s.segments(config.m, config.segmentation == "value")
            if carried:
                held[2] = held[2] + carried
            if not len(first):
                continue
            if held:
                yield held
            rows = [ids.take(pa.array(s.read[first])), s.place[first], size, (hashes & np.uint64(config.blocks - 1)).astype(np.int64)]
            # the last one may go on
            held = [x[-1:] for x in rows]
            yield [x[:-1] for x in rows]
        if held:
            yield held

    return over_scans(reads, config.k, "record_id long, first_window long, n_windows long, block long", make)
