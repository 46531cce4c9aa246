"""The blocked counting sketch: packed increments summed by part, and estimates by one exchange of super-k-mers to the parts.

The counters are cut into parts of whole blocks.  A part's counters are one binary row, so an index is a row for each part,
and a part's probes meet them once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.config import SketchConfig
from strandtally.operators.kernel import Scan, chains, inserted, over_scans
from strandtally.operators.kmers import opened
from strandtally.operators.packing import HELD_RECORDS, Layout, Opened, Records, binary, cut, lanes, summed, whole_parts

DENSE_SLOTS = 1 << 22
HELD_ADDRESSES = 1 << 22
TOTAL = -1
TOTALS = ["records_processed", "records_indexed", "chunks", "inserted_kmers", "inserted_smers", "super_kmers"]
INCREMENTS = "part int, slots binary, counts binary"
PACKED = "part int, counters binary"


def part_slots(config: SketchConfig) -> int:
    """Counters of a part: whole blocks, 2**16 or a 64th of all if that is less."""
    return max(config.block_slots, min(1 << 16, config.counter_slots >> 6))


def sketch_layout(config: SketchConfig) -> Layout:
    return Layout(config.k, config.m, part_slots(config) // config.block_slots)


class Totals:
    """Figures of a task's insertions; pieces of one read, which follow each other, count as one."""

    def __init__(self, config: SketchConfig):
        self.config = config
        self.sums = np.zeros(len(TOTALS), np.int64)
        self.indexed = False  # whether the read that was cut last has a valid window so far

    def add(self, s: Scan) -> None:
        first, size, _, carried = s.segments(self.config.m, self.config.segmentation == "value")
        run = s.known.copy()
        run[1:] &= ~(s.known[:-1] & (s.read[1:] == s.read[:-1]))
        good = np.bincount(s.read[s.valid], minlength=len(s.lead)) > 0
        read = np.cumsum(s.starts == 0)  # 0: the read before goes on
        some = np.unique(read[good])
        indexed = len(some) - int(self.indexed and 0 in some)
        self.indexed = bool(len(some) and some[-1] == read[-1]) or (self.indexed and read[-1] == 0)
        kmers = size.sum() + carried
        self.sums += [(s.starts == 0).sum(), indexed, (run & s.own).sum(), kmers, kmers + len(size) * (self.config.k - self.config.s), len(size)]


def increments(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(part, slots, counts): partial, not yet saturated counts of a part's slots (both as 32-bit numbers; no slots: all of them in order).

    A task's last row, of part TOTAL, has its figures instead, as 64-bit numbers in the order of TOTALS, so that reads are scanned once.
    A small sketch is counted in one dense array for each task, a large one by some millions of addresses at a time.
    """
    size = part_slots(config)

    def addresses(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        block, smer = inserted(scan, config)
        order = np.lexsort((smer, block))
        block, smer = block[order], smer[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (smer[1:] != smer[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(block)))
        return (block[at, None] * config.block_slots + chains(smer[at], config)).reshape(-1), np.repeat(n, config.n_hashes)

    def sparse(where: np.ndarray, n: np.ndarray) -> Iterator[list]:
        where, n, _ = summed(where, n)
        # counts beyond 32 bits are put out in several rows
        while len(where):
            parts, at = np.unique(where // size, return_index=True)
            ends = np.append(at, len(where)) * 4
            some = np.minimum(n, (1 << 32) - 1)
            yield [parts.astype(np.int32), binary((where % size).astype(np.uint32).view(np.uint8), ends), binary(some.astype(np.uint32).view(np.uint8), ends)]
            where, n = where[n > some], (n - some)[n > some]

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kept = 0
        total = np.zeros(config.counter_slots, np.int64) if config.counter_slots <= DENSE_SLOTS else None
        figures = Totals(config)
        for _, scan in own:
            figures.add(scan)
            where, n = addresses(scan)
            if total is not None:
                total += np.bincount(where, weights=n, minlength=len(total)).astype(np.int64)
                continue
            held.append((where, n))
            kept += len(where)
            if kept >= HELD_ADDRESSES:
                yield from sparse(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, kept = [], 0
        if held:
            yield from sparse(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if total is not None and total.any():
            where = np.flatnonzero(total)
            if total.max() < 1 << 32 and 2 * len(where) > len(total):
                n_parts = len(total) // size
                yield [np.arange(n_parts, dtype=np.int32), binary(np.zeros(0, np.uint8), np.zeros(n_parts + 1)), binary(total.astype(np.uint32).view(np.uint8), np.arange(n_parts + 1) * size * 4)]
            else:
                yield from sparse(where, total[where])
        sums = figures.sums.view(np.uint8)
        yield [np.array([TOTAL], np.int32), binary(sums[:0], np.zeros(2)), binary(sums, np.array([0, len(sums)]))]

    return over_scans(reads, config.k, INCREMENTS, make)


def totals(partial: DataFrame) -> DataFrame:
    """One row: records_processed, records_indexed, chunks (runs of k valid bases or more), inserted_kmers, inserted_smers, super_kmers; from increments()."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, len(TOTALS))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.T], names=TOTALS)

    rows = partial.where(F.col("part") == TOTAL).select("counts").mapInArrow(read, ", ".join(f"{n} long" for n in TOTALS))
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in TOTALS])


def _sums(partial: DataFrame, config: SketchConfig, schema: str, rows_of: Callable[[int, np.ndarray], Iterator[list]]) -> DataFrame:
    """Rows of each part's sums over increments(), one part at a time."""
    size, names = part_slots(config), [x.split()[0] for x in schema.split(",")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(size, np.int64)
        for batch in batches:
            for part, slots, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != at:
                    if at is not None:
                        yield from (pa.RecordBatch.from_arrays(x, names=names) for x in rows_of(at, total))
                    at, total = part, np.zeros(size, np.int64)
                if slots:
                    total[np.frombuffer(slots, np.uint32)] += np.frombuffer(n, np.uint32)
                else:
                    total += np.frombuffer(n, np.uint32)
        if at is not None:
            yield from (pa.RecordBatch.from_arrays(x, names=names) for x in rows_of(at, total))

    return partial.where(F.col("part") != TOTAL).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema)


def packed(partial: DataFrame, config: SketchConfig) -> DataFrame:
    """(part, counters): a row for each part that isn't empty, its saturated counters by slot at their own width."""
    kind = f"<u{config.counter_bits // 8}"

    def rows(part: int, total: np.ndarray) -> Iterator[list]:
        yield [pa.array([part], pa.int32()), pa.array([np.minimum(total, config.counter_max).astype(kind).tobytes()], pa.binary())]

    return _sums(partial, config, PACKED, rows)


def summed_increments(partial: DataFrame, config: SketchConfig) -> DataFrame:
    """Increments that say the same in fewer rows: each part's sums, not saturated, and one row of figures."""

    def rows(part: int, total: np.ndarray) -> Iterator[list]:
        slot = np.flatnonzero(total)
        n = total[slot]
        while len(slot):  # counts beyond 32 bits in several rows
            some = np.minimum(n, (1 << 32) - 1)
            yield [pa.array([part], pa.int32()), pa.array([slot.astype(np.uint32).tobytes()], pa.binary()), pa.array([some.astype(np.uint32).tobytes()], pa.binary())]
            slot, n = slot[n > some], (n - some)[n > some]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums = np.array([row[n] for n in TOTALS], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TOTAL], pa.int32()), pa.array([b""], pa.binary()), pa.array([sums], pa.binary())], names=["part", "slots", "counts"])

    return _sums(partial, config, INCREMENTS, rows).unionByName(totals(partial).mapInArrow(figures, INCREMENTS))


def counters(index: DataFrame, config: SketchConfig) -> DataFrame:
    """(block, slot, cnt): the occupied counters of packed ones."""
    size, kind = part_slots(config), f"<u{config.counter_bits // 8}"

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, kind)
                slot = np.flatnonzero(own)
                where = slot + part * size
                yield pa.RecordBatch.from_arrays([pa.array(where // config.block_slots), pa.array((where % config.block_slots).astype(np.int32)), pa.array(own[slot].astype(np.int64))], names=["block", "slot", "cnt"])

    return index.mapInArrow(take_apart, "block long, slot int, cnt long")


def inserted_totals(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """What totals() would say, without the increments."""

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        figures = Totals(config)
        for _, s in own:
            figures.add(s)
        yield [np.array([x]) for x in figures.sums]

    rows = over_scans(reads, config.k, ", ".join(f"{n} long" for n in TOTALS), make)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in TOTALS])


def probes(reads: DataFrame, config: SketchConfig, places: bool = False) -> DataFrame:
    """(part, records, counts): packed super-k-mers by the part of their block, equal ones of a task summed; with places (part, records, ids, places): each with its read and first window."""
    layout, size = sketch_layout(config), part_slots(config) // config.block_slots

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        records = Records(layout, repeats=not places)
        for ids, s in own:
            first, n, hashes = cut(s, config.m)
            if len(first):
                block = (hashes & np.uint64(config.blocks - 1)).astype(np.int64)
                own_ids = ids.take(pa.array(s.read[first])) if places else None
                # a null id is told by a negative place
                more = [own_ids.fill_null(0).to_numpy(), np.where(own_ids.is_null(), ~s.place[first], s.place[first])] if places else []
                records.add((block // size).astype(np.int32), block % size, n, lanes(s, first, n, layout), *more)
            if records.n >= HELD_RECORDS:
                yield records.rows()
        if records.n:
            yield records.rows()

    return over_scans(reads, config.k, "part int, records binary, ids binary, places binary" if places else "part int, records binary, counts binary", make)


def met(asked: DataFrame, index: DataFrame, buckets: int | None) -> DataFrame:
    """Rows of probes() by part with a last column of their part's counters: once, at the first of them, null elsewhere.

    The one exchange of the probes; the index, a row for each part, moves only if it isn't stored by part in that many buckets.
    """
    moved = asked.repartition(buckets, "part") if buckets else asked.repartition("part")
    lead = F.row_number().over(W.partitionBy("part").orderBy("part"))
    joined = moved.withColumn("_n", lead).join(index.hint("merge"), "part", "left")
    return joined.select(*asked.columns, F.when(F.col("_n") == 1, F.col("counters")).alias("counters"))


class Tables:
    """Counters of the parts at hand, side by side; parts that the index doesn't have share one table of zeros."""

    def __init__(self, config: SketchConfig):
        self.config, self.size = config, part_slots(config)
        self.kind = f"<u{config.counter_bits // 8}"
        self.none = np.zeros(self.size, self.kind)
        self.part: int | None = None
        self.own: np.ndarray | None = None  # of the last part: its later rows come without

    def of(self, rows: list[pa.RecordBatch], each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counters, and for each record (each: how many a row has) where its part's begin."""
        parts = [p for row in rows for p in row.column(0).to_pylist()]
        found = [x for row in rows for x in row.column(row.num_columns - 1).to_pylist()]
        tables, at, where = [self.none], [], 0
        if parts and parts[0] == self.part and self.own is not None:
            tables.append(self.own)
            where = 1
        for part, data in zip(parts, found, strict=True):
            if part != self.part:
                self.part, self.own, where = part, None, 0
            if data is not None:
                self.own = np.frombuffer(data, self.kind)
                tables.append(self.own)
                where = len(tables) - 1
            at.append(where)
        return np.concatenate(tables), np.repeat(np.array(at, np.int64), each) * self.size

    def estimates(self, records: Opened, rows: list[pa.RecordBatch], each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, records, places and estimates of all windows of the records: the least counter of the s-mers of each."""
        c = self.config
        table, base = self.of(rows, each)
        smer, record, _ = records.codes(c.s)
        start = (base + records.block * c.block_slots)[record]
        least = None
        slots = chains(smer, c)
        for i in range(c.n_hashes):
            own = table[start + slots[:, i]]
            least = own if least is None else np.minimum(least, own)
        kmer, record, place = records.codes(c.k)
        n = records.size + (c.k - c.s)
        first = (np.cumsum(n) - n)[record] + place
        best = least[first]
        for j in range(1, c.k - c.s + 1):
            best = np.minimum(best, least[first + j])
        return kmer, record, place, best.astype(np.int64)


def kmer_estimates(reads: DataFrame, index: DataFrame, config: SketchConfig, buckets: int | None = None) -> DataFrame:
    """(kmer, n, estimate) of the distinct k-mers of reads; index: packed counters.

    A k-mer's block depends on the k-mer alone, so all its windows meet in one part; a k-mer's estimate is the least of its slots, 0 if one is empty.
    """
    layout = sketch_layout(config)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = Tables(config), None
        for whole, rows in whole_parts(batches):
            records, n = opened(rows, layout)
            each = np.array([len(x) // layout.size for row in rows for x in row.column(1).to_pylist()])
            kmer, record, _, found = tables.estimates(records, rows, each)
            kmer, sums, at = summed(kmer, n[record])
            found = found[at]
            if held:
                kmer, found = np.concatenate([held[0], kmer]), np.concatenate([held[2], found])
                kmer, sums, at = summed(kmer, np.concatenate([held[1], sums]))
                found = found[at]
            held = None if whole else (kmer, sums, found)
            if whole:
                for at in range(0, len(kmer), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (kmer.view(np.int64), sums, found)], names=["kmer", "n", "estimate"])

    return met(probes(reads, config), index, buckets).mapInArrow(answer, "kmer long, n long, estimate long")


def window_estimates(reads: DataFrame, index: DataFrame, config: SketchConfig, buckets: int | None = None, summed_up: bool = False) -> DataFrame:
    """(record_id, kmer_index, abundance) of the windows that are ACGT alone; or summed up (record_id, abundance, n): how many windows of a read have an abundance, by part.

    Super-k-mers travel with their reads and places, so no window is exchanged.
    """
    layout = sketch_layout(config)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(config)
        for _, rows in whole_parts(batches):
            data = [b"".join(x for row in rows for x in row.column(i).to_pylist()) for i in (1, 2, 3)]
            records = Opened(np.frombuffer(data[0], np.uint8), layout)
            ids, places = (np.frombuffer(x, np.int64) for x in data[1:])
            none = places < 0
            places = np.where(none, ~places, places)
            each = np.array([len(x) // layout.size for row in rows for x in row.column(1).to_pylist()])
            _, record, place, found = tables.estimates(records, rows, each)
            if summed_up:
                order = np.lexsort((found, ids[record], none[record]))
                own, gone, found = ids[record][order], none[record][order], found[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (gone[1:] != gone[:-1]) | (found[1:] != found[:-1])
                at = np.flatnonzero(new)
                out = [pa.array(own[at], mask=gone[at]), pa.array(found[at]), pa.array(np.diff(np.append(at, len(own))))]
            else:
                out = [pa.array(ids[record], mask=none[record]), pa.array(places[record] + place), pa.array(found)]
            for at in range(0, len(out[0]), 200_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 200_000) for x in out], names=names)

    names = ["record_id", "abundance", "n"] if summed_up else ["record_id", "kmer_index", "abundance"]
    schema = ", ".join(f"{n} long" for n in names)
    return met(probes(reads, config, places=True), index, buckets).mapInArrow(answer, schema)


def counter_histogram(index: DataFrame, config: SketchConfig, most: int | None = None) -> DataFrame:
    """(counter_value, counters) of packed counters, the empty ones included; with `most`, greater values stand together as most + 1, so that there are at most most + 2 rows."""
    kind = f"<u{config.counter_bits // 8}"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, kind)
                value, n = np.unique(own[own > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["counter_value", "counters"])

    rows = index.select("counters").mapInArrow(tally, "counter_value long, counters long")
    if most is not None:
        rows = rows.withColumn("counter_value", F.least("counter_value", F.lit(most + 1)))
    some = rows.groupBy("counter_value").agg(F.sum("counters").alias("counters"))
    zero = some.agg((F.lit(config.counter_slots) - F.coalesce(F.sum("counters"), F.lit(0))).alias("counters")).where("counters > 0").select(F.lit(0).cast("long").alias("counter_value"), "counters")
    return some.unionByName(zero).orderBy("counter_value")
