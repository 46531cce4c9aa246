"""Reads asked for their own k-mers, estimated or exact, by one exchange.

All that a block's counters are made of arrives where its k-mers are asked for, so super-k-mers move once: a cell (some blocks of a
sketch, or some minimizers) is counted from its rows and then answered from them.  A cell of more rows than fit is kept in a temporary file between the two.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.config import SketchConfig
from strandtally.functions.hashing import mix64
from strandtally.operators.kernel import Scan, chains, codes, over_scans, reverse_complement
from strandtally.operators.kmers import PARTS, minimizer_width
from strandtally.operators.packing import Layout, Opened, binary, planes, summed, unplaned, whole_parts

#: records that a task holds before it sends them, and that a row has at most
HELD, ROW = 1 << 20, 1 << 11
#: counters, or bytes of rows, of the cells that are counted at once
SLOTS, PORTION = 1 << 21, 1 << 19
#: a record's first byte has its windows, and this if no segment begins with it
GOES_ON = 64
#: rows of windows that aren't ACGT alone, and of a task's figures, are told by cells below 0
FIGURES = -1
#: widest s-mers whose slots are looked up, for so many records
LISTED, MANY = 11, 1 << 15
#: windows whose answers are held before they go back to their reads, and cells of reads
HELD_ANSWERS, READ_CELLS = 1 << 21, 1 << 11


class Cells:
    """How super-k-mers are dealt: by block of a sketch, or by minimizer alone."""

    def __init__(self, k: int, config: SketchConfig | None = None):
        self.k, self.config = k, config
        self.m = config.m if config else minimizer_width(k)
        self.by_value = bool(config) and config.segmentation == "value"
        self.cells = min(config.blocks, max(PARTS, config.counter_slots >> 18)) if config else PARTS
        self.blocks = config.blocks // self.cells if config else 1
        self.layout = Layout(k, self.m, self.blocks)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, block within it)."""
        if not self.config:
            return (hashes % np.uint64(self.cells)).astype(np.int64), np.zeros(0, np.int64)
        block = (hashes & np.uint64(self.config.blocks - 1)).astype(np.int64)
        return block // self.blocks, block % self.blocks


def bounded(begins: np.ndarray, n: int) -> np.ndarray:
    """Where rows begin, none of them longer than ROW."""
    pieces = (np.diff(np.append(begins, n)) + ROW - 1) // ROW
    return np.repeat(begins, pieces) + ROW * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))


class Held:
    """Records of a task until they are sent: (cell, records, counts) or (cell, records, ids, places)."""

    def __init__(self, cells: Cells, named: bool, placed: bool):
        self.cells, self.named, self.placed = cells, named, placed
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids: pa.Array, s: Scan) -> None:
        d = self.cells.layout
        first, size, hashes, goes = s.runs(self.cells.m, self.cells.by_value)
        if not len(first):
            return
        cell, block = self.cells.of(hashes)
        base = np.concatenate([s.clean, np.zeros(96, np.uint8)])
        code = codes(base, 32)
        n = size + d.k - 1
        one = code[first] >> (64 - 2 * np.minimum(n, 32)).astype(np.uint64) << (64 - 2 * np.minimum(n, 32)).astype(np.uint64)
        two = code[first + 32] & ~(np.uint64((1 << 64) - 1) >> (2 * np.maximum(n - 32, 0)).astype(np.uint64)) if d.bases > 32 else one[:0]
        head = (size + GOES_ON * goes).astype(np.uint8)
        more: list[np.ndarray] = []
        if self.named:
            read, place = s.placed(first)
            own = ids.take(pa.array(read))
            more = [own.fill_null(0).to_numpy().astype(np.int64), own.is_null().to_numpy(zero_copy_only=False), place.astype(np.int64) if self.placed else place[:0]]
        self.held.append((cell.astype(np.int32), head, one, two, block.astype(np.int32) if d.block_bytes else block[:0], *more))
        self.n += len(first)

    def rows(self) -> Iterator[list]:
        d = self.cells.layout
        cell, head, one, two, block, *more = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        null = more[1] if self.named else None
        counts = None
        bits = 2 * d.bases + 7
        if self.named:
            at = np.argsort(cell * 2 + null if null.any() else cell.astype(np.uint16) if self.cells.cells <= 1 << 16 else cell, kind="stable")
            cell, head, one, two, block, null = (x[at] if len(x) else x for x in (cell, head, one, two, block, null))
            ids, places = more[0][at], more[2][at] if self.placed else more[2]
        elif not d.block_bytes and bits + (self.cells.cells - 1).bit_length() <= 64:
            # all of a record in one number
            low = np.uint64(64 - 2 * d.bases)
            key = np.sort(cell.astype(np.uint64) << np.uint64(bits) | one >> low << np.uint64(7) | head)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts, key = np.diff(np.append(at, len(key))), key[at]
            cell, head = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64(127)).astype(np.uint8)
            one = key >> np.uint64(7) << low
        else:
            keys = [x for x in (head, two, one, cell) if len(x)]  # the bases say the block
            order = np.lexsort(keys)
            new = np.ones(len(order), bool)
            new[1:] = functools.reduce(np.logical_or, [x[order[1:]] != x[order[:-1]] for x in keys])
            at = np.flatnonzero(new)
            counts = np.diff(np.append(at, len(order)))
            cell, head, one, two, block = (x[order[at]] if len(x) else x for x in (cell, head, one, two, block))
        out = np.empty((len(cell), d.size), np.uint8)
        out[:, 0] = head
        if d.block_bytes:
            out[:, 1 : 1 + d.block_bytes] = block.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : d.block_bytes]
        bases = (np.stack([one, two], axis=1) if len(two) else one[:, None]).astype(">u8").view(np.uint8).reshape(len(cell), -1)
        out[:, 1 + d.block_bytes :] = bases[:, : d.base_bytes]
        key = cell.astype(np.int64) * 2 + null if self.named else cell
        begins = bounded(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        ends = np.append(begins[1:], len(key))
        cuts = np.append(begins, len(key))
        names = cell[begins].astype(np.int32)
        blob = binary(out.reshape(-1), cuts * d.size)
        if self.named:
            gone = null[begins]
            named = pa.array([None if g else planes(ids[a:b]) for a, b, g in zip(begins, ends, gone, strict=True)], pa.binary())
            where = pa.array([planes(places[a:b], False) for a, b in zip(begins, ends, strict=True)] if self.placed else [b""] * len(begins), pa.binary())
            yield [names, blob, named, where]
        else:
            yield [names, blob, binary(np.minimum(counts, (1 << 32) - 1).astype(np.uint32).view(np.uint8), cuts * 4)]


def sent(reads: DataFrame, cells: Cells, named: bool = False, placed: bool = False, figures: bool = False) -> DataFrame:
    """Rows of Held; placed: also runs of windows that aren't ACGT alone (their lengths for records); figures: a row with the numbers of reads and windows."""

    def gap_rows(some: list[tuple[pa.Array, np.ndarray, np.ndarray]], at: int) -> list:
        own = pa.concat_arrays([x[0] for x in some])
        place, size = (np.concatenate([x[i] for x in some]) for i in (1, 2))
        ids, gone = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
        rows = []
        for null in (False, True):
            keep = np.flatnonzero(gone == null)
            for lo in range(0, len(keep), ROW):
                x = keep[lo : lo + ROW]
                rows.append((-1 - (at + len(rows)) % PARTS, planes(size[x], False), None if null else planes(ids[x]), planes(place[x], False), len(x)))
        # as many bytes as the numbers need, so their number goes first
        return [np.array([r[0] for r in rows], np.int32), *(pa.array([r[i] if i != 1 else r[4].to_bytes(4, "little") + r[1] for r in rows], pa.binary()) for i in (1, 2, 3))]

    def make(own: Iterator[tuple[pa.Array, Scan]]) -> Iterator[list]:
        held = Held(cells, named, placed)
        sums = np.zeros(2, np.int64)
        gaps: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n, at = 0, 0
        for ids, s in own:
            held.add(ids, s)
            if figures:
                sums += [(s.starts == 0).sum(), (s.windows - np.minimum(s.lead, s.windows)).sum()]
            if placed:
                first, size = s.gaps()
                read, place = s.placed(first)
                if len(first):
                    gaps.append((ids.take(pa.array(read)), place, size))
                    n += len(first)
                if n >= HELD:
                    made = gap_rows(gaps, at)
                    yield made
                    gaps, n, at = [], 0, at + len(made[0])
            if held.n >= HELD:
                yield from held.rows()
        if gaps:
            yield gap_rows(gaps, at)
        if held.n:
            yield from held.rows()
        if figures:
            yield [np.array([FIGURES], np.int32), pa.array([b""], pa.binary()), pa.array([sums.tobytes()], pa.binary())]

    return over_scans(reads, cells.k, "cell int, records binary, " + ("ids binary, places binary" if named else "counts binary"), make)


@functools.lru_cache(2)
def _listed(s: int, n_hashes: int, block_slots: int) -> np.ndarray:
    """All slots of an s-mer, by its code on either strand, eight or sixteen bits each from the lowest, in one number."""
    width = 8 if block_slots <= 256 else 16
    own = np.arange(1 << 2 * s, dtype=np.uint64)
    out = np.zeros(len(own), np.uint32 if width * n_hashes <= 32 else np.uint64)
    for lo in range(0, len(own), 1 << 18):
        h = own[lo : lo + (1 << 18)]
        h = np.minimum(h, reverse_complement(h, s))
        for i in range(n_hashes):
            h = mix64(h)
            out[lo : lo + (1 << 18)] |= ((h & np.uint64(block_slots - 1)) << np.uint64(width * i)).astype(out.dtype)
    return out


class Group:
    """Whole cells, in one portion or in several that can be read again and again."""

    def __init__(self, portions: Callable[[], Iterator[list[pa.RecordBatch]]], single: bool):
        self.portions, self.single = portions, single


def groups(batches: Iterator[pa.RecordBatch], most: int, most_cells: int | None = None) -> Iterator[Group]:
    """Rows of whole cells, about `most` bytes or so many cells at a time; where a cell has more than four times that, they are kept in a file (in memory up to 32 times that)."""
    portions = whole_parts(batches, most, most_cells)
    for whole, rows in portions:
        if whole:
            yield Group(functools.partial(lambda x: iter([x]), rows), True)
            continue
        with tempfile.SpooledTemporaryFile(32 * most) as file:
            with pa.ipc.new_stream(file, rows[0].schema) as out:
                while True:
                    for row in rows:
                        out.write_batch(row)
                    if whole:
                        break
                    whole, rows = next(portions)

            def again(file=file) -> Iterator[list[pa.RecordBatch]]:
                file.seek(0)
                held, size = [], 0
                for batch in pa.ipc.open_stream(file):
                    held.append(batch)
                    size += batch.nbytes
                    if size >= most:
                        yield held
                        held, size = [], 0
                if held:
                    yield held

            yield Group(again, False)


class Portion:
    """Records of some rows with their counts, or reads and places."""

    def __init__(self, rows: list[pa.RecordBatch], cells: Cells, named: bool, placed: bool):
        d = cells.layout
        blobs = [x for row in rows for x in row.column(1).to_pylist()]
        self.records = Opened(np.frombuffer(b"".join(blobs), np.uint8), d)
        self.goes = self.records.size >= GOES_ON
        self.records.size %= GOES_ON
        each = np.array([len(x) // d.size for x in blobs], np.int64)
        self.cell = np.repeat(np.concatenate([row.column(0).to_numpy() for row in rows]), each).astype(np.int64)
        if named:
            ids = [x for row in rows for x in row.column(2).to_pylist()]
            self.ids = np.concatenate([np.zeros(n, np.int64) if x is None else unplaned(x, n) for x, n in zip(ids, each, strict=True)])
            self.gone = np.repeat(np.array([x is None for x in ids]), each)
            if placed:
                self.places = np.concatenate([unplaned(x, n, False) for x, n in zip((x for row in rows for x in row.column(3).to_pylist()), each, strict=True)])
        else:
            self.n = np.frombuffer(b"".join(x for row in rows for x in row.column(2).to_pylist()), np.uint32).astype(np.int64)

    def kmers(self, k: int) -> np.ndarray:
        return self.records.codes(k)[0]

    @functools.cached_property
    def record(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.records.size)), self.records.size)

    @functools.cached_property
    def place(self) -> np.ndarray:
        size = self.records.size
        return np.arange(len(self.record)) - np.repeat(np.cumsum(size) - size, size)


def sketched(group: Group, cells: Cells, named: bool, placed: bool) -> Iterator[tuple[Portion, np.ndarray]]:
    """Portions of a group, and the estimates of their windows by the counters that the group makes."""
    c = cells.config
    size = cells.blocks * c.block_slots
    more = c.k - c.s

    def opened() -> Iterator[tuple[Portion, list[np.ndarray], np.ndarray]]:
        for rows in group.portions():
            p = Portion(rows, cells, named, placed)
            width = 8 if c.block_slots <= 256 else 16
            listed = c.s <= LISTED and len(p.cell) >= MANY and width * c.n_hashes <= 64 and c.block_slots <= 1 << 16
            smer, record, place = p.records.codes(c.s, not listed)
            if listed:
                found = _listed(c.s, c.n_hashes, c.block_slots)[smer.view(np.int64)]
                slots = [(found >> found.dtype.type(width * i) & found.dtype.type(c.block_slots - 1)).astype(np.int64) for i in range(c.n_hashes)]
            else:
                slots = list(chains(smer, c).T)
            yield p, slots, record, place

    names, counters = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = None

    def starts(p: Portion) -> np.ndarray:
        return np.searchsorted(names, p.cell) * size + p.records.block * c.block_slots

    for x in opened():
        p, slots, record, place = x
        new = np.unique(p.cell)
        new = new[~np.isin(new, names)]  # cells come in ascending order
        names, counters = np.concatenate([names, new]), np.concatenate([counters, np.zeros(len(new) * size, np.int64)])
        start = starts(p)[record]
        into = None
        if p.goes.any():
            into = np.flatnonzero(~p.goes[record] | (place >= more))
        n = None if named else p.n[record]
        for slot in slots:
            at = start + slot
            if n is None:
                counters += np.bincount(at if into is None else at[into], minlength=len(counters))
            else:
                counters += np.bincount(at if into is None else at[into], weights=n if into is None else n[into], minlength=len(counters)).astype(np.int64)
        if group.single:
            kept = x
    counters = np.minimum(counters, c.counter_max).astype(np.uint32)
    for p, slots, record, _ in [kept] if kept else opened():
        start = starts(p)[record]
        least = functools.reduce(np.minimum, [counters[start + slot] for slot in slots])
        # the least of more + 1 neighbours; a record has `more` s-mers beyond its windows
        width, best = 1, least
        while 2 * width <= more + 1:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        rest = more + 1 - width
        best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
        n = p.records.size
        yield p, best[p.place + np.repeat(np.cumsum(n + more) - (n + more), n)].astype(np.int64)


def counted(group: Group, cells: Cells, named: bool, placed: bool) -> Iterator[tuple[Portion, np.ndarray]]:
    """Portions of a group, and how often their windows' k-mers occur in it."""
    keys, sums, kept = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for rows in group.portions():
        p = Portion(rows, cells, named, placed)
        kmer = p.kmers(cells.k)
        if group.single:
            order = np.argsort(kmer)
            own = kmer[order]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            n = np.diff(np.append(np.flatnonzero(new), len(own)))
            found = np.empty(len(own), np.int64)
            found[order] = n[np.cumsum(new) - 1]
            kept = (p, found)
        else:
            own, n, _ = summed(kmer, np.ones(len(kmer), np.int64))
            keys, sums, _ = summed(np.concatenate([keys, own]), np.concatenate([sums, n]))
    if kept:
        yield kept
        return
    for rows in group.portions():
        p = Portion(rows, cells, named, placed)
        yield p, sums[np.searchsorted(keys, p.kmers(cells.k))]


def answered(reads: DataFrame, cells: Cells, schema: str, answer: Callable[[Iterator[Group]], Iterator[list]], others: Callable[[pa.RecordBatch], Iterator[list]] | None = None, **options: bool) -> DataFrame:
    """What answer yields from a task's groups of whole cells, and others from rows of cells below 0."""
    names, portion = [x.split()[0] for x in schema.split(",")], PORTION
    at_once = max(1, SLOTS // (cells.blocks * cells.config.block_slots)) if cells.config else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)

        def made() -> Iterator[list]:
            for batch in batches:
                n = int((batch.column(0).to_numpy() < 0).sum())  # in order, so these are first
                if n:
                    yield from others(batch.slice(0, n))
                if n < batch.num_rows:
                    yield from answer(groups(itertools.chain([batch.slice(n)], batches), portion, at_once))

        for x in made():
            full = pa.RecordBatch.from_arrays([y if isinstance(y, pa.Array) else pa.array(y) for y in x], names=names)
            for at in range(0, full.num_rows, 200_000):
                yield full.slice(at, 200_000)

    return sent(reads, cells, **options).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _distinct(group: Group, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers, n, estimates) of a group."""
    held = None
    for p, found in sketched(group, cells, False, False):
        kmer, sums, at = summed(p.kmers(cells.k), p.n[p.record])
        own = (kmer, sums, found[at])
        if held:
            both = [np.concatenate(x) for x in zip(held, own, strict=True)]
            kmer, sums, at = summed(both[0], both[1])
            own = (kmer, sums, both[2][at])
        held = own
    return held


def estimates(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(kmer, n, estimate) of the distinct k-mers of reads by a sketch of the same reads."""
    cells = Cells(config.k, config)

    def answer(some: Iterator[Group]) -> Iterator[list]:
        for group in some:
            kmer, n, found = _distinct(group, cells)
            yield [kmer.view(np.int64), n, found]

    return answered(reads, cells, "kmer long, n long, estimate long", answer)


def spectrum(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(estimated_count, kmers), ascending, of reads by a sketch of the same reads."""
    cells = Cells(config.k, config)

    def answer(some: Iterator[Group]) -> Iterator[list]:
        for group in some:
            yield list(np.unique(_distinct(group, cells)[2], return_counts=True))

    rows = answered(reads, cells, "estimated_count long, kmers long", answer)
    return rows.groupBy("estimated_count").agg(F.sum("kmers").alias("kmers")).orderBy("estimated_count")


def report(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """One row: records_processed, total_windows, valid_kmers, positive_estimates, estimate_checksum, of reads by a sketch of the same reads."""
    cells = Cells(config.k, config)
    names = ["records_processed", "total_windows", "valid_kmers", "positive_estimates", "estimate_checksum"]

    def answer(some: Iterator[Group]) -> Iterator[list]:
        for group in some:
            for p, found in sketched(group, cells, False, False):
                n = p.n[p.record]
                yield [np.array([x]) for x in (0, 0, n.sum(), n[found > 0].sum(), (n * found).sum())]

    def others(batch: pa.RecordBatch) -> Iterator[list]:
        for x in batch.column(2).to_pylist():
            yield [np.array([y]) for y in (*np.frombuffer(x, np.int64), 0, 0, 0)]

    rows = answered(reads, cells, ", ".join(f"{n} long" for n in names), answer, others, figures=True)
    return rows.agg(*[F.coalesce(F.sum(F.col(n).cast("decimal(38,0)")), F.lit(0)).cast("long").alias(n) for n in names])


def windows(reads: DataFrame, config: SketchConfig, absent: int | None = None) -> DataFrame:
    """(record_id, kmer_index, abundance) of all windows of reads by a sketch of the same reads; absent (or null) where a window isn't ACGT alone."""
    cells = Cells(config.k, config)

    def answer(some: Iterator[Group]) -> Iterator[list]:
        for group in some:
            for p, found in sketched(group, cells, True, True):
                ids = p.ids[p.record]
                yield [pa.array(ids, mask=p.gone[p.record]) if p.gone.any() else ids, p.places[p.record] + p.place, found]

    def others(batch: pa.RecordBatch) -> Iterator[list]:
        for blob, named, placed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            n = int.from_bytes(blob[:4], "little")
            size, place = unplaned(blob[4:], n, False), unplaned(placed, n, False)
            total = int(size.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            ids = pa.nulls(total, pa.int64()) if named is None else np.repeat(unplaned(named, n), size)
            yield [ids, np.repeat(place, size) + inner, pa.nulls(total, pa.int64()) if absent is None else np.full(total, absent)]

    return answered(reads, cells, "record_id long, kmer_index long, abundance long", answer, others, named=True, placed=True)


def _returned(reads: DataFrame, cells: Cells, values: Callable[..., Iterator[tuple[Portion, np.ndarray]]]) -> DataFrame:
    """(cell, ids, sizes, values): the windows' values by super-k-mer, dealt by read; null ids in a cell of their own."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> list:
        ids, gone, size, found = (np.concatenate(x) for x in zip(*held, strict=True))
        cell = np.where(gone, READ_CELLS, (mix64(ids.view(np.uint64)) & np.uint64(READ_CELLS - 1)).astype(np.int64)).astype(np.uint16)
        order = np.lexsort((ids, cell))
        begin = (np.cumsum(size, dtype=np.int64) - size)[order]
        cell, ids, size = cell[order], ids[order], size[order]
        moved = np.cumsum(size, dtype=np.int64)
        found = found[np.arange(len(found)) + np.repeat(begin - (moved - size), size)]
        at = bounded(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
        to = np.append(at[1:], len(cell))
        cut = np.append(0, moved)
        blobs = [[planes(ids[a:b]) for a, b in zip(at, to, strict=True)], [size[a:b].tobytes() for a, b in zip(at, to, strict=True)], [planes(found[cut[a] : cut[b]].astype(np.int64), False) for a, b in zip(at, to, strict=True)]]
        return [cell[at].astype(np.int32), *(pa.array(x, pa.binary()) for x in blobs)]

    def answer(some: Iterator[Group]) -> Iterator[list]:
        held, n = [], 0
        for group in some:
            for p, found in values(group, cells, True, False):
                held.append((p.ids, p.gone, p.records.size.astype(np.uint8), found.astype(np.uint32) if not len(found) or found.max() < 1 << 32 else found))
                n += len(found)
                if n >= HELD_ANSWERS:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return answered(reads, cells, "cell int, ids binary, sizes binary, found binary", answer, named=True)


def _medians(ids: np.ndarray, found: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(id, windows, mean, median), from rows in the order of ids and values."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total = np.add.reduceat(n, at)
    mean = np.add.reduceat(found * n, at).astype(np.float64) / total
    ends = np.cumsum(n)
    before = np.append(0, np.cumsum(total)[:-1])
    low, high = (found[np.searchsorted(ends, before + x, side="right")] for x in ((total - 1) // 2, total // 2))
    return [ids[at], total, mean, low + (high - low) * 0.5]


def _summaries(reads: DataFrame, back: DataFrame, k: int) -> DataFrame:
    def runs(ids: np.ndarray, found: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, ...]:
        order = np.lexsort((found, ids))
        ids, found = ids[order], found[order]
        at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (found[1:] != found[:-1])]))
        sums = np.diff(np.append(at, len(ids))) if n is None else np.add.reduceat(n[order], at)
        return ids[at], found[at], sums

    portion = PORTION >> 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole, rows in whole_parts(batches, portion):
            ids, found, gone = [], [], []
            for cell, named, sizes, values in zip(*([x for row in rows for x in row.column(i).to_pylist()] for i in range(4)), strict=True):
                size = np.frombuffer(sizes, np.uint8)
                n = int(size.sum())
                ids.append(np.repeat(unplaned(named, len(size)), size))
                found.append(unplaned(values, n, False))
                gone.append((cell == READ_CELLS, n))
            null = np.repeat([x[0] for x in gone], [x[1] for x in gone])
            ids, found = np.concatenate(ids), np.concatenate(found)
            # null ids are in a cell of their own, after all others
            for mine in (False, True):
                if not (null == mine).any():
                    continue
                own = runs(ids[null == mine], found[null == mine], None)
                if held and held[0] == mine:
                    own = runs(*(np.concatenate(x) for x in zip(held[1], own, strict=True)))
                elif held:
                    yield stats(*held)
                held = (mine, own)
            if whole and held:
                yield stats(*held)
                held = None

    def stats(null: bool, own: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ids, total, mean, median = _medians(*own)
        return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()) if null else pa.array(ids), pa.array(total), pa.array(mean), pa.array(median)], names=["_record", "_valid", "mean_abundance", "median_abundance"])

    by = back.repartition("cell").sortWithinPartitions("cell").mapInArrow(take, "_record long, _valid long, mean_abundance double, median_abundance double")
    text = F.coalesce("sequence", F.lit(""))
    own = reads.select("record_id", F.length(text).cast("long").alias("length"), F.greatest(F.octet_length(text) - (k - 1), F.lit(0)).cast("long").alias("total_windows"))
    own = own.withColumn("total_windows", F.sum("total_windows").over(W.partitionBy("record_id")))
    return own.join(by, F.col("record_id").eqNullSafe(F.col("_record")), "left").select("record_id", "length", "total_windows", F.coalesce("_valid", F.lit(0).cast("long")).alias("valid_kmers"), "mean_abundance", "median_abundance")


def summaries(reads: DataFrame, config: SketchConfig) -> DataFrame:
    """(record_id, length, total_windows, valid_kmers, mean_abundance, median_abundance) of reads by a sketch of the same reads."""
    return _summaries(reads, _returned(reads, Cells(config.k, config), sketched), config.k)


def exact_summaries(reads: DataFrame, k: int) -> DataFrame:
    """The same by exact counts."""
    return _summaries(reads, _returned(reads, Cells(k), counted), k)
