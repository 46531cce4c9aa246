"""The Arrow kernel: everything that depends on neighbouring bases, a bounded number of bases at a time.

Windows, codes, minimizers and segments of a read are sliding computations.  As
relational windows they would shuffle a row for each base; here they are numpy
passes over a batch of reads, and what leaves a batch is already aggregated.
Long reads are cut into overlapping pieces before they leave the JVM, so that neither a task's memory nor a batch grows with the read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.config import SketchConfig
from strandtally.functions.hashing import mix64

CHUNK_BASES = 1 << 18
#: windows of a piece of a longer read
PIECE_WINDOWS = 1 << 21
#: widest m-mers that are ranked by a table
RANKED = 10
LOW = (1 << 32) - 1
_PAIRS, _NIBBLES = np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_BASE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i


def codes(base: np.ndarray, width: int) -> np.ndarray:
    """Two-bit codes of all windows of this width, by doubling."""
    n = len(base) - width + 1
    out, have = np.zeros(len(base), np.uint64), 0
    piece, size = base.astype(np.uint64), 1
    while True:
        if width & size:
            out = (out[: len(base) - have - size + 1] << np.uint64(2 * size)) | piece[have:][: len(base) - have - size + 1] if have else piece.copy()
            have += size
        if have == width:
            return out[:n]
        piece = (piece[: len(piece) - size] << np.uint64(2 * size)) | piece[size:]
        size *= 2


def reverse_complement(code: np.ndarray, width: int) -> np.ndarray:
    x = ~code
    x = ((x >> np.uint64(2)) & _PAIRS) | ((x & _PAIRS) << np.uint64(2))
    x = ((x >> np.uint64(4)) & _NIBBLES) | ((x & _NIBBLES) << np.uint64(4))
    return x.byteswap() >> np.uint64(64 - 2 * width)


@functools.lru_cache(4)
def ranks(m: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each m-mer's hash, by its code on either strand, and the hashes by rank: equal ranks are equal hashes."""
    own = np.arange(1 << 2 * m, dtype=np.uint64)
    hashes, rank = np.unique(mix64(np.minimum(own, reverse_complement(own, m))), return_inverse=True)
    return rank.astype(np.int64), hashes


def least_of_runs(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` values, by doubling."""
    have, size = x, 1
    while 2 * size <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Scan:
    """All windows of some pieces of reads; a window is known if it holds ACGT alone, and valid if it is this scan's own besides.

    A piece that isn't its read's first begins one window early (lead): that
    window belongs to the piece before, and tells whether the first own one continues a segment or run.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, starts: np.ndarray | None = None, lead: np.ndarray | None = None):
        n_pieces = len(offsets) - 1
        self.starts = np.zeros(n_pieces, np.int64) if starts is None else starts
        self.lead = np.zeros(n_pieces, np.int64) if lead is None else lead
        self.base, self.offsets, self.k = _BASE[data], offsets, k
        self._both: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._marks: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    @functools.cached_property
    def windows(self) -> np.ndarray:
        return np.maximum(np.diff(self.offsets) - self.k + 1, 0)

    @functools.cached_property
    def read(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.windows)), self.windows)

    @functools.cached_property
    def _local(self) -> np.ndarray:
        return np.arange(len(self.read)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)

    @functools.cached_property
    def place(self) -> np.ndarray:
        return self._local + (self.starts - self.lead)[self.read]

    @functools.cached_property
    def at(self) -> np.ndarray:
        return self._local + self.offsets[:-1][self.read]

    @functools.cached_property
    def wrong(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int32), np.cumsum(self.base > 3, dtype=np.int32)])

    @functools.cached_property
    def known(self) -> np.ndarray:
        return self.wrong[self.at + self.k] == self.wrong[self.at]

    @functools.cached_property
    def own(self) -> np.ndarray:
        return self._local >= self.lead[self.read]

    @functools.cached_property
    def heads(self) -> np.ndarray:
        return self._local == self.lead[self.read]

    @functools.cached_property
    def valid(self) -> np.ndarray:
        return self.known & self.own

    @functools.cached_property
    def clean(self) -> np.ndarray:
        return np.where(self.base > 3, 0, self.base).astype(np.uint8)

    def both(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the windows at each base, forward and reverse-complemented."""
        if width not in self._both:
            if len(self.clean) < width:
                self._both[width] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            else:
                self._both[width] = (codes(self.clean, width), codes((3 - self.clean)[::-1], width)[::-1])
        return self._both[width]

    def canonical(self, width: int) -> np.ndarray:
        return np.minimum(*self.both(width))

    def minimizers(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of each window's minimizer.

        The least hash of a canonical m-mer; of equal ones the leftmost if the
        window is its own canonical form, else the rightmost.
        """
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place, value, hashes = self.least(m)
        value = value[self.at]
        return place[self.at], value if hashes is None else hashes[value]

    def least(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """minimizers() of the k bases at every base, reads' ends ignored: (position, hash, None), or (position, rank of the hash, hashes by rank)."""
        width, n = self.k - m + 1, len(self.base) - self.k + 1
        forward, backward = self.both(self.k)
        if m <= RANKED:
            # rank and place in one number, so that the least of a run says both
            rank, hashes = ranks(m)
            one = rank.take(codes(self.clean, m).view(np.int64)) << 32
            place = np.arange(len(one))
            left = least_of_runs(one | place, width)
            right = least_of_runs(one | (LOW - place), width)
            return np.where(forward <= backward, left & LOW, LOW - (right & LOW)), left >> 32, hashes
        hashes = mix64(self.canonical(m))
        best = least_of_runs(hashes, width)
        right, ties = np.zeros(n, np.int8), np.zeros(n, np.int8)
        for j in range(width):
            same = hashes[j : j + n] == best
            right[same] = j
            ties += same
        left = right.copy()
        several = np.flatnonzero(ties > 1)
        for j in range(width - 1, -1, -1):
            same = several[hashes[several + j] == best[several]]
            left[same] = j
        return np.arange(n) + np.where(forward <= backward, left, right), best, None

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the k bases at every base: whether they are a known window, and whether they are one that isn't known; both without windows that belong to the piece before."""
        n = len(self.base) - self.k + 1
        if n <= 0:
            return np.zeros(0, bool), np.zeros(0, bool)
        within = np.repeat(self.offsets[1:], np.diff(self.offsets))[:n] - np.arange(n) >= self.k
        within[self.offsets[:-1][(self.lead > 0) & (self.windows > 0)]] = False
        good = self.wrong[self.k :] == self.wrong[: -self.k]
        return within & good, within & ~good

    def placed(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that some bases belong to, and the windows that begin there."""
        read = np.searchsorted(self.offsets, first, side="right") - 1
        return read, first - self.offsets[read] + (self.starts - self.lead)[read]

    def runs(self, m: int, by_value: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first base, number of windows, hash, goes on) of runs of own valid windows that share a minimizer's place, of at most k - m + 1 windows.

        A run goes on if no segment begins with it: if a cut of its read divides one, or, by value, if the minimizer's hash is that of the window before.
        """
        valid, _ = self.kinds()
        if not valid.any():
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none.astype(bool)
        position, value, hashes = self.least(m)
        n = len(valid)
        heads = self.offsets[:-1][self.windows > self.lead] + self.lead[self.windows > self.lead]
        before = valid.copy()
        # windows of the piece before, which tell whether the first own one goes on
        lead = self.offsets[:-1][(self.lead > 0) & (self.windows > 0)]
        before[lead] = self.wrong[lead + self.k] == self.wrong[lead]
        new = np.ones(n, bool)
        new[1:] = (position[1:] != position[:-1]) | ~before[:-1]
        cuts = new.copy()
        cuts[heads] = True
        cuts &= valid
        edges = np.flatnonzero(cuts | ~valid)
        size = np.diff(np.append(edges, n))[cuts[edges]]
        first = np.flatnonzero(cuts)
        own = value[first]
        goes = ~new[first]
        if by_value:
            back = np.maximum(first - 1, 0)
            goes |= (first > 0) & before[back] & (value[back] == own)
        return first, size, own if hashes is None else hashes[own], goes

    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """(first base, number of windows) of runs of own windows that aren't ACGT alone."""
        _, unknown = self.kinds()
        new = unknown.copy()
        new[1:] &= ~unknown[:-1]
        starts = self.offsets[:-1][self.windows > 0]
        new[starts] = unknown[starts]
        edges = np.flatnonzero(new | ~unknown)
        return np.flatnonzero(new), np.diff(np.append(edges, len(unknown)))[new[edges]]

    def marks(self, m: int, by_value: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each window whether a segment (super-k-mer: neighbours that share a minimizer) begins there, and its minimizer's hash."""
        if (m, by_value) not in self._marks:
            position, hashes = self.minimizers(m)
            mark = hashes if by_value else position
            new = self.known.copy()
            new[1:] &= ~(self.known[:-1] & (self.read[1:] == self.read[:-1]) & (mark[1:] == mark[:-1]))
            self._marks[m, by_value] = (new & self.own, hashes)
        return self._marks[m, by_value]

    def segments(self, m: int, by_value: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Segments that begin here as (first window, number of windows, hash of the minimizer); and how many windows continue the last scan's last one."""
        new, hashes = self.marks(m, by_value)
        first = np.flatnonzero(new)
        segment = (np.cumsum(new) - 1)[self.valid]
        size = np.bincount(segment[segment >= 0], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        return first, size, hashes[first], int((segment < 0).sum())


def chains(smers: np.ndarray, config: SketchConfig) -> np.ndarray:
    """(s-mers, n_hashes) slots: each hash is the mix of the one before."""
    out = np.empty((len(smers), config.n_hashes), dtype=np.int64)
    h = smers
    for i in range(config.n_hashes):
        h = mix64(h)
        out[:, i] = (h & np.uint64(config.block_slots - 1)).astype(np.int64)
    return out


def inserted(scan: Scan, config: SketchConfig) -> tuple[np.ndarray, np.ndarray]:
    """(block, canonical s-mer) of every insertion: a window's last s-mer, and all others of a window that begins a segment."""
    new, hashes = scan.marks(config.m, config.segmentation == "value")
    if not len(new):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    more = config.k - config.s
    own, first = np.flatnonzero(scan.valid), np.flatnonzero(new)
    at = np.concatenate([scan.at[own] + more, (scan.at[first][:, None] + np.arange(more)).reshape(-1)])
    block = (hashes & np.uint64(config.blocks - 1)).astype(np.int64)
    return np.concatenate([block[own], np.repeat(block[first], more)]), scan.canonical(config.s)[at]


def pieces(reads: DataFrame, k: int) -> DataFrame:
    """(record_id, start, lead, sequence binary): reads of more than PIECE_WINDOWS windows cut into pieces that share k bases; others whole."""
    data = F.coalesce(F.col("sequence").cast("string"), F.lit("")).cast("binary")
    rows = reads.select(F.col("record_id").cast("long").alias("record_id"), data.alias("sequence"))
    n = F.octet_length("sequence") - (k - 1)
    starts = F.when(n > PIECE_WINDOWS, F.sequence(F.lit(0), n - 1, F.lit(PIECE_WINDOWS))).otherwise(F.array(F.lit(0)))
    rows = rows.select("record_id", "sequence", n.alias("_n"), F.explode(starts).alias("start"))
    lead = F.when(F.col("start") > 0, 1).otherwise(0)
    piece = F.substring(F.col("sequence"), F.col("start") - lead + 1, F.least(F.lit(PIECE_WINDOWS), F.col("_n") - F.col("start")) + lead + (k - 1))
    return rows.select("record_id", F.col("start").cast("long").alias("start"), lead.cast("long").alias("lead"), F.when(F.col("_n") > PIECE_WINDOWS, piece).otherwise(F.col("sequence")).alias("sequence"))


def scans(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, Scan]]:
    """(first row, end row, scan) of about CHUNK_BASES of pieces(); a longer piece is a scan of its own."""
    reads = batch.column(3)
    if not len(reads):
        return
    if pa.types.is_large_binary(reads.type):
        reads = reads.cast(pa.binary())
    held = reads.buffers()
    offsets = np.frombuffer(held[1], np.int32, len(reads) + reads.offset + 1)[reads.offset :].astype(np.int64)
    data = np.frombuffer(held[2], np.uint8) if held[2] is not None and held[2].size else np.zeros(0, np.uint8)
    starts, lead = (batch.column(i).to_numpy() for i in (1, 2))
    lo = 0
    while lo < len(reads):
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + CHUNK_BASES, side="right")) - 1, lo + 1), len(reads))
        yield lo, hi, Scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, starts[lo:hi], lead[lo:hi])
        lo = hi


def over_scans(reads: DataFrame, k: int, schema: str, make: Callable[[Iterator[tuple[pa.Array, Scan]]], Iterator[list]]) -> DataFrame:
    """What make yields from a task's (record ids, scan), which are in the order of the reads, as rows of the schema."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((batch.column(0).slice(lo, hi - lo), scan) for batch in batches for lo, hi, scan in scans(batch, k))
        for made in make(own):
            full = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names)
            for at in range(0, full.num_rows, 200_000):
                yield full.slice(at, 200_000)

    return pieces(reads, k).mapInArrow(run, schema)


def per_scan(reads: DataFrame, k: int, schema: str, fn: Callable[[pa.Array, Scan], list]) -> DataFrame:
    """What fn makes of (record ids, scan), as rows of the schema."""
    return over_scans(reads, k, schema, lambda own: (fn(ids, scan) for ids, scan in own))
