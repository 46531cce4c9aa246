"""Super-k-mers as packed binary records: the unit in which k-mers are exchanged.

A record is the number of windows (a byte), the block's place within its part (0 to 4 bytes) and the bases, two bits each.
Equal records of a task are one, with a count.  Records are dealt by minimizer, so all windows of a k-mer meet in one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandtally.operators.kernel import Scan, codes, reverse_complement

_TOP = np.array([0] + [((1 << 64) - 1) ^ ((1 << (64 - 2 * b)) - 1) for b in range(1, 33)], np.uint64)
HELD_RECORDS = 1 << 21


class Layout:
    """Sizes of the fields of a record."""

    def __init__(self, k: int, m: int, blocks_in_part: int = 1):
        self.k, self.m = k, m
        self.windows = k - m + 1
        self.bases = k + self.windows - 1  # at most 63
        self.block_bytes = ((blocks_in_part - 1).bit_length() + 7) // 8
        self.base_bytes = (self.bases + 3) // 4
        self.size = 1 + self.block_bytes + self.base_bytes


def cut(scan: Scan, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash): runs of a piece's own windows that share a minimizer's place, of at most k - m + 1 windows."""
    new, hashes = scan.marks(m)
    new = new | scan.valid & scan.heads
    first = np.flatnonzero(new)
    size = np.bincount((np.cumsum(new) - 1)[scan.valid], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    return first, size, hashes[first]


def lanes(scan: Scan, first: np.ndarray, size: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The bases of the runs in two 64-bit lanes, from the top."""
    code = codes(np.concatenate([scan.clean, np.zeros(96, np.uint8)]), 32)
    at, n = scan.at[first], size + layout.k - 1
    return code[at] & _TOP[np.minimum(n, 32)], code[at + 32] & _TOP[np.maximum(n - 32, 0)]


class Records:
    """Records of a task, kept as columns until they are put out."""

    def __init__(self, layout: Layout, repeats: bool = True):
        self.layout, self.repeats = layout, repeats
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, part: np.ndarray, block: np.ndarray, size: np.ndarray, lane: tuple[np.ndarray, np.ndarray], *more: np.ndarray) -> None:
        self.held.append((part, block, size, *lane, *more))
        self.n += len(part)

    def rows(self) -> list[np.ndarray | pa.Array]:
        """Columns part, records, counts or further ones (each a binary, an item for each record): a row for each part."""
        part, block, size, one, two, *more = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        if self.repeats:
            if self.layout.bases <= 29:  # a record's number of windows fits below its bases
                _, lead, n = np.unique(one | size.astype(np.uint64), return_index=True, return_counts=True)
            else:
                order = np.lexsort((size, two, one))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
                at = np.flatnonzero(new)
                lead, n = order[at], np.diff(np.append(at, len(order)))
            more = [n.astype(np.uint32)]
        else:
            lead = np.arange(len(part))
        own = np.argsort(part[lead], kind="stable")
        lead, more = lead[own], [(x if self.repeats else x[lead])[own] for x in more]
        d = self.layout
        out = np.empty((len(lead), d.size), np.uint8)
        out[:, 0] = size[lead]
        out[:, 1 : 1 + d.block_bytes] = block[lead].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : d.block_bytes]
        bases = np.stack([one[lead], two[lead]], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)
        out[:, 1 + d.block_bytes :] = bases[:, : d.base_bytes]
        parts, at = np.unique(part[lead], return_index=True)
        ends = np.append(at, len(lead))
        blobs = [binary(out.reshape(-1), ends * d.size), *[binary(x.view(np.uint8), ends * x.itemsize) for x in more]]
        return [parts.astype(np.int32), *blobs]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def planes(x: np.ndarray, steps: bool = True) -> bytes:
    """Numbers (their differences, with steps) byte by byte: first the lowest byte of each, as many as the greatest needs, so that they compress."""
    if steps:
        x = np.diff(x, prepend=0)
    most = int(np.bitwise_or.reduce(x.view(np.uint64))) if len(x) else 0
    return x.view(np.uint8).reshape(-1, 8)[:, : max(1, (most.bit_length() + 7) // 8)].T.tobytes()


def unplaned(data: bytes, n: int, steps: bool = True) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    x = out.view(np.int64).reshape(-1)
    return np.cumsum(x) if steps else x


class Opened:
    """Records read back: sizes, blocks and lanes."""

    def __init__(self, data: np.ndarray, layout: Layout):
        d = self.layout = layout
        rows = data.reshape(-1, d.size)
        self.size = rows[:, 0].astype(np.int64)
        block = np.zeros((len(rows), 4), np.uint8)
        block[:, : d.block_bytes] = rows[:, 1 : 1 + d.block_bytes]
        self.block = block.view("<u4").reshape(-1).astype(np.int64)
        bases = np.zeros((len(rows), 16), np.uint8)
        bases[:, : d.base_bytes] = rows[:, 1 + d.block_bytes :]
        both = bases.view(">u8").astype(np.uint64)
        self.one, self.two = both[:, 0], both[:, 1]

    def codes(self, width: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical (or forward) codes of all stretches of `width` bases; the record of each, and its place there."""
        n = self.size + self.layout.k - width
        record = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
        shift = (2 * place).astype(np.uint64)
        top = self.one[record] << (shift & np.uint64(63))
        if self.layout.bases > 32:
            two = self.two[record]
            within = (place > 0) & (place < 32)
            top = np.where(within, top | (two >> (np.uint64(64) - np.where(within, shift, np.uint64(2)))), np.where(place < 32, top, two << (shift & np.uint64(63))))
        forward = top >> np.uint64(64 - 2 * width)
        return np.minimum(forward, reverse_complement(forward, width)) if canonical else forward, record, place


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums of n, and a place of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0], order[at]


def whole_parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, parts_at_once: int | None = None) -> Iterator[tuple[bool, list[pa.RecordBatch]]]:
    """(whole, rows) from rows sorted by part (the first column), about `most` bytes or at most so many parts at a time, counters that came with them included; whole if no later rows have the same parts."""
    held: list[pa.RecordBatch] = []
    size, last, n = 0, None, 0
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(parts)], strict=True):
            if parts[lo] != last and (size > most or n == parts_at_once):
                yield True, held
                held, size, n = [], 0, 0
            n += parts[lo] != last
            at, last = lo, parts[lo]
            while at < hi:
                # a part of many rows is handed on in portions, the last of which is held until it is known what follows
                if size > 4 * most:
                    yield False, held
                    held, size = [], 0
                own = batch.column(1).slice(at, hi - at)
                ends = np.frombuffer(own.buffers()[1], np.int32, len(own) + own.offset + 1)[own.offset :]
                to = min(at + max(1, int(np.searchsorted(ends, int(ends[0]) + most, side="right")) - 1), hi)
                held.append(batch.slice(at, to - at))
                size += held[-1].nbytes
                at = to
    if held:
        yield True, held
