"""Operator 3: SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of
their 8 bytes.  The inverted index is keyed by byte positions with their
values; as a posting list for each single byte would hold a 256th of all
documents, lists are kept for triples of positions, chosen (Turan's
construction of 20 triples) so that any 4 agreeing positions hold one of them.  Pairs that
meet in a list are tallied: those that share fewer than the guaranteed
number of positional bytes go, the rest are verified by their differing bits.

Equal fingerprints are one entry of the index.  A list of more than `block` entries
is dealt over several tasks by pairs of blocks; only the edges of a spanning
forest leave a list, and components are found by star contraction.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import cell_pairs, chunks, components, forest, grouped_blocks, table, whole_cells, written

BYTES, SEED = 8, 42
BLOCK = 2048
#: hashes whose bits are spread at once
FOLD = 1 << 15


def shingle_fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of one text, as the batches below compute it."""
    own = text.lower().split()
    hashes = shingle_hashes(own, width)
    return int(fold(np.array(hashes, dtype=np.uint64), np.array([0]), np.array([len(hashes)]))[0]) if hashes else 0


def shingle_hashes(own: list[bytes], width: int) -> array:
    if not own:
        return array("Q")
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    if len(own) <= width:
        return array("Q", [digest(joined, SEED)])
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts, stops = np.append(0, ends[: len(own) - width] + 1), ends[width - 1 :]
    out = array("Q")
    for lo in range(0, len(starts), FOLD):
        out.extend([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + FOLD].tolist(), stops[lo : lo + FOLD].tolist(), strict=True)])
    return out


def fold(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes: the bits that are set in over half of them."""
    out = np.zeros(len(starts), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        ones = np.zeros((len(some), 8 * BYTES), dtype=np.int32)
        first = starts[some]
        # bits are spread a piece at a time, which may cut a run
        for lo in range(0, len(hashes), FOLD):
            bits = np.unpackbits(hashes[lo : lo + FOLD].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
            own = slice(int(np.searchsorted(first, lo, side="right")) - 1, int(np.searchsorted(first, lo + FOLD)))
            ones[own] += np.add.reduceat(bits, np.maximum(first[own] - lo, 0), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) for each row; a text without words, or null, has fingerprint zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                raw = data.tobytes().lower()
                hashes, sizes = array("Q"), []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = shingle_hashes(raw[a:b].split(), width)
                    hashes += own
                    sizes.append(len(own))
                sizes = np.array(sizes)
                out = fold(np.array(hashes, dtype=np.uint64), np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(mark, "id long, fp long")


def position_triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions of which any 4 positions hold one: within a third, or two of a third and one of the next."""
    third = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(BYTES), 3):
        kinds = sorted(third[i] for i in t)
        if len(set(kinds)) == 1 or kinds in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
            out.append(t)
    return out


def tally(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a spanning forest of the links in some cells, of (cell, node, fp) sorted by cell."""
    least = BYTES - max_bits
    low, one = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x0101010101010101)
    for part in whole_cells(batches):
        node = part.column(1).to_numpy()
        fp = part.column(2).to_numpy().view(np.uint64)
        # the same entry in several cells is one member
        names, member = np.unique(node, return_inverse=True)
        root = np.arange(len(names))
        for a, b in cell_pairs(part.column(0).to_numpy()):
            x = fp[a] ^ fp[b]
            y = (x | (x >> np.uint64(4))) & low
            y |= y >> np.uint64(2)
            y = (y | (y >> np.uint64(1))) & one
            shared = BYTES - np.bitwise_count(y).astype(np.int8)
            keep = np.flatnonzero(shared >= least)
            keep = keep[np.bitwise_count(x[keep]) <= max_bits]
            # links are taken up as they come: in a group of near copies almost all pairs are links
            u, v = root[member[a[keep]]], root[member[b[keep]]]
            new = u != v
            if new.any():
                root = forest(len(names), u[new], v[new])[root]
        own = np.flatnonzero(root != np.arange(len(names)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(names[root[own]]), pa.array(names[own])], names=["a", "b"])


def near_edges(reps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) that join all of reps (node, fp; fp distinct) within max_bits <= 4 of each other into the same components."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be from 0 to 4")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = [F.lit(n * (1 << 24)) + byte[a] * 65536 + byte[b] * 256 + byte[c] for n, (a, b, c) in enumerate(position_triples())]
    lists = reps.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    cells = grouped_blocks(lists, "key", "fp", BLOCK).select("cell", "node", "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(functools.partial(tally, max_bits=max_bits), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp long, component_id) for each row: the smallest id reachable by links of at most max_bits differing bits.

    Texts that are null or have no words have fingerprint zero and link like
    any other.  Repeated rows are repeated in the result; a null id has the component of its fingerprint and
    is never a component's name unless no id there is known.  Other columns are ignored.
    """
    marked = written(fingerprints(df, id_col, text_col, width), "fingerprints")
    reps = written(marked.groupBy("fp").agg(F.min("id").alias("node")), "classes")
    root = components(near_edges(reps.where("node is not null"), max_bits))
    named = reps.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
