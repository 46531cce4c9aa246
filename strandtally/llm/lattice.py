"""Operator 5: embedding near-duplicates by lattice hashing.

Unit vectors are projected to 8 dimensions by random matrices, one for each of
several tables, and decoded to the nearest point of the E8 lattice.  A vector is
filed under its own cell and the nearest neighbouring cells (the lattice's 240
shortest vectors away) of each table; two vectors that share a cell are compared by
their cosine in double precision.  Of 8,000 random pairs at a cosine of exactly 0.95, 0.9998 share
a cell with the defaults in 16 and in 64 dimensions, 0.9997 in 384 (closer pairs do so more often).

Equal vectors are one entry with a weight.  A pair that shares several cells is counted in
the smallest of them alone, so neither pairs nor links are ever collected by
vector; a large cell is dealt over several tasks by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import cell_pairs, components, forest, grouped_blocks, table, whole_cells, written

BLOCK = 1024


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, from their rule."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the closer of the two cosets."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cell_keys(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = 5) -> np.ndarray:
    """(vectors, tables * (1 + probes)) keys of the cells under which vectors are filed."""
    n, width = unit.shape
    out = np.empty((n, tables, 1 + probes), dtype=np.uint64)
    for t in range(tables):
        projection = np.random.default_rng([seed, t, width]).normal(size=(width, 8))
        at = unit @ projection / scale
        own = nearest(at)
        points = [own]
        if probes:
            gain = (at - own) @ shortest().T
            order = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            points += [own + shortest()[order[:, i]] for i in range(probes)]
        for i, point in enumerate(points):
            h = np.full(n, 1 + t + tables * width, dtype=np.uint64)
            for c in (2 * point).astype(np.int64).T:
                h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, t, i] = h
    return out.reshape(n, -1)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, tables: int = 8, probes: int = 2, scale: float = 1.2) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    n_links counts the other rows linked directly, component_id is the smallest id
    reachable.  A vector that is null, zero or holds a null or non-finite component
    links with nothing; so do vectors of different lengths with each other.  Rows of equal
    vectors link.  A null id is a row like any other, with a null component_id if it has
    no links.  Other columns are ignored.
    """
    values = F.col(vector_col).cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(good, values).alias("v"))
    # equal vectors by 96 bits of hash; adding 0.0 makes one zero of two
    even = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(even)).alias("h"), F.when(F.col("v").isNotNull(), F.hash(even)).alias("g"))
    classes = written(rows.where("h is not null").groupBy("h", "g").agg(F.first("v").alias("v"), F.min("id").alias("node"), F.count("*").alias("weight")).where("node is not null"), "vectors")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for width in np.unique(sizes):
                for own in np.array_split(np.flatnonzero(sizes == width), max(1, int((sizes == width).sum()) // 1000)):
                    x = flat[first[own][:, None] + np.arange(width)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    keys = cell_keys(x, tables, probes, scale)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(batch.column(1).to_numpy()[own], keys.shape[1])),
                            pa.array(np.repeat(batch.column(2).to_numpy()[own], keys.shape[1])),
                            pa.array(keys.reshape(-1).view(np.int64)),
                            pa.array([b for b in [r.tobytes() for r in keys] for _ in range(keys.shape[1])], pa.binary()),
                            pa.array([b for b in [r.tobytes() for r in x] for _ in range(keys.shape[1])], pa.binary()),
                        ],
                        names=["node", "weight", "key", "keys", "unit"],
                    ) if n else pa.RecordBatch.from_pylist([], schema=filed)

    filed = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("key", pa.int64()), ("keys", pa.binary()), ("unit", pa.binary())])
    lists = classes.select("v", "node", "weight").mapInArrow(file, "node long, weight long, key long, keys binary, unit binary")
    cells = grouped_blocks(lists, "key", "node", BLOCK).select("cell", "key", "_own", "_lo", "_hi", "node", "weight", "keys", "unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, 5_000):
            cell, key, own, lo, hi, node, weight = (part.column(i).to_numpy() for i in range(7))
            keys = np.stack([np.frombuffer(b, np.uint64) for b in part.column(7).to_pylist()])
            units = part.column(8).to_pylist()
            widths = np.array([len(u) // 8 for u in units])
            left, right = [], []
            for width in np.unique(widths):  # cells of one width: it is part of the key
                rows = np.flatnonzero(widths == width)
                x = np.stack([np.frombuffer(units[i], np.float64) for i in rows])
                for a, b in close_pairs(cell[rows], x, cosine):
                    left.append(rows[a])
                    right.append(rows[b])
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            # each pair in the smallest cell that it shares, and there in its own two blocks
            mine = (np.minimum(own[a], own[b]) == lo[a]) & (np.maximum(own[a], own[b]) == hi[a])
            a, b = a[mine], b[mine]
            least = np.empty(len(a), dtype=np.uint64)
            for s in range(0, len(a), 4096):
                p, q = keys[a[s : s + 4096]], keys[b[s : s + 4096]]
                least[s : s + 4096] = np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, np.uint64(0xFFFFFFFFFFFFFFFF)).min(axis=1)
            mine = least == key[a].view(np.uint64)
            a, b = a[mine], b[mine]
            names, member = np.unique(node, return_inverse=True)
            links = np.bincount(member[a], weights=weight[b], minlength=len(names)) + np.bincount(member[b], weights=weight[a], minlength=len(names))
            root = forest(len(names), member[a], member[b])
            some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([names[some], names[root[moved]]])), pa.array(np.concatenate([names[some], names[moved]])), pa.array(np.concatenate([links[some], np.zeros(len(moved))]).astype(np.int64))],
                names=["a", "b", "links"],
            )

    found = written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long, links long"), "links")
    root = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("h", "g", "node", "weight").join(links, "node", "left").join(root, "node", "left")
    named = named.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("id", "h", "g").join(named, ["h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def close_pairs(cells: np.ndarray, unit: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell with the cosine or a greater one; large cells by matrix products."""
    _, first, size = np.unique(cells, return_index=True, return_counts=True)
    large = np.repeat(size > 64, size)
    rows = np.flatnonzero(~large)
    for a, b in cell_pairs(cells[rows], 1 << 13):
        near = np.einsum("ij,ij->i", unit[rows[a]], unit[rows[b]]) >= cosine
        yield rows[a[near]], rows[b[near]]
    for s, n in zip(first[size > 64], size[size > 64], strict=True):
        for lo in range(s, s + n, 256):
            hi = min(lo + 256, s + n)
            a, b = np.nonzero(unit[lo:hi] @ unit[lo : s + n].T >= cosine)
            yield (a + lo)[a < b], (b + lo)[a < b]


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
