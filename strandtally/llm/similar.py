"""Near-duplicates by the Jaccard similarity of word shingles, for stages of a pipeline.

Candidates share one of BANDS bands of ROWS MinHash values: at a similarity of 0.8 a pair has no band in common
with probability (1 - 0.8 ** 4) ** 24 = 3e-6.  Of those, pairs that agree in NEAR or more of all 96 values, compared by
one byte each, form groups (a pair of similarity 0.8 agrees in fewer with probability 3e-7); what joins a group is a
forest, not all of its pairs.  A group's texts then move once, in blocks if they are many, and all pairs within a block that are not yet
linked are verified on their full shingle sets.  The blocks of a group are joined by a representative of each of their classes.  Only where a
group has several classes even then do the texts outside its largest class meet all others.  So a large group of copies costs
about its size in rows moved, not its square; only what lies outside the largest class moves once for each block of the group.
Texts with equal sets are one entry.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.llm._shared import chunks, components, drop_written, grouped_blocks, mix64, release, whole_cells, window_hashes, word_hashes, words, written

BANDS, ROWS = 24, 4
NEAR = 56
BLOCK = 2048
#: shingles of a block of a group
BLOCK_SHINGLES = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words, A-Z as a-z; a shorter text is one run, one without words none."""
    starts, ends, first = words(data, offsets)
    values = word_hashes(data, starts, ends, lower=True)
    runs = window_hashes(values, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(runs[a : b - width + 1]) if b - a >= width else window_hashes(values[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, BANDS): a 64-bit key for each band, and (sets, BANDS * ROWS): a byte of each MinHash value; no set may be empty."""
    joined = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    odd = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    sketch = np.zeros((len(sets), BANDS * ROWS), np.uint8)
    for i in range(BANDS * ROWS):
        least = mix64(np.minimum.reduceat((joined ^ odd[2 * i]) * odd[2 * i + 1], at))
        sketch[:, i] = (least >> np.uint64(56)).astype(np.uint8)
        keys[:, i // ROWS] = mix64(keys[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(i // ROWS + 1))
    return keys, sketch


def shingled(rows: DataFrame, width: int) -> DataFrame:
    """(id, dig, n, bands, sketch) for each (id, text) with words; dig names the set, n is its size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = shingles(data, offsets, width)
                some = np.flatnonzero([len(s) for s in sets])
                if not len(some):
                    continue
                sets = [sets[i] for i in some]
                size = np.array([len(s) for s in sets])
                # order does not matter for the sum of mixed values, and a set has each once
                total = np.add.reduceat(mix64(np.concatenate(sets)), np.cumsum(size) - size)
                dig = mix64(total + size.astype(np.uint64)).view(np.int64)
                keys, sketch = band_keys(sets)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(dig), pa.array(size), bands, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["id", "dig", "n", "bands", "sketch"])

    return rows.mapInArrow(mark, "id long, dig long, n long, bands array<long>, sketch binary")


def joined_up(n: np.ndarray, least: float, linked: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the classes of entries in ascending order of their sizes n; a label is the place of a member (those given: what is known before).

    linked(i, others) tells which of the others are linked to i.  Entries too different in size
    aren't asked for, nor those that are of i's class already.
    """
    label = np.arange(len(n)) if label is None else label.copy()
    ends = np.searchsorted(n, n / least + 1e-9, side="right")
    for i in range(len(n) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 : ends[i]] != label[i])
        found = np.unique(label[others[linked(i, others)]]) if len(others) else others
        if len(found):
            label[np.isin(label, found)] = label[i]
    return label


def edges_of(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) from each entry to the one that its class is named after."""
    a, b = node[label], node
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def bounds(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end position of each run of equal cells."""
    cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True)


def candidate_edges(lists: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of nodes that share a band and agree in NEAR of their MinHash values; lists(key, node, n, sketch)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches):
            cell, node, n = (part.column(i).to_numpy() for i in range(3))
            sketch = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            for lo, hi in bounds(cell):
                order = lo + np.argsort(n[lo:hi], kind="stable")
                own = sketch[order]
                label = joined_up(n[order], least, lambda i, others, own=own: np.count_nonzero(own[others] == own[i], axis=1) >= NEAR)
                yield edges_of(node[order], label)

    cells = grouped_blocks(lists, "key", "node", BLOCK).select("cell", "node", "n", "sketch")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def dealt(groups: DataFrame) -> DataFrame:
    """groups(node, root, n) in blocks of about BLOCK_SHINGLES: with parts, the number of blocks of the group, and own, the node's block."""
    parts = groups.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts"))
    return groups.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(13)), "parts").cast("int"))


def verify(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the classes in each cell, of (cell, node, text, class) sorted by cell."""
    for part in whole_cells(batches, 1):
        for lo, hi in bounds(part.column(0).to_numpy()):
            some = part.slice(lo, hi - lo)
            node, known = some.column(1).to_numpy(), some.column(3).to_numpy()
            sets = [s for piece in some.column(2).chunks for _, _, data, offsets in chunks(piece) for s in shingles(data, offsets, width)]
            n = np.array([len(s) for s in sets])
            order = np.argsort(n, kind="stable")[np.count_nonzero(n == 0) :]
            if len(order) < 2:
                continue
            node, n, known = node[order], n[order], known[order]
            names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
            own = np.split(flat.astype(np.int32), np.cumsum(n)[:-1])
            mark = np.zeros(len(names), np.uint8)

            def linked(i: int, others: np.ndarray, n=n, own=own, mark=mark) -> np.ndarray:
                mark[own[i]] = 1
                size = n[others]
                common = np.add.reduceat(mark[np.concatenate([own[j] for j in others])], np.cumsum(size) - size, dtype=np.int64)
                mark[own[i]] = 0
                return common >= least * (n[i] + size - common) - 1e-9

            _, first, back = np.unique(known, return_index=True, return_inverse=True)
            yield edges_of(node, joined_up(n, least, linked, first[back]))


def representatives(classed: DataFrame) -> DataFrame:
    """(node, class, cells): the smallest node of each class of a group, each pair of them in a cell."""
    some = dealt(classed.where("node = class").select("node", "root", "n"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("root", F.least("own", other), F.greatest("own", other)))
    return some.select("node", F.col("node").alias("class"), cells.alias("cells"))


def outsiders(classed: DataFrame) -> DataFrame:
    """(node, class, cells): each pair of nodes of a group that aren't both in its largest class in a cell; groups of one class are left out."""
    sizes = classed.groupBy("root", "class").agg(F.sum("n").alias("n"))
    main = sizes.groupBy("root").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count("*").alias("classes")).where("classes > 1")
    marked = classed.join(main, "root").withColumn("out", F.col("class") != F.col("main"))
    blocks = marked.groupBy("root").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("out") == kind, F.col("n")).otherwise(0)) / F.lit(BLOCK_SHINGLES)).cast("int")).alias(name) for kind, name in ((True, "q"), (False, "p"))])
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.when(F.col("out"), F.col("q")).otherwise(F.col("p"))).cast("int")
    rows = marked.join(blocks, "root").withColumn("own", own)
    outer = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda v: F.xxhash64("root", F.least("own", v), F.greatest("own", v), F.lit("out")))
    inner = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda v: F.xxhash64("root", "own", v, F.lit("in")))
    main_cells = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda u: F.xxhash64("root", u, "own", F.lit("in")))
    return rows.select("node", "class", F.when(F.col("out"), F.concat(outer, inner)).otherwise(main_cells).alias("cells"))


def verified_edges(groups: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b) that join all nodes of groups(node, root, n) that are linked by similarities of `least` or more within a group."""
    blocks = written(dealt(groups), "blocks")
    edges = written(checked(blocks.select("node", F.col("node").alias("class"), F.array(F.xxhash64("root", "own")).alias("cells")), rows, width, least), "verified")
    several = blocks.where("parts > 1").select("root", "node", "n")
    if several.isEmpty():
        return edges
    for cells_of in (representatives, outsiders):
        known = components(edges).select("node", F.col("root").alias("class"))
        classed = written(several.join(known, "node", "left").withColumn("class", F.coalesce("class", "node")), "classed")
        if classed.groupBy("root").agg(F.count_distinct("class").alias("classes")).where("classes > 1").isEmpty():
            break
        edges = written(edges.unionByName(checked(cells_of(classed), rows, width, least)), "verified")
    return edges


def checked(cells: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Edges within each cell of cells(node, class, cells array<long>); nodes of one class are linked already."""
    # whole texts move by id once, repeated ones as one, and then to their cells
    texts = rows.groupBy(F.col("id").alias("node")).agg(F.collect_set("text").alias("texts"))
    moved = texts.join(cells.hint("shuffle_merge"), "node").select("node", "class", "cells", F.explode("texts").alias("text")).select(F.explode("cells").alias("cell"), "node", "text", "class")
    return moved.repartition("cell").sortWithinPartitions("cell").mapInArrow(functools.partial(verify, width=width, least=least), "a long, b long")


def similar_components(df: DataFrame, links: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) for the ids that reach a smaller one: by similarities of `least` or more, or by links (a, b).

    Null ids and texts without words are linked by nothing here.  Of different texts with one id each counts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    marked = written(shingled(rows, width), "bands")
    # equal sets have equal sizes, bands and sketches
    entries = written(marked.groupBy("dig").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "entries")
    equal = written(marked.select("id", "dig").join(entries.select("dig", "node"), "dig").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")), "equal")
    drop_written(marked)
    lists = entries.select("dig", F.explode("bands").alias("key"))
    shared = written(lists.join(lists.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1").select("key"), "key", "left_semi"), "shared")
    release(spark)
    cells = shared.join(entries.select("dig", "node", "n", "sketch"), "dig").select("key", "node", "n", "sketch")
    roots = components(candidate_edges(cells, least))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    drop_written(shared)
    groups = written(roots.join(entries.groupBy("node").agg(F.sum("n").alias("n")), "node"), "groups")
    drop_written(entries)
    release(spark)
    edges = verified_edges(groups, rows, width, least)
    edges = edges.unionByName(equal)
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
    return components(edges)
