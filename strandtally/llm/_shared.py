"""What the operators of this subpackage have in common.

* tables are read and written through Spark only;
* intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
* numpy kernels work on Arrow buffers, a bounded number of bytes at a time.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
WORD_BREAKS = np.zeros(256, dtype=bool)
WORD_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is named (tests), one temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named.rstrip("/") if named else _own_dir()


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.shared_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing will read again."""
    drop_path(df.sparkSession, df.shared_path)


def stored(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like written(), but as a table bucketed by key, so that joins with it by the key move the other side only."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.shared_path, out.table_name = path, name
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table made by stored()."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
    drop_path(spark, df.shared_path)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    held = column.buffers()
    offsets = np.frombuffer(held[1], dtype=width, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(held[2], dtype=np.uint8) if held[2] is not None and held[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in pieces of about `most` bytes; a longer text is a piece of its own."""
    if not len(column):
        return
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_RADIX = 0x5851F42D4C957F2D
#: keeps the first n bytes of a little-endian lane
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 256


class Powers:
    """Powers of the hash radix modulo 2**64, grown on demand."""

    def __init__(self, radix: int = _RADIX):
        self.radix, self.inverse = radix, pow(radix, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.radix), ("down", self.inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = Powers()


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text the index of its first word (one more at the end)."""
    gap = breaks[data]
    first = np.empty(len(data), dtype=bool)
    first[:1] = True
    first[1:] = gap[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = True
    last = np.empty(len(data), dtype=bool)
    last[-1:] = True
    last[:-1] = gap[1:]
    last[bounds[bounds > 0] - 1] = True
    starts = np.flatnonzero(first & ~gap)
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z.

    Words are taken by lanes of eight bytes, each mixed into what came before, so that words of equal length
    up to a lane never share a hash, and no structure of longer ones cancels out; very long words are digested whole.
    """
    size = (ends - starts).astype(np.int64)
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = 0
    while at < len(starts):  # a piece of about CHUNK_BYTES at a time; a longer word is a piece of its own
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        piece = data[base : ends[to - 1]]
        piece = np.concatenate([_LOWER[piece] if lower else piece, np.zeros(8, np.uint8)])
        lanes = np.lib.stride_tricks.as_strided(piece[:8].view(np.uint64), (len(piece) - 7,), (1,))
        first, own = starts[at:to] - base, size[at:to]
        for i in np.flatnonzero(own > LONG_WORD):
            out[at + i] = int.from_bytes(hashlib.blake2b(piece[first[i] : first[i] + own[i]], digest_size=8).digest(), "little")
        live = np.flatnonzero(own <= LONG_WORD)
        place = 0
        while len(live):
            lane = lanes[first[live] + place] & _LANE[np.minimum(own[live] - place, 8)]
            out[at + live] = mix64((out[at + live] ^ lane) * np.uint64(_RADIX) + np.uint64(place + 1))
            place += 8
            live = live[own[live] > place]
        at = to
    return out


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` consecutive values (across texts: the caller picks the starts that are valid)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[:n])


def grouped_blocks(df: DataFrame, key: str, spread: str, block: int) -> DataFrame:
    """Rows whose key occurs more than once, with a column `cell` to group by.

    A key of up to `block` rows is one cell.  A larger one is cut into blocks
    by `spread`, and each pair of its blocks is a cell of its own, so that
    no cell holds more than about two blocks and every pair of rows shares
    one, the one whose _lo and _hi are the pair's own blocks (_own).  Rows are
    repeated, never dropped.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = df.join(sizes, key)
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(11)), parts).cast("int")
    return (
        rows.withColumn("_parts", parts)
        .withColumn("_own", F.when(F.col("_parts") == 1, F.lit(0)).otherwise(own))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .withColumn("cell", F.xxhash64(F.col(key), "_lo", "_hi"))
        .drop("_n", "_parts", "_other")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each
    round is written to the shared folder, and joins rather than windows let
    adaptive execution split a node with many neighbours.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        drop_written(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_written(large)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == print_of:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        print_of = tuple(mark)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of 0..n-1, the smallest member of each member's class."""
    parent = np.arange(n)
    while len(left):
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, parent[left], low)
        np.minimum.at(parent, parent[right], low)
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        if (parent == before).all():
            break
    return parent


def release(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop the shuffle files of steps that are done and no longer referenced (the last job's are, until another ran)."""
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def squeeze(*arrays: np.ndarray, plain: bool = False) -> bytes:
    """Integer arrays, compressed by bytes of the same weight (as many as the values need): as differences of neighbours, or (plain) as they are."""
    sizes, packed = [], []
    for a in arrays:
        a = a.astype(np.int64, copy=False)
        if not plain:
            # small differences of either sign have small codes
            steps = a.copy()
            steps[1:] -= a[:-1]
            a = (steps << 1) ^ (steps >> 63)
        flat = a.view(np.uint64)
        width = max(1, -(-int(flat.max(initial=0)).bit_length() // 8))
        kind = np.dtype(f"<u{1 << (width - 1).bit_length()}")
        flat = flat.astype(kind, copy=False)
        # by shifts, which take less time than copies with a stride
        planes = np.empty((width, len(flat)), np.uint8)
        for i in range(width):
            planes[i] = flat >> kind.type(8 * i) if i else flat
        packed.append(_squeezer().compress(planes))
        sizes.append(len(packed[-1]) << 4 | width)
    return b"".join([np.array([-len(packed) if plain else len(packed), *sizes], np.int64).tobytes(), *packed])


def unsqueeze(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    plain, n = n < 0, abs(n)
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(data, np.int64, n, 8).tolist():
        size, width = size >> 4, size & 15
        flat = np.frombuffer(_unsqueezer().decompress(data[at : at + size]), np.uint8).reshape(width, -1)
        kind = np.dtype(f"<u{1 << (width - 1).bit_length()}")
        values = np.zeros(flat.shape[1] * kind.itemsize, np.uint8)
        for i in range(width):
            values[i :: kind.itemsize] = flat[i]
        values = values.view(kind).astype(np.uint64, copy=False)
        if plain:
            out.append(values.view(np.int64))
        else:
            out.append(np.cumsum((values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)))
        at += size
    return out


@functools.lru_cache(maxsize=1)
def _squeezer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.lru_cache(maxsize=1)
def _packer() -> zstandard.ZstdCompressor:
    """For texts, which are written once and moved several times."""
    return zstandard.ZstdCompressor(level=6)


@functools.lru_cache(maxsize=1)
def _unsqueezer() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def shelve(df: DataFrame, id_col: str, text_col: str, most: int, flag: Column | None = None) -> DataFrame:
    """The texts in shelves of about `most` bytes, written to a table of the warehouse without a shuffle.

    (shelf long, ids binary, ends binary, n_words long, texts binary): a shelf has
    its documents in order of id (null first) and is the unit of later exchanges, which so
    move compressed texts and arrays instead of a row for each word.  A
    longer text is a shelf of its own.  A flag, if given, is kept with the ids.
    """
    mark = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), mark.alias("flag"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        task, number = (TaskContext.get().partitionId(), 0) if TaskContext.get() else (0, 0)
        schema = pa.schema([("shelf", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("n_words", pa.int64()), ("texts", pa.binary())])

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            ids = np.concatenate([h[0] for h in held])
            none = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            data = np.concatenate([h[3] for h in held])
            order = np.lexsort((ids, ~none))
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = data.tobytes()
            texts = b"".join([raw[at[i] : at[i + 1]] for i in order])
            data = np.frombuffer(texts, np.uint8)
            ends = np.cumsum(sizes[order])
            count = len(words(data, np.concatenate([[0], ends]))[0])
            flags = np.concatenate([h[4] for h in held])
            row = [task << 33 | number, squeeze(ids[order], none[order], flags[order]), squeeze(ends), count, _packer().compress(texts)]
            held, number = [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            ids = batch.column(0)
            none = np.asarray(ids.is_null())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(1), most):
                if held and sum(len(h[3]) for h in held) + len(data) > most:
                    yield flush()
                held.append((values[lo:hi], none[lo:hi], np.diff(offsets), data.copy(), flags[lo:hi]))
        if held:
            yield flush()

    # bucketed by shelf, so that joins with the shelves move the other side only; a task holds few shelves and so writes few files
    spark = df.sparkSession
    name = f"shelves_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(pack, "shelf long, ids binary, ends binary, n_words long, texts binary")
    packed.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "shelf").format("parquet").saveAsTable(name)
    return spark.table(name)


def unshelve(ids: bytes, ends: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, which of them are null, the bytes of the texts, and their offsets."""
    values, none = unsqueeze(ids)[:2]
    (ends_,) = unsqueeze(ends)
    return values, none.astype(bool), np.frombuffer(_unsqueezer().decompress(texts), np.uint8), np.concatenate([[0], ends_])


def split_buckets(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that occurs, the (ascending) positions of its entries."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b] : bounds[b + 1]]


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by their first column, of `least` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            last = batch.column(0)[-1].as_py()
            # the last cell may begin in an earlier batch
            k = len(held) - 1
            while k and held[k].column(0)[0].as_py() == last and held[k - 1].column(0)[-1].as_py() == last:
                k -= 1
            cut = int(np.searchsorted(held[k].column(0).to_numpy(zero_copy_only=False), last))
            if k == 0 and cut == 0:
                continue
            yield pa.Table.from_batches([*held[:k], held[k].slice(0, cut)])
            held = [held[k].slice(cut), *held[k + 1 :]]
            rows = sum(h.num_rows for h in held)
    if held:
        yield pa.Table.from_batches(held)


def cell_pairs(cells: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of rows of the same cell, at most about `most` at a time; cells are sorted."""
    _, first, size = np.unique(cells, return_index=True, return_counts=True)
    place = np.arange(len(cells)) - np.repeat(first, size)
    left_over = np.repeat(size, size) - place - 1
    d = 1
    while len(at := np.flatnonzero(left_over >= d)):
        step = max(1, most // len(at))
        steps = np.arange(d, d + step)
        if step == 1:
            for lo in range(0, len(at), most):
                yield at[lo : lo + most], at[lo : lo + most] + d
        else:
            a = np.repeat(at, step)
            b = a + np.tile(steps, len(at))
            good = np.tile(steps, len(at)) <= left_over[a]
            yield a[good], b[good]
        d += step
