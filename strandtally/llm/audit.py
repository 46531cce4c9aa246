"""Operator 13: how document filters interact, over all orders in which they can stand.

A pass over the Arrow buffers finds for each document which filters it fails:
byte classes and prefix sums count words, capitals and symbols, and the sorted hashes of each document's words, equal
neighbours compared byte by byte, count distinct words.  What leaves it is a mask, the part and a digest of the text.  Copies are
found by their digest (SHA-256) with the smallest id that has it; groups of copies are reduced to counts before they are moved.  All figures of all
orders follow from the numbers of documents of each mask (at most 32 a part).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.llm._shared import chunks, table, word_hashes, words

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
#: bytes that begin a code point
_LEAD = (np.arange(256) & 0xC0) != 0x80


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """The number of distinct words of each text; keys (by default their hashes) are the same for equal words."""
    n = len(first) - 1
    document = np.repeat(np.arange(n), np.diff(first))
    keys = word_hashes(data, starts, ends) if keys is None else keys
    bits = max(n - 1, 0).bit_length()
    # one number to sort by: the text in front, then as much of the key as there is room for
    code = keys if not bits else (document.astype(np.uint64) << np.uint64(64 - bits)) | (keys >> np.uint64(bits))
    order = np.argsort(code)
    code = code[order]
    same = np.flatnonzero(code[1:] == code[:-1])
    out = np.diff(first) - np.bincount(document[order[same]], minlength=n)
    # neighbours of equal keys are compared; a text where two differ is counted by its words themselves
    a, b = order[same], order[same + 1]
    size = ends - starts
    wrong = size[a] != size[b]
    a, b = a[~wrong], b[~wrong]
    differ = np.zeros(len(a), dtype=bool)
    for at in range(0, int(size[a].max(initial=0))):
        live = np.flatnonzero(size[a] > at) if at else np.arange(len(a))
        if at >= 64:  # few words are that long: whole ones
            for i in live:
                differ[i] |= data[starts[a[i]] : ends[a[i]]].tobytes() != data[starts[b[i]] : ends[b[i]]].tobytes()
            break
        differ[live] |= data[starts[a[live]] + at] != data[starts[b[live]] + at]
    odd = np.union1d(document[order[same][wrong]], document[a[differ]])
    for i in odd:
        out[i] = len({data[s:e].tobytes() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)})
    return out


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask for each text: bits 0 to 3 are set where it fails A to D."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    few = n < LEAST_WORDS
    alike = 100 * distinct_words(data, starts, ends, first) < LEAST_DISTINCT * n
    loud = 100 * per_text(_CAPITAL[data], offsets) > MOST_CAPITALS * per_text(_LEAD[data], offsets)
    odd = per_text(_SYMBOL[data], offsets) > 0
    return few + 2 * alike + 4 * loud + 8 * odd


def marked(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask) for each row: what it fails of A to D."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(3)):
                own = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(failures(data, offsets).astype(np.int32))], names=["id", "part", "digest", "mask"])

    return rows.mapInArrow(run, "id long, part string, digest binary, mask int")


def mask_counts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters that they fail (bit 4 is E), and how many of them are labelled so.

    E fails a row whose text is also that of a smaller id.  A row with a null id is neither smaller nor larger than another, so it never fails E,
    and has no label.  Rows with one id don't fail each other.  Of several labels of one id the greatest of each kind counts.
    """
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows of one id become one before the join with its label
    rows = marked(df, id_col, text_col, part_col).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.where("id is not null").join(told, "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    zero = F.lit(0)
    rows = rows.select("id", "digest", "part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    # copies are summed up before they meet: a row for each task and kind of copy, with its smallest id and the rows that have it
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    head = F.min("least.id").over(W.partitionBy("digest"))
    whole = F.col("unnamed") + F.when(F.col("least.id") == head, F.col("least.n")).otherwise(0)
    groups = groups.withColumn("whole", whole)
    copies = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("whole").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("whole")).alias("n"))))
    split = groups.select("part", "good", "toxic", copies.alias("c")).select("part", "good", "toxic", "c.*").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), from mask_counts(): a row for each order and step of each part.

    shapley: of the documents that fail some filters, each of these comes first in an equal share of the orders.
    """
    steps = []
    for order in itertools.permutations(filters):
        bits = [1 << filters.index(c) for c in order]
        steps += [("".join(order), i + 1, bit, sum(bits[:i])) for i, bit in enumerate(bits)]
    orders = math.factorial(len(filters))
    own = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    literal = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for order, step, bit, before in steps])
    rows = own.select("part", "masks", F.explode(literal).alias("s")).select("part", "masks", "s.*")

    def total(which: Callable[[Column], Column], what: Callable[[Column], Column] = lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", lambda m: which(m["mask"])), F.lit(0).cast("long"), lambda s, m: s + what(m))

    fails = lambda x: x.bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x.bitwiseAND(F.col("before")) != 0
    here = lambda x: fails(x) & ~gone(x)
    firsts = F.array(*[F.lit(orders // max(1, n)) for n in range(len(filters) + 1)])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x == F.col("bit")).alias("unique_fails"),
        total(here, lambda m: m["good"]).alias("good_lost"),
        total(here, lambda m: m["toxic"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * F.get(firsts, F.bit_count(m["mask"]))).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of filters A to E over df; labels(doc_id, quality, toxic).

    A null text is empty (and a copy of other empty ones), a null part the empty string.  An empty table has no parts and so no rows.  Other columns
    are ignored.  See mask_counts() for null and repeated ids.
    """
    return interactions(mask_counts(df, labels, id_col, text_col, part_col))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
