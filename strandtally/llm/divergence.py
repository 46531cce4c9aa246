"""Operator 11: how the word use of sources diverges, within each language.

Plain relational once terms are cut out: a small Arrow kernel finds them and leaves, for each piece of some megabytes of texts, a row for each
language, source and term with its occurrences and documents, which Spark groups and sums; each (language, source) group and each language as
a whole is crossed with the language's kept vocabulary, so that zeros count; smoothed shares are compared by a self-join on language and term,
summed, and ranked by windows.  The crossing goes by language and a salt of the term, and pairs by language and a salt
of the source, as one language may hold most rows.  All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.llm._shared import chunks, table, words, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a term is a longest run of [^\x00-\x40\x5B-\x60\x7B-\x7F]; all bytes of a character beyond ASCII are outside these, so bytes tell the same
TERM_BREAKS = np.arange(256) < 0x80
TERM_BREAKS[[ord(c) for c in UPPER + LOWER]] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
#: texts that are tallied together
PIECE_BYTES = 8 << 20
#: rows that leave the kernel at once
OUT_ROWS = 1 << 16
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
SMOOTHING, SCALE = 5, 1_000_000_000
SALTS = 64
#: up to this count SCALE * (count + SMOOTHING) fits a BIGINT
_MOST = 9_000_000_000


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly; by decimals only where the product outgrows a BIGINT."""
    below = total + F.lit(SMOOTHING) * kept
    short = F.call_function("div", (F.least(count, F.lit(_MOST)) + SMOOTHING) * F.lit(SCALE), below)
    long = F.call_function("div", (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(count <= _MOST, short).otherwise(long)


def salted(rows: DataFrame, by: str | None) -> DataFrame:
    """rows with a salt of the column, or (None) once for each salt."""
    if by is None:
        return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def term_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, texts that hold it) of each group and term that occur; group: a small number for each text."""
    starts, ends, at = words(data, offsets, TERM_BREAKS)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = LOWERED[data[~TERM_BREAKS[data]]]
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(letters)).dictionary_encode()
    # sorted by term, group and text, as texts are numbered in the order of their groups
    order = np.argsort(group, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    keys = terms.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(number, np.diff(at))
    keys.sort()
    texts = np.flatnonzero(np.diff(keys, prepend=-1))
    code, own = np.divmod(keys[texts], max(len(order), 1))
    own = group[order][own]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
    n = np.diff(np.append(texts[first], len(keys)))
    return terms.dictionary.take(pa.array(code[first])), own[first], n, np.diff(np.append(first, len(texts)))


def long_counts(data: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """term_counts() of one long text, by pieces of about `most` bytes that end where no term does on."""
    held, lo = None, 0
    while lo < len(data):
        hi = lo + most
        while hi < len(data) and not (gap := TERM_BREAKS[data[hi : hi + most]]).any():
            hi += most
        hi = hi + int(gap.argmax()) if hi < len(data) else len(data)
        term, _, n, _ = term_counts(data[lo:hi], np.array([0, hi - lo]), np.zeros(1, np.int64))
        own = pa.table({"term": term, "n": pa.array(n, pa.int64())})
        held = own if held is None else pa.concat_tables([held, own]).group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        lo = hi
    term = held["term"].combine_chunks()
    return term, np.zeros(len(term), np.int64), held["n"].to_numpy(), np.ones(len(term), np.int64)


def tallied(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text) a row (lang, source, term, n, held) for each of the three in pieces of about `most` bytes: occurrences, and texts with the term."""
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in range(2))
        pairs = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
        for lo, hi, data, offsets in chunks(batch.column(2), most):
            _, first, group = np.unique(pairs[lo:hi], return_index=True, return_inverse=True)
            term, own, n, held = long_counts(data, most) if len(data) > most else term_counts(data, offsets, group)
            for k in range(0, len(term), OUT_ROWS):
                at = slice(k, k + OUT_ROWS)
                named = [batch.column(i).take(pa.array(lo + first[own[at]])) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*named, term[at], pa.array(n[at], pa.int64()), pa.array(held[at], pa.int64())], names=["lang", "source", "term", "n", "held"])


def kept_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """groups(lang, source); and counts(lang, source, term, n) of the terms that at least so many rows of the language hold."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = df.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    each = rows.mapInArrow(tallied, "lang string, source string, term string, n long, held long")
    counts = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    # a row for each source of a language that has the term
    held = F.sum("held").over(W.partitionBy("lang", "term"))
    return rows.select("lang", "source").distinct(), counts.withColumn("held", held).where(F.col("held") >= least).select("lang", "source", "term", "n")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of language and source.

    Part `pair`: the other sources of the language, by the sum of differences of all kept terms' shares (0 where no term is kept), all of them.  Part
    `term`: the kept terms that the group has and uses more than the language as a whole, the first `top` of them.  Ranks are by value, greatest first,
    and by the item's bytes where values are equal.  Null texts, languages and sources count as empty strings; repeated rows are documents of
    their own.  An empty table, or a language of one source with no kept term, gives no rows.  Other columns are ignored.
    """
    groups, counts = kept_counts(df, text_col, lang_col, source_col, least)
    groups, counts = written(groups, "groups"), written(counts, "counts")
    kept = counts.select("lang", "term").distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")

    # every group with every kept term of its language
    shaped = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", zero))
    dense = salted(kept, "term").join(salted(shaped, None), ["lang", "_salt"]).drop("_salt").join(counts, ["lang", "source", "term"], "left")
    dense = dense.select("lang", "source", "term", F.coalesce("n", zero).alias("n"), share(F.coalesce("n", zero), F.col("total"), F.col("v")).alias("p"))
    dense = written(dense, "dense")

    a, b = (dense.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}")) for x in "ab")
    sums = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    every = salted(groups, "source").join(salted(groups.withColumnRenamed("source", "item"), None), ["lang", "_salt"]).where("source <> item").drop("_salt")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("all_total")).join(sizes, "lang")
    usual = salted(whole, "term").join(salted(sums, None), ["lang", "_salt"]).select("lang", "term", share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"))
    terms = dense.where("n > 0").join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
