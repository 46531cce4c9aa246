"""Operator 8: secret scans.  Built-in functions only.

Base rules find assignments, access keys and long hexadecimal strings.  The method
adds candidate strings whose Shannon entropy, in the best window of `window`
characters, reaches the limit of their character class.  The counts of a window's
characters are carried along as it slides by one character (one leaves, one enters), and only the
entropy terms of these two change.  Windows that hold an allow-listed part don't count; candidates that
consist of words, and those that overlap a base span, are suppressed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._native import bound, count_of, joined_pieces, located, overlaps, said, scanned, span_runs
from strandtally.llm._shared import table

KINDS = ["assign", "access", "hex", "entropy"]
# The base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
#: (pattern of the whole candidate, bits a character that the best window must reach); the first that matches is the class.
CLASSES = ((r"^[0-9]+$", 3.2), (r"^[0-9a-fA-F]+$", 3.3), (r"^[A-Za-z0-9]+$", 4.0), (r".", 4.1))
#: What is no secret: parts that no window may hold (placeholders, a repeated character), and strings whose pieces between JOINTS are all words or short numbers.
ALLOW = r"(?i:example|placeholder|x{6,}|0{8,}|12345678)|(.)\1{7,}+"
JOINTS = r"[-_/]+"
WORD = r"^(?:[A-Za-z]?[a-z]*+|[A-Z]++|[0-9]{1,4})$"
MIXED_WORD = r"^[A-Za-z]++$"


def window_entropy(candidate: Column, window: int) -> Column:
    """The greatest entropy, in bits a character, of a window of the string (0 if it is shorter)."""

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def best(places: Column, counts: Column) -> Column:
        """places: the number of each character among the distinct ones; counts: those of the first window."""
        total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + term(n))

        def slide(state: Column, i: Column) -> Column:
            gone, new = F.get(places, i - 1), F.get(places, i + window - 1)
            less, more = F.get(state["counts"], gone), F.get(state["counts"], new)
            change = term(less - 1) - term(less) + term(more + 1) - term(more)
            counts = F.transform(state["counts"], lambda n, k: n - (k == gone).cast("int") + (k == new).cast("int"))
            moved = bound(state["sum"] + change, lambda now: F.struct(counts.alias("counts"), now.alias("sum"), F.least(state["least"], now).alias("least")))
            return F.when(gone == new, state).otherwise(moved)

        start = bound(total, lambda total: F.struct(counts.alias("counts"), total.alias("sum"), total.alias("least")))
        steps = F.when(F.size(places) > window, F.sequence(F.lit(1), F.size(places) - window)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, slide, lambda s: s["least"])

    def counted(characters: Column) -> Column:
        return bound(F.array_distinct(characters), lambda kinds: bound(F.transform(characters, lambda c: (F.array_position(kinds, c) - 1).cast("int")), lambda places: best(places, first_counts(kinds, places))))

    def first_counts(kinds: Column, places: Column) -> Column:
        return F.transform(kinds, lambda _, k: F.size(F.filter(F.slice(places, 1, window), lambda p: p == k)))

    # entropy = log2(window) - sum(c * log2(c)) / window
    return F.when(F.length(candidate) >= window, F.log2(F.lit(float(window))) - bound(F.split(candidate, ""), counted) / F.lit(float(window))).otherwise(F.lit(0.0))


def words_only(candidate: Column) -> Column:
    """Whether a string is words and short numbers, joined or one."""
    parts = F.filter(F.split(candidate, JOINTS), lambda p: p != "")
    joined = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(WORD) | p.rlike(MIXED_WORD))
    return joined | F.forall(parts, lambda p: p.rlike(WORD))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, base, spans): arrays of struct<start,kind,end>, in that order; kind is the number in KINDS.

    base holds what the base rules find, spans also what the method adds.
    Positions are code points, end exclusive.  A null or empty text has no spans.  Matches of different kinds may
    overlap; at the same place the kinds stand in the order of KINDS.  Repeated rows, and rows with a null id, are rows like any
    other.  Other columns are ignored; `keep` may not name one of the result's own columns.
    """
    rows = df.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    base, spans = spans_of(F.col("_text"), window)
    return rows.withColumn("base", base).withColumn("spans", spans(F.col("base"))).drop("_text")


def spans_of(text: Column, window: int) -> tuple[Column, Callable[[Column], Column]]:
    """The base spans of a text that is not null; and from them (given once they are computed) all spans."""

    def span(kind: int) -> object:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    assign = F.transform(F.filter(located(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8), span(0))
    access = F.transform(located(text, ACCESS), span(1))
    hexes = F.transform(located(text, HEX), span(2))

    def secret(s: Column, base: Column) -> Column:
        """base: the base spans in runs."""
        c = s["match"]
        limit = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES):
            limit = F.when(c.rlike(pattern), F.lit(bits)).otherwise(limit)
        known = overlaps(base, s)
        free = F.array_max(F.transform(F.split(c, ALLOW), lambda piece: window_entropy(piece, window)))
        return F.when(known | words_only(c), F.lit(False)).otherwise(free >= limit)

    def spans(base: Column) -> Column:
        added = bound(span_runs(base), lambda runs: F.transform(F.filter(located(text, CANDIDATE), lambda s: secret(s, runs)), span(3)))
        return F.array_sort(F.concat(base, added))

    return F.array_sort(F.concat(assign, access, hexes)), spans


def redact(df: DataFrame, text_col: str = "text", mark: str = "<secret>", window: int = 24) -> DataFrame:
    """df with each span of its texts replaced by the mark; overlapping spans by one.

    Null texts stay null; no other column is read or changed, whatever its name.
    """
    names = df.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text_col.lower())
    own = [f"_c{i}" for i in range(len(names))]
    rows = df.toDF(*own)
    text = F.col(own[at])
    base, spans = spans_of(F.coalesce(text.cast("string"), F.lit("")), window)
    rows = rows.withColumn("_base", base).withColumn("_spans", spans(F.col("_base")))

    def piece(at: Column, s: Column) -> tuple[Column, Column]:
        """What to keep in front of a span: nothing (end before start) where it overlaps an earlier one."""
        return F.greatest(at, s["end"]), F.struct(at.alias("start"), s["start"].alias("end"))

    ahead = F.filter(scanned(F.col("_spans"), piece, "array<struct<start:int,end:int>>"), lambda s: s["end"] >= s["start"])
    rest = F.array(F.struct(F.array_max(F.transform("_spans", lambda s: s["end"])).alias("start"), F.length(text).alias("end")))
    clean = bound(F.concat(ahead, rest), lambda kept: joined_pieces(text, kept, mark))
    out = F.when(F.size("_spans") > 0, clean).otherwise(text)
    return rows.select(*[(out if i == at else F.col(c)).alias(names[i]) for i, c in enumerate(own)])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base"), KINDS), 256).alias("base_sha256"), said(F.col("spans"), KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
