"""Span finding with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, wherever and how often it is used (lambdas compute what they name at each step)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(rows: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: str) -> Column:
    """For each row the output of step(at, row) -> (the next at, output), with at (an int) from 0 on; empty: the output array's type.

    By runs of RUN, as appending each output to one array would take time in the square of their number.
    """

    def one(state: Column, row: Column) -> Column:
        at, out = step(state["at"], row)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    def whole(rows: Column) -> Column:
        def run(state: Column, first: Column) -> Column:
            start = F.struct(state["at"].alias("at"), F.array().cast(empty).alias("out"))
            return F.aggregate(F.slice(rows, first, F.lit(RUN)), start, one, lambda s: F.struct(s["at"].alias("at"), F.concat(state["runs"], F.array(s["out"])).alias("runs")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{empty}>").alias("runs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(RUN)), start, run, lambda s: s["runs"]))

    return bound(rows, whole)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,match,value>> of the leftmost non-overlapping matches.

    Positions are code points, end exclusive; value is the group.  The pattern must not
    match the empty string, and must not repeat a group of several characters without a bound unless possessively: the
    engine would recurse once a repetition, and long texts exhaust its stack.  Texts without a match are scanned once.
    """
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
    # what stands before each match; the last piece, after all matches, falls to zip_with's shorter side
    before = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(before, F.lit(1), F.size(matches)).alias("before"), matches.alias("match"), values.alias("value"))
    plain = F.transform(rows, lambda r: F.struct(r["before"].alias("0"), r["match"].alias("1"), r["value"].alias("2")))

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        start = at + F.length(row["0"])
        end = start + F.length(row["1"])
        return end, F.struct(start.alias("start"), end.alias("end"), row["1"].alias("match"), row["2"].alias("value"))

    empty = "array<struct<start:int,end:int,match:string,value:string>>"
    return F.when(text.rlike(pattern), scanned(plain, step, empty)).otherwise(F.array().cast(empty))


def in_runs(rows: Column) -> Column:
    """An array's items in arrays of up to RUN."""
    firsts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda first: F.slice(rows, first, F.lit(RUN)))


def span_runs(spans: Column) -> Column:
    """Spans sorted by start, in runs with the stretch that each covers, for overlaps()."""
    return F.transform(in_runs(spans), lambda own: F.struct(F.array_min(F.transform(own, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(own, lambda s: s["end"])).alias("hi"), own.alias("own")))


def overlaps(runs: Column, s: Column) -> Column:
    """Whether a span overlaps one of those of span_runs()."""
    return F.exists(runs, lambda r: (r["lo"] < s["end"]) & (s["start"] < r["hi"]) & F.exists(r["own"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def joined_pieces(text: Column, pieces: Column, mark: str) -> Column:
    """The pieces (start, end) of a text, in order, joined by the mark.  Runs of pieces are cut out first, as finding a place takes time in proportion to it."""

    def run(own: Column) -> Column:
        lo, hi = F.get(own, F.lit(0))["start"], F.element_at(own, -1)["end"]
        return bound(F.substring(text, lo + 1, hi - lo), lambda part: F.array_join(F.transform(own, lambda s: F.substring(part, s["start"] - lo + 1, s["end"] - s["start"])), mark))

    return F.array_join(F.transform(in_runs(pieces), run), mark)


def said(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted array<struct<kind (its number),start,end>> in any field order, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
