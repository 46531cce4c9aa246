"""Operator 4: language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is counted from
labelled texts: contexts of `order` bytes and all shorter ones.  A symbol is
coded in the longest known context; where it is new there, an escape (method C:
as many escape counts as distinct symbols) leads to the next shorter context,
with the symbols of the longer one excluded, and at last to the uniform code
over the remaining byte values.  So the probabilities of a context sum to
one and the code lengths are exact.  The counts are frozen after training.

A tree is kept as sorted arrays of its contexts and their symbols; a context's symbols are
a subset of those of its suffix, so exclusion needs no sets, but two sums a context.  Trees are whole: no context is
pruned, however rare.  They are cut into pieces by the last byte of the context, as a context's suffixes end with the same byte
(a piece also has its language's counts without context); at the default order such a piece has less than 2**24 entries
whatever the corpus.  Pieces are dealt over blocks of bounded size, and each block is broadcast.  Texts are read in
one pass: a chunk's distinct grams meet the blocks one after the other, and one block at a time is held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandtally.llm._shared import chunks, drop_written, table, written

ORDER = 3
START = 256
BASE = 257
MERGE_ROWS = 2_000_000
BLOCK_ENTRIES = 4_000_000
PIECE_BYTES = 1 << 20
MANY_BYTES = 4 << 20  # a chunk of texts, if blocks are loaded again for each
AT_ONCE = 8  # languages


def ranked(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams (order + 1 symbols, to base BASE, START before each text), and for each byte the number of its gram."""
    used = np.flatnonzero(np.bincount(data, minlength=256))
    k = len(used) + 1
    small = np.zeros(256, dtype=np.int32)
    small[used] = np.arange(len(used))
    symbol = small[data]
    names = np.append(used, START)
    starts = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    code, grams = np.zeros(len(data), np.int32), np.zeros(1, np.int64)
    for back in range(order, -1, -1):
        own = np.full(len(data), k - 1, dtype=np.int32)
        own[back:] = symbol[: len(data) - back]
        for i in range(back):  # places less than `back` from their text's start
            own[(starts + i)[starts + i < ends]] = k - 1
        # (the grams of a piece are fewer than its bytes, so this fits)
        code = code.astype(np.int64 if len(grams) * k >= 1 << 31 else np.int32) * k + own
        seen = np.zeros(len(grams) * k, dtype=bool)
        seen[code] = True
        found = np.flatnonzero(seen)
        rank = np.zeros(len(seen), dtype=np.int32)
        rank[found] = np.arange(len(found))
        code, grams = rank[code], grams[found // k] * BASE + names[found % k]
    return grams, code


def context_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each byte occurs after its `order` predecessors, over all rows with a language and a text.

    gram has the symbols as digits to base 257; 256 stands for a place before a text.  Repeated rows count each.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be from 0 to 6")
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows_held = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi, data, offsets in chunks(batch.column(1), PIECE_BYTES):
                if not len(data):
                    continue
                grams, code = ranked(data, offsets, order)
                which, own = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                seen, n = np.unique(np.repeat(own * len(grams), np.diff(offsets)) + code, return_counts=True)
                for i, lang in enumerate(which):
                    a, b = np.searchsorted(seen, [i * len(grams), (i + 1) * len(grams)])
                    if a < b:
                        held.setdefault(str(lang), []).append((grams[seen[a:b] - i * len(grams)], n[a:b]))
                        rows_held += b - a
                if rows_held > MERGE_ROWS:
                    for lang in held:
                        held[lang] = [merged(held[lang])]
                    rows_held = sum(len(p[0][0]) for p in held.values())
                    if rows_held > MERGE_ROWS // 2:
                        yield from flushed()
                        rows_held = 0
        yield from flushed()

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """One language: by length of context the sorted contexts and grams, and what code lengths need of them.

    total and kinds are a context's counts and distinct symbols; left and others are those of its suffix, once the symbols
    seen after the context itself are excluded.  span: the first and the last byte that may end the contexts known here.
    """

    span: tuple[int, int] = (0, BASE - 1)
    contexts: list[np.ndarray] = field(default_factory=list)
    total: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    others: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray]], span: tuple[int, int] = (0, BASE - 1)) -> Tree:
        """From (grams, counts) by length of context; grams are distinct."""
        out = cls(span)
        for j, (grams, counts) in enumerate(levels):
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order]
            contexts, first = np.unique(grams // BASE, return_index=True)
            kinds = np.diff(np.append(first, len(grams)))
            out.contexts.append(contexts)
            out.total.append(np.add.reduceat(counts, first) if len(first) else counts)
            out.kinds.append(kinds)
            out.grams.append(grams)
            out.counts.append(counts)
            if j and len(first):
                # every gram's suffix is a gram too, and every context's suffix a context
                shorter = np.searchsorted(out.grams[j - 1], grams % BASE**j)
                parent = np.searchsorted(out.contexts[j - 1], contexts % BASE ** (j - 1))
                out.left.append(out.total[j - 1][parent] - np.add.reduceat(out.counts[j - 1][shorter], first))
                out.others.append(out.kinds[j - 1][parent] - kinds)
            else:
                out.left.append(np.zeros(len(first), np.int64))
                out.others.append(np.zeros(len(first), np.int64))
        return out

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last symbol of each gram after the others."""
        order = len(self.grams) - 1
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), dtype=bool)
        left, others = np.full(len(grams), -1), np.zeros(len(grams), np.int64)  # of this level, if a longer context was known
        for j in range(order, -1, -1):
            own = grams % BASE ** (j + 1)
            at, known = found(self.contexts[j], own // BASE)
            gram, seen = found(self.grams[j], own)
            total = np.where(left >= 0, left, self.total[j][at] if len(self.total[j]) else 0)
            kinds = np.where(left >= 0, others, self.kinds[j][at] if len(self.kinds[j]) else 0)
            now = open_ & known & (kinds > 0)
            hit = now & seen
            n = np.where(hit, self.counts[j][gram] if len(self.counts[j]) else 1, kinds)
            out[now] += np.log2((total + kinds)[now]) - np.log2(n[now])
            open_ &= ~hit
            if j:
                left = np.where(known, self.left[j][at] if len(self.left[j]) else -1, -1)
                others = np.where(known, self.others[j][at] if len(self.others[j]) else 0, 0)
        out[open_] += np.log2(max(1, 256 - len(self.grams[0])))
        return out


def found(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array (0 if it is empty), and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_, values), max(0, len(sorted_) - 1))
    return at, (sorted_[at] == values) if len(sorted_) else np.zeros(len(values), bool)


@dataclass
class Trees:
    """The frozen model: its entries (lang, last, level, gram, n) in a table, and by block the span of last bytes of each language in it."""

    entries: DataFrame
    blocks: list[dict[str, tuple[int, int]]]
    order: int

    @property
    def langs(self) -> list[str]:
        return sorted({x for b in self.blocks for x in b})

    def block(self, i: int) -> dict[str, Tree]:
        """One block's trees, or their parts; their size is bounded by BLOCK_ENTRIES, or a single piece."""
        spans = self.blocks[i]
        wanted = F.col("lang").isin([x for x, span in spans.items() if span == (0, BASE - 1)])
        for lang, (lo, hi) in spans.items():
            if (lo, hi) != (0, BASE - 1):
                wanted |= (F.col("lang") == lang) & (F.col("last").between(lo, hi) | (F.col("level") == 0))
        rows = self.entries.where(wanted).select("lang", "level", "gram", "n").toArrow()
        names = np.array(sorted(spans), dtype=object)
        at = pc.index_in(rows["lang"], pa.array(names, pa.string())).to_numpy()
        level, gram, n = (rows[c].to_numpy() for c in ("level", "gram", "n"))
        key = at * (self.order + 1) + level
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(len(names) * (self.order + 1) + 1))
        parts = [(gram[order[a:b]], n[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {x: Tree.of(parts[k * (self.order + 1) : (k + 1) * (self.order + 1)], spans[x]) for k, x in enumerate(names)}


def dealt(sizes: Iterable[tuple[str, int, int]], block_entries: int) -> list[dict[str, tuple[int, int]]]:
    """Blocks of about `block_entries` from sorted (lang, last byte or -1 for no context, entries); languages that fit a block stay whole."""
    blocks: list[dict[str, tuple[int, int]]] = []
    room = 0
    for lang, cells in groupby(sizes, key=lambda r: r[0]):
        own = [(last, n) for _, last, n in cells]
        whole, lo = sum(n for _, n in own), 0
        free = sum(n for last, n in own if last < 0)
        if not blocks or whole > room:
            blocks.append({})
            room = block_entries
        if whole > block_entries:
            room -= free
            for last, n in own:
                if last > lo and n > room:
                    blocks[-1][lang] = (lo, last - 1)
                    blocks.append({})
                    lo, room = last, block_entries - free
                room -= n if last >= 0 else 0
        else:
            room -= whole
        blocks[-1][lang] = (lo, BASE - 1)
    return blocks


def freeze(counts: DataFrame, order: int = ORDER, block_entries: int = BLOCK_ENTRIES) -> Trees:
    """The frozen trees from context_counts(); at most 258 numbers a language reach the driver here."""
    counts = written(counts, "grams")
    levels = None
    for j in range(order, -1, -1):
        own = counts if j == order else counts.groupBy("lang", (F.col("gram") % BASE ** (j + 1)).alias("gram")).agg(F.sum("n").alias("n"))
        last = F.floor(F.col("gram") / F.lit(BASE)).cast("long") % BASE if j else F.lit(-1)
        own = own.select("lang", last.cast("int").alias("last"), F.lit(j).alias("level"), "gram", "n")
        levels = own if levels is None else levels.unionByName(own)
    # sorted, so that a block's scan skips the others' row groups
    entries = written(levels.repartitionByRange("lang", "last", "gram").sortWithinPartitions("lang", "last"), "trees")
    drop_written(counts)
    sizes = entries.groupBy("lang", "last").agg(F.count("*").alias("n")).orderBy("lang", "last").collect()
    return Trees(entries, dealt(((r["lang"], r["last"], r["n"]) for r in sizes), block_entries), order)


def code_lengths(data: np.ndarray, offsets: np.ndarray, blocks: Iterable[dict[str, Tree]], langs: list[str], order: int) -> np.ndarray:
    """(texts, languages): each text's bits in the code of each language."""
    totals = np.zeros((len(offsets) - 1, len(langs)))
    if not len(data):
        return totals
    grams, code = ranked(data, offsets, order)
    last = grams // BASE % BASE
    full = np.flatnonzero(np.diff(offsets) > 0)
    place = {x: i for i, x in enumerate(langs)}
    ready: list[tuple[int, np.ndarray]] = []
    open_: dict[str, np.ndarray] = {}  # of the language that goes on in the next block

    def added() -> None:
        bits = np.stack([b for _, b in ready], axis=1)
        totals[np.ix_(full, [i for i, _ in ready])] = np.add.reduceat(bits[code], offsets[:-1][full], axis=0)
        ready.clear()

    for block in blocks:
        for lang in sorted(block):
            tree = block[lang]
            lo, hi = tree.span
            if (lo, hi) == (0, BASE - 1):
                bits = tree.bits(grams)
            else:
                bits = open_.pop(lang) if lo else np.zeros(len(grams))
                mine = np.flatnonzero((last >= lo) & (last <= hi))
                bits[mine] = tree.bits(grams[mine])
            if hi < BASE - 1:
                open_[lang] = bits
                continue
            ready.append((place[lang], bits))
            if len(ready) == AT_ONCE:
                added()
    if ready:
        added()
    return totals


def scored(df: DataFrame, trees: Trees, text_col: str = "text", carry: bool = True) -> DataFrame:
    """df with its columns renamed to _c0, _c1, ..., and _lang, _score, _bits (a byte); names of its own never clash.

    Texts move to Python once, and don't come back without carry.
    """
    names = df.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text_col.lower())
    rows = df.toDF(*[f"_c{i}" for i in range(len(names))])
    own = [c for i, c in enumerate(rows.columns) if carry or i != at]
    if not trees.blocks:
        return rows.select(*own, F.lit("und").alias("_lang"), F.lit(0.0).alias("_score"), F.lit(0.0).alias("_bits"))
    letter = F.coalesce(F.col(f"_c{at}").cast("string").rlike(r"\p{L}"), F.lit(False))
    others = [c for i, c in enumerate(rows.columns) if i != at]
    kept = isinstance(rows.schema[f"_c{at}"].dataType, T.StringType)  # else the text is sent beside its column
    rows = rows.select(*others, *([] if kept or not carry else [f"_c{at}"]), F.col(f"_c{at}").cast("string").alias(f"_c{at}" if kept else "_text"), letter.alias("_letter"))
    schema = T.StructType([rows.schema[c] for c in own] + [T.StructField("_letter", T.BooleanType()), T.StructField("_best", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("_least", "_mass")] + [T.StructField("_size", T.LongType())])
    order, langs = trees.order, trees.langs
    model = [df.sparkSession.sparkContext.broadcast(trees.block(i)) for i in range(len(trees.blocks))]
    places = [rows.columns.index(c) for c in own]
    width = len(rows.columns)

    def loaded() -> Iterator[dict[str, Tree]]:
        for block in model:
            # several blocks aren't kept: each is read again from the executor's own copy
            yield block.value if len(model) == 1 or block._path is None else block.load_from_path(block._path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, has_letter = batch.column(width - 2), batch.column(width - 1)
            for lo, hi, data, offsets in chunks(text.fill_null(""), PIECE_BYTES if len(model) == 1 else MANY_BYTES):
                n = hi - lo
                totals = code_lengths(data, offsets, loaded(), langs, order)
                best = totals.argmin(axis=1)  # ties go to the first name
                least = totals[np.arange(n), best]
                mass = np.exp2(-np.minimum(totals - least[:, None], 1000)).sum(axis=1)
                out = [batch.column(i).slice(lo, n) for i in places]
                name = pa.array(langs, pa.string()).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([*out, has_letter.slice(lo, n), name, pa.array(least), pa.array(mass), pa.array(np.diff(offsets))], names=schema.names)

    rows = rows.mapInArrow(score, schema)
    good = F.col("_letter")
    return rows.select(*own, F.when(good, F.col("_best")).otherwise("und").alias("_lang"), F.when(good, 1 / F.col("_mass")).otherwise(0.0).alias("_score"), (F.col("_least") / F.greatest(F.col("_size"), F.lit(1))).alias("_bits"))


def identify(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) for each row.

    score is the posterior of the chosen language under equal priors.  A text
    that is null or has no letter is `und` with score 0, as is every text if
    no language has been learned.  Ties go to the first language by name.  Repeated rows, and rows with a null id, are rows like
    any other.  Other columns are ignored.
    """
    rows = scored(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), trees, "_text", carry=False)
    return rows.select(F.col("_c0").alias(id_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_bits").alias("bits_per_byte"))


def recognised(df: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5, most_bits: float = 8.0) -> DataFrame:
    """The rows of df, all columns as they are, whose language is told.

    Rows go if their text is null or has no letter, if the posterior is below `least`, or if the best language's code takes
    `most_bits` a byte or more: no learned language tells more of such a text than its plain bytes.
    """
    rows = scored(df, trees, text_col)
    kept = rows.where((F.col("_lang") != "und") & (F.col("_score") >= least) & (F.col("_bits") < most_bits))
    return kept.drop("_lang", "_score", "_bits").toDF(*df.columns)


def held_out(id_col: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = freeze(context_counts(docs.where(~held_out("doc_id", 4, 2))))
    found_ = identify(docs, trees)
    return found_.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
