"""Operator 1: language-model scores by Katz backoff.

N-grams of `order` words back off, one word at a time, down to words, and those to one class of unknown words:

    P(w | h) = d(c(h w)) c(h w) / c(h)   if h w was seen
             = a(h) P(w | h')            otherwise (h' is h without its oldest word; a(h) = 1 if h is new)
    P(w)     = d(c(w)) c(w) / N          if w was seen, else P(unknown)

d are Good-Turing discounts for counts up to K, one set for each order (absolute discounting where the
counts of counts don't allow them), P(unknown) is the mass that the discounts free, and
a(h) makes the probabilities after h sum to one over the vocabulary and the unknown class:
a(h) = (1 - sum of the seen) / (1 - sum of P(w | h') over the seen).  Where nothing is
discounted, one is added to the denominator, so that some mass is free.

Words are known by 64-bit hashes and get numbers, frequent ones small ones.  Documents stay on shelves (packs of texts
as numbers); for each order, a shelf sends its distinct n-grams with their training counts to the buckets that own their
contexts, and gets the corpus counts back, so a frequent n-gram costs a shelf one entry.  If the model's tables are to be kept,
a bucket writes what it counted as a part of them (see Model).  Contexts are whole in one bucket, but for frequent ones (over an N / FREQUENT of
all tokens, so at most FREQUENT of an order), which are dealt by n-gram and whose sums are aggregated and broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import (
    chunks,
    drop_path,
    drop_stored,
    drop_written,
    mix64,
    release,
    shared_dir,
    split_buckets,
    squeeze,
    stored,
    table,
    unsqueeze,
    word_hashes,
    words,
    written,
)
from strandtally.llm.langid import held_out

K = 5
ORDER = 3
SHELF_BYTES = 6 << 20
BUCKET_WORDS, LEAST_BUCKETS = 1_000_000, 64
FREQUENT = 20_000
ROUNDS = 2
END = mix64(np.array([1], dtype=np.uint64))[0]
UNKNOWN, START, FIRST_WORD = 0, 1, 2


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..K+1) from the counts of counts n[1..K+1]; d(r) = 1 above K."""
    out = np.ones(K + 2)
    out[0] = 0
    n = np.asarray(n, dtype=float)
    with np.errstate(all="ignore"):
        r = np.arange(1, K + 1)
        tail = (K + 1) * n[K + 1] / n[1]
        found = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - tail) / (1 - tail)
    if np.isfinite(found).all() and (found > 0).all() and (found < 1).all():
        out[1 : K + 1] = found
    elif n[1] > 0:
        b = n[1] / (n[1] + 2 * n[2])
        out[1 : K + 1] = (r - min(b, 0.9)) / r
    return out


@dataclass
class Words:
    """What is known of single words: the totals and the discounted probability by count."""

    total: int
    kinds: int
    of_counts: np.ndarray  # counts of counts, 1..K+1
    sums: float  # sum of d(c) c

    @classmethod
    def of(cls, total: int, kinds: int, n: np.ndarray) -> Words:
        d = discounts(n)
        lost = sum((1 - d[r]) * r * n[r] for r in range(1, K + 1))
        return cls(total, kinds, np.asarray(n), total - lost)

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words of these counts; 0 is the unknown class."""
        d = discounts(self.of_counts)
        whole = self.total if self.sums < self.total - 1e-9 * self.total else self.total + 1
        return np.where(c > 0, d[np.minimum(c, K + 1)] * c / whole, 1 - self.sums / whole)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.kinds + 1)))


def wholes(d: np.ndarray, total: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Denominators of contexts; small: whether any n-gram was seen 1..K times."""
    return total + ~(small & (d[1] < 1))


def weights(d: np.ndarray, total: np.ndarray, of_counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """a(h) of contexts.  of_counts: (K, contexts), the numbers of n-grams seen 1..K times; lower: sum of P(w | h') over the seen."""
    lost = sum((1 - d[r]) * r * of_counts[r - 1] for r in range(1, K + 1))
    whole = wholes(d, total, of_counts.sum(axis=0) > 0)
    return (lost + (whole - total)) / whole / (1 - lower)


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of nonnegative columns, in their order."""
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (int(code.max(initial=0)) + 1) * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * width + c
    return code


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending; a place of each; and for each place the number of its value."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)) >> (63 - bits):
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    else:
        # values with their places in the low bits: sorting numbers is quicker than sorting places
        codes = np.sort(codes.astype(np.int64, copy=False) << bits | np.arange(len(codes)))
        order = codes & ((1 << bits) - 1)
        codes = codes >> bits
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    back = np.empty(len(codes), dtype=np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], order[new], back


def packed_places(places: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers that are mostly small: two bytes each, and what these leave of the few that don't fit."""
    large = np.flatnonzero(places >= 0xFFFF)
    return zstandard.compress(np.minimum(places, 0xFFFF).astype("<u2").tobytes(), 3), squeeze(large, places[large])


def unpacked_places(low: bytes, rest: bytes) -> np.ndarray:
    out = np.frombuffer(zstandard.decompress(low), "<u2").astype(np.int32)
    at, values = unsqueeze(rest)
    out[at] = values
    return out


def heads(codes: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


@dataclass
class Level:
    """A shelf's distinct n-grams of one order: the context (an n-gram of the order below), the last word's slot, and the n-gram without its oldest word."""

    at: np.ndarray  # of each padded place, -1 where none ends
    context: np.ndarray
    last: np.ndarray
    suffix: np.ndarray
    pairs: np.ndarray  # in training, on this shelf
    asked: np.ndarray
    known: np.ndarray  # in training, in all
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # those asked for
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by context
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))


def split(owner: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    return split_buckets(owner.astype(np.uint16) if buckets <= 1 << 16 else owner, buckets)


def packed_shelf(number: int, ids: np.ndarray, none: np.ndarray, train: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> dict:
    """A shelf of texts: the distinct words' hashes and counts in training, and each token's word.  Frequent words come first, then early ones, so that places pack well."""
    starts, ends, first = words(data, offsets)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    size = np.diff(first) + 1
    tokens = np.empty(len(starts) + n, dtype=np.uint64)
    tokens[np.arange(len(starts)) + owner] = word_hashes(data, starts, ends, lower=True)
    tokens[np.cumsum(size) - 1] = END
    # a dictionary has its values as they first come
    held = pa.array(tokens).dictionary_encode()
    kinds, at = held.dictionary.to_numpy(), held.indices.to_numpy()
    order = np.argsort(-np.bincount(at, minlength=len(kinds)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    at = rank[at]
    seen = np.bincount(at, weights=np.repeat(train, size), minlength=len(kinds)).astype(np.int64)
    low, rest = packed_places(at)
    return {"shelf": number, "ids": squeeze(ids, none, train), "sizes": squeeze(size, plain=True), "kinds": kinds[order].tobytes(), "counts": squeeze(seen, plain=True), "low": low, "rest": rest, "n_tokens": len(tokens)}


def known_shelf(row: dict, buckets: int) -> dict:
    """The shelf with its words' numbers and corpus counts in place of hashes; words unknown to training become one."""
    kinds = np.frombuffer(row["kinds"], np.uint64)
    names, known = np.zeros(len(kinds) + 1, np.int64), np.zeros(len(kinds) + 1, np.int64)
    got = {r["bucket"]: r["a"] for r in row["r1"] or []}
    for b, at in split_buckets((kinds % np.uint64(buckets)).astype(np.int64), buckets):
        names[at], known[at] = unsqueeze(got[b])
    some = np.append(known[:-1] > 0, True)
    place = np.where(some, np.cumsum(some) - 1, some.sum() - 1)
    low, rest = packed_places(place[unpacked_places(row["low"], row["rest"])])
    ends = int(known[:-1][kinds == END].sum())
    return {"shelf": row["shelf"], "ids": row["ids"], "sizes": row["sizes"], "words": squeeze(names[some], known[some], plain=True), "low": low, "rest": rest, "ends": ends}


class Shelf:
    """A shelf's tokens: words and an end for each document, as slots: the shelf's words, then one for unknown words and one for starts."""

    def __init__(self, row: dict, order: int):
        self.ids, none, train = unsqueeze(row["ids"])
        self.none, self.train = none.astype(bool), train.astype(bool)
        self.size = unsqueeze(row["sizes"])[0]
        names, known = unsqueeze(row["words"])
        self.names, self.known = np.append(names, START), np.append(known, row["ends"])
        n = len(names)
        # slots in order of their words' numbers, so that n-grams come in the order in which they are sent
        by_number = np.argsort(names)
        rank = np.empty(n, np.int32)
        rank[by_number] = np.arange(n)
        self.names[:n], self.known[:n] = names[by_number], known[by_number]
        # each document behind order - 1 starts
        pad = order - 1
        length = self.size + pad
        first = np.cumsum(length) - length
        self.place = (np.arange(length.sum()) - np.repeat(first, length)).astype(np.int32)
        self.real = self.place >= pad
        self.slots = np.full(len(self.place), n, dtype=np.int32)
        self.slots[self.real] = rank[unpacked_places(row["low"], row["rest"])]
        self.counted = self.real & np.repeat(self.train, length)
        none = np.zeros(0, np.int32)
        self.levels = [Level(self.slots, none, np.arange(n + 1, dtype=np.int32), none, none, none > 0, self.known)]

    def deepen(self, counted: bool = True) -> Level:
        """The n-grams of the next order; counted: with their training counts on this shelf."""
        below, n = self.levels[-1], len(self.levels)
        places = np.flatnonzero(self.place >= n)
        start = len(self.names) - 1
        bits = start.bit_length()
        codes, lead, back = distinct(below.at[places - 1].astype(np.int64) << bits | self.slots[places])
        at = np.full(len(self.place), -1, dtype=np.int32)
        at[places] = back
        context, last = (codes >> bits).astype(np.int32), (codes & ((1 << bits) - 1)).astype(np.int32)
        real = last != start
        pairs = np.bincount(back[self.counted[places]], minlength=len(codes)) if counted else np.zeros(0, np.int64)
        # what ends before a text is starts alone, which stand before every document
        known = np.where(real, 0, self.known[-1])
        suffix = below.at[places[lead]] if n > 1 else last
        level = Level(at, context, last, suffix, pairs, real & (below.known[context] > 0), known)
        level.whole, level.weight = np.zeros(len(below.known), np.int64), np.ones(len(below.known))
        self.levels.append(level)
        return level

    def columns(self, n: int, context: np.ndarray) -> list[np.ndarray]:
        """The numbers of the words of contexts (n-grams of order n), the latest first."""
        out = []
        for level in self.levels[n - 1 :: -1]:
            out.append(self.names[level.last[context]])
            context = level.context[context] if len(level.context) else context
        return out

    def deal(self, level: Level, buckets: int, frequent: int) -> None:
        """The order in which asked n-grams are sent, their buckets, and whether their contexts are frequent."""
        n = len(self.levels) - 1
        asked = np.flatnonzero(level.asked)
        # n-grams are in order of their contexts, so these are runs
        context = level.context[asked]
        run = heads(context)
        length = np.diff(np.append(run, len(asked)))
        context = context[run]
        by_context = np.zeros(len(run), np.uint64)
        for c in self.columns(n, context):
            by_context = mix64(by_context * np.uint64(3) + c.astype(np.uint64) + np.uint64(1))
        often = self.levels[n - 1].known[context] > frequent
        hot = np.repeat(often, length)
        owner = np.repeat((by_context % np.uint64(buckets)).astype(np.int64), length)
        if often.any():
            word = self.names[level.last[asked[hot]]].astype(np.uint64)
            owner[hot] = (mix64(np.repeat(by_context[often], length[often]) + word) % np.uint64(buckets)).astype(np.int64)
        level.order, level.owner, level.hot = asked, owner, hot

    def probabilities(self, d: list[np.ndarray], one: Words) -> np.ndarray:
        """P of the token at each real place, by recursion over the orders."""
        p = one.probability(self.levels[0].known)
        for level, own in zip(self.levels[1:], d, strict=True):
            with np.errstate(all="ignore"):
                seen = own[np.minimum(level.known, K + 1)] * level.known / level.whole[level.context]
            p = np.where(level.asked & (level.known > 0), seen, level.weight[level.context] * p[level.suffix])
        return p[self.levels[-1].at[self.real]]


@dataclass
class Model:
    """A model's tables under `path`, each in parts by bucket.

    words (bucket, a: hashes, numbers and counts); for each order n: grams (bucket, a: the contexts' columns and where their
    n-grams begin, b: words and counts, contexts in order) and weights (bucket, a: totals, b: a(h), in the order of grams' contexts);
    hot (key, total, weight): the frequent contexts.  grams() and contexts() spell them out as rows.
    """

    path: str
    order: int
    one: Words
    d: list[np.ndarray] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)

    def grams(self, spark: SparkSession, n: int) -> DataFrame:
        """(w1..wn, count): the n-grams of order n seen in training, as numbers of words, the latest word of the context first and the word itself last."""

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    new, *columns = unsqueeze(row["a"])
                    word, count = unsqueeze(row["b"])
                    runs = np.diff(np.append(new, len(word)))
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(c, runs)) for c in columns], pa.array(word), pa.array(count)], names=[*[f"w{i + 1}" for i in range(n)], "count"])

        rows = spark.read.schema("a binary, b binary").parquet(*[f"{self.path}/{n}-{r}/part=grams" for r in range(self.rounds[n - 2])])
        return rows.select("a", "b").mapInArrow(spell, ", ".join(f"w{i + 1} long" for i in range(n)) + ", count long")

    def contexts(self, spark: SparkSession, n: int) -> DataFrame:
        """(w1.., total, weight): the contexts of n-grams of order n, frequent ones too, with c(h) and a(h)."""
        names = [f"w{i + 1}" for i in range(n - 1)]

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    (total,) = unsqueeze(row["totals"])
                    columns = unsqueeze(row["a"])[1:]
                    whole = total > 0
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[whole]) for c in columns], pa.array(total[whole]), pa.array(np.frombuffer(row["weights"], np.float64)[whole])], names=[*names, "total", "weight"])

        paths = [f"{self.path}/{n}-{r}" for r in range(self.rounds[n - 2])]
        grams = spark.read.schema("bucket long, a binary").parquet(*[f"{p}/part=grams" for p in paths])
        rows = grams.join(spark.read.schema("bucket long, totals binary, weights binary").parquet(*[f"{p}/weights" for p in paths]), "bucket")
        schema = ", ".join(f"{c} long" for c in names) + ", total long, weight double"
        hot = spark.read.parquet(f"{self.path}/{n}-hot").select(*[F.get("key", F.lit(i)).alias(c) for i, c in enumerate(names)], "total", "weight")
        return rows.select("a", "totals", "weights").mapInArrow(spell, schema).unionByName(hot)


PARTS = "part string, bucket long, shelf long, a binary, b binary, c binary, stats array<long>, lower double"
PART_TYPES = pa.schema([("part", pa.string()), ("bucket", pa.int64()), ("shelf", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stats", pa.list_(pa.int64())), ("lower", pa.float64())])


def parts_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, PART_TYPES)


def batch_of(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "shelf": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.binary())) for n, x in zip(names.split(), zip(*rows, strict=True), strict=True)], names=names.split())


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for own in parts[1:]:
        out = out.unionByName(own)
    return out


def summed(parts: DataFrame, n: int) -> list[int]:
    sums = parts.where("part = 'stats'").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in sums]


def shelved(df: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        task, number = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            ids, none, train, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            row = packed_shelf(task << 33 | number, ids, none, train, data, np.concatenate([[0], np.cumsum(sizes)]))
            held, number = [], number + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            none = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(1), SHELF_BYTES):
                if held and sum(len(h[4]) for h in held) + len(data) > SHELF_BYTES:
                    yield flush()
                held.append((ids[lo:hi], none[lo:hi], flags[lo:hi], np.diff(offsets), data.copy()))
        if held:
            yield flush()

    return stored(rows.mapInArrow(pack, "shelf long, ids binary, sizes binary, kinds binary, counts binary, low binary, rest binary, n_tokens long"), "shelf", "shelves")


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, model_path: str | None = None) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each row, learning from the rows where train is true.

    Tokens are the words, with A-Z lower-cased, and one end; a null text is empty.  score is
    log10 of the model's probability of the text, with words unknown to training as one class;
    base_score the additively smoothed one of single words.  Without training rows train_tokens is 0, base_score counts all
    words as unseen, and so does score.  Repeated rows are scored, and learned from, each; a null id is a row like any other.
    Other columns are ignored.  The model's tables (see Model) are written under model_path if one is named.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = df.sparkSession
    path = model_path or f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    texts = shelved(df, train, id_col, text_col)
    size = texts.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_WORDS))
    known = counted_words(texts, buckets, f"{path}/1", bool(model_path))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([known_shelf(row, buckets)])

    told = joined(texts, {1: known})
    shelves = stored(told.mapInArrow(settle, "shelf long, ids binary, sizes binary, words binary, low binary, rest binary, ends long"), "shelf", "shelves")
    drop_stored(texts)
    drop_path(spark, f"{path}/1/part=reply")
    del texts, told
    release(spark)
    stats = summed(known, K + 3)
    one = Words.of(stats[0], stats[1], np.array([0, *stats[2:]]))
    frequent = max(one.total // FREQUENT, BUCKET_WORDS // 8)
    model = Model(path, order, one)
    hot: list[Broadcast] = []
    replies: dict[int, DataFrame] = {}
    for n in range(2, order + 1):
        # tables that stay take room, so the n-grams then move in rounds, for which shelves are opened again each time
        rounds = ROUNDS if n > 2 and model_path else 1
        model.rounds.append(rounds)
        found = [counted_grams(shelves, replies, model, n, buckets, frequent, hot, r, rounds, bool(model_path)) for r in range(rounds)]
        seen = union(found)
        model.d.append(discounts(np.array([0, *summed(seen, K + 1)])))
        hot.append(weighed(spark, found, model, n, bool(model_path)))
        replies[n] = seen
        release(spark)
    asked = joined(shelves, replies)

    def scored(row: dict) -> pa.RecordBatch:
        s = opened(row, order, buckets, frequent, model, hot)
        c = s.known[s.slots[s.real]]
        at = np.cumsum(s.size) - s.size
        return pa.RecordBatch.from_arrays(
            [
                pa.array(s.ids, pa.int64(), mask=s.none),
                pa.array(s.train),
                pa.array(s.size),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                pa.array(np.full(len(at), one.total, dtype=np.int64)),
                pa.array(np.add.reduceat(one.base(c), at)),
                pa.array(np.add.reduceat(np.log10(s.probabilities(model.d, one)), at)),
            ],
            names=[id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # (a shelf goes before the next is opened)
            yield from map(scored, batch.to_pylist())

    out = written(asked.mapInArrow(score, f"`{id_col}` long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    drop_stored(shelves)
    if not model_path:
        drop_path(spark, path)
    return out


def joined(shelves: DataFrame, parts: dict[int, DataFrame]) -> DataFrame:
    """The shelves with the replies of each order; the shelves themselves stay where they are."""
    for n, own in parts.items():
        replies = own.where("part = 'reply'").groupBy("shelf").agg(F.collect_list(F.struct("bucket", "a", "b", "c")).alias(f"r{n}"))
        shelves = shelves.join(replies, "shelf", "left")
    return shelves


def opened(row: dict, order: int, buckets: int, frequent: int, model: Model, hot: list[Broadcast]) -> Shelf:
    """A shelf with what it has been told of its n-grams so far."""
    s = Shelf(row, order)
    for n in range(2, 2 + len(hot)):
        level, d = s.deepen(counted=False), model.d[n - 2]
        s.deal(level, buckets, frequent)
        got = {r["bucket"]: r for r in row[f"r{n}"] or []}
        # the buckets' replies one after the other, as one
        dealt = list(split(level.owner, buckets))
        if not dealt:
            continue
        at = np.concatenate([x for _, x in dealt])
        replies = [got[b] for b, _ in dealt]
        counts = np.concatenate([unsqueeze(r["a"])[0] for r in replies])
        grams = level.order[at]
        level.known[grams] = counts
        codes = level.context[grams]
        new = np.append(True, codes[1:] != codes[:-1])
        new[np.cumsum([0, *[len(x) for _, x in dealt[:-1]]])] = True
        run = np.flatnonzero(new)
        context = codes[run]
        marks = np.concatenate([unsqueeze(r["b"])[0] for r in replies])
        total, small = marks >> 1, marks & 1 > 0
        own = ~level.hot[at[run]]
        level.whole[context[own]] = wholes(d, total, small)[own]
        need = own & (np.minimum.reduceat(counts, run) == 0)
        if need.any():
            sums = [unsqueeze(r["c"]) for r in replies if r["c"] is not None]
            of_counts = np.concatenate([x.reshape(K, -1) for x, _ in sums], axis=1)
            level.weight[context[need]] = weights(d, total[need], of_counts, np.concatenate([x for _, x in sums]).view(np.float64))
        often = np.unique(codes[level.hot[at]])
        if len(often):
            keys = np.stack(s.columns(n - 1, often), axis=1)
            sums = np.array([hot[n - 2].value[tuple(k)] for k in keys.tolist()])
            level.whole[often], level.weight[often] = sums[:, 0].astype(np.int64), sums[:, 1]
    return s


def counted_words(shelves: DataFrame, buckets: int, path: str, keep: bool) -> DataFrame:
    """Parts: the words table if it is to be kept, the replies (numbers and counts) and the sums of single words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds, (counts,) = np.frombuffer(row["kinds"], np.uint64), unsqueeze(row["counts"])
                owner = (kinds % np.uint64(buckets)).astype(np.int64)
                out = [(b, row["shelf"], kinds[at].tobytes(), squeeze(counts[at], plain=True)) for b, at in split(owner, buckets)]
                if out:
                    yield batch_of(out, "bucket shelf grams counts")

    def count(asks: pa.Table) -> pa.Table:
        rows = asks.to_pylist()
        grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        kinds, _, back = distinct(np.concatenate(grams))
        total = np.bincount(back, weights=np.concatenate([unsqueeze(r["counts"])[0] for r in rows])).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        bucket = rows[0]["bucket"]
        number = np.empty(len(kinds), np.int64)
        number[order] = FIRST_WORD + np.arange(len(kinds)) * buckets + bucket
        number[total == 0] = UNKNOWN
        cut = np.cumsum([len(g) for g in grams])[:-1]
        out = [{"part": "reply", "bucket": bucket, "shelf": r["shelf"], "a": squeeze(number[at], total[at], plain=True)} for r, at in zip(rows, np.split(back, cut), strict=True)]
        seen = total > 0
        if keep:
            out.append({"part": "grams", "bucket": bucket, "a": kinds[seen].tobytes(), "b": squeeze(number[seen], total[seen], plain=True)})
        out.append({"part": "stats", "bucket": bucket, "stats": [int(total.sum()), int(seen.sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]})
        return parts_of(out)

    asked = shelves.mapInArrow(ask, "bucket long, shelf long, grams binary, counts binary")
    return parted(asked.groupBy("bucket").applyInArrow(count, PARTS), path)


def parted(df: DataFrame, path: str) -> DataFrame:
    """Writes parts to folders of their own."""
    df.write.partitionBy("part").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    # (an empty input leaves no folder to take columns from)
    return spark.read.schema(PARTS).option("basePath", path).parquet(path)


def counted_grams(shelves: DataFrame, replies: dict[int, DataFrame], model: Model, n: int, buckets: int, frequent: int, hot: list[Broadcast], round_: int, rounds: int, keep: bool) -> DataFrame:
    """Parts for the n-grams of order n in every rounds-th bucket: replies, counts of counts, the partial sums of frequent contexts, and, if tables are to be kept, grams and their contexts' sums."""
    order, one, d = model.order, model.one, model.d[n - 3] if n > 2 else None
    slim = Model(model.path, order, one, model.d)

    def grams_of(row: dict) -> Iterator[pa.RecordBatch]:
        s = opened(row, order, buckets, frequent, slim, hot)
        below = s.levels[-1]
        level = s.deepen()
        s.deal(level, buckets, frequent)
        out = []
        columns = s.columns(n - 1, np.arange(len(below.known)))
        for b, at in split(level.owner, buckets):
            if b % rounds != round_:
                continue
            grams = level.order[at]
            context, suffix = level.context[grams], level.suffix[grams]
            run = heads(context)
            context = context[run]
            *newer, oldest = (c[context] for c in columns)
            # of the shorter n-gram: its count, and what the counts after its context are divided by
            whole = below.whole[below.context[suffix[run]]] if n > 2 else np.zeros(len(run), np.int64)
            lower = below.known[suffix]
            out.append((b, row["shelf"], squeeze(run, level.hot[at[run]], oldest, whole), squeeze(*newer, plain=True), squeeze(s.names[level.last[grams]], level.pairs[grams], lower, plain=True)))
            if len(out) == 16:
                yield batch_of(out, "bucket shelf contexts newer grams")
                out = []
        if out:
            yield batch_of(out, "bucket shelf contexts newer grams")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from grams_of(row)

    def count(asks: pa.Table) -> pa.Table:
        rows = asks.to_pylist()
        bucket = rows[0]["bucket"]
        contexts = [unsqueeze(r["contexts"]) for r in rows]
        grams = [unsqueeze(r["grams"]) for r in rows]
        newer = [unsqueeze(r["newer"]) for r in rows]
        columns = [*[np.concatenate(x) for x in zip(*newer, strict=True)], np.concatenate([c[2] for c in contexts])]
        names, lead, context = distinct(joint(columns))
        columns = [c[lead] for c in columns]
        is_hot = np.zeros(len(names), bool)
        is_hot[context] = np.concatenate([c[1] for c in contexts]) > 0
        lengths = np.concatenate([np.diff(np.append(c[0], len(g[0]))) for c, g in zip(contexts, grams, strict=True)])
        owner = np.repeat(context, lengths)
        word = np.concatenate([g[0] for g in grams])
        _, first, back = distinct(joint([owner, word]))
        count_ = np.bincount(back, weights=np.concatenate([g[1] for g in grams])).astype(np.int64)
        owner, word = owner[first], word[first]
        below = np.concatenate([g[2] for g in grams])[first]
        if n == 2:
            p = one.probability(below)
        else:
            whole = np.concatenate([c[3] for c in contexts])[lead]
            with np.errstate(all="ignore"):
                p = d[np.minimum(below, K + 1)] * below / whole[owner]
        size = len(names)
        seen = count_ > 0
        of_counts = np.array([np.bincount(owner[count_ == r], minlength=size) for r in range(1, K + 1)])
        total = np.bincount(owner, weights=count_, minlength=size).astype(np.int64)
        lower = np.bincount(owner[seen], weights=p[seen], minlength=size)
        marks = total * 2 + (of_counts.sum(axis=0) > 0)
        out = []
        gram_at = context_at = 0
        for r, c, g in zip(rows, contexts, grams, strict=True):
            i, own = context[context_at : context_at + len(c[0])], count_[back[gram_at : gram_at + len(g[0])]]
            gram_at, context_at = gram_at + len(g[0]), context_at + len(c[0])
            need = i[~is_hot[i] & (np.minimum.reduceat(own, c[0]) == 0)]
            out.append({"part": "reply", "bucket": bucket, "shelf": r["shelf"], "a": squeeze(own, plain=True), "b": squeeze(marks[i], plain=True), "c": squeeze(of_counts[:, need].ravel(), lower[need].view(np.int64), plain=True) if len(need) else None})
        if keep:
            # the tables hold what was seen
            run = heads(owner[seen])
            some = owner[seen][run]
            out.append({"part": "grams", "bucket": bucket, "a": squeeze(run, *[x[some] for x in columns]), "b": squeeze(word[seen], count_[seen], plain=True)})
            cold = ~is_hot[some]
            out.append({"part": "sums", "bucket": bucket, "a": squeeze(np.where(cold, total[some], 0), *(of_counts[:, some] * cold), plain=True), "b": np.where(cold, lower[some], 0.0).tobytes()})
        out.append({"part": "stats", "bucket": bucket, "stats": [int((count_ == r).sum()) for r in range(1, K + 2)]})
        for i in np.flatnonzero(is_hot):
            out.append({"part": "hot", "bucket": bucket, "a": np.array([x[i] for x in columns]).tobytes(), "stats": [int(x) for x in [*[c[i] for c in columns], total[i], *of_counts[:, i]]], "lower": float(lower[i])})
        return parts_of(out)

    asked = joined(shelves, replies).mapInArrow(ask, "bucket long, shelf long, contexts binary, newer binary, grams binary")
    out = parted(asked.groupBy("bucket").applyInArrow(count, PARTS), f"{model.path}/{n}-{round_}")
    del asked
    release(out.sparkSession)
    return out


def weighed(spark: SparkSession, found: list[DataFrame], model: Model, n: int, keep: bool) -> Broadcast:
    """Writes the weights of the contexts of order n in place of their sums, if tables are to be kept, and those of frequent contexts; the latter are broadcast: at most FREQUENT."""
    d, width = model.d[n - 2], n - 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total, *of_counts = unsqueeze(row["a"])
                with np.errstate(all="ignore"):
                    out = np.where(total > 0, weights(d, total, np.array(of_counts), np.frombuffer(row["b"], np.float64)), 0.0)
                yield batch_of([(row["bucket"], squeeze(total, plain=True), out.tobytes())], "bucket totals weights")

    for r, parts in enumerate(found if keep else []):
        rows = parts.where("part = 'sums'").select("bucket", "a", "b").mapInArrow(weigh, "bucket long, totals binary, weights binary")
        rows.write.option("compression", "zstd").parquet(f"{model.path}/{n}-{r}/weights")
        drop_path(spark, f"{model.path}/{n}-{r}/part=sums")
    sums = union(found).where("part = 'hot'").groupBy("a").agg(F.first(F.slice("stats", 1, width)).alias("key"), *[F.sum(F.get("stats", F.lit(width + i))).alias(f"s{i}") for i in range(K + 1)], F.sum("lower").alias("lower"))
    lost = sum((F.col(f"s{r}") * float((1 - d[r]) * r) for r in range(1, K + 1)), F.lit(0.0))
    small = sum((F.col(f"s{r}") for r in range(1, K + 1)), F.lit(0)) > 0
    extra = F.when(small & F.lit(bool(d[1] < 1)), 0).otherwise(1)
    rows = sums.select("key", F.col("s0").alias("total"), (F.col("s0") + extra).alias("whole"), ((lost + extra) / (F.col("s0") + extra) / (1 - F.col("lower"))).alias("weight"))
    rows.write.parquet(f"{model.path}/{n}-hot")
    table_ = spark.read.schema("key array<long>, total long, whole long, weight double").parquet(f"{model.path}/{n}-hot")
    return spark.sparkContext.broadcast({tuple(r["key"]): (r["whole"], r["weight"]) for r in table_.collect()})


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
