"""Operator 6: chroma fingerprints of audio columns.

A recording (WAV, or raw unsigned 8-bit samples) is cut into overlapping frames whose
spectra are folded into 12 pitch classes.  Filters over an integral image of 16 frames
by 12 classes each give two bits, packed into one 32-bit integer for each frame offset.

Search: the recordings of a stated query set against all.  The bit errors of every
offset with enough overlap are counted, so no pair within the limit is missed; of the offsets of a pair that
pass, the one that is furthest below the limit, in bits, is its alignment.  Queries are taken in blocks of
bounded size, each broadcast for one pass over the fingerprint table; within a task hits become counts by
query, so pairs are never shuffled.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import chunks, table, written

FRAME, HOP, SPAN, RATE = 512, 128, 16, 11025
LEAST_HZ, MOST_HZ = 28.0, 3520.0
FILTERS = 16
BLOCK_VALUES = 2_000_000
BLOCK_PLACES = 1 << 15
PAIRS = 1 << 20
LONG = 2047


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate; bytes that are no WAV are unsigned 8-bit samples."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(data)) as w:
                raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
        except (wave.Error, EOFError):
            return np.zeros(0, np.float32), RATE
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
        elif width == 2:
            x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
        else:
            return np.zeros(0, np.float32), RATE
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
        return x, rate
    return np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1, RATE


@lru_cache(maxsize=8)
def pitch_classes(rate: int) -> np.ndarray:
    """(bins, 12): which pitch class each spectrum bin counts for."""
    hz = np.arange(FRAME // 2 + 1) * rate / FRAME
    out = np.zeros((len(hz), 12), dtype=np.float32)
    used = np.flatnonzero((hz >= LEAST_HZ) & (hz <= MOST_HZ))
    out[used, np.rint(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the filters: kinds compare halves in time, halves in pitch, quarters crosswise, and the middle with both ends."""
    out = []
    for i in range(FILTERS):
        kind = i % 4
        classes = (12, 4, 6, 12)[(i // 4) % 4] if kind != 0 else (3, 12, 6, 2)[(i // 4) % 4]
        out.append((kind, (3 * i + i // 4) % (12 - classes + 1), classes, (4, 8, 12, 16)[(i // 4 + kind) % 4]))
    return out


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) unit rows; a short recording is padded to SPAN frames."""
    need = FRAME + (SPAN - 1) * HOP
    if len(x) < need:
        x = np.concatenate([x, np.zeros(need - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    out = np.empty((len(frames), 12), dtype=np.float64)
    for lo in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft((frames[lo : lo + 2048] - frames[lo : lo + 2048].mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2
        out[lo : lo + 2048] = power @ pitch_classes(rate)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0.0)


def fingerprint(data: bytes) -> np.ndarray:
    """uint32 for each run of SPAN frames; none for an empty recording."""
    x, rate = samples(data)
    if not len(x):
        return np.zeros(0, np.uint32)
    rows = chroma(x, rate)
    image = np.zeros((len(rows) + 1, 13))
    image[1:, 1:] = rows.cumsum(axis=0).cumsum(axis=1)
    n = len(rows) - SPAN + 1
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, dtype=np.uint32)
    for i, (kind, c, h, w) in enumerate(filters()):
        if kind == 0:
            a, b = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        elif kind == 1:
            a, b = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h)
        elif kind == 2:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = area(w // 2, w, c, c + h // 2) + area(0, w // 2, c + h // 2, c + h)
        else:
            a, b = area(w // 4, w - w // 4, c, c + h), area(0, w // 4, c, c + h) + area(w - w // 4, w, c, c + h)
        level = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        step = (level > -0.15).astype(np.uint32) + (level > 0) + (level > 0.15)
        out |= (step ^ (step >> 1)).astype(np.uint32) << np.uint32(2 * i)  # neighbouring levels differ in one bit
    return out


def fingerprints(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, prints binary) for each row: uint32 values, little-endian; empty for a null or empty recording."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(media_col).cast("binary"), F.lit(b"")).alias("media"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), 4 << 20):
                raw = data.tobytes()
                out = [fingerprint(raw[a:b]).astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["id", "prints"])

    return rows.mapInArrow(mark, "id long, prints binary")


@dataclass
class Queries:
    """A block of queries: their prints end to end."""

    ids: np.ndarray
    first: np.ndarray
    prints: np.ndarray


def block_of(rows: list[tuple[int, bytes]]) -> Queries:
    prints = [np.frombuffer(p, np.uint32) for _, p in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int64)
    return Queries(np.array([i for i, _ in rows], dtype=np.int64), first, np.concatenate(prints) if prints else np.zeros(0, np.uint32))


@dataclass
class Hay:
    """Recordings laid out with `gap` places between them: each place's print with its follower as one 64-bit value, and which of these bits are real."""

    own: np.ndarray
    start: np.ndarray
    gap: int
    prints: np.ndarray
    real: np.ndarray
    twins: np.ndarray
    masks: np.ndarray
    upto: np.ndarray


def hays(own: np.ndarray, prints: np.ndarray, first: np.ndarray, gap: int) -> Iterator[Hay]:
    """Layouts of about BLOCK_PLACES places; a longer recording is one of its own."""
    size = first[own + 1] - first[own]
    lo = 0
    ends = np.cumsum(size + gap)
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_PLACES, side="right")))
        part, n = own[lo:hi], size[lo:hi]
        start = np.cumsum(n + gap) - n
        total = int(start[-1] + n[-1]) + 2 * gap + 2
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value, real = np.zeros(total, np.uint64), np.zeros(total, bool)
        value[np.repeat(start, n) + step] = prints[np.repeat(first[part], n) + step]
        real[np.repeat(start, n) + step] = True
        mask = np.where(real, np.uint64(0xFFFFFFFF), np.uint64(0))
        shift = np.uint64(32)
        upto = np.concatenate([[0], np.cumsum(real)])
        yield Hay(part, start, gap, value, real, value[:-1] | value[1:] << shift, mask[:-1] | mask[1:] << shift, upto)
        lo = hi


def wrong_bits(needle: np.ndarray, hay: Hay) -> np.ndarray:
    """Bit errors with the needle's first print at each place of the layout but the last."""
    m, n = len(needle), len(hay.prints) - hay.gap - 2
    if m <= LONG:
        total, piece = np.zeros(n, np.uint16), np.zeros(n, np.uint8)
        both, count = np.empty(n, np.uint64), np.empty(n, np.uint8)
        values = np.append(needle, np.uint32(0))[: m + m % 2].astype("<u4").view("<u8")
        for i, value in enumerate(values):
            np.bitwise_xor(hay.twins[2 * i : 2 * i + n], value, out=both)
            np.bitwise_and(both, hay.masks[2 * i : 2 * i + n], out=both)
            if 2 * i + 1 == m:
                both &= np.uint64(0xFFFFFFFF)
            np.bitwise_count(both, out=count)
            piece += count
            if i % 3 == 2 or i == len(values) - 1:  # three counts of up to 64 fit a byte
                total += piece
                piece[:] = 0
        return total
    # 32 correlations of -1 and 1: agreeing less differing bits
    size = 1 << (len(hay.prints) + m).bit_length()
    spectrum = np.zeros(size // 2 + 1, np.complex128)
    for bit in range(32):
        sign = np.where(hay.real, 2.0 * (hay.prints >> np.uint64(bit) & np.uint64(1)) - 1, 0.0)
        spectrum += np.fft.rfft(sign, size) * np.conj(np.fft.rfft(2.0 * (needle >> np.uint32(bit) & np.uint32(1)) - 1, size))
    return (32 * (hay.upto[m : m + n] - hay.upto[:n]) - np.rint(np.fft.irfft(spectrum, size)[:n]).astype(np.int64)) // 2


def most_wrong(longest: int, most_errors: float, least_overlap: int) -> np.ndarray:
    """For each overlap the bit errors that still align; -1 where the overlap is too short."""
    size = np.arange(longest + 1)
    out = np.floor(32.0 * size * most_errors).astype(np.int64)
    out += (out + 1) / np.maximum(32.0 * size, 1) <= most_errors
    out -= out / np.maximum(32.0 * size, 1) > most_errors
    out[: min(least_overlap, longest + 1)] = -1
    return out


def aligned(prints: np.ndarray, first: np.ndarray, q: Queries, most_errors: float, least_overlap: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(recording, query, offset, errors) of the recordings that align with a query, in pieces; offset = place in the recording - place in the query."""
    size, own_size = np.diff(first), np.diff(q.first)
    # recordings with few prints must overlap as a whole: equal lengths, offset zero
    for n in range(1, least_overlap):
        left, right = np.flatnonzero(size == n), np.flatnonzero(own_size == n)
        step = max(1, PAIRS // max(1, len(left)))
        for lo in range(0, len(right) if len(left) else 0, step):
            part = right[lo : lo + step]
            wrong = sum(np.bitwise_count(prints[first[left] + i][None, :] ^ q.prints[q.first[part] + i][:, None]).astype(np.int64) for i in range(n))
            k, r = np.nonzero(wrong / (32.0 * n) <= most_errors)
            yield left[r], part[k], np.zeros(len(r), np.int64), wrong[k, r] / (32.0 * n)
    # of a longer pair the one of the smaller class of length slides over the other
    least = max(least_overlap, 1)
    rank = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    own_rank = np.ceil(np.log2(np.maximum(own_size, 1))).astype(int)
    for c in range(int(max(rank.max(initial=0), own_rank.max(initial=0))) + 1):
        sides = (
            (np.flatnonzero((own_rank == c) & (own_size >= least)), np.flatnonzero((rank >= c) & (size >= least)), q.prints, q.first, prints, first, False),
            (np.flatnonzero((rank == c) & (size >= least)), np.flatnonzero((own_rank > c) & (own_size >= least)), prints, first, q.prints, q.first, True),
        )
        limit = most_wrong(1 << c, most_errors, least)
        for needles, others, of, at, over, over_at, swapped in sides:
            for hay in hays(others, over, over_at, 1 << c) if len(needles) else ():
                m = 0
                for k in needles[np.argsort(at[needles + 1] - at[needles], kind="stable")]:
                    wrong = wrong_bits(of[at[k] : at[k + 1]], hay)
                    if m != at[k + 1] - at[k]:
                        m = int(at[k + 1] - at[k])
                        overlap = hay.upto[m : m + len(wrong)] - hay.upto[: len(wrong)]
                        bound = (limit[overlap] + 1).astype(wrong.dtype)
                    place = np.flatnonzero(wrong < bound)
                    if not len(place):
                        continue
                    # a place belongs to the recording that the needle touches there
                    it = np.searchsorted(hay.start, place + m - 1, side="right") - 1
                    offset = place - hay.start[it]
                    offset = -offset if swapped else offset
                    wrong, met = wrong[place].astype(np.int64), overlap[place]
                    order = np.lexsort((offset, wrong - 32.0 * most_errors * met, it))
                    best = order[np.concatenate([[True], np.diff(it[order]) > 0])]
                    one, other = np.full(len(best), k), hay.own[it[best]]
                    yield (one if swapped else other), (other if swapped else one), offset[best], wrong[best] / (32.0 * met[best])


def gathered(pieces: Iterator[tuple[np.ndarray, ...]], least: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces joined to `least` rows or more but for the last."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for piece in pieces:
        held.append(piece)
        rows += len(piece[0])
        if rows >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def search(df: DataFrame, id_col: str, media_col: str, every: int = 20, most_errors: float = 0.15, least_overlap: int = 4) -> DataFrame:
    """(id, n_prints, n_matches, best_id, best_offset, best_errors) for each distinct id that `every` divides.

    n_matches counts the other ids' rows that align with the query; the best has the fewest bit errors, then the smallest id.
    A recording without prints (null or empty) matches nothing.  Null ids are searched but are no queries; of rows
    that repeat a query's id the greatest prints are the query, and rows of one id never match each other.  Other columns are ignored.
    """
    spark = df.sparkSession
    marked = written(fingerprints(df, id_col, media_col), "prints")
    queries = written(marked.where(F.col("id") % every == 0).groupBy("id").agg(F.max("prints").alias("prints")), "queries")
    # blocks by running size: bounded broadcasts, however many queries
    sizes = queries.agg(F.sum(F.length("prints")).alias("n"), F.max(F.length("prints")).alias("top")).first()
    parts = max(1, -(-int(sizes["n"] or 0) // (4 * BLOCK_VALUES)))
    schema = "query long, n long, errors double, best long, offset long"
    out = None
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect() if parts > 1 else queries.collect()
        block = spark.sparkContext.broadcast(block_of(sorted((r["id"], bytes(r["prints"])) for r in rows)))

        def match(batches: Iterator[pa.RecordBatch], block: object = block) -> Iterator[pa.RecordBatch]:
            q = block.value
            n = np.zeros(len(q.ids), np.int64)
            best = [None] * len(q.ids)
            for batch in batches:
                ids = batch.column(0).fill_null(-1).to_numpy()
                none = np.asarray(batch.column(0).is_null())
                for lo, hi, data, offsets in chunks(batch.column(1)):
                    for r, k, offset, errors in gathered(aligned(np.frombuffer(data.tobytes(), np.uint32), offsets // 4, q, most_errors, least_overlap)):
                        r = r + lo
                        other = none[r] | (ids[r] != q.ids[k])
                        r, k, offset, errors = r[other], k[other], offset[other], errors[other]
                        n += np.bincount(k, minlength=len(n))
                        order = np.lexsort((offset, ids[r], none[r], errors, k))
                        for i in order[np.concatenate([[True], np.diff(k[order]) > 0])] if len(order) else []:
                            mine = (float(errors[i]), bool(none[r[i]]), int(ids[r[i]]), int(offset[i]))
                            best[k[i]] = mine if best[k[i]] is None else min(best[k[i]], mine)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q.ids[some]),
                    pa.array(n[some]),
                    pa.array([best[i][0] for i in some], pa.float64()),
                    pa.array([None if best[i][1] else best[i][2] for i in some], pa.int64()),
                    pa.array([best[i][3] for i in some], pa.int64()),
                ],
                names=["query", "n", "errors", "best", "offset"],
            )

        own = marked.mapInArrow(match, schema)
        own = written(own.groupBy("query").agg(F.sum("n").alias("n"), F.min(F.struct("errors", F.col("best").isNull().alias("none"), "best", "offset")).alias("b")), "matches")
        out = own if out is None else out.unionByName(own)
    full = queries.join(out, F.col("id") == F.col("query"), "left")
    return full.select(
        F.col("id").alias(id_col),
        (F.length("prints") / 4).cast("long").alias("n_prints"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.col("b.best").alias("best_id"),
        F.col("b.offset").alias("best_offset"),
        F.col("b.errors").alias("best_errors"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the bytes of each page stand for its samples."""
    return search(table(spark, sf_dir, "pages"), "page_id", "html")
