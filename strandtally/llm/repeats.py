"""Operator 9: exact repeats of word sequences, found with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of `anchor` words.
The rolling windows of `anchor` words of all documents probe the block index.
A sequence of `window` >= 2 * anchor - 1 words holds a whole block wherever it
stands, so each of its occurrences has a probe that hits a block of another place.  Hits
are extended: the windows of `window` words round them are compared by 64-bit
hashes, each with the first place where it occurs, and runs of windows that occur earlier merge
into the maximal repeats whose words are removed.

Documents stay on shelves (see _shared.shelve).  A shelf sends each distinct hash
once, whatever its number of occurrences, to the bucket that owns the hash, so a passage that a
third of all documents hold makes one entry a shelf; the shelf marks its own
repeats itself.  Hashes are truncated to 32 bits beside the bucket only for the anchors, whose false hits the full
hashes discard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._shared import (
    drop_written,
    release,
    shelve,
    split_buckets,
    squeeze,
    table,
    unshelve,
    unsqueeze,
    window_hashes,
    word_hashes,
    words,
    written,
)

SHELF_BYTES = 4 << 20
BUCKET_WORDS = 2_000_000
LEAST_BUCKETS = 64


def rolling(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as word numbers of the shelf) of the windows inside one document, and their hashes."""
    lengths = np.diff(first)
    valid = np.maximum(lengths - width + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(valid)[:-1]]), valid) + np.arange(valid.sum())
    return at, window_hashes(values, width)[at]


def first_of_each(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each distinct hash, ascending; and for each entry whether its hash occurs more than once."""
    _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return np.sort(first), n[back] > 1


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor: int = 10) -> DataFrame:
    """(id, n_words, spans array<struct<start,end>>, kept string) for each row.

    spans are the maximal runs of words to remove (word numbers from 0, end
    exclusive); kept is the rest, joined by one space.  A null text has no words; a null id counts as
    the smallest.  Rows with the same id count as one place: equal windows at equal starts
    don't remove each other.  Other columns are ignored.
    """
    if window < 2 * anchor - 1:
        raise ValueError("window must be at least 2 * anchor - 1")
    spark = df.sparkSession
    shelves = shelve(df, id_col, text_col, SHELF_BYTES)
    total = shelves.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_WORDS))

    def opened(row: dict) -> tuple:
        ids, none, data, offsets = unshelve(row["ids"], row["ends"], row["texts"])
        starts, ends, first = words(data, offsets)
        return ids, none, data, starts, ends, first, word_hashes(data, starts, ends)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                *_, first, values = opened(row)
                at, hashes = rolling(values, first, anchor)
                if not len(at):
                    continue
                document = np.searchsorted(first, at, side="right") - 1
                block = (at - first[document]) % anchor == 0
                # a block stands for its hash where both occur, and a probe asks
                _, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
                blocks = np.bincount(back, weights=block)
                n = np.bincount(back)
                some = np.sort(lead)
                kind = np.minimum(blocks, 2)[back[some]].astype(np.int64) + 3 * (n[back[some]] > blocks[back[some]])
                owner = (hashes[some] % np.uint64(buckets)).astype(np.int64)
                out = [(b, row["shelf"], (hashes[some[i]] >> np.uint64(32)).astype(np.uint32).tobytes(), squeeze(some[i], kind[i])) for b, i in split_buckets(owner, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shelf", "hashes", "entries"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entries whose hash is a block's in another place."""
        parts = [unsqueeze(x) for x in pdf["entries"]]
        hashes = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]])
        kind = np.concatenate([p[1] for p in parts])
        _, back = np.unique(hashes, return_inverse=True)
        has_block = kind % 3 > 0
        blocks = np.bincount(back, weights=has_block)
        entries = np.bincount(back)
        hit = (blocks[back] > 0) & (entries[back] > 1)
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        out = [(s, squeeze(p[0][m])) for s, p, m in zip(pdf["shelf"], parts, np.split(hit, cut[1:-1]), strict=True) if m.any()]
        return pd.DataFrame(out, columns=["shelf", "hits"])

    asked = shelves.mapInArrow(probes, "bucket long, shelf long, hashes binary, entries binary")
    hits = written(asked.groupBy("bucket").applyInPandas(meet, "shelf long, hits binary"), "hits")
    del asked
    release(spark)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, _, _, _, first, values = opened(row)
                at, hashes = rolling(values, first, anchor)
                if not len(at):
                    continue
                hit = np.zeros(len(values) + 1, dtype=bool)
                lead, repeated = first_of_each(hashes)
                hit[at[repeated]] = True
                for x in row["hits"] or []:
                    hit[at[unsqueeze(x)[0]]] = True
                # a window is near a hit if one of the anchors inside it was hit
                near = np.concatenate([[0], np.cumsum(hit)])
                at, hashes = rolling(values, first, window)
                close = near[at + window - anchor + 1] > near[at]
                at, hashes = at[close], hashes[close]
                if not len(at):
                    continue
                lead, _ = first_of_each(hashes)
                at, hashes = at[lead], hashes[lead]
                document = np.searchsorted(first, at, side="right") - 1
                owner = (hashes % np.uint64(buckets)).astype(np.int64)
                place = at - first[document]
                out = [(b, row["shelf"], hashes[i].tobytes(), squeeze(at[i], ids[document[i]], none[document[i]], place[i])) for b, i in split_buckets(owner, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shelf", "hashes", "entries"])

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entries whose window occurs on another shelf at an earlier place."""
        parts = [unsqueeze(x) for x in pdf["entries"]]
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        ids, none, place = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.lexsort((place, ids, 1 - none, hashes))
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late = np.empty(len(order), dtype=bool)
        late[order] = (ids[order] != ids[lead]) | (none[order] != none[lead]) | (place[order] != place[lead])
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        out = [(s, squeeze(p[0][m])) for s, p, m in zip(pdf["shelf"], parts, np.split(late, cut[1:-1]), strict=True) if m.any()]
        return pd.DataFrame(out, columns=["shelf", "late"])

    near = shelves.join(hits.groupBy("shelf").agg(F.collect_list("hits").alias("hits")), "shelf", "left")
    judged = written(near.mapInArrow(windows, "bucket long, shelf long, hashes binary, entries binary").groupBy("bucket").applyInPandas(later, "shelf long, late binary"), "late")
    del near
    drop_written(hits)
    release(spark)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, data, starts, ends, first, values = opened(row)
                at, hashes = rolling(values, first, window)
                late = np.zeros(len(values) + 1, dtype=bool)
                for x in row["late"] or []:
                    late[unsqueeze(x)[0]] = True
                if len(at):
                    # the shelf's own repeats: all but the first place, and that too if it is late
                    _, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
                    document = np.searchsorted(first, at, side="right") - 1
                    head = lead[back]
                    same = (ids[document] == ids[document[head]]) & (none[document] == none[document[head]]) & (at - first[document] == at[head] - first[document[head]])
                    late[at] = ~same | late[at[head]]
                edge = np.zeros(len(values) + window + 1, dtype=np.int64)
                marked = np.flatnonzero(late)
                edge[marked] += 1
                edge[marked + window] -= 1
                gone = np.cumsum(edge)[: len(values)] > 0
                raw = data.tobytes()
                spans, kept = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = gone[a:b].astype(np.int8)
                    turn = np.flatnonzero(np.diff(own, prepend=0, append=0))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    kept.append(" ".join([raw[starts[i] : ends[i]].decode(errors="replace") for i in np.flatnonzero(own == 0) + a]) if len(turn) else b" ".join(raw[starts[a] : ends[b - 1]].split()).decode(errors="replace") if b > a else "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=none),
                        pa.array(np.diff(first)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.string()),
                    ],
                    names=[id_col, "n_words", "spans", "kept"],
                )

    done = shelves.join(judged.groupBy("shelf").agg(F.collect_list("late").alias("late")), "shelf", "left")
    return done.mapInArrow(remove, f"`{id_col}` long, n_words long, spans array<struct<start:long,end:long>>, kept string")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
