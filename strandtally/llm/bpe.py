"""Operator 2: byte-level BPE, encoding and decoding.

Each pre-token is encoded with a priority queue of merge ranks over a doubly
linked list of symbols; entries whose symbols have changed since they were
queued are stale and skipped.  Decoding concatenates vocabulary strings and
maps their characters back to bytes.  The vocabulary file is a parameter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandtally.llm._shared import chunks, table

# Fixed value: the published pre-tokenisation pattern of byte-level BPE, with white space as in Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# The same for texts of these characters alone, for the faster standard engine.
PLAIN_PATTERN = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NOT_PLAIN = r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
CACHE_ENTRIES, CACHE_IDS = 600_000, 4_000_000


def byte_characters() -> list[str]:
    """The printable stand-in of each byte value: itself where printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        vocab = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        #: Rank by left * 2**20 + right; and by rank what is merged and what comes out.
        self.ranks, self.left, self.right, self.made = {}, [], [], []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 20 | vocab[right]] = rank
            self.left.append(vocab[left])
            self.right.append(vocab[right])
            self.made.append(vocab[left + right])
        characters = byte_characters()
        self.first = [vocab[c] for c in characters]
        to_byte = {c: b for b, c in enumerate(characters)}
        self.bytes_of = {}
        for i, s in self.strings.items():
            known = all(c in to_byte for c in s)
            self.bytes_of[i] = bytes(to_byte[c] for c in s) if known else s.encode()
        self.find_any = regex.compile(PATTERN).findall
        self.find_plain = re.compile(PLAIN_PATTERN).findall
        self.not_plain = re.compile(NOT_PLAIN).search
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        top = max(self.bytes_of) + 1
        spelled = [self.bytes_of.get(i, b"") for i in range(top)]
        self.spelling = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelling_at = np.cumsum([0] + [len(x) for x in spelled])
        self.forget()

    def forget(self) -> None:
        """Empties the cache: pre-token -> its number, and its ids in one array."""
        self.cache: dict[str, int] = {}
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.pool_at = np.zeros(1 << 14, dtype=np.int64)

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece]
        n = len(ids)
        rank_of, wide = self.ranks.get, n.bit_length()
        queue = []
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 20 | ids[i + 1])) is not None:
                queue.append(rank << wide | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        lefts, rights, mask, pop, push = self.left, self.right, (1 << wide) - 1, heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            i, rank = top & mask, top >> wide
            j = after[i]
            if ids[i] != lefts[rank] or j < 0 or ids[j] != rights[rank]:
                continue  # stale
            made = ids[i] = self.made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of(made << 20 | ids[k])) is not None:
                    push(queue, rank << wide | i)
            k = before[i]
            if k >= 0 and (rank := rank_of(ids[k] << 20 | made)) is not None:
                push(queue, rank << wide | k)
        return [x for x in ids if x >= 0]

    def numbers(self, tokens: list[str]) -> list[int]:
        """The cache's number of each pre-token, encoding those that are new."""
        out = list(map(self.cache.get, tokens))
        if None in out:
            cache = self.cache
            for i, n in enumerate(out):
                if n is None:
                    out[i] = cache.get(tokens[i], -1)
                    if out[i] < 0:
                        out[i] = self.learn(tokens[i])
        return out

    def learn(self, token: str) -> int:
        n, ids = len(self.cache), self.merge(token.encode(errors="replace"))
        at = int(self.pool_at[n])
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        if n + 2 > len(self.pool_at):
            self.pool_at = np.concatenate([self.pool_at, np.zeros_like(self.pool_at)])
        self.pool[at : at + len(ids)] = ids
        self.pool_at[n + 1] = at + len(ids)
        self.cache[token] = n
        return n

    def tokens(self, text: str) -> list[str]:
        """Pre-tokens; a special token's string is one of its own."""
        find = self.find_any if self.not_plain(text) else self.find_plain
        if self.cut is None or not (cuts := list(self.cut.finditer(text))):
            return find(text)
        out, at = [], 0
        for m in cuts:
            out += find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + find(text[at:])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        if len(self.cache) > CACHE_ENTRIES or len(self.pool) > CACHE_IDS:
            self.forget()
        for content, i in self.special.items():
            if content not in self.cache:
                n = self.learn("")  # an entry of no ids, made the special token's
                del self.cache[""]
                self.cache[content] = n
                self.pool[self.pool_at[n]] = i
                self.pool_at[n + 1] = self.pool_at[n] + 1
        found: list[int] = []
        ends = [0]
        for text in texts:
            found += self.numbers(self.tokens(text))
            ends.append(len(found))
        at = np.array(found, dtype=np.int64)
        sizes = self.pool_at[at + 1] - self.pool_at[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.pool_at[at] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[ends]

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the concatenated vocabulary strings, and where each text's begin."""
        sizes = self.spelling_at[ids + 1] - self.spelling_at[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = self.spelling[np.repeat(self.spelling_at[ids] - before[:-1], sizes) + np.arange(before[-1])]
        return out.tobytes(), before[starts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode(errors="replace")


@functools.lru_cache(maxsize=1)
def codec_of(definition: str) -> BytePairCodec:
    """Kept by a Python worker from task to task, with its cache of pre-tokens."""
    return BytePairCodec(definition)


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, ids array<int>, decoded string) for each row of df.

    A null text counts as empty and has no ids.  Texts are whole, whatever
    their length; memory is a chunk of texts and a bounded cache of
    pre-tokens.  `vocabulary` is the path of a tokenizer's JSON file, read on
    the driver and broadcast (a few MB whatever the data).  Other columns
    than the named ones are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    # columns are renamed by position, so equal or clashing names elsewhere don't matter
    rows = df.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(definition.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi, data, offsets in chunks(texts, 2 << 20):
                raw = data.tobytes()
                ids, starts = codec.encode_all([raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                said, at = codec.decode_all(ids, starts)
                decoded = pa.array([said[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                listed = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                others = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*others, listed, decoded], names=schema.names)

    return rows.mapInArrow(code, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), default_vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
