"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Method. A pre-token is a linked list of pieces. Each pair of neighbours that the vocabulary can merge is queued in the
bucket of its merge rank, by the position of its left piece. A bitmap in two levels marks the ranks whose buckets hold
entries: words of 64 ranks, and a top with a bit for each word; find-first-set in the top and then in the word gives
the lowest rank in a constant number of steps. Its leftmost entry is taken; it is stale, and skipped, if its left piece
has been merged away or its pair has changed.
Each merge queues at most two pairs, so a pre-token of n bytes takes O(n log n) steps however long it is.

Texts are cut by the pre-token pattern; texts within Latin-1 take an equivalent pattern of the standard library, which
is faster. The ids of pre-tokens are kept in two generations of at most ``CACHE`` entries for each worker.

Defined cases: a null text is empty; an empty text has no ids; bytes that a decoder gets are the text's own, so the
round trip is exact; repeated rows and null ids give a row each; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, text_or_empty, texts

#: Pre-tokens that a worker remembers in each of two generations.
CACHE = 250_000
#: Longer pre-tokens are not remembered.
CACHE_CHARS = 64

_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085 "


def latin_pattern(pattern: str) -> re.Pattern | None:
    """An equal of a pre-token pattern for texts within Latin-1, if the pattern uses no classes but these."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
    out = out.replace(r"\s", f"[{_BLANKS}]").replace(r"\S", f"[^{_BLANKS}]")
    return None if "\\p" in out else re.compile(out)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        self.ranks, self.cache = ranks, cache
        self.bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self.find, self.find_latin = regex.compile(pattern).findall, (latin_pattern(pattern) or regex.compile(pattern)).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """The packed ids of one pre-token."""
        if piece in self.packed:
            return self.packed[piece]
        n = len(piece)
        ends = list(range(1, n + 1))  # of the piece that starts at a position; 0: merged away
        prev = list(range(-1, n - 1))
        get = self.ranks.get
        top = 0
        words: dict[int, int] = {}
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(i)  # in order, so it stays a heap
            else:
                buckets[rank] = [i]
                word = rank >> 6
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                words[word] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            mid = ends[i]
            if not mid or mid == n:
                continue  # stale
            end = ends[mid]
            if get(piece[i:end]) != rank:
                continue  # stale
            ends[i], ends[mid] = end, 0
            before = prev[i]
            if end < n:
                prev[end] = i
            for left, right in ((i, ends[end] if end < n else 0), (before, end if before >= 0 else 0)):
                if right and (rank := get(piece[left:right])) is not None:
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        word = rank >> 6
                        words[word] = words.get(word, 0) | 1 << (rank & 63)
                        top |= 1 << word
        out, i, packed = [], 0, self.packed
        while i < n:
            out.append(packed[piece[i : ends[i]]])
            i = ends[i]
        return b"".join(out)

    def _ids(self, token: str) -> bytes:
        ids = self.old.get(token)
        if ids is None:
            ids = self.merge(token.encode())
        if len(token) <= CACHE_CHARS:
            if len(self.young) >= self.cache:
                self.young, self.old = {}, self.young
            self.young[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        try:
            text.encode("latin-1")
            tokens = self.find_latin(text)
        except UnicodeEncodeError:
            tokens = self.find(text)
        get, miss = self.young.get, self._ids
        out = []
        for at in range(0, len(tokens), 1 << 16):
            for token in tokens[at : at + (1 << 16)]:
                ids = get(token)
                if ids is None:
                    ids = miss(token)
                    get = self.young.get
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file's content."""
    return Codec(load_ranks(data), pattern)


def _arrow(docs: DataFrame, path: str, pattern: str, schema: str, make: Callable[[Codec, list[bytes]], list[pa.Array]]) -> DataFrame:
    with open(path, "rb") as f:  # a vocabulary: below 5 MB, read once by the driver
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(own, batch)], names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers)."""

    def make(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([own.encode(x.decode()) for x in texts(batch, "text")], pa.binary())]

    return _arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")), path, pattern, "doc_id long, ids binary", make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary) of rows (doc_id, ids)."""

    def make(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(1), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())]

    return _arrow(encoded.select("doc_id", "ids"), path, pattern, "doc_id long, ids binary, decoded binary", make)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the digests of the encoded and decoded text; both in one Python worker, which then holds the vocabulary once."""

    def make(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = [own.encode(x.decode()) for x in texts(batch, "text")]
        return [pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())]

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return digests(_arrow(rows, path, pattern, "doc_id long, ids binary, decoded binary", make))


def defaults() -> tuple[str, str]:
    """Vocabulary file and pattern of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(prepare(spark), sf_dir, "documents"), *defaults())
