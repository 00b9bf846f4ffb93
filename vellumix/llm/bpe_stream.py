"""Byte-level BPE as a streaming transducer with bounded lookahead, for vocabularies of a merge list.

Method. A text goes through in pieces. Pre-tokens are cut from a buffer: a match is settled once three more code points
follow; one that is still open and long is passed on as it grows, and a machine of its class (letters, numbers, blanks,
others) tells where it ends. A pre-token's bytes go to a transducer that emits ids as soon as no further byte can change
them, and holds no more than ``lookahead`` bytes and one window behind them. So the state is constant, however long a
text or a pre-token is.

The lookahead follows from the merge list. Let two strings share their first n bytes, and apply the merges rank by rank
to both. The boundaries up to a front agree, the front being n at first. A merge (a, b) moves the front only if a is the
last piece before it and b follows in one of the strings; then it moves back by the length of a. The next merge (c, d)
that moves it finds a, or a b, at its right; so a is on d's left edge, and what d's edge grows to next does so at a's
merge or later. The longest chain of such merges, in order of rank, bounds the way that the front can go: pieces that
end so many bytes before the end of what is known are final. What follows a boundary is encoded as if it stood alone.
This needs a proper list, in which each piece is made before it is merged; others are refused.

Decoding is a machine over bytes: ids become bytes, and code points are given out once complete; up to three bytes are
held, and what is not UTF-8 becomes U+FFFD, one for each longest part of a code point.

Letters, numbers and blanks are those of the tokenizers library: beyond Latin-1, each new code point is looked up in its
own byte-level pre-tokenizer, and stands for one of its class while the pattern runs. Added tokens are found in the
text, as the library does.

Defined cases: a null text is empty; an empty text has no ids and decodes to an empty one; bytes that are not UTF-8 are
read as U+FFFD; ids that the vocabulary lacks decode to nothing; repeated rows and null ids give a row each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, text_or_empty, texts
from .bpe import latin_pattern

#: The pattern of the library's byte-level pre-tokenizer, and the longest string it looks ahead for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AHEAD = 3
#: Pre-tokens that a worker remembers in each of two generations (some 100 MB), and the longest of them.
CACHE, CACHE_CHARS = 500_000, 64
#: Code points that go through the buffer at once, and those after which an open pre-token is passed on.
CHUNK, LONG = 1 << 16, 1 << 10
#: Above all ranks.
NEVER = 1 << 30
#: A code point of Latin-1 for each class beyond it: letters, numbers, blanks, others.
CLASSES = "ª¹ ¡"


def byte_symbols() -> dict[str, int]:
    """The code point that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a piece after which nothing changes it any more."""
    rank: dict[bytes, int] = {}
    for r, (a, b) in enumerate(merges):
        if any(len(x) > 1 and x not in rank for x in (a, b)):
            raise ValueError(f"merge {r} takes a piece that no earlier one makes")
        if a + b in rank:
            raise ValueError(f"merge {r} makes a piece that merge {rank[a + b]} makes")
        rank[a + b] = r
    moves: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))  # by left piece: ranks, ways that grow
    longest = 0
    for r, (a, b) in enumerate(merges):
        way, edge, until = 0, b, r - 1
        while True:
            ranks, ways = moves[edge] if edge in moves else ([], [])
            i = np.searchsorted(ranks, until, "right") - 1
            if i >= 0:
                way = max(way, ways[i])
            if len(edge) == 1:
                break
            until = rank[edge]
            edge = merges[until][0]
        way += len(a)
        if not moves[a][1] or way > moves[a][1][-1]:
            moves[a][0].append(r)
            moves[a][1].append(way)
        longest = max(longest, way)
    return longest


class Vocabulary:
    """Merges, ids and added tokens of a tokenizer file of the library's."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model, steps = spec["model"], [spec[k] for k in ("normalizer", "post_processor")]
        pre, back = spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or any(steps):
            raise ValueError("not a byte-level BPE without further steps")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or back.get("type") != "ByteLevel":
            raise ValueError("not the byte-level pre-tokenizer and decoder")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with rules of their own")
        of = byte_symbols()
        as_bytes = lambda s: bytes(of[c] for c in s)
        ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        self.first = [ids[bytes([b])] for b in range(256)]
        self.ranks = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.size = {i: len(b) for b, i in ids.items()}
        self.window = 2 * (self.lookahead + max(self.size.values()))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of bytes that stand alone, a window at most: pieces are merged by rank, the leftmost first."""
        find, made = self.ranks.get, self.made
        ids = [*map(self.first.__getitem__, piece)]
        ranks = [*map(find, zip(ids, ids[1:]), repeat(NEVER))]
        while ranks and (low := min(ranks)) < NEVER:
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), NEVER)
        return ids


class Transducer:
    """Bytes of one pre-token in, settled ids out."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.own, self.held = vocabulary, b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.own.window):
            self.held += data[at : at + self.own.window]
            if len(self.held) >= self.own.window:
                ids, settled = self.own.merge(self.held), len(self.held) - self.own.lookahead
                end = count = 0
                while end + self.own.size[ids[count]] <= settled:
                    end += self.own.size[ids[count]]
                    count += 1
                out += ids[:count]
                self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, b""
        return self.own.merge(held)


class _Classes(dict):
    """For str.translate: code points beyond Latin-1 to that of Latin-1 which stands for their class."""

    def __init__(self) -> None:
        from tokenizers import pre_tokenizers

        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str

    def __missing__(self, c: int) -> int:
        if c < 256:
            out = c
        elif 0xD800 <= c < 0xE000:
            out = ord(CLASSES[3])
        else:  # one pre-token with what is of its class
            out = next(ord(k) for k, like in zip(CLASSES, ("a", "1", "\n\n", "!"), strict=True) if k == CLASSES[3] or len(self.cut(like + chr(c) if k != CLASSES[2] else chr(c) + "\n")) == 1)
        self[c] = out
        return out


class Codec:
    """What a worker keeps: vocabulary, pattern, the classes of code points met, and the ids of short pre-tokens met."""

    def __init__(self, data: bytes, cache: int = CACHE) -> None:
        self.vocabulary, self.cache = Vocabulary(data), cache
        self.pattern = latin_pattern(PATTERN)
        letters, numbers, blanks, others = (latin_pattern(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"))
        self.runs = [letters, numbers, blanks, others]
        self.classes = _Classes()
        self.added = re.compile("|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True)))) if self.vocabulary.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def alone(self, data: bytes) -> list[int]:
        if len(data) < self.vocabulary.window:
            return self.vocabulary.merge(data)
        way = Transducer(self.vocabulary)
        return way.push(data) + way.end()

    def in_latin(self, text: str) -> str:
        try:
            text.encode("latin-1")
            return text
        except UnicodeEncodeError:
            return text.translate(self.classes)

    def ids(self, token: str) -> bytes:
        """The packed ids of a whole pre-token."""
        found = self.young.get(token) or self.old.get(token)
        if found is None:
            found = _pack(self.alone(token.encode()))
        if len(token) <= CACHE_CHARS:
            if len(self.young) >= self.cache:
                self.young, self.old = {}, self.young
            self.young[token] = found
        return found

    def tokens(self, tokens: list[str]) -> bytes:
        found = [*map(self.young.get, tokens)]
        try:
            return b"".join(found)
        except TypeError:  # some are not remembered
            return b"".join([x or self.ids(t) for x, t in zip(found, tokens, strict=True)])


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """One text in pieces in, packed ids out."""

    def __init__(self, own: Codec) -> None:
        self.own, self.rest, self.kind = own, "", -1
        self.way = Transducer(own.vocabulary)

    def feed(self, piece: str, last: bool = False) -> bytes:
        text, out, at = self.rest + piece, [], 0
        for m in self.own.added.finditer(text) if self.own.added else ():
            if not last and m.end() == len(text) and any(x != m[0] and x.startswith(m[0]) for x in self.own.vocabulary.added):
                break  # a longer one may come
            out.append(self._plain(text[at : m.start()], True)[0])
            out.append(_pack([self.own.vocabulary.added[m[0]]]))
            at = m.end()
        stop = len(text)
        if not last:  # an added token may have begun
            for x in self.own.vocabulary.added:
                begun = next((k for k in range(min(len(x), len(text) - at), 0, -1) if text.endswith(x[:k])), 0)
                stop = min(stop, len(text) - begun)
        ids, used = self._plain(text[at:stop] if at or stop < len(text) else text, last)
        self.rest = text[at + used :]
        return b"".join([*out, ids])

    def _plain(self, text: str, last: bool) -> tuple[bytes, int]:
        """The settled ids of a text without added tokens, and how many of its code points they and the transducer have."""
        out, at, seen = [], 0, self.own.in_latin(text)
        if self.kind >= 0:
            end = self.own.runs[self.kind].match(seen).end()
            blanks = self.kind == 2
            if end == len(text) and not last:
                at = max(0, end - blanks)  # the last blank may belong to what follows
                return _pack(self.way.push(text[:at].encode())), at
            at = max(0, end - (blanks and end < len(text)))
            out.append(_pack(self.way.push(text[:at].encode()) + self.way.end()))
            self.kind = -1
        if last and seen is text:
            return b"".join([*out, self.own.tokens(self.own.pattern.findall(text, at))]), len(text)
        spans = [m.span() for m in self.own.pattern.finditer(seen, at)]
        n = len(spans)
        while not last and n and spans[n - 1][1] > len(text) - AHEAD:
            n -= 1
        out.append(self.own.tokens([text[a:b] for a, b in spans[:n]]))
        if n == len(spans):
            return b"".join(out), len(text) if last else spans[-1][1] if spans else at
        at, end = spans[n]
        if end == len(text) and end - at >= LONG:
            self.kind = next(k for k, run in enumerate(self.own.runs) if run.match(seen, end - 1).end() == end)
            end -= self.kind == 2
            out.append(_pack(self.way.push(text[at:end].encode())))
            at = end
        return b"".join(out), at


class Decoder:
    """Packed ids in pieces in, text out."""

    def __init__(self, own: Codec) -> None:
        self.bytes, self.machine = own.vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        get = self.bytes.__getitem__
        numbers = np.frombuffer(ids, "<i4").tolist()
        try:
            data = b"".join(map(get, numbers))
        except KeyError:
            data = b"".join(self.bytes.get(i, b"") for i in numbers)
        return self.machine.decode(data, last)


def encode_text(own: Codec, text: str, chunk: int = CHUNK) -> bytes:
    """The packed ids (little-endian 32-bit integers) of a text."""
    way = Encoder(own)
    return b"".join(way.feed(text[at : at + chunk], at + chunk >= len(text)) for at in range(0, len(text), chunk))


def decode_ids(own: Codec, ids: bytes, chunk: int = CHUNK) -> str:
    way = Decoder(own)
    return "".join(way.feed(ids[at : at + 4 * chunk], at + 4 * chunk >= len(ids)) for at in range(0, len(ids), 4 * chunk))


@functools.lru_cache(maxsize=1)
def codec(data: bytes) -> Codec:
    """The worker's codec for a tokenizer file's content."""
    return Codec(data)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _arrow(rows: DataFrame, path: str, schema: str, make: Callable[[Codec, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    with open(path, "rb") as f:  # a tokenizer file: below 5 MB, read once by the driver
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(own, batch)], names)

    return rows.mapInArrow(run, schema)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def _encoded(own: Codec, batch: pa.RecordBatch) -> list[bytes]:
    return [encode_text(own, x.decode("utf-8", "replace")) for x in texts(batch, "text")]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""
    return _arrow(_rows(docs, text), path, "doc_id long, ids array<int>", lambda own, batch: [_lists(_encoded(own, batch))])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (text) of rows (doc_id, ids)."""

    def make(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(1), pa.array([decode_ids(own, np.array(x.as_py() or [], "<i4").tobytes()) for x in batch.column(1)], pa.string())]

    return _arrow(encoded.select("doc_id", "ids"), path, "doc_id long, ids array<int>, decoded string", make)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids, decoded; both steps in one Python worker, which then holds the vocabulary once."""

    def make(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = _encoded(own, batch)
        return [_lists(ids), pa.array([decode_ids(own, x) for x in ids], pa.string())]

    return _arrow(_rows(docs, text), path, "doc_id long, ids array<int>, decoded string", make)


def default() -> str:
    """The tokenizer file of the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(read(prepare(spark), sf_dir, "documents"), default())
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
