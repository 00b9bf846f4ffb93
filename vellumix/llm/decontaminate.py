"""Benchmark decontamination: pigeonhole edit matching.

Method. An item of m characters may differ from a passage by up to k = min(m * rate, m / min_piece - 1) edits, rounded
down. The item is cut into k + 1 pieces; whatever k edits do, one piece stays whole, so exact hits of pieces find every
passage within the budget. Hits are found by a pass of whole batches of text: every eight bytes are looked up in a
bitmap of the pieces' first eight bytes, then compared with the pieces. Each hit's surroundings are verified with Myers'
bit-parallel edit distance (the item against any substring), first for the half of the item's piece tree that holds
the hit, smallest part first: of j pieces within j - 1 edits, one half is always within its own pieces less one, so a
hit whose part fails can be dropped. Texts and items are lower-cased and their blanks collapsed first; positions refer
to that form.

Items are taken from the driver in blocks of ``block`` items and ``block_chars`` characters, one pass over the
documents each, so what is broadcast is bounded however long the benchmark is.

Defined cases: null and empty texts match nothing, null and blank items match nothing; an item shorter than
2 * min_piece must occur exactly; items repeated under several ids are each reported, an id repeated with one text
once; repeated documents give repeated rows; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checked_broadcast, prepare, read, slices, text_or_empty

RATE = 0.1
MIN_PIECE = 8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000
#: Bytes of text that are searched at once.
CHUNK = 1 << 19
#: Bits of the bitmap of first bytes.
BITS = 22
STEP = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE, min_piece: int = MIN_PIECE) -> int:
    """Edits that an item of m characters may have."""
    return max(0, min(int(m * rate), m // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets; together they are the item."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best substring of text within most edits of the pattern, by bit vectors of m bits."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: the row above is all zeros
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def chain(parts: list[tuple[int, str]], i: int) -> list[tuple[int, int]]:
    """The nested ranges of pieces that hold piece i when the item is halved again and again, smallest first."""
    lo, hi, out = 0, len(parts), []
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if i < mid else (mid, hi)
    return out[::-1]


class Matcher:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_piece: int = MIN_PIECE) -> None:
        self.items = [(i, t, budget(len(t), rate, min_piece)) for i, t in items if t]
        self.short: list[int] = []
        self.by_first: dict[int, list[tuple[bytes, int, int, int]]] = {}
        self.parts: list[list[tuple[int, str]]] = []
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        for n, (_, text, k) in enumerate(self.items):
            self.parts.append(parts := pieces(text, k))
            for i, (at, piece) in enumerate(parts):
                raw = piece.encode()
                if len(raw) < 8:  # then it is a short item, whole
                    self.short.append(n)
                else:
                    self.by_first.setdefault(int.from_bytes(raw[:8], "little"), []).append((raw, n, i, len(text[:at].encode())))
        self.firsts = np.array(sorted(self.by_first), np.uint64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.firsts * STEP) >> np.uint64(64 - BITS)] = True

    def hits(self, raw: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(position, item number, piece number, start of the item if nothing moved) of each exact hit of a piece."""
        for n in self.short:
            word = self.items[n][1].encode()
            at = raw.find(word)
            while at >= 0:
                yield at, n, 0, at
                at = raw.find(word, at + 1)
        if not len(self.firsts) or len(raw) < 8:
            return
        x = np.frombuffer(raw, np.uint8).astype(np.uint64)
        for half in (1, 2, 4):  # eight bytes in three doublings
            x = x[:-half] | x[half:] << np.uint64(8 * half)
        at = np.flatnonzero(self.bitmap[(x * STEP) >> np.uint64(64 - BITS)])
        x = x[at]
        found = np.searchsorted(self.firsts, x)
        good = self.firsts[np.minimum(found, len(self.firsts) - 1)] == x
        for p, first in zip(at[good].tolist(), x[good].tolist(), strict=True):
            for piece, n, i, offset in self.by_first[first]:
                if raw.startswith(piece, p):
                    yield p, n, i, p - offset

    def _within(self, n: int, lo: int, hi: int, raw: bytes, at: int, start: int, end: int) -> tuple[int, int] | None:
        """Pieces lo to hi of item n against raw, from where they would lie if piece bytes at were their own; see chain."""
        parts, item = self.parts[n], self.items[n][1]
        a = parts[lo][0]
        b = parts[hi][0] if hi < len(parts) else len(item)
        most = hi - lo - 1
        before, size = len(item[:a].encode()), len(item[a:b].encode())
        left, right = max(start, at + before - 4 * most), min(end, at + before + size + 4 * most)
        while left > start and raw[left] & 0xC0 == 0x80:
            left -= 1
        if (n, lo, hi) not in self.masks:
            self.masks[n, lo, hi] = masks(item[a:b])
        window = raw[left:right].decode("utf-8", "ignore")
        got = myers(self.masks[n, lo, hi], b - a, window, most)
        return got and (got[0], len(raw[start:left].decode("utf-8", "ignore")) + got[1] if (lo, hi) == (0, len(parts)) else 0)

    def search(self, rows: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalized text (item number, distance, budget, end of the passage) of each item that occurs, its best passage."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in rows]
        raw = b"\n".join(rows)
        ends = np.cumsum([len(r) + 1 for r in rows]) - 1
        starts = (ends - [len(r) for r in rows]).tolist()
        ends = ends.tolist()
        row = 0
        seen: set[tuple[int, int]] = set()
        for p, n, i, start in sorted(self.hits(raw)):
            while ends[row] <= p:
                row += 1
                seen.clear()
            best = out[row].get(n)
            if best and not best[0] or (n, start) in seen:
                continue
            size = len(self.parts[n])
            if size == 1:
                got = (0, len(raw[starts[row] : p].decode()) + len(self.items[n][1]))
            else:
                got = None
                for lo, hi in chain(self.parts[n], i):
                    got = self._within(n, lo, hi, raw, start, starts[row], ends[row])
                    if not got:
                        break
                if got:
                    seen.add((n, start))
            if got and (best is None or got[0] < best[0]):
                out[row][n] = got
        return [[(n, d, self.items[n][2], end) for n, (d, end) in found.items()] for found in out]


def _blocks(benchmark: DataFrame, items: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    total = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        text = normalize(row.text)
        if block and (len(block) >= items or total + len(text) > chars):
            yield block
            block, total = [], 0
        block.append((row.item_id, text))
        total += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_piece: int = MIN_PIECE, block: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, n_chars (of the item), end_char: one row per document and item found in it."""
    spark = prepare(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, budget int, n_chars int, end_char int"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out: DataFrame | None = None
    for items in _blocks(benchmark, block, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_piece)
            for batch in batches:
                rows = []
                ids, norms = batch.column(0).to_pylist(), [normalize(x).encode() for x in batch.column(1).to_pylist()]
                for a, b in slices([len(x) for x in norms], CHUNK):
                    for doc, found in zip(ids[a:b], matcher.search(norms[a:b]), strict=True):
                        rows += [(doc, matcher.items[n][0], distance, k, len(matcher.items[n][1]), end) for n, distance, k, end in found]
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                    names = ["doc_id", "item_id", "distance", "budget", "n_chars", "end_char"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of docs in which no item occurs; columns as they were. A null doc_id stays."""
    drop = find_leaks(docs, benchmark, **options).where("doc_id is not null").select("doc_id").distinct().checkpoint()
    return docs.join(checked_broadcast(drop), "doc_id", "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items."""
    prepare(spark)
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
