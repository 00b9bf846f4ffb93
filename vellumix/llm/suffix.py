"""Suffix-array dedup: repeated byte strings across a corpus, by linear grouping construction.

Method, in five steps.

1. Every string of ``WIDTH`` bytes has an anchor, the k-mer in it that hashes lowest (see ``_anchors``); equal strings have
   equal anchors. The strings of one anchor cover its context, about 130 bytes. Tasks drop contexts that they have met
   before (their strings all start earlier elsewhere) before anything is shuffled.
2. Anchors are dealt out by k-mer, those of hot k-mers (see ``HOT``) by k-mer and context. Of equal contexts (told by
   BLAKE2b digests of 128 bits) all but the first are covered whole. The first ones of k-mers with several contexts may
   still share single strings; these, the suffix arrays find, which compare bytes.
3. Those contexts' bytes are fetched from the documents and dealt out by k-mer again; what agrees with no other context
   of its k-mer around it drops out; each task builds suffix arrays of the rest by linear grouping: suffixes start in groups by their first symbol; groups are processed in descending
   order; each member finds its previous smaller suffix by following the pointers of processed ones; the suffixes pointed
   at leave their group for one right above it, higher the more members point at them. The groups are then those of
   equal Lyndon prefixes in order, and one pass emits the suffix array group by group, following the same pointers,
   without recursion or renaming.
4. Neighbours in the suffix array that share WIDTH bytes are one string; all but the earliest start are covered. The
   contexts of a hot k-mer are first dealt out by more of the bytes around it (see ``_split``), until each
   part is small enough for a suffix array, or all its strings are one.
5. The covered ranges of each document are merged, and the other bytes are kept.

Defined cases: a null text is empty; a text shorter than WIDTH keeps all; rows with a null doc_id are documents of their
own, behind all others; rows that share a doc_id are documents of their own too, in the order of their texts (so of
equal ones all but one go), unlike in an order by doc_id alone; an empty table gives no rows; further columns are
ignored. Texts of any length are anchored in pieces of ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import WIDTH, K, anchors, context_hashes_of, kmer_hashes, mix
from ._common import checked_broadcast, prepare, read, release, slices, stored, text_or_empty, texts

#: A k-mer of which tasks meet OFTEN contexts or more in HELD bytes of text, and HOT of those in all, is dealt out by more
#: bytes: others have less than an OFTEN in HELD of all rows. HOT also bounds the parts of such a k-mer.
HOT, OFTEN = 4096, 8
#: Bytes of text hashed at once, bytes whose contexts a task holds to tell repeated ones, and symbols of one suffix array.
CHUNK, HELD, SYMBOLS = 1 << 21, 32 << 20, 300_000


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups of the suffixes with equal Lyndon prefixes: group of each suffix, its previous smaller suffix, groups in
    descending order, and each group's size. The last symbol must be the only lowest one."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, ch in enumerate(text):
        first.setdefault(ch, []).append(i)
    members: list[list[int]] = [first[ch] for ch in sorted(first, reverse=True)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = [*range(1, len(members)), -1]
    above = [-1, *range(len(members) - 1)]
    done = [False] * len(members)
    prev = [-1] * n
    order: list[int] = []
    sizes = [0] * len(members)
    now = 0
    while now >= 0:
        own = members[now]
        if len(own) > 1:
            own = [i for i in own if group[i] == now]
        elif own and group[own[0]] != now:
            own = []
        members[now] = []
        done[now] = True
        if own:
            order.append(now)
            sizes[now] = len(own)
            moved: dict[tuple[int, int], list[int]] = {}
            last, count = -1, 0
            for i in own:  # ascending, and so are the pointers
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = prev[p]
                prev[i] = p
                if p == last:
                    count += 1
                    continue
                if last >= 0:
                    moved.setdefault((group[last], count), []).append(last)
                last, count = p, 1
            if last >= 0:
                moved.setdefault((group[last], count), []).append(last)
            for (old, _), suffixes in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
                new = len(members)
                up = above[old]
                members.append(suffixes)
                done.append(False)
                sizes.append(0)
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for i in suffixes:
                    group[i] = new
        now = below[now]
    return group, prev, order, sizes


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of symbols of which the last is the only lowest one."""
    group, prev, order, sizes = lyndon_groups(text)
    place = [0] * len(sizes)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += sizes[g]
    n = len(text)
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    place[group[n - 1]] += 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[place[g]] = i
            place[g] += 1
            placed[i] = 1
            i = prev[i]
    return out


def repeated_starts(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which starts hold a string of width bytes that also starts earlier in another context: a flag for every byte
    position at which a string begins, contexts one after the other."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = b"\0".join(contexts) + b"\0" * width
    x = np.frombuffer(raw, np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = x[: begins[-1] + sizes[-1] + 1].astype(np.int32) + 2
    symbols[begins[1:] - 1] = 1
    symbols[-1] = 0
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    strings = sizes - width + 1
    which = np.repeat(np.arange(len(contexts)), strings)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
    slot = np.full(len(symbols), -1, np.int64)
    slot[begins[which] + offset] = np.arange(len(which))
    order = order[slot[order] >= 0]
    same = np.zeros(len(order), bool)
    rows = np.lib.stride_tricks.sliding_window_view(x, width)
    for a in range(1, len(order), 1 << 15):
        b = min(a + (1 << 15), len(order))
        same[a:b] = (rows[order[a:b]] == rows[order[a - 1 : b - 1]]).all(axis=1)
    slots = slot[order]
    own = np.empty(len(which), np.int64)
    own[slots] = np.cumsum(~same)
    ranked = np.lexsort((start[which] + offset, doc[which], own))
    first = np.concatenate([[True], np.diff(own[ranked]) != 0])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc[which][ranked] != doc[which][ranked][lead]) | ((start[which] + offset)[ranked] != (start[which] + offset)[ranked][lead])
    flags = np.zeros(len(which), bool)
    flags[ranked] = later
    return flags


#: Ranges of bytes right of the k-mer by which contexts are sifted.
SIFTS = 8


def may_share(key: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of the part of each context that can share a string with another one of its k-mer, both 0 if
    none can: a string with lo to hi bytes right of the k-mer has lo of them, and the rest of WIDTH - K but hi left of it, in
    common with its equals, for one of SIFTS ranges."""
    x = np.frombuffer(b"".join(contexts), np.uint8)
    end = np.cumsum([len(c) for c in contexts])
    begin = end - np.array([len(c) for c in contexts])
    h = kmer_hashes(x)
    which = np.repeat(np.arange(len(contexts)), end - begin)[: len(h)]
    found = np.flatnonzero(h == key.view(np.uint64)[which])
    found = found[found + K <= end[which[found]]]
    own, first = np.unique(which[found], return_index=True)
    at = np.zeros(len(contexts), np.int64)
    at[own] = found[first]
    first_byte, last_byte = end.copy(), begin.copy()
    steps = np.linspace(0, WIDTH - K + 1, SIFTS + 1).astype(int)
    ranges = list(zip(steps[:-1].tolist(), (steps[1:] - 1).tolist(), strict=True))
    sides = [(at - (WIDTH - K - hi), at + K + lo) for lo, hi in ranges]
    for k, side in enumerate(context_hashes_of(x, sides)):
        inside = np.flatnonzero((sides[k][0] >= begin) & (sides[k][1] <= end))
        both = mix(side[inside] ^ mix(key[inside].view(np.uint64)))
        _, back, n = np.unique(both, return_inverse=True, return_counts=True)
        some = inside[n[back] > 1]
        lo, hi = ranges[k]
        first_byte[some] = np.minimum(first_byte[some], np.maximum(begin[some], at[some] - (WIDTH - K - lo)))
        last_byte[some] = np.maximum(last_byte[some], np.minimum(end[some], at[some] + K + hi))
    none = last_byte - first_byte < WIDTH
    return np.where(none, 0, first_byte - begin), np.where(none, 0, last_byte - begin)


def _runs(flags: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) of runs of flagged starts that follow each other."""
    i = np.flatnonzero(flags)
    if not len(i):
        return doc[:0], at[:0], at[:0]
    cut = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(at[i]) != 1) | (np.diff(doc[i]) != 0)])
    end = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(i) - 1]])
    return doc[i[cut]], at[i[cut]], at[i[end]]


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c if c.dtype != np.uint64 else c.view(np.int64)) for c in columns], names.split())


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """key, c, c2, doc, a, b, often. A context: k-mer, digest (two numbers), document, first and last start, and whether the
    task met its k-mer OFTEN. Covered starts: b < 0, c the last."""

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, doc, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((lo, doc, c[:, 1], c[:, 0], h))
        same = np.zeros(len(h), bool)
        same[order[1:]] = (np.diff(h[order]) == 0) & (np.diff(c[order], axis=0) == 0).all(axis=1)
        lead = np.maximum.accumulate(np.where(~same[order], np.arange(len(h)), 0))
        head = np.empty(len(h), np.int64)
        head[order] = order[lead]
        later = same & ((doc != doc[head]) | (lo != lo[head]))
        # runs of covered contexts that follow each other are one row
        i = np.flatnonzero(later)
        cut = np.concatenate([[True], (np.diff(i) != 1) | (doc[i[1:]] != doc[i[:-1]]) | (lo[i[1:]] != hi[i[:-1]] + 1)]) if len(i) else np.zeros(0, bool)
        end = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(i) - 1]]) if len(i) else i
        s, e = i[cut], i[end]
        own = np.flatnonzero(~same)
        _, back, n = np.unique(h[own], return_inverse=True, return_counts=True)
        often = np.concatenate([n[back] >= OFTEN, np.zeros(len(s), bool)])
        key = np.concatenate([h[own], h[s] ^ lo[s].astype(np.uint64)]).view(np.int64)
        c = c.view(np.int64)
        return _batch("key c c2 doc a b often", key, np.concatenate([c[own, 0], hi[e]]), np.concatenate([c[own, 1], np.zeros(len(e), np.int64)]), np.concatenate([doc[own], doc[s]]), np.concatenate([lo[own], lo[s]]), np.concatenate([hi[own], np.full(len(s), -1, np.int64)]), often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            rows, ids = texts(batch, "text"), batch.column(0).to_numpy()
            cuts = [(i, at) for i, r in enumerate(rows) for at in range(0, max(len(r), 1), CHUNK)]
            pieces = [rows[i][at : at + CHUNK + WIDTH - 1] for i, at in cuts]  # each with the strings that start in it
            of, begin = np.array(cuts, np.int64).reshape(-1, 2).T
            for a, b in slices([len(x) for x in pieces], CHUNK):
                row, lo, hi, h, c = anchors(pieces[a:b])
                if len(row):
                    held.append((h, c, ids[of[a:b][row]], begin[a:b][row] + lo, begin[a:b][row] + hi))
                size += sum(map(len, pieces[a:b]))
                if size >= HELD and held:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return docs.mapInArrow(run, "key long, c long, c2 long, doc long, a long, b long, often boolean")


def _sort_out(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """kind, key, doc, a, b: 0, covered starts; 1, contexts that may share strings; 2, those of hot k-mers (key, blocks)."""

    def settle(cols: list[np.ndarray], lead: tuple[int, ...]) -> tuple[pa.RecordBatch, tuple[int, ...]]:
        """lead: key, digest, document and start of the first context like the last row so far."""
        key, c, c2, doc, a, b, blocks = cols
        done = b < 0
        new_key = np.concatenate([[True], np.diff(key) != 0])
        new = new_key | np.concatenate([[True], (np.diff(c) != 0) | (np.diff(c2) != 0)])
        new &= ~done
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        first_doc, first_a = doc[head], a[head]
        if lead and (key[0], c[0], c2[0]) == lead[:3] and not done[0]:
            new[0] = False
            like = (head == 0) & (key == lead[0]) & (c == lead[1]) & (c2 == lead[2])
            first_doc, first_a = np.where(like, lead[3], first_doc), np.where(like, lead[4], first_a)
        later = ~done & ~new & ((doc != first_doc) | (a != first_a))
        run = np.cumsum(new_key) - 1
        n = np.bincount(run, weights=new)[run]
        kind = np.where(done | later, 0, np.where(blocks > 0, 2, 1))
        keep = done | later | (new & ((n > 1) | (blocks > 0)))
        out = _batch("kind key doc a b", *(x[keep] for x in (kind.astype(np.int32), key, doc, a, np.where(done, c, b))))
        return out, () if done[-1] else (key[-1], c[-1], c2[-1], first_doc[-1], first_a[-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        lead: tuple[int, ...] = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([x.to_numpy() for x in batch.columns])
            count += batch.num_rows
            if count < 50_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) or count  # one k-mer alone is a hot one, of which any part will do
            out, lead = settle([x[:cut] for x in cols], lead)
            yield out
            held, count = [[x[cut:] for x in cols]], count - cut
        if count:
            yield settle([np.concatenate(x) for x in zip(*held, strict=True)], lead)[0]

    blocks = F.coalesce("blocks", F.lit(0))
    dealt = rows.join(checked_broadcast(hot), "key", "left").select("key", "c", "c2", "doc", "a", "b", blocks.alias("blocks"))
    return dealt.repartition("key", F.when(F.col("blocks") > 0, F.pmod("c", "blocks")).otherwise(0)).sortWithinPartitions("key", "c", "c2", "doc", "a").mapInArrow(work, "kind int, key long, doc long, a long, b long")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """kind, key, doc, a, ctx: the bytes of the wanted contexts."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "a", "b")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch, "text")
            w = batch.column(2)
            counts = np.diff(w.offsets.to_numpy())
            flat = w.flatten()
            kind, key, a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(len(rows)), counts)
            doc = batch.column(0).to_numpy()[row]
            ctx = [rows[r][s : e + WIDTH] for r, s, e in zip(row.tolist(), a.tolist(), b.tolist(), strict=True)]
            good = np.flatnonzero([len(x) >= WIDTH for x in ctx])
            for i in range(0, len(good), 20_000):
                g = good[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(kind[g]), pa.array(key[g]), pa.array(doc[g]), pa.array(a[g]), pa.array([ctx[j] for j in g], pa.binary())], ["kind", "key", "doc", "a", "ctx"])

    return docs.join(lists, "doc").select("doc", "text", "w").mapInArrow(run, "kind int, key long, doc long, a long, ctx binary")


def _by_suffix_arrays(contexts: DataFrame, by: list[str]) -> DataFrame:
    """doc, a, b: covered starts found by suffix arrays over whole groups of contexts (key, doc, a, ctx) alike in ``by``."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        if by == ["key"]:
            parts = may_share(np.array([x[3] for x in held], np.int64), [x[2] for x in held])
            held = [(x[0], x[1] + a, x[2][a:b]) for x, a, b in zip(held, *(p.tolist() for p in parts), strict=True) if b]
        if not held:
            return _batch("doc a b", *[np.zeros(0, np.int64)] * 3)
        doc, start = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        ctx = [x[2] for x in held]
        flags = repeated_starts(ctx, doc, start)
        strings = np.array([len(c) - WIDTH + 1 for c in ctx])
        which = np.repeat(np.arange(len(ctx)), strings)
        at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
        return _batch("doc a b", *_runs(flags, doc[which], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SYMBOLS and row[3:] != held[-1][3:]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
        if held:
            yield settle(held)

    return contexts.select("doc", "a", "ctx", *by).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "doc long, a long, b long")


def _sides(contexts: DataFrame) -> DataFrame:
    """lo, hi, g, doc, a, ctx, at: contexts (key, doc, a, ctx) dealt out as ``_split`` says, at being the k-mer's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = texts(batch, "ctx"), batch.column(0).to_numpy().view(np.uint64)
            at = [int(np.argmax(kmer_hashes(np.frombuffer(r, np.uint8)) == k)) for r, k in zip(rows, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary()), pa.array(at, pa.int32())], ["doc", "a", "ctx", "at"])

    rows = contexts.select("key", "doc", "a", "ctx").mapInArrow(run, "doc long, a long, ctx binary, at int")
    return _dealt(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(WIDTH - K)))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row under both halves of its range lo to hi, with the bytes that all strings of the half have."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi"))
    left, right = F.col("at"), F.length("ctx") - F.col("at") - K  # bytes on either side of the k-mer
    out = rows.select("doc", "a", "ctx", "at", F.inline(halves).alias("lo", "hi"))
    least, most = F.greatest(F.col("lo"), WIDTH - K - left), F.least(F.col("hi"), right)
    out = out.where(least <= most)
    first = F.col("at") - (WIDTH - K - F.col("lo"))  # where the leftmost string of the half starts
    begin = F.greatest(F.lit(0), first)
    end = F.least(F.length("ctx"), F.col("at") + K + F.col("hi"))
    g = F.expr(f"substring(ctx, at - ({WIDTH - K} - hi) + 1, {WIDTH} - (hi - lo))")
    return out.select("lo", "hi", g.alias("g"), "doc", (F.col("a") + begin).alias("a"), F.substring(F.col("ctx"), begin + 1, end - begin).alias("ctx"), (F.col("at") - begin).alias("at"))


def _split(contexts: DataFrame, hot: int) -> DataFrame:
    """doc, a, b: covered starts among the contexts of hot k-mers.

    A string has from 0 to WIDTH - K bytes right of the k-mer and the rest left of it. Contexts are dealt out by halves of
    that range: strings with lo to hi bytes on the right all have lo bytes there and WIDTH - K - hi on the left in common
    with their equals, and are dealt out by them. Parts of one context drop out, those of up to ``hot`` go to suffix
    arrays, larger ones are halved again; where lo is hi, a part is one string, of which all but the first are covered.
    """
    found = []
    rows = _sides(contexts)
    while rows is not None:
        rows = stored(rows, "suffix-parts")
        sizes = rows.groupBy("lo", "hi", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc", "a")).alias("first")).where("n > 1").checkpoint()
        small, large = sizes.where(F.col("n") <= hot), sizes.where(F.col("n") > hot)
        found.append(_by_suffix_arrays(rows.join(small.select("lo", "hi", "g"), ["lo", "hi", "g"], "left_semi"), ["lo", "g"]))
        if large.isEmpty():
            break
        parts = rows.join(checked_broadcast(large.select("lo", "hi", "g", "first")), ["lo", "hi", "g"])  # at most a hot-th of the rows
        found.append(parts.where("lo = hi and struct(doc, a) <> first").select("doc", "a", F.col("a").alias("b")))
        wide = parts.where("lo < hi")
        rows = None if large.where("lo < hi").isEmpty() else _dealt(wide)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def covered(docs: DataFrame) -> DataFrame:
    """doc, a, b: ranges of starts whose strings also start earlier, for docs of (doc, text), doc being unique."""
    rows = stored(_anchor_rows(docs), "suffix-kmers")
    hot = rows.where("often").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")).checkpoint()
    found = stored(_sort_out(rows, hot), "suffix-anchors")
    release(rows)
    contexts = stored(_contexts(docs, found.where("kind > 0")), "suffix-contexts")
    out = found.where("kind = 0").select("doc", "a", "b").union(_by_suffix_arrays(contexts.where("kind = 1"), ["key"]))
    return out if hot.isEmpty() else out.union(_split(contexts.where("kind = 2"), HOT))


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, doc, text: doc is doc_id where that tells the rows apart, else the rows' number in its order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    n, distinct = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == distinct:
        return rows.withColumn("doc", F.col("doc_id"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("doc", F.monotonically_increasing_id()), "suffix-rows")


def spans_to_remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text, spans: array of (start, end) of the removed bytes, merged and in order; one row per row of docs."""
    prepare(docs.sparkSession)
    rows = _keyed(docs, text)
    ranges = covered(rows.select("doc", "text")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("r"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, ranges in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for r in ranges or ():
                    end = min(r["b"] + WIDTH, size)
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    elif r["a"] < end:
                        spans.append([r["a"], end])
                out.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "text", "spans"])

    joined = rows.join(ranges, "doc", "left").select("doc_id", "text", "r", F.octet_length("text").cast("long").alias("size"))
    return joined.mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,end:long>>")


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of rows of spans_to_remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch, "text")
            out = []
            for raw, spans in zip(rows, batch.column(2).to_pylist(), strict=True):
                cuts = [0, *(p for s in spans for p in (s["start"], s["end"])), len(raw)]
                out.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            removed = [len(r) - len(o) for r, o in zip(rows, out, strict=True)]
            spans = [len(s) for s in batch.column(2)]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(r) for r in rows], removed, spans)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spans_to_remove(read(prepare(spark), sf_dir, "documents")))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
