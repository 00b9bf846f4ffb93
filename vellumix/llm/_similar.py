"""Groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of ``simhash``: SimHash fingerprints, a byte-position index, count filtering, verification. At a
similarity of 0.8 some 15 % of a fingerprint's bits differ, so 64 bits can't tell such pairs from others and no byte
position surely agrees; these fingerprints have ``BYTES`` bytes, of which such a pair shares some 17 and texts without
common shingles a quarter of one.

Texts with equal shingles are one node. Nodes are posted under pairs of positions and their bytes: all pairs of each
group of ``GROUP`` neighbouring positions. Within a posting list the shared positional bytes of each pair are tallied,
and pairs with at least ``LEAST`` of them are candidates. A pair at 0.8 is posted together with a probability of 0.996
and reaches the tally with 0.999; a test measures the recall. Candidates only make clusters: a spanning forest of each
list's is kept, and what it connects is a cluster. Within a cluster every pair that reaches the tally is verified by the
exact similarity of its texts, but for pairs that verified links connect already; so no link is lost to a stronger
candidate that fails, and the groups do not depend on blocks. Postings are made and paired in ``PASSES`` passes over the
positions, one after the other, so that the disk holds those of one pass. Lists of one group of near copies link its
nodes again and again, up to once a pair of positions. So of each flush of lists, and of each partition of a pass's links,
only a spanning forest goes on, in which a node has one link to the smallest node that it is connected with.

Lists with over ``BLOCK`` nodes are first compared with ``LEADERS`` of their nodes. The nodes that these link are one
part; the others are compared with all, in pairs of blocks. Clusters with over ``BLOCK`` nodes are verified in the same
way. A large group of near copies is settled by its leaders, one of its links each.

Defined cases: a null text is empty; texts of fewer words than five are one shingle, those without any are equal to each
other; rows repeated with one doc_id give one row each; a null doc_id never names a group unless all members are null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checked_broadcast, components, prepare, release, stored, sweep, text_or_empty, texts

WORDS, SIMILARITY = 5, 0.8
#: Positions of a fingerprint, positions that are paired with each other, and shared positions of a candidate pair.
BYTES, GROUP, LEAST = 64, 4, 7
#: Pairs of positions whose bytes nodes are posted under, and the passes in which that is done.
POSITIONS = [(g + a, g + b) for g in range(0, BYTES, GROUP) for a, b in combinations(range(GROUP), 2)]
PASSES = 4
#: Postings that are compared at once, about.
POSTS = 1 << 14
#: Nodes of a posting list or cluster that one task compares with each other, and leaders of a longer one.
BLOCK, LEADERS = 1024, 16
#: Links that a task holds before it makes a forest of them.
LINKS = 1 << 18
#: Long posting lists with their leaders (1 KB each) that may be broadcast.
LISTS = 20_000


def _odd(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, BYTES // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, OFFSETS = _odd(1), _odd(2)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order: of lower-cased (A-Z) words, or of all words if there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    rows = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in rows], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingle hashes in order: a bit is set if set in over half of them; if in just half, it is that
    of the first. Each hash is drawn out to BYTES bytes."""
    ones = np.zeros(BYTES * 8, np.int64)
    first = ones
    for a in range(0, len(hashes), 255):  # so that sums fit a byte
        x = (hashes[a : a + 255, None] ^ OFFSETS) * FACTORS
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        bits = np.unpackbits((x ^ x >> np.uint64(32)).view(np.uint8).reshape(len(x), -1), axis=1)
        first = first if a else bits[0]
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + first > len(hashes))


def nodes_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node (a hash of the text's shingles), sig (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig = [], []
            for text in texts(batch, "text"):
                h = shingles(text, words)
                node.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sig.append(signature(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "node", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, sig binary")


def forest(sig: np.ndarray, side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of the spanning forest by highest tally over pairs with at least least shared bytes (Prim's algorithm).
    side: 0 may pair with all; 1 and 2 only with each other."""
    n = len(sig)
    out: list[tuple[int, int]] = []
    best, of, free = np.zeros(n, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n):
        free[at] = False
        tally = (sig == sig[at]).sum(axis=1, dtype=np.int16)
        if side[at]:
            tally[side == side[at]] = 0
        better = free & (tally > best)
        best[better], of[better] = tally[better], at
        rest = np.flatnonzero(free)
        if not len(rest):
            break
        at = int(rest[np.argmax(best[rest])])
        if best[at] >= least:
            out.append((int(of[at]), at))
    return out


def _forests(dealt: DataFrame, by: list[str]) -> DataFrame:
    """u, v: the forests of lists of (by..., side, node, sig)."""

    def flush(rows: list[tuple]) -> tuple[list[int], list[int]]:
        if len(rows) < 2:
            return [], []
        node = [r[-2] for r in rows]
        found = forest(np.frombuffer(b"".join(r[-1] for r in rows), np.uint8).reshape(len(rows), -1), np.array([r[-3] for r in rows]), LEAST)
        return [node[a] for a, _ in found], [node[b] for _, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            u, v = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:-3] != held[-1][:-3]:
                    a, b = flush(held)
                    u += a
                    v += b
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        a, b = flush(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return dealt.select(*by, "side", "node", "sig").repartition(*by).sortWithinPartitions(*by, "side", "node").mapInArrow(run, "u long, v long").where("u <> v")


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v as a forest: each node but the smallest of its component is linked with that."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(node))
    while True:  # each node takes the smallest label that it is linked with
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(node)))
    return node[label[moved]], node[moved]


def spanning(links: DataFrame) -> DataFrame:
    """u, v: links that connect the same nodes, of each partition (all links of a v) a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros((2, 0), np.int64)
        for batch in batches:
            u, v = (np.concatenate([x, c.to_numpy()]) for x, c in zip((u, v), batch.columns, strict=True))
            if len(u) < LINKS:
                continue
            u, v = star_forest(u, v)
            if len(u) > LINKS // 2:  # so many nodes: what there is goes out, the rest are forests of their own
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = np.zeros((2, 0), np.int64)
        u, v = star_forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return links.select("u", "v").repartition("v").mapInArrow(run, "u long, v long")


def link_lists(run: np.ndarray, node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of equal run (in order) with at least LEAST shared bytes, as a forest over all runs."""
    left, right = [], []
    at = np.arange(len(run))
    for shift in range(1, len(run)):
        at = at[: np.searchsorted(at, len(run) - shift)]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            break
        for a in range(0, len(at), POSTS):
            own = at[a : a + POSTS]
            own = own[(sig[own] == sig[own + shift]).sum(axis=1, dtype=np.uint8) >= LEAST]
            left.append(own)
            right.append(own + shift)
    if not left:
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return star_forest(node[a], node[b])


def _short_lists(posts: DataFrame) -> DataFrame:
    """u, v: the links of whole lists of (key, node, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush(cut: int | None) -> pa.RecordBatch:
            key, node, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(key) if cut is None else int(np.searchsorted(key, key[-1]))  # the last list may go on
            held[:] = [(key[cut:], node[cut:], sig[cut:])]
            u, v = link_lists(key[:cut], node[:cut], sig[:cut])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BYTES)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sig))
            size += batch.num_rows
            if size >= POSTS:
                yield flush(0)
                size = len(held[0][0])
        if held:
            yield flush(None)

    return posts.select("key", "node", "sig").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: candidate links between distinct nodes (node, sig) that span every group of them."""
    found = None
    step = -(-len(POSITIONS) // PASSES)
    for first in range(0, len(POSITIONS), step):
        group = lambda p: F.conv(F.hex(F.substring("sig", p // GROUP * GROUP + 1, GROUP)), 16, 10).cast("long")
        byte = lambda p: F.shiftright(group(p), 8 * (GROUP - 1 - p % GROUP)).bitwiseAND(F.lit(255)).cast("int")
        keys = F.array(*(F.lit(i << 16) + byte(a) * 256 + byte(b) for i, (a, b) in enumerate(POSITIONS[first : first + step], first)))
        posts = nodes.select("node", "sig", F.explode(keys).alias("key"))
        sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key").checkpoint()
        if sizes.isEmpty():
            links = _short_lists(posts)
        else:
            long = checked_broadcast(sizes)
            links = _short_lists(posts.join(long, "key", "left_anti")).union(_by_leaders(posts.join(long, "key", "left_semi").select(F.lit(0).alias("i"), F.col("key").cast("string").cast("binary").alias("k"), "node", "sig"), block))
        links = links if found is None else links.union(found)
        found = spanning(links).checkpoint()
        del posts, sizes, links
        sweep(nodes.sparkSession)
    return found


def _by_leaders(posts: DataFrame, block: int) -> DataFrame:
    """u, v: the same for lists with over block nodes."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(s)), "node", "sig")).alias(f"l{s}") for s in range(LEADERS)]
    leaders = posts.groupBy("i", "k").agg(*first).select("i", "k", F.array(*(F.col(f"l{s}.node") for s in range(LEADERS))).alias("ids"), F.concat(*(F.col(f"l{s}.sig") for s in range(LEADERS))).alias("sigs")).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link, part = [], []
            last, lead, label = None, None, None
            for node, sig, ids, sigs in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if sigs != last:  # the parts that the leaders form among themselves
                    last, lead = sigs, np.frombuffer(sigs, np.uint8).reshape(LEADERS, -1)
                    near = (lead[:, None] == lead[None]).sum(axis=2) >= LEAST
                    label = np.arange(LEADERS)
                    for _ in range(LEADERS):
                        label = np.array([label[row].min() for row in near])
                tally = (lead == np.frombuffer(sig, np.uint8)).sum(axis=1)
                hit = np.flatnonzero(tally >= LEAST)
                if node not in ids:  # leaders of one part are linked by their own rows
                    hit = hit[np.unique(label[hit], return_index=True)[1]]
                other = [h for h in hit if ids[h] != node]
                link.append([ids[h] for h in other])
                part.append(int(label[hit].min()) if len(hit) else -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(link, pa.list_(pa.int64())), pa.array(part, pa.int32())], ["i", "k", "node", "sig", "link", "part"])

    joined = posts.join(checked_broadcast(leaders, LISTS), ["i", "k"])
    rows = stored(joined.select("i", "k", "node", "sig", "ids", "sigs").mapInArrow(run, "i int, k binary, node long, sig binary, link array<long>, part int"), "similar-leaders")
    found = rows.select(F.explode("link").alias("u"), F.col("node").alias("v"))
    sizes = rows.groupBy("i", "k", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("i", "k").agg(F.max_by("part", F.when(F.col("part") >= 0, F.col("n"))).alias("main"), F.sum("n").alias("n"))
    counted = main.join(sizes.withColumnRenamed("n", "m"), ["i", "k"]).groupBy("i", "k", "main", "n").agg(F.sum(F.when(F.col("part") == F.col("main"), 0).otherwise(F.col("m"))).alias("others"))
    plan = counted.where("others > 0").select("i", "k", "main", F.ceil(F.col("others") / block).cast("int").alias("mine"), F.ceil(F.col("n") / block).cast("int").alias("all")).checkpoint()
    if plan.isEmpty():
        return found
    planned = rows.join(checked_broadcast(plan), ["i", "k"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = planned.where("part <> main").select("i", "k", F.pmod(F.xxhash64("node"), F.col("mine")).cast("int").alias("a"), spread("all").alias("b"), F.lit(1).alias("side"), "node", "sig")
    every = planned.select("i", "k", spread("mine").alias("a"), F.pmod(F.xxhash64("node"), F.col("all")).cast("int").alias("b"), F.lit(2).alias("side"), "node", "sig")
    return found.union(_forests(mine.union(every), ["i", "k", "a", "b"]))


def links_within(dealt: DataFrame, by: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """u, v: links between similar texts of the groups of (by..., side, label, node, sig, grams): of all pairs of a group (side 0),
    or of nodes of side 1 with those of side 2. Pairs with LEAST shared bytes are verified by their shingles, one after the
    other, but for those that labels or links found before connect."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        side, label, node = (np.array([r[k] for r in rows]) for k in range(3))
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        grams = [r[4] for r in rows]
        size = np.array([len(g) for g in grams])
        root = np.unique(label, return_inverse=True)[1]
        out = []
        other = np.flatnonzero(side != 1)
        for i in np.flatnonzero(side != 2):
            of = other[other > i] if not side[i] else other
            tally = (sig[of] == sig[i]).sum(axis=1, dtype=np.int16)
            near = (tally >= LEAST) & (root[of] != root[i]) & (np.minimum(size[of], size[i]) >= similarity * np.maximum(size[of], size[i]))
            for j in of[near][np.argsort(-tally[near], kind="stable")]:
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both):
                    out.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            good = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:-5] != last:
                    good += flush(held)
                    held, last = [], row[:-5]
                held.append((*row[-5:-1], np.frombuffer(row[-1], np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], ["u", "v"])
        good = flush(held)
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], ["u", "v"])

    return dealt.select(*by, "side", "label", "node", "sig", "grams").repartition(*by).sortWithinPartitions(*by, "side", "node").mapInArrow(run, "u long, v long")


def verified(clusters: DataFrame, block: int = BLOCK, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: links between similar texts that span all of each cluster of (cluster, node, sig, grams).

    A cluster of up to block nodes is one group. A larger one is dealt into parts, each of which meets the cluster's leaders
    first; the nodes of its largest group of links so far need no further ones among themselves. The others meet all nodes,
    in pairs of blocks.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > block).checkpoint()
    whole = clusters.join(checked_broadcast(sizes), "cluster", "left_anti").select("cluster", F.lit(0).alias("side"), F.col("node").alias("label"), "node", "sig", "grams")
    found = links_within(whole, ["cluster"], similarity)
    if sizes.isEmpty():
        return found.checkpoint()
    large = clusters.join(checked_broadcast(sizes), "cluster").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    firsts = [F.min_by("node", F.xxhash64("node", F.lit(s))).alias(f"l{s}") for s in range(LEADERS)]
    leaders = large.groupBy("cluster").agg(*firsts).select("cluster", F.explode(F.array_distinct(F.array(*(f"l{s}" for s in range(LEADERS))))).alias("node")).checkpoint()
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = lambda side, *by: [*by, F.lit(side).alias("side"), "label", "node", "sig", "grams"]
    plain = large.withColumn("label", F.col("node"))
    lead = plain.join(checked_broadcast(leaders, LISTS), ["cluster", "node"], "left_semi").select(*row(1, "cluster", spread("parts").alias("a")))
    first = links_within(lead.union(plain.select(*row(2, "cluster", part("parts").alias("a")))), ["cluster", "a"], similarity).checkpoint()
    known = components(first).withColumnRenamed("component", "label")
    marked = large.select("cluster", "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node")).checkpoint()
    counts = marked.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    plan = counts.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("top"), F.sum("m").alias("all")).where(F.col("all") > F.col("top"))
    plan = plan.select("cluster", "main", F.ceil((F.col("all") - F.col("top")) / block).cast("int").alias("mine")).checkpoint()
    found = found.union(first)
    if not plan.isEmpty():
        planned = large.join(marked.select("node", "label"), "node").join(checked_broadcast(plan), "cluster")
        mine = planned.where("label <> main").select(*row(1, "cluster", part("mine").alias("a"), spread("parts").alias("b")))
        every = planned.select(*row(2, "cluster", spread("mine").alias("a"), part("parts").alias("b")))
        found = found.union(links_within(mine.union(every), ["cluster", "a", "b"], similarity))
    return found.checkpoint()


def similar_groups(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, node, component_id (smallest doc_id reachable by links between similar texts)."""
    if similarity < SIMILARITY:
        raise ValueError("the signature's positions and tally are laid out for 0.8 and more")
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    found = nodes_of(rows, words).checkpoint()
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).checkpoint()
    near = components(candidates(nodes.select("node", "sig"), block)).withColumnRenamed("component", "cluster").checkpoint()
    ids = nodes.join(near, "node").select(F.col("rep").alias("of")).distinct()
    some = rows.join(checked_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    grams = with_grams(some, words).groupBy("node").agg(F.max("grams").alias("grams"))
    sweep(docs.sparkSession)
    clusters = stored(near.join(nodes.select("node", "sig"), "node").join(grams, "node").select("cluster", "node", "sig", "grams"), "similar-clusters")
    links = verified(clusters, block, similarity)
    release(clusters)
    sweep(docs.sparkSession)
    comp = components(links)
    named = nodes.select("node", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return found.select("doc_id", "node").join(named.join(least, "component").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def with_grams(rows: DataFrame, words: int) -> DataFrame:
    """node, grams (its shingles' hashes, in order) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(x, words).tobytes() for x in texts(batch, "text")]
            node = [xxhash.xxh3_64_intdigest(g) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(grams, pa.binary())], ["node", "grams"])

    return rows.select("text").mapInArrow(run, "node long, grams binary")
