"""SimHash near-dedup: byte-position index with count filtering.

Method. Fingerprints of 8 bytes that differ in at most 3 bits agree in at least 5 of their 8 byte positions. The
index posts every distinct fingerprint under sets of three positions and their bytes: the eight 3-subsets of {0..3}
and of {4..7}, of which any five common positions hold at least one. Posting lists longer than ``block`` are posted anew
under two more of their other five positions, of which such pairs share two as well, so that lists do not grow by chance
with the corpus. Within a posting list the shared positional bytes of each pair are tallied, pairs with fewer than 8 -
max_bits are dropped, and the rest are verified by XOR and popcount. Lists that are still longer than ``block`` are
dealt out as pairs of blocks, so no task holds a whole hot list, and
a task returns a spanning forest of the links it finds, never all pairs of a group. Equal fingerprints are collapsed
before anything is paired.

``keep_first``, for stages that take a similarity of 0.8 over five-word shingles, goes the same way with wider
fingerprints and verifies the texts, see ``_similar``.

Defined cases: a null text is empty; an empty or blank text has fingerprint zero and links like any other; rows
repeated with one doc_id give one output row each; a null doc_id never names a component unless all members are null;
an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checked_broadcast, components, prepare, read, text_or_empty, texts, unsigned_to_long
from ._similar import similar_groups

SEED = 42
#: Three-subsets of the byte positions; see the module's text.
POSITIONS = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of a posting list that one task compares with each other.
BLOCK = 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text: bit set if set in over half of the shingles' hashes."""
    tokens = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not tokens:
        return 0
    rows = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in rows], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), unsigned_to_long(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b, the smallest index each node is connected with."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def link_runs(run: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal posting keys, as a forest. side: 0 compares with all; 1 and 2 only with each other."""
    left, right = [], []
    at = np.arange(len(run))
    for shift in range(1, len(run)):
        at = at[at + shift < len(run)]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            break
        pair = at[(side[at] == 0) | (side[at] != side[at + shift])]
        x = fp[pair] ^ fp[pair + shift]
        x, pair = x[x != 0], pair[x != 0]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        pair, x = pair[tally >= 8 - max_bits], x[tally >= 8 - max_bits]
        pair = pair[np.bitwise_count(x) <= max_bits]
        left.append(pair)
        right.append(pair + shift)
    if not left:
        return fp[:0], fp[:0]
    label = _forest(len(run), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(run)))
    return fp[label[moved]], fp[moved]


def _long_lists(posts: DataFrame, block: int) -> DataFrame:
    """i, k, blocks of the posting lists with over ``block`` fingerprints: at most a block-th of the posts."""
    return posts.groupBy("i", "k").agg(F.count("*").alias("n")).where(F.col("n") > block).select("i", "k", F.ceil(F.col("n") / block).cast("int").alias("blocks")).checkpoint()


def _finer(spark: SparkSession) -> DataFrame:
    """i, j, m: for each set of three positions, the sets with two more: a number for it, and the mask of its bytes."""
    rows = []
    for i, three in enumerate(POSITIONS):
        for two in combinations(sorted(set(range(8)) - set(three)), 2):
            m = sum(0xFF << (8 * p) for p in (*three, *two))
            rows.append((i, len(POSITIONS) + len(rows), m - (1 << 64) if m >> 63 else m))
    return spark.createDataFrame(rows, "i int, j int, m long")


def links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the distinct values of fp that span every component of "at most max_bits bits apart"."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees hits up to 3 bits")
    masks = [sum(0xFF << (8 * p) for p in three) for three in POSITIONS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))
    posts = fps.select("fp").distinct().select("fp", F.explode(keys).alias("p")).select("fp", "p.i", "p.k")
    long = _long_lists(posts, block)
    if not long.isEmpty():
        more = F.broadcast(_finer(fps.sparkSession))  # 80 rows
        marked = posts.join(checked_broadcast(long.select("i", "k", F.lit(True).alias("long"))), ["i", "k"], "left")
        again = marked.where("long").join(more, "i").select("fp", F.col("j").alias("i"), F.col("fp").bitwiseAND(F.col("m")).alias("k"))
        posts = marked.where("long is null").select("fp", "i", "k").union(again)
        long = _long_lists(again, block)
    dealt = (
        posts.join(checked_broadcast(long), ["i", "k"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("i", "k", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), F.when(F.col("lo") == F.col("hi"), 0).when(F.col("b") == F.col("lo"), 1).otherwise(2).alias("side"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.cumsum(np.any([np.diff(x, prepend=x[0]) != 0 for x in rows[:4]], axis=0))
            u, v = link_runs(ids, rows[4], rows[5].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(rows[0]):
                continue
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)] if held else rows
            last = np.all([x == x[-1] for x in rows[:4]], axis=0)
            cut = len(last) - int(last.sum())  # sorted: the last run is the tail
            if cut:
                yield flush([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held:
            yield flush(held)

    ordered = dealt.repartition("i", "k", "lo", "hi").sortWithinPartitions("i", "k", "lo", "hi", "side", "fp")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prepare(docs.sparkSession)
    fps = fingerprints(docs, text, words).checkpoint()
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    named = reps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component of similar texts (five words, 0.8 or more; options
    as for ``similar_groups``); columns as they were. A null doc_id stays."""
    drop = similar_groups(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(read(spark, sf_dir, "documents"))
