"""Retrieval: lexical and vector search for sets of queries, rank fusion, and measures of the results.

Queries are the stated set: they are few, so they are broadcast (in blocks where their number asks for it) and the
corpus is never shuffled by more than what it holds of the queries' terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
#: Queries that are compared with all vectors at a time, and vectors that a task compares at a time.
BLOCK, SLICE = 4000, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """term, key, tf, size: an inverted index; store it partitioned by term for repeated use."""
    rows = docs.select(key, tokens.alias("t")).withColumn("size", F.size("t"))
    return rows.select(key, "size", F.explode("t").alias("term")).groupBy("term", key, "size").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, score (higher is better) of the documents that hold all terms of a query; queries: query_id, terms.

    Only the queries' terms are looked up, so texts are reduced to their counts of those before anything is shuffled.
    """
    q = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    need = q.groupBy("query_id").agg(F.count("*").alias("need"))
    terms = F.broadcast(q.select("term").distinct())
    rows = docs.select(key, tokens.alias("t"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_size"))
    tf = rows.select(key, F.size("t").alias("size"), F.explode("t").alias("term")).join(terms, "term").groupBy("term", key, "size").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_size")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg_size")))
    hits = tf.join(F.broadcast(weights), "term").join(F.broadcast(q), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("found"))
    out = hits.join(F.broadcast(need), "query_id").where("found = need").select("query_id", key, "score")
    return out if k is None else top(out, key, F.desc("score"), k).drop("rank")


def top(hits: DataFrame, key: str, order: Column, k: int) -> DataFrame:
    """The first k rows of each query with their rank; ties by key."""
    w = Window.partitionBy("query_id").orderBy(order, key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, key, distance, rank: the exact k nearest by Euclidean distance, ties by key; queries: query_id, q.

    Vectors of different lengths raise an error, rows without one are left out. Queries go in blocks, each broadcast as a
    matrix; each task keeps its k best of each query over all its rows, so that k rows a query and task are shuffled.
    """
    ids, keys = (dict(df.dtypes)[c] for df, c in ((queries, "query_id"), (vectors, key)))
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    out = None
    v = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow()  # about a block of queries
        shared = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].combine_chunks(), [r.as_py() for r in rows["q"]]))
        near = v.mapInArrow(_nearest(shared, key, k), f"query_id {ids}, {key} {keys}, distance double")
        found = top(near, key, F.col("distance"), k)
        out = found if out is None else out.union(found)
    return out


def _nearest(shared, key: str, k: int):
    """The k nearest rows of a task to each of the broadcast queries. A product of matrices tells which rows may be among
    them; their distances are then taken from the differences, as rounding must not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        if not queries:
            return
        if len({len(q) for q in queries}) > 1:
            raise ValueError("vectors of different lengths")
        q = np.array(queries).reshape(len(queries), -1)
        norm = (q * q).sum(axis=1)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        worst = np.full(len(queries), np.inf)
        names: list[pa.Array] = []  # the keys of all rows so far, by place
        seen = 0
        for batch in (rows.slice(at, SLICE) for rows in batches for at in range(0, rows.num_rows, SLICE)):
            vectors = batch.column(1)
            if (np.diff(vectors.offsets.to_numpy()) != q.shape[1]).any():
                raise ValueError("vectors of different lengths")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = (x * x).sum(axis=1)
            near = norm[:, None] + far[None] - 2 * (q @ x.T)
            slack = 1e-9 * (1 + norm + (np.sqrt(norm) + np.sqrt(far.max())) ** 2)
            bound = worst**2
            some = near <= (bound + 2 * slack)[:, None]
            many = np.flatnonzero(some.sum(axis=1) > 2 * k)  # here the slice itself has k better ones
            if len(many):
                bound[many] = np.minimum(bound[many], np.partition(near[many], k - 1, axis=1)[:, k - 1])
                some[many] = near[many] <= (bound + 2 * slack)[many, None]
            found = np.flatnonzero(some.any(axis=1))
            if not len(found):
                continue
            for j in found:
                at = np.flatnonzero(some[j])
                d = np.sqrt(((x[at] - q[j]) ** 2).sum(axis=1))
                best[j] = np.concatenate([best[j][0], d]), np.concatenate([best[j][1], at + seen])
            names.append(batch.column(0))
            seen += batch.num_rows
            every = pa.chunked_array(names).combine_chunks()
            kept = np.unique(np.concatenate([b[1] for b in best]))
            label = np.array(every.take(pa.array(kept)).to_pylist())
            for j in found:
                d, at = best[j]
                order = np.lexsort((label[np.searchsorted(kept, at)], d))[:k]
                best[j] = d[order], at[order]
                if len(order) == k:
                    worst[j] = best[j][0][-1]
            kept = np.unique(np.concatenate([b[1] for b in best]))  # what is still among the best: few keys stay in memory
            names, seen = [every.take(pa.array(kept))], len(kept)
            best = [(d, np.searchsorted(kept, at)) for d, at in best]
        if names:
            which = pa.array(np.repeat(np.arange(len(q)), [len(b[0]) for b in best]))
            place = pa.array(np.concatenate([b[1] for b in best]))
            yield pa.RecordBatch.from_arrays([ids.take(which), names[0].take(place), pa.array(np.concatenate([b[0] for b in best]))], ["query_id", key, "distance"])

    return run


def rrf(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """query_id, key, score: the sum of 1 / (k + rank) over all lists that name a key; lists: query_id, list, key, rank."""
    return lists.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def fuse(lexical: DataFrame, vector: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """query_id, key, score, lexical_rank, vector_rank: a full outer merge of two lists with ranks."""
    a = lexical.select("query_id", key, F.col("rank").alias("lexical_rank"))
    b = vector.select("query_id", key, F.col("rank").alias("vector_rank"))
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", key], "full_outer").withColumn("score", one("lexical_rank") + one("vector_rank"))


def best_of_parent(hits: DataFrame, parent: str, child: str, score: str = "score") -> DataFrame:
    """query_id, parent, score, child: a parent has its best child's score; ties by the smaller child."""
    best = F.max_by(child, F.struct(score, -F.col(child).cast("double")))
    return hits.groupBy("query_id", parent).agg(F.max(score).alias("score"), best.alias(child))


def carried(hits: DataFrame, parent: str, child: str, score: str, carry: str) -> DataFrame:
    """``best_of_parent`` with a further figure: the winner's own, else that of the parent's best child that has one."""
    order = F.struct(score, -F.col(child).cast("double"))
    best = F.max_by(child, order).alias(child)
    return hits.groupBy("query_id", parent).agg(F.max(score).alias(score), best, F.max_by(carry, F.when(F.col(carry).isNotNull(), order)).alias(carry))


def attach_chunks(parents: DataFrame, lexical: DataFrame, vector: DataFrame, parent: str, child: str) -> DataFrame:
    """query_id, parent, key, child, by: the chunk that stands for each parent (query_id, parent) that a search found.

    The best chunk by a lexical search (query_id, parent, child, score) is its own key. A parent without one takes its content
    from the best chunk by a vector search (query_id, parent, child, rank), under a key of its own, so that no rank of the two
    searches is added up for a chunk which one of them did not find. by: lexical, vector or none.
    """
    ids = ["query_id", parent]
    own = best_of_parent(lexical, parent, child).select(*ids, F.col(child).alias("__l"))
    near = vector.groupBy(*ids).agg(F.min_by(child, F.struct("rank", child)).alias("__v"))
    rows = parents.select(*ids).distinct().join(own, ids, "left").join(near, ids, "left")
    key = F.coalesce(F.col("__l").cast("string"), F.concat(F.lit("parent::"), F.col(parent).cast("string")))
    by = F.when(F.col("__l").isNotNull(), "lexical").when(F.col("__v").isNotNull(), "vector").otherwise("none")
    return rows.select(*ids, key.alias("key"), F.coalesce("__l", "__v").alias(child), by.alias("by"))


def measures(ranked: DataFrame, relevant: DataFrame, key: str, k: int = 10) -> DataFrame:
    """query_id, recall, ndcg, rr at k; queries without relevant keys are left out. ranked: query_id, key, rank."""
    pairs = relevant.select("query_id", key).distinct()
    hits = ranked.where(F.col("rank") <= k).join(pairs, ["query_id", key])
    return _measured(hits, pairs.groupBy("query_id").agg(F.count("*").alias("n")), k)


def class_measures(ranked: DataFrame, queries: DataFrame, items: DataFrame, key: str, label: str, k: int = 10) -> DataFrame:
    """``measures`` where all items (key, label) of a query's label (query_id, label) are relevant to it: they are counted by label, and
    only ranked ones meet their query, as the pairs of queries and items of a label grow with the square of the items."""
    items = items.select(key, label).where(F.col(label).isNotNull()).distinct()
    queries = queries.select("query_id", label)
    of = items.withColumnRenamed(label, "__of")
    hits = ranked.where(F.col("rank") <= k).join(queries, "query_id").join(of, key).where(F.col(label) == F.col("__of"))
    return _measured(hits, queries.join(items.groupBy(label).agg(F.count("*").alias("n")), label).select("query_id", "n"), k)


def _measured(hits: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """The measures by the ranked keys that are relevant (query_id, rank), and the number of relevant ones (query_id, n)."""
    got = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = total.join(got, "query_id", "left")
    return joined.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def macro(measured: DataFrame, subset: str) -> DataFrame:
    """subset, n, recall, ndcg, mrr: means over the queries of each subset, each query counting once."""
    return measured.groupBy(subset).agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"))


def gate(before: DataFrame, after: DataFrame, subset: str, least: dict[str, float]) -> DataFrame:
    """subset, the change of each measure from one macro table to another, and passed: no measure of least lies below its value.
    Subsets that only one of them has have null changes; without a later value nothing passes."""
    names = ("recall", "ndcg", "mrr")
    both = before.select(subset, *(F.col(m).alias(f"b_{m}") for m in names)).join(after.select(subset, *(F.col(m).alias(f"a_{m}") for m in names)), subset, "full")
    passed = F.lit(True)
    for m, value in least.items():
        passed = passed & F.coalesce(F.col(f"a_{m}") >= value, F.lit(False))
    return both.select(subset, *((F.col(f"a_{m}") - F.col(f"b_{m}")).alias(f"d_{m}") for m in names), passed.alias("passed"))
