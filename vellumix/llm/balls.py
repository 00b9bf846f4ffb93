"""Centroid clustering (Lloyd's rounds over integers) with ball trees that are local to partitions.

Method. Vectors are made integers once. Each task builds metric trees of the vectors that it holds: a node is split at
the median of the direction between two far points, down to leaves of ``LEAF``. Each node stores its centre, radius,
count and integer sum. Trees over ``TREE`` vectors at most, with the vectors in leaf order, are written to the shared
folder: a row a tree. Nothing is shuffled, so that no vector, however often it occurs, is a hot key.

A round broadcasts the centroids (a fixed number). A tree is gone down level by level: of a node's candidates, those
drop out whose distance less the radius is greater than the least distance plus the radius; a node with one candidate
left gives its count and sum to it whole, others hand their candidates down, and vectors in leaves are compared with
the candidates left, exactly. A task sums up what its trees give for each centroid; the rows of all tasks are added up in
Spark, and only the sums of the centroids come to the driver. The last assignment goes down the same way, and gives each
vector its centroid and distance.

Distances are exact integers. In the triangle inequality, rounding is allowed for by a margin, so a candidate that may
be nearest, or as near, is never dropped; ties go to the smaller number. Integers of 2^23 and more are compared in
64-bit integers rather than in floating point, where products would no longer be exact; components whose squared
distances could exceed 64 bits (2^27 and more) raise an error.

Defined cases: a vector that is null, has another number of components, or one that is null or not finite, is left out;
with fewer vectors than centroids each is one; repeated ids and equal vectors give a row each (the hash's ties are
broken by the vector); a null id is hashed as an empty string; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, stored

#: Vectors of a leaf, of a tree that is written, and of those that a task builds trees of at once.
LEAF, TREE, HELD = 32, 1024, 1 << 14
#: Bounds of the integers: for exact products in floating point, and for squared distances in 64 bits.
NARROW, WIDE = 1 << 23, 1 << 27
#: Relative margin of distances in floating point.
SLACK = 1e-9

TREES = "ids array<long>, kind string, points binary, spans binary, centres binary, radii binary, sums binary"


def kept_vectors(rows: DataFrame, dim: int, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, q (array of long): floor(scale * component) of the vectors that are whole."""
    v = F.col(vector)
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.exists(v, lambda x: F.abs(F.floor(x.cast("double") * scale)) >= WIDE)
    q = F.when(wide, F.raise_error(F.lit("a component is too large for squared distances in 64 bits"))).otherwise(F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.q for r in vectors.orderBy(digest, "q").limit(k).select("q").collect()], np.int64)


def _halves(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at, split at the median of the direction between two far ones."""
    own = points[at].astype(np.float64)
    one = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
    far = own[np.argmax(((own - one) ** 2).sum(axis=1))]
    order = np.argsort(own @ (far - one), kind="stable")
    return at[order[: len(at) // 2]], at[order[len(at) // 2 :]]


def _levels(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows in the leaves, and the nodes: first row, end, first child (0: a leaf), each level behind the one above."""
    groups = [np.arange(len(points))]
    nodes: list[list[int]] = []
    order: list[np.ndarray] = []
    start = {0: 0}
    i = 0
    while i < len(groups):
        own = groups[i]
        nodes.append([start[i], start[i] + len(own), 0])
        if len(own) <= leaf or (points[own] == points[own[0]]).all():
            order.append((start[i], own))
        else:
            nodes[i][2] = len(groups)
            low, high = _halves(points, own)
            start[len(groups)], start[len(groups) + 1] = start[i], start[i] + len(low)
            groups += [low, high]
        groups[i] = own[:0]
        i += 1
    return np.concatenate([x for _, x in sorted(order, key=lambda x: x[0])]), np.array(nodes, np.int32)


def tree_row(ids: list[int | None], points: np.ndarray, leaf: int = LEAF) -> tuple:
    """A tree as a row of TREES."""
    order, nodes = _levels(points, leaf)
    points = points[order]
    before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])
    sums = before[nodes[:, 1]] - before[nodes[:, 0]]
    centres = sums / (nodes[:, 1] - nodes[:, 0])[:, None]
    radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _), c in zip(nodes, centres, strict=True)])
    kind = next(t for t in ("<i2", "<i4") if np.abs(points).max(initial=0) < np.iinfo(t).max)
    return [ids[i] for i in order], kind, points.astype(kind).tobytes(), nodes.astype("<i4").tobytes(), centres.astype("<f8").tobytes(), radii.astype("<f8").tobytes(), sums.astype("<i8").tobytes()


def build_trees(vectors: DataFrame, tree: int = TREE, leaf: int = LEAF, held: int = HELD) -> DataFrame:
    """Trees of rows (vec_id, q), a row each."""

    def rows(ids: list[int | None], points: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [np.arange(len(points))]
        while parts:
            own = parts.pop()
            if len(own) > tree:
                parts += _halves(points, own)
                continue
            row = tree_row([ids[i] for i in own], points[own], leaf)
            types = [pa.list_(pa.int64()), pa.string(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column(0).to_pylist()
            parts.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            if len(ids) >= held:
                yield from rows(ids, np.concatenate(parts))
                ids, parts = [], []
        if ids:
            yield from rows(ids, np.concatenate(parts))

    return vectors.select("vec_id", "q").mapInArrow(run, TREES)


class Tree:
    """A row of TREES, opened."""

    def __init__(self, kind: str, points: bytes, spans: bytes, centres: bytes, radii: bytes, sums: bytes) -> None:
        self.nodes = np.frombuffer(spans, "<i4").reshape(-1, 3)
        of = lambda x, t: np.frombuffer(x, t).reshape(-1, len(centres) // 8 // len(self.nodes))
        self.points, self.centres, self.sums, self.radii = of(points, kind), of(centres, "<f8"), of(sums, "<i8"), np.frombuffer(radii, "<f8")


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer points to centroids, exact."""
    top = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    p, c = (x.astype(np.float64 if top < NARROW else np.int64) for x in (points, centroids))
    if top >= NARROW:
        return np.stack([((p - x) ** 2).sum(axis=1) for x in c], axis=1)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def descend(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that are assigned whole, their centroids; rows of leaves compared one by one, their centroids."""
    c = centroids.astype(np.float64)
    nodes = np.array([0])
    free = np.ones((1, len(c)), bool)  # candidates of each node
    whole, owner, rows, nearest = [], [], [], []
    while len(nodes):
        m, r = tree.centres[nodes], tree.radii[nodes][:, None]
        square = ((m * m).sum(axis=1)[:, None] - 2 * (m @ c.T) + (c * c).sum(axis=1)).clip(0)
        margin = SLACK * ((m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1)) + 1e-6  # of the squares
        low, high = np.sqrt((square - margin).clip(0)) - r * (1 + SLACK), np.sqrt(square + margin) + r * (1 + SLACK)
        free &= low <= np.where(free, high, np.inf).min(axis=1)[:, None]
        one = free.sum(axis=1) == 1
        whole.append(nodes[one])
        owner.append(free[one].argmax(axis=1))
        leaf = ~one & (tree.nodes[nodes, 2] == 0)
        for i in np.flatnonzero(leaf):
            some = np.flatnonzero(free[i])
            a, b, _ = tree.nodes[nodes[i]]
            rows.append(np.arange(a, b))
            nearest.append(some[distances(tree.points[a:b], centroids[some]).argmin(axis=1)])
        inner = ~one & ~leaf
        first = tree.nodes[nodes[inner], 2]
        nodes, free = np.concatenate([first, first + 1]), np.concatenate([free[inner]] * 2)
    return (*(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (whole, owner, rows, nearest)),)


def _opened(batch: pa.RecordBatch) -> Iterator[Tree]:
    for row in zip(*(batch.column(i) for i in range(batch.num_columns - 6, batch.num_columns)), strict=True):
        yield Tree(*(x.as_py() for x in row))


def sums_by_centroid(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors of each centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for tree in _opened(batch):
                whole, owner, rows, nearest = descend(tree, centroids)
                np.add.at(n, owner, (tree.nodes[whole, 1] - tree.nodes[whole, 0]).astype(np.int64))
                np.add.at(s, owner, tree.sums[whole])
                n += np.bincount(nearest, minlength=k)
                np.add.at(s, nearest, tree.points[rows].astype(np.int64))
        some = np.flatnonzero(n)
        columns = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["c", "n", "s"])

    parts = trees.drop("ids").mapInArrow(run, "c int, n long, s array<long>")
    total = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out: list[tuple[int, list[int]]] = [(0, [0] * dim)] * k
    for row in parts.groupBy("c").agg(F.sum("n").alias("n"), *total).collect():  # a row for each centroid
        out[row.c] = row.n, [int(row[f"s{i}"]) for i in range(dim)]
    return out


def moved(centroids: np.ndarray, sums: list[tuple[int, list[int]]]) -> np.ndarray:
    """The floor of each centroid's mean; one without vectors stays."""
    return np.array([[x // n for x in s] if n else old for (n, s), old in zip(sums, centroids.tolist(), strict=True)], np.int64).reshape(centroids.shape)


def assign(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in zip(batch.column(0), _opened(batch), strict=True):
                whole, owner, rows, nearest = descend(tree, centroids)
                cluster = np.empty(len(tree.points), np.int64)
                cluster[rows] = nearest
                for (a, b, _), c in zip(tree.nodes[whole], owner, strict=True):
                    cluster[a:b] = c
                distance = ((tree.points.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of the whole vectors after the rounds, and the centroids."""
    prepare(rows.sparkSession)
    vectors = kept_vectors(rows, dim, scale, vec_id, vector)
    centroids = first_centroids(vectors, k, seed)
    trees = stored(build_trees(vectors), "ball-trees")
    if not len(centroids):
        return assign(trees, np.zeros((1, dim), np.int64)), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        centroids = moved(centroids, sums_by_centroid(trees, centroids))
    return assign(trees, centroids), centroids


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(read(prepare(spark), sf_dir, "embeddings"))
    found = stored(found, "ball-clusters")
    sums = {r.cluster: int(r.own) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # a row for each centroid
    digests = [(i, n, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in sorted(sums.items())]
    each = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, dim: int = 64, rounds: int = 5) -> str:
    """The rounds as a chain of tables."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM k QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min([d, c]) AS m FROM (SELECT k.r, k.vec_id, k.q, c.c, list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT m[2] AS c, pos, sum(v) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS v, generate_subscripts(q, 1) AS pos FROM a{i}) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(x.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS q FROM s{i} GROUP BY c) x USING (c))")
    last = f"SELECT vec_id, m[2]::INT AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m[2]"
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE_SQL = _oracle()
