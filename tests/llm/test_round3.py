"""What the third round's findings were about."""

from __future__ import annotations

import gc
import weakref
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellumix.llm import _common, _similar, quality, toxicity


def test_sweep_frees_frames_in_cycles(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    held = [df]
    held.append(held)
    alive = weakref.ref(df)
    gc.disable()
    try:
        del df, held
        _common.sweep(spark)
        assert alive() is None
    finally:
        gc.enable()


def test_low_orders_take_one_partition(spark):
    """Tables that no input makes larger than TABLE rows are not dealt out; higher orders are."""
    _common.prepare(spark)
    counts = spark.range(5000).select((F.col("id") % 2).cast("int").alias("half"), (F.col("id") * 7919).alias("g"), F.lit(1).cast("long").alias("c")).repartition(6)
    parts = [seen.rdd.getNumPartitions() for seen, _ in quality.kneser_ney(counts)]
    assert parts[:2] == [1, 1] and quality.SIZE**3 * 2 > quality.TABLE


def toxic_rows(n):
    """Texts of which every fourth is toxic, told by one of 300 words that few texts share."""
    rng = np.random.default_rng(5)
    return [(i, " ".join([*(f"w{k}" for k in rng.integers(0, 400, 30)), *([f"bad{rng.integers(0, 300)}"] * (i % 4 == 0))]), "en", int(i % 4 == 0)) for i in range(n)]


def test_toxicity_learns_from_every_label(spark):
    """Counts and shards cover all labelled documents that are not held out, and what they learn holds for the others."""
    rows = toxic_rows(9500)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    _common.prepare(spark)
    found = toxicity.labelled(docs, labels)
    want = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert len(want) > 7500 and found.count() == len(want)
    plain = toxicity.bucket_counts([toxicity.word_hashes(r[1].encode()) for r in want], np.array([r[3] for r in want]))
    assert (toxicity.count_buckets(found) == plain).all()
    model = toxicity.fit(docs, labels, shard=1500)
    p = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    held = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    assert sum(p[r[0]] == r[3] for r in held) > 0.97 * len(held) and "en" in model.thresholds


def test_toxicity_long_texts_train_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    rows, y = [rng.integers(0, 500, n).astype(np.uint32) for n in [5, 0, 40, 200, 1000] * 16], np.arange(80) % 2
    whole = toxicity.train_model(rows, y).rows()
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, toxicity.train_model(rows, y).rows(), strict=True))


def test_binned_threshold():
    rng = np.random.default_rng(8)
    step = rng.integers(-40, 40, 500)
    y = (step + rng.normal(0, 15, 500) > 5).astype(int)
    at = np.unique(step)
    odds = toxicity.binned_threshold(at, *(np.array([np.sum((step == s) & (y == k)) for s in at]) for k in (1, 0)))
    want = toxicity.best_threshold(step.astype(float), y.astype(float))
    assert odds * toxicity.STEPS == want


def test_signatures_are_simhashes():
    """A bit is set if set in over half of the shingles' hashes, so bits differ as the angle of the shingle sets says."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 63, 700, dtype=np.uint64))
    one = lambda h: np.unpackbits(_similar.signature(np.array([h], np.uint64)))
    votes = np.sum([one(h).astype(int) for h in base], axis=0)
    sure = 2 * votes != len(base)
    assert (np.unpackbits(_similar.signature(base))[sure] == (2 * votes > len(base))[sure]).all()
    differ = []
    for _ in range(60):
        h = rng.permutation(np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)))
        a, b = np.sort(h[:800]), np.sort(h[100:])  # 700 of 900 shared
        differ.append(np.unpackbits(_similar.signature(a) ^ _similar.signature(b)).mean())
    assert abs(np.mean(differ) - np.arccos(700 / 800) / np.pi) < 0.01


def test_pairs_at_the_limit_are_posted_together():
    rng = np.random.default_rng(10)
    met = 0
    for _ in range(400):
        h = rng.permutation(rng.integers(0, 1 << 63, 360, dtype=np.uint64))
        a, b = (_similar.signature(np.sort(x)) for x in (h[:324], h[36:]))  # similarity 0.8
        same = a == b
        met += any(same[p] and same[q] for p, q in _similar.POSITIONS) and same.sum() >= _similar.LEAST
    assert met >= 0.985 * 400


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    _common.prepare(spark)
    edges = spark.range(300).select("id", (F.col("id") + F.when(F.col("id") % 10 == 9, 0).otherwise(1)).alias("to")).repartition(5)
    want = {i: i - i % 10 for i in range(300)}
    rows = {r.node: r.component for r in _common.components(edges, "id", "to").collect()}
    assert rows == want and _common.components(edges, "id", "to").rdd.getNumPartitions() == 2
    monkeypatch.setattr(_common, "EDGES", 0)
    assert {r.node: r.component for r in _common.components(edges, "id", "to").collect()} == want


def test_near_copies_have_few_candidate_links(spark):
    """Posting lists link the nodes of one group again and again; what goes on connects the same nodes by few links."""
    _common.prepare(spark)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, _similar.BYTES, dtype=np.uint8)
    sigs = [np.where(rng.random(_similar.BYTES) < 0.4, rng.integers(0, 256, _similar.BYTES, dtype=np.uint8), base) for _ in range(400)]
    nodes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "node long, sig binary").repartition(3)
    for block in (1024, 50):
        links = _similar.candidates(nodes, block)
        label = {r.node: r.component for r in _common.components(links).collect()}
        assert links.count() <= 4 * len(sigs) and [label[i] for i in range(len(sigs))] == [0] * len(sigs)


def test_star_forest_connects_the_same_nodes():
    rng = np.random.default_rng(12)
    u, v = rng.integers(-300, 300, (2, 260))
    want = {x: x for x in np.concatenate([u, v]).tolist()}
    for _ in want:
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            want[a] = want[b] = min(want[a], want[b])
    a, b = _similar.star_forest(u, v)
    assert dict(zip(b.tolist(), a.tolist(), strict=True)) == {x: y for x, y in want.items() if x != y}
    assert [len(x) for x in _similar.star_forest(u[:0], v[:0])] == [0, 0]


def test_spanning_holds_few_links(spark, monkeypatch):
    _common.prepare(spark)
    monkeypatch.setattr(_similar, "LINKS", 64)  # of parts that go out before all is read
    rng = np.random.default_rng(13)
    edges = spark.createDataFrame([(int(x) // 40 * 40 + int(y), int(x)) for x, y in zip(rng.integers(0, 800, 3000), rng.integers(0, 40, 3000), strict=True)], "u long, v long")
    rows = lambda df: {(r.node, r.component) for r in _common.components(df).collect()}
    assert rows(_similar.spanning(edges)) == rows(edges)
