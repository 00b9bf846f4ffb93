"""The pipeline stage by stage against plain versions of the stages' decisions."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import duckdb
from conftest import SMALL
from test_llm import encoder, none, odd, plain_spans  # noqa: F401 (fixtures)

from vellumix.llm import _common, _similar, decontaminate, quality


def test_pipeline(spark):
    _common.prepare(spark)
    docs = _common.read(spark, SMALL, "documents")
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(_common.stored(stage(spark, states[-1], SMALL), f"t-{name}"))
    frames = [s.toPandas() for s in states]
    assert all(s.columns == columns for s in states[:-1])

    rejected = {r.doc_id for r in quality.perplexity(docs, _common.read(spark, SMALL, "labels")).where("not keep").collect()}
    assert set(frames[1].doc_id) == set(frames[0].doc_id) - rejected

    sets = {i: set(_similar.shingles(t.encode()).tolist()) for i, t in zip(frames[1].doc_id, frames[1].text, strict=True)}
    first = {}
    for i in sorted(sets):
        near = [first[j] for j in first if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        first[i] = min(near, default=i)
        for j in first:
            if first[j] in near:
                first[j] = first[i]
    assert set(frames[2].doc_id) == set(first.values())

    items = [decontaminate.normalize(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    kept = set(frames[3].doc_id)
    for i, t in zip(frames[2].doc_id, frames[2].text, strict=True):
        if any(x in decontaminate.normalize(t) for x in items):
            assert i not in kept
    leaks = {r.doc_id for r in decontaminate.find_leaks(states[2], _common.read(spark, SMALL, "benchmark")).collect()}
    assert kept == set(frames[2].doc_id) - leaks

    before = dict(zip(frames[3].doc_id, frames[3].text, strict=True))
    for i, t in zip(frames[4].doc_id, frames[4].text, strict=True):
        assert (t == before[i]) == (not plain_spans(before[i])) and not plain_spans(t)

    _, library = encoder()
    for i, t in zip(frames[4].doc_id, frames[4].text, strict=True):
        r = frames[5][frames[5].doc_id == i].iloc[0]
        assert r.n_tokens == len(library.encode_ordinary(t)) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()

    assert corpus_pipeline.run(spark, SMALL).count() == len(frames[5])


def test_pipeline_odd(odd, none, spark):
    """Nulls, empty and repeated rows, further columns with clashing names, and no rows pass through all stages but the last."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = _common.stored(stage(spark, docs, SMALL), f"odd-{name}")
            assert docs.columns == columns
        left = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert left.count() == docs.count()
        if "text" in docs.columns and docs.count():
            assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id in (0, 1, 2)").count() == 1
