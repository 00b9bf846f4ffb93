"""Plug-in points: pair scorers over Arrow batches, vector codecs, context sentences, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PairScorer = Callable[[list[str], list[str]], np.ndarray]


def shared_words(a: list[str], b: list[str]) -> np.ndarray:
    """A stand-in for a cross-encoder or an entailment model: the share of a's words that b has."""
    out = []
    for x, y in zip(a, b, strict=True):
        own = set(x.lower().split())
        out.append(len(own & set(y.lower().split())) / max(1, len(own)))
    return np.array(out)


def score_pairs(df: DataFrame, left: str, right: str, keep: tuple[str, ...], scorer: PairScorer = shared_words, batch: int = 64) -> DataFrame:
    """The columns of keep and pair_score."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                a, b = ([x or "" for x in part.column(part.schema.get_field_index(c)).to_pylist()] for c in ("__left", "__right"))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(scorer(a, b), pa.float64())], [*keep, "pair_score"])

    rows = df.select(*keep, F.col(left).alias("__left"), F.col(right).alias("__right"))
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", pair_score double")


def verdicts(claims: DataFrame, key: str, threshold: float, scorer: PairScorer = shared_words) -> DataFrame:
    """key, verdict of (key, claim, evidence): by rule where the wording tells, else by the scorer."""
    low = F.lower("claim")
    rule = F.when(F.col("claim").isNull() | (F.col("claim") == ""), "empty").when(low.rlike(r"\b(laut|according to|selon|según)\b"), "attributed").when(low.rlike(r"\b(nicht|kein|not|no|ne|pas)\b"), "negated")
    rows = claims.withColumn("rule", rule)
    told = rows.where("rule is not null").select(key, F.col("rule").alias("verdict"))
    scored = score_pairs(rows.where("rule is null"), "claim", "evidence", (key,), scorer)
    return told.union(scored.select(key, F.when(F.col("pair_score") >= threshold, "faithful").otherwise("finding")))


def pack_vector(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(c)


def unpack_vector(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return F.pandas_udf(run, "array<float>")(c)
