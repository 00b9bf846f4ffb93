"""Embedders as plug-ins: any function from texts to vectors, run over Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], size: int = 16) -> np.ndarray:
    """A stand-in for a model: signed counts of hashed words, scaled to length one."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h & 1 << 20 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = hashed_words, batch: int = 128) -> DataFrame:
    """key, embedding; batches of at most ``batch`` texts reach the embedder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embedder([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors.tolist(), pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


# Letters whose shares make the stand-in vector of the JVM side.
LETTERS = "enirstadhulcgmob"


def letter_shares(c: Column) -> Column:
    """A stand-in for a model without Python: the letters' shares of a text, in whole thousandths (so that sums are exact)."""
    low = F.lower(c)
    size = F.greatest(F.length(low), F.lit(1))
    return F.array(*(F.floor(1000.0 * (F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / size).cast("double") for x in LETTERS))
