"""Chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, words: windows of ``size`` words that overlap by ``overlap``; native."""
    step = size - overlap
    words = F.split(F.trim(text), r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    rows = docs.select(key, words.alias("w"), F.explode(starts).alias("i"))
    return rows.select(key, F.floor(F.col("i") / step).alias("chunk"), F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("words"))


def section_chunks(docs: DataFrame, budget: int = 120, overlap: int = 20, fill: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk, start_word, n_words, words, snapped: windows of up to budget words that end at a line's end where one lies
    in their last part (from ``fill`` of the budget on); only windows cut elsewhere overlap. State runs along a text, so
    this is a kernel per row, with nothing grouped or shuffled."""
    schema = f"{key} long, chunk int, start_word int, n_words int, words string, snapped boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, body in zip(batch[key], batch[text], strict=True):
                words, ends = [], set()
                for line in (body or "").split("\n"):
                    words += line.split()
                    ends.add(len(words))
                at = n = 0
                while at < len(words):
                    limit = min(at + budget, len(words))
                    snap = next((e for e in range(limit, at + int(budget * fill) - 1, -1) if e in ends), None) if limit < len(words) else limit
                    end = snap or limit
                    out.append((k, n, at, end - at, " ".join(words[at:end]), snap is not None))
                    at, n = end if snap is not None else max(end - overlap, at + 1), n + 1
            yield pd.DataFrame(out, columns=[key, "chunk", "start_word", "n_words", "words", "snapped"])

    return docs.select(key, text).mapInPandas(run, schema)
