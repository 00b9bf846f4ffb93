"""Toxicity: a convolutional text classifier, trained and run in numpy.

Method. Words (letters, ASCII lower-cased) are hashed into two tables of embeddings whose halves are concatenated, so
that a word is confused with another only if both hashes meet. Filters of widths one to three slide over the whole
text, each filter's maximum over all positions is pooled, and a logistic layer on the rectified maxima gives the score.
The first coordinate of each half starts as the bucket's log-ratio between toxic and other training documents, the
rest as noise; Adagrad trains all of it. Buckets met in fewer than ``MIN_DOCS`` training documents stay zero, so
words that training has hardly seen say nothing. Texts are scored in pieces that overlap by the widest filter, so
memory is bounded and the maxima are those of the whole text.

Training takes every labelled document but those held out. They are dealt into shards of about ``SHARD`` documents by a
hash of doc_id. Documents with each bucket are counted over all of them; every shard then trains from the same start,
and the model is the shards' mean, that of a bucket over the shards that have moved it. A fifth of the documents is kept
from training to calibrate, all of it: the base is moved so that F1 is highest at one half over all languages, and each
language has the threshold at which its own is highest; one with too few examples takes one half. Scores are counted by
log-odds, ``STEPS`` to a unit, so thresholds come from all documents and what reaches the driver is of fixed size.

Defined cases: a null or empty text has no words and gets the score of a text whose filters all see nothing; without
labelled rows of both classes every score is the share of toxic labels (0 without any label); a document is toxic if
any of its label rows says so; a null doc_id is not held out and not trained on; a null language is a language of its
own; repeated rows give a row each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checked_broadcast, prepare, read, text_or_empty, texts

#: Documents of a shard, and words of one, about.
SHARD, SHARD_WORDS = 4000, 4_000_000
#: Steps of log-odds by which scores are counted, and the log-odds beyond which they are not told apart.
STEPS, FAR = 512, 30
BUCKETS = 1 << 16
HALF = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MIN_DOCS = 4
EPOCHS = 5
BATCH = 32
RATE = 0.1
#: Words that are scored at once.
CHUNK = 1 << 17
#: Documents of a language, toxic and not, below which it takes the threshold of all languages.
LEAST = 20

#: Letters, and all bytes of other scripts, stay; A-Z are lower-cased; all else is blank.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LETTERS).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


@dataclass
class Model:
    """tables: the embeddings of both hashes, a row of zeros at the end; filters: for each width (width, 2 * HALF, FILTERS)."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    threshold: float = 0.5

    def embed(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[0][h & (BUCKETS - 1)], self.tables[1][h >> 16]], axis=-1)

    def maps(self, x: np.ndarray) -> np.ndarray:
        """Responses (positions, all filters); blanks follow x, WIDTHS[-1] - 1 rows of them must be in x."""
        n = len(x) - WIDTHS[-1] + 1
        return np.concatenate([sum(x[j : j + n] @ w[j] for j in range(len(w))) for w in self.filters], axis=1)

    def maxima(self, h: np.ndarray) -> np.ndarray:
        """Each filter's maximum over a whole text and the blanks around it."""
        best = np.zeros(len(self.bias), np.float32)
        pad = WIDTHS[-1] - 1
        for at in range(0, len(h), CHUNK):
            lead = min(at, pad)
            x = self.embed(h[at - lead : at + CHUNK])
            x = np.concatenate([x, np.zeros((pad, x.shape[1]), np.float32)])
            best = np.maximum(best, self.maps(x).max(axis=0))
        return best

    def score(self, maxima: np.ndarray) -> np.ndarray:
        z = np.maximum(maxima + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as word hashes: short ones together, long ones in pieces."""
        best = np.zeros((len(rows), len(self.bias)), np.float32)
        pad = WIDTHS[-1] - 1
        at = 0
        while at < len(rows):
            end, total = at, 0
            while end < len(rows) and (end == at or total + len(rows[end]) + pad <= CHUNK):
                total += len(rows[end]) + pad
                end += 1
            if end == at + 1:
                best[at] = self.maxima(rows[at])
            elif total > pad * (end - at):
                m = self.maps(np.concatenate([self._padded(rows[at:end]), np.zeros((pad, 2 * HALF), np.float32)]))
                starts = np.cumsum([0] + [len(r) + pad for r in rows[at : end - 1]])
                best[at:end] = np.maximum(np.maximum.reduceat(m, starts, axis=0), 0)
            at = end
        return self.score(best) if len(rows) else np.zeros(0)

    def _padded(self, rows: list[np.ndarray]) -> np.ndarray:
        """Embeddings of texts, each followed by blanks."""
        pad = WIDTHS[-1] - 1
        ids = [np.concatenate([i for r in rows for i in (f(r), blank)]) for f, blank in ((lambda r: r & (BUCKETS - 1), np.full(pad, BUCKETS)), (lambda r: r >> 16, np.full(pad, BUCKETS)))]
        return np.concatenate([self.tables[0][ids[0]], self.tables[1][ids[1]]], axis=1)


    def _at(self, flat: np.ndarray, real: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Embeddings at some places of texts that lie one behind the other with blanks (not real) between."""
        return self.embed(flat[at]) * real[at][..., None]

    def _tops(self, flat: np.ndarray, real: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum in each text of flat and where it lies, over pieces of CHUNK words."""
        n, pad = len(starts) - 1, WIDTHS[-1] - 1
        high, top = np.full((n, len(self.bias)), -np.inf, np.float32), np.zeros((n, len(self.bias)), np.int64)
        for a in range(0, int(starts[-1]), CHUNK):
            m = self.maps(self._at(flat, real, slice(a, min(a + CHUNK, int(starts[-1])) + pad)))
            for i in range(int(np.searchsorted(starts, a, "right")) - 1, n):
                lo, hi = max(int(starts[i]) - a, 0), min(int(starts[i + 1]) - a, len(m))
                if lo >= len(m):
                    break
                at = m[lo:hi].argmax(axis=0)
                own = np.take_along_axis(m[lo:hi], at[None], axis=0)[0]
                better = own > high[i]
                high[i, better], top[i, better] = own[better], at[better] + lo + a
        return high, top

    def rows(self) -> list[np.ndarray]:
        """All weights as three tables of HALF columns: the embeddings, and the rest."""
        rest = np.concatenate([self.bias, self.out, *(w.ravel() for w in self.filters), [np.float32(self.base)]])
        return [*(t[:BUCKETS] for t in self.tables), np.append(rest, np.zeros(-len(rest) % HALF)).astype(np.float32).reshape(-1, HALF)]

    def moved(self, table: np.ndarray, index: np.ndarray, by: np.ndarray) -> Model:
        """The model with by added to the rows index of the tables."""
        own = [x.copy() for x in self.rows()]
        for t, x in enumerate(own):
            x[index[table == t]] += by[table == t]
        blank, rest, at = np.zeros((1, HALF), np.float32), own[2].ravel(), 0
        parts = []
        for p in (self.bias, self.out, *self.filters):
            parts.append(rest[at : at + p.size].reshape(p.shape))
            at += p.size
        return Model([np.concatenate([x, blank]) for x in own[:2]], parts[2:], parts[0], parts[1], float(rest[at]), dict(self.thresholds), self.threshold)


def constant(share: float) -> Model:
    """A model that gives every text the same score."""
    n = len(WIDTHS) * FILTERS
    share = min(max(share, 1e-6), 1 - 1e-6)
    zeros = [np.zeros((BUCKETS + 1, HALF), np.float32) for _ in range(2)]
    return Model(zeros, [np.zeros((w, 2 * HALF, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), float(np.log(share / (1 - share))))


def bucket_counts(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Documents with each bucket: (table, label, bucket)."""
    met = np.zeros((2, 2, BUCKETS), np.int64)
    for r, label in zip(rows, y, strict=True):
        for t, ids in enumerate((r & (BUCKETS - 1), r >> 16)):
            met[t, int(label)][np.unique(ids)] += 1
    return met


def start(met: np.ndarray, n: np.ndarray, seed: int = 7, prior: bool = True) -> tuple[Model, list[np.ndarray]]:
    """The model that training starts from, and which buckets are known. met: bucket_counts; n: documents of each label."""
    model = constant(float(n[1] / n.sum()))
    rng = np.random.default_rng(seed)
    seen = []
    for t in range(2):
        known = met[t].sum(axis=0) >= MIN_DOCS
        ratio = np.log((met[t, 1] + 0.5) / (n[1] + 1)) - np.log((met[t, 0] + 0.5) / (n[0] + 1))
        table = rng.normal(0, 0.05, (BUCKETS, HALF))
        if prior:
            table[:, 0] = ratio / 4
        model.tables[t][:BUCKETS] = table * known[:, None]
        seen.append(np.append(known, False))
    for w in model.filters:
        w += rng.normal(0, 0.1, w.shape)
        w[:, 0] += 0.5 / len(w)
        w[:, HALF] += 0.5 / len(w)
    model.out += rng.normal(0.5, 0.1, len(model.out))
    return model, seen


def train_model(rows: list[np.ndarray], y: np.ndarray, seed: int = 7, prior: bool = True, epochs: int = EPOCHS) -> Model:
    """The classifier of texts given as word hashes. prior: start from the words' log-ratios rather than at random."""
    n = np.array([len(y) - float(np.sum(y)), float(np.sum(y))])
    if not n.all():
        return constant(float(n[1] / n.sum()) if len(y) else 0.0)
    model, seen = start(bucket_counts(rows, y), n, seed, prior)
    return descend(model, seen, rows, y, seed, epochs)


def descend(model: Model, seen: list[np.ndarray], rows: list[np.ndarray], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Trains the model in place."""
    rng = np.random.default_rng([seed, 1])
    params = [model.bias, model.out, *model.filters]
    sums = [np.full(p.shape, 1e-6, np.float32) for p in params]
    table_sums = [np.full(BUCKETS + 1, 1e-6, np.float32) for _ in range(2)]
    base_sum = 1e-6
    pad = WIDTHS[-1] - 1
    rate = RATE
    blank = np.zeros(pad, np.uint32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            own = [rows[i] for i in part]
            flat = np.concatenate([x for r in own for x in (r, blank)] + [blank])
            starts = np.cumsum([0] + [len(r) + pad for r in own])
            real = np.ones(len(flat), bool)
            for k in range(pad):
                real[starts[1:] - 1 - k] = False
            real[starts[-1] :] = False
            high, top = model._tops(flat, real, starts)
            best = np.maximum(high, 0)
            hidden = np.maximum(best + model.bias, 0)
            z = hidden @ model.out + model.base
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[part]) / len(part)
            dh = d[:, None] * model.out * (hidden > 0)
            grads = [dh.sum(axis=0), hidden.T @ d + 1e-4 * model.out, *[np.zeros_like(w) for w in model.filters]]
            dm = dh * (best > 0)
            touched: list[list[np.ndarray]] = [[], []]
            given: list[list[np.ndarray]] = [[], []]
            for g, w in enumerate(model.filters):
                cols = slice(g * FILTERS, (g + 1) * FILTERS)
                for j in range(len(w)):
                    pos = top[:, cols] + j
                    grads[2 + g][j] = np.einsum("dfk,df->kf", model._at(flat, real, pos), dm[:, cols])
                    dx = (w[j].T[None] * dm[:, cols, None] * real[pos][:, :, None]).reshape(-1, 2 * HALF)
                    h = flat[pos].reshape(-1)
                    for t, ids in enumerate((h & (BUCKETS - 1), h >> 16)):
                        touched[t].append(ids)
                        given[t].append(dx[:, t * HALF : (t + 1) * HALF])
            for p, s, grad in zip(params, sums, grads, strict=True):
                s += grad**2
                p -= rate * 0.3 * grad / np.sqrt(s)
            base_sum += float(d.sum()) ** 2
            model.base -= rate * 0.3 * float(d.sum()) / base_sum**0.5
            for t in range(2):
                ids, back = np.unique(np.concatenate(touched[t]), return_inverse=True)
                grad = np.zeros((len(ids), HALF), np.float32)
                np.add.at(grad, back, np.concatenate(given[t]))
                grad *= seen[t][ids][:, None]
                table_sums[t][ids] += (grad**2).mean(axis=1)
                model.tables[t][ids] -= rate * 0.3 * grad / np.sqrt(table_sums[t][ids])[:, None]
    return model


def best_threshold(score: np.ndarray, y: np.ndarray, weight: float = 1.0) -> float:
    """The score from which "toxic" has the highest F1, halfway to the next lower score; weight: of a row that isn't toxic."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (hits + np.cumsum((1 - y[order]) * weight) + y.sum())
    last = np.append(score[order][:-1] != score[order][1:], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    below = score[order][i + 1] if i + 1 < len(y) else 0.0
    return float((score[order][i] + below) / 2)


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, lang, n, words (hashes), check (kept from training): all labelled documents that are not held out.
    Rows that share a doc_id are reduced to one."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id"))).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [word_hashes(x) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "lang", "toxic", "n", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    found = rows.join(checked_broadcast(marks), "doc_id").select("doc_id", "lang", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), "text")
    hashed = found.mapInArrow(run, "doc_id long, lang string, toxic int, n long, words binary")
    one = hashed.groupBy("doc_id", "toxic").agg(F.min(F.struct("n", "words", "lang")).alias("r")).select("doc_id", "toxic", "r.*")
    return one.withColumn("check", F.crc32(F.concat(F.lit("check"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).checkpoint()


def count_buckets(rows: DataFrame) -> np.ndarray:
    """bucket_counts over all of rows (toxic, words): at most 4 * BUCKETS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, 2, BUCKETS), np.int64)
        for batch in batches:
            met += bucket_counts([np.frombuffer(w, np.uint32) for w in batch.column(1).to_pylist()], batch.column(0).to_numpy())
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met.ravel()[at])], ["at", "n"])

    sums = rows.select("toxic", "words").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    met = np.zeros((2, 2, BUCKETS), np.int64)
    met.ravel()[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return met


def train_shards(rows: DataFrame, model: Model, seen: list[np.ndarray], shards: int) -> Model:
    """The mean of the models that shards of rows (doc_id, toxic, words) train from the given one. A weight that only some
    shards have moved is the mean of theirs; shards count by their documents. The sums are as large as the model."""
    shared = rows.sparkSession.sparkContext.broadcast((model, seen))
    names = [f"d{k}" for k in range(HALF)]

    def run(group: pa.Table) -> pa.Table:
        first, known = shared.value
        data = group.sort_by("doc_id")
        own = first.moved(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HALF), np.float32))
        descend(own, known, [np.frombuffer(w, np.uint32) for w in data["words"].to_pylist()], data["toxic"].to_numpy().astype(np.float32))
        out = []
        for t, (a, b) in enumerate(zip(first.rows(), own.rows(), strict=True)):
            by = (b - a).astype(np.float64)
            at = np.flatnonzero(by.any(axis=1))
            out.append(pa.table([pa.array(np.full(len(at), t)), pa.array(at), pa.array(np.full(len(at), data.num_rows)), *(pa.array(by[at, k] * data.num_rows) for k in range(HALF))], ["t", "at", "n", *names]))
        return pa.concat_tables(out)

    dealt = rows.select("doc_id", "toxic", "words", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    each = dealt.groupBy("shard").applyInArrow(run, "t long, at long, n long, " + ", ".join(f"{x} double" for x in names))
    sums = each.groupBy("t", "at").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow()
    by = np.stack([sums[x].to_numpy() for x in names], axis=1) / sums["n"].to_numpy()[:, None]
    return model.moved(sums["t"].to_numpy(), sums["at"].to_numpy(), by.astype(np.float32))


def binned_threshold(step: np.ndarray, yes: np.ndarray, no: np.ndarray) -> float:
    """best_threshold of scores counted by steps of log-odds: halfway to the next lower step that occurs, as log-odds."""
    order = np.argsort(-step)
    hits, misses = np.cumsum(yes[order]), np.cumsum(no[order])
    i = int(np.argmax(2 * hits / np.maximum(hits + misses + yes.sum(), 1)))
    below = step[order][i + 1] if i + 1 < len(step) else step[order][i] - 1
    return float((step[order][i] + below) / 2 / STEPS)


def calibrate(rows: DataFrame, model: Model) -> Model:
    """The model with its base and thresholds set on all of rows (lang, toxic, words)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores([np.frombuffer(w, np.uint32) for w in batch.column(2).to_pylist()])
            odds = np.clip(np.log(score) - np.log1p(-score), -FAR, FAR) if len(score) else score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(odds * STEPS).astype(np.int64))], ["lang", "toxic", "step"])

    counted = rows.select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, step long")
    steps = counted.groupBy("lang", "step").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).checkpoint()
    every = steps.groupBy("step").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()  # at most 2 * FAR * STEPS rows
    step, yes, no = (every[x].to_numpy() for x in ("step", "yes", "no"))
    if not (yes.sum() and no.sum()):
        return model
    edge = float(np.log(0.02 / 0.98))
    base = min(max(binned_threshold(step, yes, no), edge), -edge)  # then a score of one half is where F1 is highest
    model.base -= base

    def limit(group: pa.Table) -> pa.Table:  # the steps of one language
        return pa.table([group["lang"][:1], pa.array([binned_threshold(*(group[x].to_numpy() for x in ("step", "yes", "no")))])], ["lang", "odds"])

    enough = steps.where("lang is not null").groupBy("lang").agg(F.sum("yes").alias("y"), F.sum("no").alias("n")).where((F.col("y") >= LEAST) & (F.col("n") >= LEAST)).select("lang")
    for r in steps.join(enough, "lang").groupBy("lang").applyInArrow(limit, "lang string, odds double").collect():  # a row per language
        model.thresholds[r.lang] = float(1 / (1 + np.exp(base - r.odds)))
    return model


def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> Model:
    """Trains on four fifths of all labelled documents that are not held out and sets the thresholds on the rest."""
    prepare(docs.sparkSession)
    rows = labelled(docs, labels)
    sums = {(r.check, r.toxic): r for r in rows.groupBy("check", "toxic").agg(F.count("*").alias("n"), F.sum("n").alias("words")).collect()}
    n = np.array([[sums[c, t].n if (c, t) in sums else 0 for t in (0, 1)] for c in (False, True)], np.int64)
    split = bool(n[0].all())  # else too few to keep any from training
    of = n[0] if split else n.sum(axis=0)
    if not of.all():
        return constant(float(of[1] / of.sum()) if of.sum() else 0.0)
    own = rows.where("not check") if split else rows
    words = sum(r.words for r in sums.values())
    model, seen = start(count_buckets(own), of)
    model = train_shards(own, model, seen, max(1, round(int(of.sum()) / shard), -(-words // SHARD_WORDS)))
    return calibrate(rows.where("check"), model) if split else model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold (of the language) and flagged (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of BUCKETS rows: 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = own.scores([word_hashes(x) for x in texts(batch, "text")])
            limit = np.array([own.thresholds.get(x, own.threshold) for x in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(limit)], ["doc_id", "score", "threshold"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, threshold double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")))
