"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Method. Trusted text is that of the documents labelled with quality 1; all of it is counted, so the model grows with the
input. Its symbols are the bytes of the texts, its order is five. Tasks count the trusted texts' n-grams; sharded
aggregates and joins (by n-gram, context and suffix) turn the counts into modified Kneser-Ney probabilities: three
discounts per order from the counts of counts, continuation counts below the top order, and interpolation down to the
uniform distribution. The documents' distinct n-grams, seen in trusted text or not, are joined with these tables order
by order (``probabilities``). What each document's n-grams got is looked up in that table, which is broadcast if it has
at most ``LOOKUP`` rows; else documents' n-grams and table are joined and summed (``join_totals``), with equal results.

Documents are dealt into two folds by a hash of their text, so that equal texts share one, and each is scored by the
model of the other fold's trusted text, labelled or not: a label never decides how its own document is scored. A
document is rejected if its perplexity, its log shrunk towards the language's trusted mean by ``PRIOR`` symbols (short
texts say little), lies above the ``quantile`` of its language's trusted documents. A language's quantile is
shrunk towards that of all languages by ``PEERS`` documents, alike at every size.

An n-gram model of any width finds a common word no less likely for standing there the twentieth time in a row, so two
more shares are held against the same quantile of the language's trusted documents: that of words which double the one
before them, and that of pairs of words which the document has had before; both are shrunk towards the language's
trusted mean by ``PRIOR`` words.

Defined cases: a null text is empty; an empty text has the perplexity of its language's mean and is kept; a null
language is a language of its own; a document is trusted if any of its label rows has quality 1 and none has 0;
repeated rows are scored one by one; if one fold alone has trusted text, it serves both; without any trusted text all
documents are kept; further columns are kept by ``filter_quality`` and ignored by ``perplexity``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checked_broadcast, prepare, read, slices, stored, sweep, text_or_empty, texts

ORDER, SIZE = 5, 256
#: Share of a language's trusted documents that lie below its threshold.
QUANTILE = 0.999
#: Symbols of mean log-probability, and words of mean repetition, that are added to each document.
PRIOR = 40
#: Trusted documents whose common quantile is added to a language's own.
PEERS = 100
#: Of percentile_approx: ranks are exact to this part of the rows.
ACCURACY = 100_000
#: Bytes of text that are scored, and counted, at once.
CHUNK, COUNTED = 1 << 18, 1 << 20
#: Rows of n-grams with their log-probability (12 bytes each) that may be broadcast.
LOOKUP = 8_000_000
#: Rows up to which a table of fixed size (all n-grams of a low order, in two folds) is one partition.
TABLE = 1 << 17
#: Counts of repetition that are held against the trusted documents' beside the perplexity.
REPEATS = ("doubled", "again")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _codes(rows: list[bytes], half: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram code that ends at each byte, its fold on top, and each row's first and last byte among them."""
    pad = b"\0" * (ORDER - 1)
    x = np.frombuffer(pad + pad.join(rows), np.uint8).astype(np.int64)
    code = x[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        code += x[ORDER - 1 - back : len(x) - back] << (8 * back)
    sizes = np.array([len(r) for r in rows], np.int64)
    start = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    fold = np.zeros(len(code) + 1, np.int64)  # that of the row from its first byte on; the padding behind it is left out
    np.add.at(fold, start, np.diff(half, prepend=0))
    return code + (np.cumsum(fold)[:-1] << (8 * ORDER)), start, start + sizes


def _inside(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks)[:-1] > 0


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_ngrams(docs: DataFrame) -> DataFrame:
    """half, g, c: counts of the n-grams of (half, text), pre-summed by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, rows = batch.column(0).to_pylist(), texts(batch, "text")
            for a, b in slices([len(r) for r in rows], COUNTED):
                code, start, end = _codes(rows[a:b], half[a:b])
                g, c = np.unique(code[_inside(len(code), start, end)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int32))], ["code", "c"])

    return _unpacked(docs.select("half", "text").mapInArrow(run, "code long, c int").groupBy("code").agg(F.sum("c").alias("c")), "c")


def _unpacked(rows: DataFrame, *others: str) -> DataFrame:
    """half and g of a code."""
    return rows.select(F.shiftright("code", 8 * ORDER).cast("int").alias("half"), F.col("code").bitwiseAND(F.lit((1 << (8 * ORDER)) - 1)).alias("g"), *others)


def distinct_ngrams(docs: DataFrame) -> DataFrame:
    """half, g: the n-grams of (half, text). Tasks pass over those they remember to have met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.full(1 << 20, -1, np.int64)
        for batch in batches:
            half, rows = batch.column(0).to_pylist(), texts(batch, "text")
            for a, b in slices([len(r) for r in rows], CHUNK):
                code, start, end = _codes(rows[a:b], half[a:b])
                code = code[_inside(len(code), start, end)]
                slot = (code.view(np.uint64) * MULTIPLIER >> np.uint64(44)).view(np.int64)
                new = np.flatnonzero(met[slot] != code)
                met[slot[new]] = code[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(code[new]))], ["code"])

    return _unpacked(docs.select("half", "text").mapInArrow(run, "code long").distinct())


def _discounts(counts: DataFrame) -> DataFrame:
    """half, d1, d2, d3: the three discounts of modified Kneser-Ney, from the counts of counts."""
    n = [F.count_if(F.col("c") == k) for k in range(1, 5)]
    rows = counts.groupBy("half").agg(*(x.alias(f"n{k}") for k, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        found = F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k)))
        return F.when((F.col("n1") == 0) | (F.col("n2") == 0), 0.5).when(F.col(f"n{k}") == 0, k / 2).otherwise(found)

    return rows.select("half", *(discount(k).alias(f"d{k}") for k in (1, 2, 3)))


def _together(rows: DataFrame, k: int, size: int) -> DataFrame:
    """Rows of distinct k-grams in one partition where there can't be more than ``TABLE`` of them, however large the input:
    joins and sums of them then need no shuffle."""
    return rows.coalesce(1) if 2 * size**k <= TABLE else rows


def kneser_ney(counts: DataFrame, size: int = SIZE, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: rows (half, g, p) of the n-grams seen, and (half, x, gamma), the weight of the order below.

    counts: (half, g, c) of the top order, a gram's code being that of its symbols in base size.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("half", (F.col("g") % size**k).alias("g")).agg(F.count("*").alias("c"))
        levels[k] = _together(levels[k], k, size).checkpoint()
    sweep(counts.sparkSession)
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        table = levels[k].withColumn("x", F.expr(f"g div {size}"))
        table = table.join(F.broadcast(_discounts(table)), "half")  # a row per fold
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.select("half", "g", "x", "c", off.alias("off")).checkpoint()
        ctx = table.groupBy("half", "x").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("gamma"))
        seen = table.join(ctx, ["half", "x"]).withColumn("s", F.col("g") % size ** (k - 1))
        below = out[-1][0].select("half", F.col("g").alias("s"), F.col("p").alias("q")) if out else None
        seen = seen.join(below, ["half", "s"]) if below is not None else seen.withColumn("q", F.lit(1.0 / size))
        p = F.greatest(F.col("c") - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("q")
        out.append((seen.select("half", "g", p.alias("p")).checkpoint(), ctx.select("half", "x", "gamma").checkpoint()))
        del levels[k], table, ctx, seen, below
        sweep(counts.sparkSession)
    return out


def probabilities(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]], size: int = SIZE) -> DataFrame:
    """half, g, logp of distinct n-grams (half, g) of the top order, whether the model has seen them, their contexts, or none."""
    below = None
    for k, (seen, ctx) in enumerate(levels, 1):
        need = _together(grams.select("half", (F.col("g") % size**k).alias("g")).distinct(), k, size) if k < len(levels) else grams.select("half", "g")
        rows = need.withColumn("x", F.expr(f"g div {size}")).withColumn("s", F.col("g") % size ** (k - 1))
        rows = rows.join(seen, ["half", "g"], "left").join(ctx, ["half", "x"], "left")
        rows = rows.join(below, ["half", "s"]) if below is not None else rows.withColumn("q", F.lit(1.0 / size))
        p = F.coalesce(F.col("p"), F.coalesce("gamma", F.lit(1.0)) * F.col("q"))
        last, below = below, rows.select("half", F.col("g").alias("s"), p.alias("q")).checkpoint()
        del rows, need, last
        sweep(grams.sparkSession)  # this order's shuffles go before the next one's come
    return below.select("half", F.col("s").alias("g"), F.log(F.greatest("q", F.lit(1e-12))).alias("logp"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def train(docs: DataFrame, labels: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """The tables of kneser_ney by the fold that they score, hence of the other fold's trusted documents; None without any."""
    prepare(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(checked_broadcast(trusted_ids(labels)), "doc_id", "left_semi")
    counts = count_ngrams(text.select(fold_of(F.col("text")).alias("half"), "text")).checkpoint()
    there = {r.half for r in counts.select("half").distinct().collect()}
    if not there:
        return None
    other = F.lit(1) - F.col("half") if len(there) == 2 else F.explode(F.array(F.lit(0), F.lit(1)))
    return kneser_ney(counts.select(other.alias("half"), "g", "c"))


def repetition(text: bytes) -> tuple[int, int, int]:
    """Number of words, of words equal to the one before, and of pairs of words that the text has had before."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in text.lower().split()], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    return len(ids), int((ids[1:] == ids[:-1]).sum()), len(pairs) - len(np.unique(pairs))


class Lookup:
    """Values of codes that are all there: codes in buckets by a hash's top bits."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(1, int(len(codes) * 2).bit_length()))
        h = self._bucket(codes)
        order = np.argsort(h, kind="stable")
        self.codes, self.values = codes[order], values[order].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(h, minlength=1 << int(64 - self.shift)))]).astype(np.int32)

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * MULTIPLIER >> self.shift).view(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.start[self._bucket(codes)]
        left = np.flatnonzero(self.codes[at] != codes)
        while len(left):
            at[left] += 1
            left = left[self.codes[at[left]] != codes[left]]
        return self.values[at]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).withColumn("half", fold_of(F.col("text")))


MEASURES = "n long, words long, doubled long, again long"


def looked_up_totals(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, lang, total (log-probability), n (symbols), words, doubled and again of each row, the scores broadcast."""
    found = scores.select((F.col("half").cast("long") * (1 << (8 * ORDER)) + F.col("g")).alias("g"), F.col("logp").cast("float").alias("p")).toArrow()  # at most LOOKUP rows
    table = Lookup(found["g"].to_numpy().astype(np.int64), found["p"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, half = texts(batch, "text"), batch.column(3).to_pylist()
            sizes = [len(r) for r in every]
            total = np.zeros(len(every))
            for a, b in slices(sizes, CHUNK):
                code, start, end = _codes(every[a:b], half[a:b])
                inside = _inside(len(code), start, end)
                logp = np.zeros(len(code) + 1)
                logp[1:][inside] = shared.value(code[inside])
                sums = np.cumsum(logp)
                total[a:b] = sums[end] - sums[start]
            again = np.array([repetition(r) for r in every], np.int64).reshape(-1, 3)
            columns = [batch.column(0), batch.column(1), pa.array(total), pa.array(np.array(sizes, np.int64)), *(pa.array(again[:, k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "total", "n", "words", *REPEATS])

    return rows.mapInArrow(run, f"doc_id long, lang string, total double, {MEASURES}")


def join_totals(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """The same by a join of the rows' n-grams with the scores, which may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts(batch, "text")):
                code, start, end = _codes([text], [0])
                g, c = np.unique(code[start[0] : end[0]], return_counts=True)
                again = repetition(text)
                for a in range(0, max(len(g), 1), 1 << 16):  # one row at least, with the measures; a code of -1 is in no table
                    part = (g[a : a + (1 << 16)], c[a : a + (1 << 16)]) if len(g) else (np.array([-1]), np.array([0]))
                    m = len(part[0])
                    same = [pa.array([batch.column(k)[i].as_py()] * m, batch.schema.field(k).type) for k in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part[0]), pa.array(part[1]), *(pa.array([x] * m, pa.int64()) for x in (len(text), *again))], ["doc_id", "lang", "half", "row", "g", "c", "n", "words", *REPEATS])

    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    grams = numbered.mapInArrow(run, f"doc_id long, lang string, half int, row long, g long, c long, {MEASURES}")
    joined = grams.join(scores, ["half", "g"], "left")
    return joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.coalesce(F.sum(F.col("c") * F.col("logp")), F.lit(0.0)).alias("total"), *(F.first(x).alias(x) for x in ("n", "words", *REPEATS))).drop("row")


def log_scores(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]] | None, limit: int | None = None) -> DataFrame:
    """doc_id, lang, total, n, words, doubled, again of each row of docs. Without a model all totals are 0."""
    rows, modelled = _measured(docs), levels is not None
    scores = probabilities(distinct_ngrams(rows).checkpoint(), levels) if levels else rows.select("half", F.lit(0).cast("long").alias("g"), F.lit(0.0).alias("logp")).where("false")
    scores = scores.checkpoint()
    del levels
    sweep(docs.sparkSession)
    limit = LOOKUP if limit is None else limit
    small = modelled and scores.limit(limit + 1).count() <= limit
    return looked_up_totals(rows, scores) if small else join_totals(rows, scores)


def _shrunk(mean: Column) -> Column:
    """Log-perplexity with PRIOR symbols of the mean added."""
    return (-F.col("total") + PRIOR * mean) / (F.col("n") + PRIOR)


def _share(count: str, mean: Column) -> Column:
    """Share of a document's words, with PRIOR words of the mean added."""
    return (F.col(count) + PRIOR * mean) / (F.col("words") + PRIOR)


def perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep: one row per row of docs."""
    prepare(docs.sparkSession)
    ids = checked_broadcast(trusted_ids(labels)).withColumn("trusted", F.lit(True))
    scored = log_scores(docs, train(docs, labels)).join(ids, "doc_id", "left").checkpoint()
    sweep(docs.sparkSession)
    trusted = scored.where("trusted")
    names = ("total", *REPEATS)
    mean = {x: F.sum(x) / F.sum("words") for x in REPEATS} | {"total": -F.sum("total") / F.sum("n")}
    means = checked_broadcast(trusted.groupBy(F.col("lang").alias("of")).agg(*(mean[x].alias(f"mean_{x}") for x in names)))
    whole = trusted.agg(*(mean[x].alias(f"all_mean_{x}") for x in names))
    of = F.col("lang").eqNullSafe(F.col("of"))
    value = lambda x, mean: _shrunk(mean) if x == "total" else _share(x, mean)

    def limits_of(prefix: str) -> list[Column]:
        found = [(F.first(f"{prefix}mean_{x}").alias(f"{prefix}mean_{x}"), F.percentile_approx(value(x, F.col(f"{prefix}mean_{x}")), quantile, ACCURACY).alias(f"{prefix}lim_{x}")) for x in names]
        return [c for pair in found for c in pair]

    limits = trusted.join(means, of).groupBy("of").agg(*limits_of(""), F.count("*").alias("n_trusted"))
    overall = trusted.crossJoin(F.broadcast(whole)).agg(*limits_of("all_"))
    rows = scored.join(checked_broadcast(limits), of, "left").crossJoin(F.broadcast(overall))  # overall: one row
    center = {x: F.coalesce(f"mean_{x}", f"all_mean_{x}", F.lit(0.0)) for x in names}
    weight = F.coalesce("n_trusted", F.lit(0))
    limit = {x: (weight * F.coalesce(f"lim_{x}", F.lit(0.0)) + PEERS * F.col(f"all_lim_{x}")) / (weight + PEERS) for x in names}
    score = F.exp(F.when(F.col("n") > 0, _shrunk(center["total"])).otherwise(center["total"]))
    rows = rows.withColumn("perplexity", score).withColumn("threshold", F.exp(limit["total"]))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    for x in REPEATS:
        keep = keep & F.coalesce(value(x, center[x]) <= limit[x], F.lit(True))
    return rows.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", "threshold", (keep | (F.col("n") == 0)).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the classifier keeps; columns as they were.

    Rejected rows are told by doc_id: where rows share one, any rejection drops them all; a null doc_id stays.
    """
    drop = perplexity(docs, labels, quantile).where("not keep and doc_id is not null").select("doc_id").distinct()
    return docs.join(checked_broadcast(drop), "doc_id", "left_anti").select(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept documents with their perplexity and their language's threshold."""
    prepare(spark)
    return perplexity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).where("keep").drop("keep")
