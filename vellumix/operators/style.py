"""Style and overlap of texts."""

from __future__ import annotations

from collections import Counter
from heapq import nlargest

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CITATION_COMMANDS
from ..session import cut
from .relational import checked_broadcast

# Shares of common n-grams, in percent, from which a text is suspicious, by n.
OVERLAP_LIMITS = {3: 40, 4: 25, 5: 15, 6: 8, 7: 5}
# Words that link sentences, that fill, and limits of the style metrics.
TRANSITIONS = ("darüber hinaus", "furthermore", "moreover", "zusätzlich", "in conclusion")
FILLERS = ("quasi", "eigentlich", "irgendwie", "sozusagen", "gewissermaßen")
NOMINAL = "(ung|heit|keit|tion)$"
NOMINAL_WORD = r"\p{L}*(?:ung|heit|keit|tion)(?!\p{L})"
PASSIVE = r"\b(wird|werden|wurde|wurden)\b.*\b(ge\p{L}+(t|en)|\p{L}+iert)\b"
LIMITS = {"mean_sentence": (15, 25), "passive_share": (None, 0.30), "nominal_share": (None, 0.40), "filler_share": (None, 0.05), "sd_sentence": (5, None), "top10_share": (None, 0.15), "transitions": (None, 2.0)}


def ngrams(df: DataFrame, key: str, levels: tuple[int, ...], text: str = "text") -> DataFrame:
    """key, n, g: hashes of each text's word n-grams, lower-cased, for several n; words are split and hashed once for all."""
    h = F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda t: F.xxhash64(t))
    rows = df.select(key, h.alias("h")).where(F.size("h") >= min(levels))

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(n))))
        return F.struct(F.lit(n).alias("n"), F.when(F.size("h") >= n, grams).alias("grams"))

    each = rows.select(key, F.inline(F.array(*map(of, levels))).alias("n", "grams"))
    return each.select(key, "n", F.explode("grams").alias("g"))


def overlap_levels(items: DataFrame, item: str, corpus: DataFrame, levels: tuple[int, ...] = tuple(OVERLAP_LIMITS)) -> DataFrame:
    """item, n, grams (distinct), shared (those that occur in the corpus), percent, flagged (over the level's limit) for each level.

    The corpus is read once for all levels. The items' hashes are broadcast if they are few enough, so that only what
    they share with the corpus is shuffled.
    """
    g = cut(ngrams(items, item, levels).distinct())
    own = checked_broadcast(g.select("n", "g").distinct())
    seen = ngrams(corpus, "doc_id", levels).select("n", "g").join(own, ["n", "g"], "left_semi").distinct().withColumn("s", F.lit(1))
    out = g.join(seen, ["n", "g"], "left").groupBy(item, "n").agg(F.count("*").alias("grams"), F.count("s").alias("shared"))
    limit = F.create_map(*(F.lit(x) for pair in OVERLAP_LIMITS.items() for x in pair))
    out = out.withColumn("percent", F.round(100.0 * F.col("shared") / F.col("grams"), 4))
    return out.select(item, "grams", "shared", "percent", "n", (F.col("percent") > limit[F.col("n")]).alias("flagged"))


def overlap_severity(levels: DataFrame, item: str) -> DataFrame:
    """item, severity: high by 7-grams, medium by 5-grams, low by 4-grams, else none."""
    over = lambda n: F.max(F.when(F.col("n") == n, F.col("flagged")).otherwise(False))
    return levels.groupBy(item).agg(F.when(over(7), "high").when(over(5), "medium").when(over(4), "low").otherwise("none").alias("severity"))


def _word_figures(low: Column) -> Column:
    """struct(words, types, top, content, repeated) of a lower-cased text: counts of words, of distinct ones, of the ten commonest of
    four letters or more, of all of those, and of three-word phrases met over twice. Counts by hash tables over Arrow batches,
    where column functions would sort arrays of strings."""

    def run(texts: pd.Series) -> pd.DataFrame:
        find = regex.compile(r"\p{L}+").findall
        rows = []
        for t in texts:
            w = find(t or "")
            content = Counter(x for x in w if len(x) >= 4)
            phrases = Counter(zip(w, w[1:], w[2:], strict=False))
            rows.append((len(w), len(set(w)), sum(nlargest(10, content.values())), content.total(), sum(n > 2 for n in phrases.values())))
        return pd.DataFrame(rows, columns=["words", "types", "top", "content", "repeated"], dtype="int64")

    return F.pandas_udf(run, "words long, types long, top long, content long, repeated long")(low)


def style_metrics(docs: DataFrame) -> DataFrame:
    """Of each text: words, distinct words; mean, median and standard deviation of the sentences' words; shares of passive
    sentences and of nominal ones (three nouns by their endings); fillers among words; linking words and sources in
    1,000 words; the ten commonest words' share of those of four letters or more; three-word phrases met over twice."""
    low = F.lower("text")
    s = F.filter(F.split(low, r"[.!?]+\s+"), lambda t: t.rlike(r"\p{L}"))
    rows = docs.select("doc_id", "text", _word_figures(low).alias("f"), s.alias("s"))
    n = F.greatest(F.col("f.words"), F.lit(1))
    m = F.greatest(F.size("s"), F.lit(1))
    lengths = F.transform("s", lambda t: F.regexp_count(t, F.lit(r"\p{L}+")))
    rows = rows.withColumn("l", F.sort_array(lengths))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    mean = total("l") / m
    middle = (F.get("l", F.floor((F.size("l") - 1) / 2).cast("int")) + F.get("l", F.floor(F.size("l") / 2).cast("int"))) / 2.0
    share = lambda f: F.round(F.size(F.filter("s", f)) / m, 6)
    filler = F.regexp_count(low, F.lit(r"(?<!\p{L})(?:" + "|".join(FILLERS) + r")(?!\p{L})"))
    return rows.select(
        "doc_id",
        F.col("f.words").alias("n_words"),
        F.col("f.types").alias("n_types"),
        F.round(mean, 4).alias("mean_sentence"),
        F.coalesce(middle, F.lit(0.0)).alias("median_sentence"),
        F.round(F.sqrt(F.greatest(total(F.transform("l", lambda x: (x - mean) * (x - mean))) / m, F.lit(0.0))), 4).alias("sd_sentence"),
        share(lambda t: t.rlike(PASSIVE)).alias("passive_share"),
        share(lambda t: F.regexp_count(t, F.lit(NOMINAL_WORD)) >= 3).alias("nominal_share"),
        F.round(filler / n, 6).alias("filler_share"),
        F.round(1000.0 * sum((F.regexp_count(F.lower("text"), F.lit(x)) for x in TRANSITIONS), F.lit(0)) / n, 4).alias("transitions"),
        F.round(1000.0 * F.regexp_count("text", F.lit(r"\([^()]*(?:19|20)\d\d[^()]*\)")) / n, 4).alias("sources"),
        F.round(F.when(F.col("f.content") > 0, F.col("f.top") / F.col("f.content")).otherwise(0.0), 6).alias("top10_share"),
        F.col("f.repeated").alias("repeated"),
    )


def layout_findings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, rule, n: lines with the list command where the text does not define it, and citing commands escaped twice."""
    cite = r"\\textbackslash\{\}(?:" + "|".join(CITATION_COMMANDS) + r")\*?\{"
    defined = F.col(text).rlike(r"\\(?:providecommand|newcommand)\{\\tightlist\}")
    lines = docs.select(key, defined.alias("defined"), F.posexplode(F.split(text, "\n")).alias("p", "line"))
    bare = F.when(~F.col("defined") & F.col("line").rlike(r"^\s*\\tightlist\s*$"), 1).otherwise(0)
    found = F.array(F.struct(F.lit("missing-tightlist-definition").alias("rule"), bare.cast("long").alias("n")), F.struct(F.lit("corrupted-cite-command").alias("rule"), F.regexp_count("line", F.lit(cite)).cast("long").alias("n")))
    return lines.select(key, (F.col("p") + 1).cast("long").alias("pos"), F.inline(found).alias("rule", "n")).where("n > 0")
