"""File sources and sinks of the research data: JSON records, JSONL ledgers, CSV datasets, profiles, replace-set writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import known
from ..session import shared_folder

#: A hit record, with the fields that all modules share.
PAPER = T.StructType(
    [
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("year", T.IntegerType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("citations", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("source_module", T.StringType()),
        T.StructField("oa_url", T.StringType()),
        T.StructField("is_retracted", T.BooleanType()),
        T.StructField("citations_normalized", T.DoubleType()),
        T.StructField("language", T.StringType()),
        T.StructField("publication_types", T.ArrayType(T.StringType())),
    ]
)
LEDGER = "paper_id string, decision string, reason string, stage string, round string, decided_by string, ts timestamp, ord long"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_records(spark: SparkSession, path: str, schema: T.StructType | str = PAPER, array: bool = False) -> DataFrame:
    """JSON records, one a line or (array) whole files that hold one array; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", array).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An append-only ledger of JSON lines: torn lines and lines without paper_id are dropped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("paper_id is not null")


def read_dataset(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV dataset of strings: trimmed, with codes of missing data as null. A byte-order mark before the header is fine."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    return raw.select(*(known(F.col(f"`{c}`")).alias(c) for c in columns))


def typed(df: DataFrame, scales: dict[str, str]) -> DataFrame:
    """Columns by their declared scale: metric ones as doubles, what doesn't parse as null; others as they are."""
    return df.select(*(F.col(c).try_cast("double").alias(c) if scales.get(c) == "metric" else F.col(c) for c in df.columns))


def profile(spark: SparkSession, path: str | None, defaults: dict[str, float]) -> dict[str, float]:
    """Settings from a file of "key: number" lines; fields that are missing or broken take their default."""
    out = dict(defaults)
    if path is None:
        return out
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\w+)\s*:\s*(-?[\d.]+)\s*(?:#.*)?$", 1).alias("k"), F.regexp_extract("value", r":\s*(-?[\d.]+)", 1).try_cast("double").alias("v"))
    for row in lines.where(F.col("k").isin(*defaults) & F.col("v").isNotNull()).toLocalIterator():
        out[row.k] = row.v
    return out


def profiles(df: DataFrame, key: str, text: str, defaults: dict[str, float]) -> DataFrame:
    """key and a column for each setting: ``profile`` for many texts of "key: number" lines, one a row; of a setting that stands
    there several times the last good one counts."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\n")

    def setting(name: str, default: float) -> Column:
        good = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^\s*{name}\s*:\s*(-?[\d.]+)\s*(?:#.*)?$", 1).try_cast("double")), lambda v: v.isNotNull())
        return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(default)).alias(name)

    return df.select(key, *(setting(k, v) for k, v in defaults.items()))


def page_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, text, n_chars, n_words, readable: what a page shows, without scripts, styles, comments and tags, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    shown = F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text")
    rows = df.select(key, shown)
    return rows.select(key, "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).cast("long").alias("n_words"), (F.col("text") != "").alias("readable"))


def replace_sets(df: DataFrame, path: str, key: str) -> None:
    """Replaces the whole set of rows of each key that df holds; sets of other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def state_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, field, value of the front matter ("---" to "---") of Markdown texts."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    line = df.select(key, F.explode(F.split(head, "\n")).alias("line")).where(F.col("line").contains(":"))
    return line.select(key, F.trim(F.substring_index("line", ":", 1)).alias("field"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))


def sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, title, paragraph: the paragraphs of marked-up texts under their headings."""
    parts = F.split(html, r"(?i)(?=<h[1-6][^>]*>)")
    rows = df.select(key, F.posexplode(parts).alias("pos", "part"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    title = plain(F.regexp_extract("part", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    paragraphs = F.regexp_extract_all("part", F.lit(r"(?is)<p[^>]*>(.*?)(?=<p[ >]|</p>|</article>|$)"), F.lit(1))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), title.alias("title"), F.explode(paragraphs).alias("p")).select(key, "pos", "title", plain(F.col("p")).alias("paragraph")).where("paragraph <> ''")


def tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_index, row, col, value: the cells of the HTML tables in texts."""
    body = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    t = df.select(key, F.posexplode(body).alias("table_index", "t"))
    r = t.select(key, "table_index", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)(?=<tr[ >]|</tr>|$)"), F.lit(1))).alias("row", "r"))
    c = r.select(key, "table_index", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=<t[dh][ >]|</t[dh]>|$)"), F.lit(1))).alias("col", "c"))
    return c.select(key, "table_index", "row", "col", F.trim(F.regexp_replace(F.regexp_replace("c", "<[^>]*>", " "), r"\s+", " ")).alias("value"))
