"""Look-ups in one source after another, each of which sees what those before it left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut


def books(wanted: DataFrame, key: str, sources: dict[str, DataFrame], open_access: DataFrame | None = None) -> DataFrame:
    """key, isbn, source, title, open_access of books (key, isbn) from saved answers (isbn, title, ...) in the order of trust.

    ISBNs are compared as those of 13 digits, whatever form they come in. An answer without a title is none; of several answers
    for one book the first title in order counts. A stage joins the books that no stage before has found, and no others. A book
    without a valid ISBN is found by none. open_access: whether that catalogue lists the book, wherever its title is from.
    """
    rest = cut(wanted.select(key, text.isbn13("isbn").alias("isbn")))
    out = None
    for name, answers in sources.items():
        known = answers.where(F.trim(F.coalesce("title", F.lit(""))) != "").select(text.isbn13("isbn").alias("isbn"), "title").where("isbn is not null")
        hits = cut(rest.join(known.groupBy("isbn").agg(F.min("title").alias("title")), "isbn").select(key, "isbn", F.lit(name).alias("source"), "title"))
        rest = cut(rest.join(hits.select(key), key, "left_anti"))
        out = hits if out is None else out.union(hits)
    none = rest.select(key, "isbn", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("title"))
    out = none if out is None else out.union(none)
    if open_access is None:
        return out.withColumn("open_access", F.lit(False))
    free = open_access.select(text.isbn13("isbn").alias("isbn")).where("isbn is not null").distinct().withColumn("open_access", F.lit(True))
    return out.join(free, "isbn", "left").select(key, "isbn", "source", "title", F.coalesce("open_access", F.lit(False)).alias("open_access"))
