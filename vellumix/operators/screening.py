"""Rule screening and the ledger of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types that the sources' vocabularies name, one vocabulary after the other.
REGISTRY_TYPES = (
    "book", "book-chapter", "book-part", "book-section", "book-series", "book-set", "book-track", "component", "database", "dataset", "dissertation", "edited-book", "grant", "journal", "journal-article",
    "journal-issue", "journal-volume", "monograph", "other", "peer-review", "posted-content", "proceedings", "proceedings-article", "proceedings-series", "reference-book", "reference-entry", "report", "report-component",
    "report-series", "standard",
)
INDEX_TYPES = (
    "article", "book", "book-chapter", "book-review", "conference-abstract", "conference-paper", "data-paper", "dataset", "dissertation", "editorial", "erratum", "letter", "libguides", "other", "paratext", "peer-review",
    "preprint", "reference-entry", "report", "retraction", "review", "software", "software-paper", "standard", "supplementary-materials",
)
SCHOLAR_TYPES = ("review", "journalarticle", "casereport", "clinicaltrial", "conference", "dataset", "editorial", "lettersandcomments", "metaanalysis", "news", "study", "book", "booksection")
# Types that name none, and spellings of one type.
UNINFORMATIVE = ("casereport", "clinicaltrial", "metaanalysis", "other", "study")
TYPE_ALIASES = {
    "article": "journal-article", "conference-paper": "proceedings-article", "journalarticle": "journal-article", "conferencepaper": "proceedings-article", "conference": "proceedings-article", "booksection": "book-chapter",
    "lettersandcomments": "letter", "review": "journal-article",
}


def publication_type(c: Column) -> Column:
    """Common form of a publication type; null for what no vocabulary knows or what names no type, as it excludes nothing."""
    low = F.lower(F.trim(c))
    alias = F.create_map(*(F.lit(x) for pair in TYPE_ALIASES.items() for x in pair))
    known = [t for t in dict.fromkeys((*REGISTRY_TYPES, *INDEX_TYPES, *SCHOLAR_TYPES)) if t not in UNINFORMATIVE]
    return F.coalesce(F.try_element_at(alias, low), F.when(low.isin(*known), low))


def publication_types(several: Column, one: Column) -> Column:
    """Common forms of all types of a record, each once; the single one counts where there is no list."""
    given = F.when(F.size(several) > 0, several).otherwise(F.array(one))
    return F.array_distinct(F.filter(F.transform(given, publication_type), lambda t: t.isNotNull()))


def violation(year: Column, language: Column, kinds_found: Column, year_min: int | None = None, year_max: int | None = None, languages: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> Column:
    """The first criterion that a paper violates: period, language, type; missing data violate nothing, and of several
    types one that is allowed will do. kinds are taken in any spelling."""
    out = F.lit(None).cast("string")
    if kinds is not None:
        allowed = [TYPE_ALIASES.get(k.strip().lower(), k.strip().lower()) for k in kinds]
        out = F.when((F.size(kinds_found) > 0) & ~F.arrays_overlap(kinds_found, F.array(*map(F.lit, allowed))), "publication_type").otherwise(out)
    if languages is not None:
        out = F.when(~F.lower(F.trim(language)).isin(*languages) & (F.trim(language) != ""), "language").otherwise(out)
    period = F.lit(False)
    if year_min is not None:
        period = period | (year < year_min)
    if year_max is not None:
        period = period | (year > year_max)
    return F.when(period, "period").otherwise(out)


def freshness(doi: Column, checked_at: Column, now: int, max_age_days: int, force: bool = False) -> Column:
    """no_doi, fresh (checked within the days) or to_check (never, too long ago, or all if forced); times in seconds."""
    fresh = F.lit(False) if force else F.coalesce(checked_at >= now - max_age_days * 86_400, F.lit(False))
    return F.when(F.coalesce(doi, F.lit("")) == "", "no_doi").when(fresh, "fresh").otherwise("to_check")


def rounds(ledger: DataFrame, stage: str = "screening") -> DataFrame:
    """A row per paper with the last decision of each round; rows by rule stay out."""
    rows = ledger.where((F.col("stage") == stage) & (F.col("decided_by") != "rule"))
    last = lambda r: F.max_by("decision", F.when(F.col("round") == r, F.col("ord")))
    return rows.groupBy("paper_id").agg(last("1").alias("r1"), last("2").alias("r2"), last("human").alias("human"))


def consolidate(ledger: DataFrame, stage: str = "screening") -> DataFrame:
    """paper_id, bucket: people decide over agreement over dissent; rule exclusions as they are; incomplete pairs absent."""
    pairs = rounds(ledger, stage).where("r1 is not null and r2 is not null")
    bucket = F.coalesce("human", F.when(F.col("r1") == F.col("r2"), F.col("r1")).otherwise("dissent"))
    ruled = ledger.where((F.col("stage") == stage) & (F.col("decided_by") == "rule") & (F.col("decision") == "exclude")).select("paper_id").distinct()
    return pairs.select("paper_id", bucket.alias("bucket")).union(ruled.select("paper_id", F.lit("exclude")))


def merged(ledger: DataFrame, stage: str) -> DataFrame:
    """paper_id, decision: the last first-round or rule decision of a stage."""
    rows = ledger.where((F.col("stage") == stage) & ((F.col("round") == "1") | (F.col("decided_by") == "rule")))
    return rows.groupBy("paper_id").agg(F.max_by("decision", "ord").alias("decision"))


def kappa(pairs: DataFrame, a: str = "r1", b: str = "r2") -> DataFrame:
    """kappa, n, po, pe of two raters, rounded to four places; the cells of the table are few."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("c").alias("x")), cells.groupBy("b").agg(F.sum("c").alias("y"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    row = total.crossJoin(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("xy") / (F.col("n") * F.col("n"))).alias("pe"))
    value = F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return row.select(F.round(value, 4).alias("kappa"), F.coalesce("n", F.lit(0)).alias("n"), F.round("po", 4).alias("po"), F.round("pe", 4).alias("pe"))


def resume(pending: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that aren't done yet."""
    return pending.join(done.select(*keys).distinct(), list(keys), "left_anti")
