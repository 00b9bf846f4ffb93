"""Scores of papers: recency, quality, authority, access, and their weighted sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import family_variants

HALF_LIFE = 5.0
# Weights of the five dimensions.
WEIGHTS = {"relevance": 0.35, "recency": 0.20, "quality": 0.15, "authority": 0.15, "access": 0.15}
# Words in a venue's name, by tier.
TOP_VENUES = ("ieee", "acm", "springer", "nature", "elsevier")
JOURNALS = ("journal",)
CONFERENCES = ("conference", "proceedings", "workshop", "symposium")


def recency(year: Column, now: int, half_life: float = HALF_LIFE) -> Column:
    """Exponential decay by age, at most 1; without a year 0."""
    if half_life <= 0:
        return F.when(year >= now, 1.0).otherwise(0.0)
    return F.coalesce(F.least(F.exp(-math.log(2) * (F.lit(now) - year) / half_life), F.lit(1.0)), F.lit(0.0))


def quality(citations: Column, year: Column, now: int, normalized: Column) -> Column:
    """Half the field-normalised citations, or else log-scaled citations by age; within 0 and 1."""
    raw = F.least(F.log10(F.coalesce(citations, F.lit(0)) / F.greatest(F.lit(1), F.lit(now) - year) + 1) / 2, F.lit(1.0))
    return F.when(normalized.isNotNull(), F.greatest(F.lit(0.0), F.least(normalized / 2, F.lit(1.0)))).otherwise(F.coalesce(raw, F.lit(0.0)))


def authority(venue: Column) -> Column:
    has = lambda keys: F.lower(venue).rlike("|".join(keys))
    return F.when(has(TOP_VENUES), 1.0).when(has(JOURNALS), 0.7).when(has(CONFERENCES), 0.4).otherwise(0.2)


def access(oa_url: Column, doi: Column, url: Column) -> Column:
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(oa_url), 1.0).when(given(doi), 0.5).when(given(url), 0.2).otherwise(0.0)


def weighted(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the given dimensions, weights scaled to one, within 0 and 1."""
    total = sum(weights[k] for k in parts)
    share = {k: (weights[k] / total if total > 0 else 1 / len(parts)) for k in parts}
    value = sum((F.lit(share[k]) * c for k, c in parts.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def cluster_label(score: Column, relevance: Column, methods: Column) -> Column:
    return F.when((score >= 0.75) & (relevance >= 0.80), "core").when(methods, "methods").when((score >= 0.50) & (relevance >= 0.50), "supplementary").when(score >= 0.30, "background").otherwise("peripheral")


# Scores from which a candidate is confirmed, or probable.
CONFIRMED, PROBABLE = 80, 65


def author_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two lists of family names, names being equal if any of their variants are; 0 for empty lists."""
    named = lambda a: F.filter(F.transform(a, family_variants), lambda v: F.size(v) > 0)
    a, b = named(left), named(right)
    both = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.arrays_overlap(x, y))))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)), F.lit(0.0))


def candidate_score(family: Column, year: Column, authors: Column, found_authors: Column, found_year: Column) -> Column:
    """0 to 100, how well a found record fits a citation: 40 for the family name, without which the score is 0; 30 for the
    year, 15 for one beside it; up to 30 for the citation's further authors."""
    hit = F.exists(found_authors, lambda x: F.arrays_overlap(family_variants(x), family_variants(family)))
    gap = F.abs(found_year - year)
    score = 40 + F.when(gap == 0, 30).when(gap == 1, 15).otherwise(0) + F.floor(30 * author_overlap(F.slice(authors, 2, 100), found_authors) + 0.5)
    return F.when(hit, score).otherwise(0).cast("long")


def candidate_class(score: Column, unavailable: Column) -> Column:
    return F.when(score >= CONFIRMED, "confirmed").when(score >= PROBABLE, "probable").when(unavailable, "unavailable").otherwise("no-match")
