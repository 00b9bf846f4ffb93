"""Evidence: quotations found in texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text
from ..session import cut
from .fuzzy import alignment
from .relational import checked_broadcast, range_join

#: Bytes of quotes that are searched for at a time.
BLOCK = 16 << 20
#: Chapters of a year that are held at a time.
CHAPTERS = 1 << 16


def containment(docs: DataFrame, quotes: DataFrame, keep: bool = False, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id) where a quote occurs in a text; with keep also text and quote.

    The quotes are the query set: an automaton of all of a block's, of a bounded size, goes over each text once, however
    many quotes it holds. Texts are never shuffled; quotes longer than a block are a block of their own.
    """
    q = quotes.where(F.col("text") != "").select("item_id", F.col("text").alias("quote"))
    blocks = max(1, math.ceil((q.agg(F.sum(F.octet_length("quote"))).first()[0] or 0) / block))
    ids, keys = dict(q.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    schema = f"item_id {ids}, doc_id {keys}" + (", text string, quote string" if keep else "")
    found = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == i)
        rows = part.toArrow()  # about a block's bytes
        names = [(rows["item_id"][k].as_py(), rows["quote"][k].as_py()) for k in range(rows.num_rows)]
        shared = docs.sparkSession.sparkContext.broadcast(names)
        hits = docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_search(shared, keep, rows["item_id"].type), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _search(shared, keep: bool, kind: pa.DataType):
    """Finds the broadcast quotes (item_id, quote) in (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        items: dict[str, list] = {}
        for item, quote in shared.value:
            items.setdefault(quote, []).append(item)
        for quote in items:
            automaton.add_word(quote, quote)
        if items:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for quote in dict.fromkeys(q for _, q in automaton.iter(text)) if items else ():
                    rows += [(item, doc, text, quote) for item in items[quote]]
            columns = (("item_id", kind), ("doc_id", batch.schema.field(0).type), ("text", pa.string()), ("quote", pa.string()))[: 4 if keep else 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])

    return run


def page_coverage(checks: DataFrame, samples: DataFrame, extents: DataFrame, width: int = 16) -> DataFrame:
    """check_id, status of pages (check_id, paper_id, page, page_end or null): covered, outside or unknown.

    A known page (samples: paper_id, page) within the range covers it; else the paper's whole extent (extents: paper_id,
    page_first, page_last, one row a paper) decides where it is known; else known pages elsewhere speak against it.
    """
    end = F.coalesce("page_end", "page")
    c = checks.select("check_id", "paper_id", F.least("page", end).alias("lo"), F.greatest("page", end).alias("hi"))
    pages = samples.where("page is not null").select("paper_id", "page").distinct()
    hits = range_join(pages, c, ["paper_id"], "lo", "hi", "page", width).select("check_id").distinct().withColumn("hit", F.lit(True))
    have = pages.select("paper_id").distinct().withColumn("sampled", F.lit(True))
    rows = c.join(hits, "check_id", "left").join(have, "paper_id", "left").join(extents.select("paper_id", "page_first", "page_last"), "paper_id", "left")
    inside = (F.col("hi") >= F.col("page_first")) & (F.col("lo") <= F.col("page_last"))
    status = F.when(F.col("hit"), "covered").when(inside.isNotNull(), F.when(inside, "covered").otherwise("outside")).when(F.col("sampled"), "outside").otherwise("unknown")
    return rows.select("check_id", status.alias("status"))


def cited_in(papers: DataFrame, chapters: DataFrame, block: int = CHAPTERS) -> DataFrame:
    """paper_id, chapters, ambiguous of papers (paper_id, families: array, year) that chapters (chapter_id, text) seem to cite.

    A chapter cites a paper if it holds its year and, as a word, one of its authors' family names in any of that name's forms
    (umlauts spelled out, accents dropped, with or without particles). chapters: how many do; ambiguous: in one of them another
    paper with the same year and name would do as well. Papers of one year with the same forms are one set. Sets meet the chapters
    with their year, a block of these at a time, as lists of the chapters that hold a form: the pairs of a paper and a chapter,
    which grow with the square, are counted but never made rows.
    """
    named = papers.where(F.col("year").isNotNull()).select("paper_id", F.col("year").cast("int").alias("year"), F.explode("families").alias("family")).where("family is not null")
    forms = cut(named.select("paper_id", "year", F.explode(text.family_variants("family")).alias("form")).where("form <> ''").distinct())
    many = forms.groupBy("form", "year").agg((F.count("*") > 1).alias("many"))
    sets = cut(forms.join(many, ["form", "year"]).groupBy("paper_id", "year").agg(F.sort_array(F.collect_list(F.struct("form", "many"))).alias("f")))
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}+)")))
    spoken = F.filter(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(text.fold(w), text.strip_accents(w))))), lambda f: f != "")
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d{4,})"))
    within_run = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 3), lambda i: F.substring(r, i, F.lit(4)).cast("int"))
    read = chapters.select("chapter_id", spoken.alias("forms"), F.array_distinct(F.flatten(F.transform(runs, within_run))).alias("years"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    whole = read.groupBy("chapter_id").agg(merged("forms"), merged("years"))
    of_year = whole.select("chapter_id", "forms", F.explode("years").alias("year")).join(checked_broadcast(sets.select("year").distinct()), "year", "left_semi")
    of_year = cut(of_year)
    most = of_year.groupBy("year").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, math.ceil(most / block))
    left = of_year.select("year", F.pmod(F.xxhash64("chapter_id"), F.lit(slices)).cast("int").alias("slice"), "forms")
    right = sets.select("year", "f").distinct().select("year", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("f.form").alias("forms"), F.col("f.many").alias("many"))
    keys = ["year", "slice"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_citing, "year int, forms array<string>, chapters long, ambiguous boolean")
    sums = found.groupBy("year", "forms").agg(F.sum("chapters").alias("chapters"), F.max("ambiguous").alias("ambiguous"))
    return sets.select("paper_id", "year", F.col("f.form").alias("forms")).join(sums, ["year", "forms"]).groupBy("paper_id").agg(F.sum("chapters").alias("chapters"), F.max("ambiguous").alias("ambiguous"))


_CITING = pa.schema({"year": pa.int32(), "forms": pa.list_(pa.string()), "chapters": pa.int64(), "ambiguous": pa.bool_()})


def _citing(chapters: pa.Table, sets: pa.Table) -> pa.Table:
    """The sets of forms (year, slice, forms, many) with how many of the chapters (year, slice, forms) hold one of them."""
    if not chapters.num_rows or not sets.num_rows:
        return _CITING.empty_table()
    wanted = sets["forms"].combine_chunks()
    ends = np.cumsum(pc.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = wanted.flatten().dictionary_encode()
    own, many = coded.indices.to_numpy(zero_copy_only=False), sets["many"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    spoken = chapters["forms"].combine_chunks()
    at = pc.fill_null(pc.index_in(spoken.flatten(), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(spoken)), pc.list_value_length(spoken).to_numpy(zero_copy_only=False))
    of, at = of[at >= 0], at[at >= 0]
    of = of[np.argsort(at, kind="stable")]
    stops = np.cumsum(np.bincount(at, minlength=len(coded.dictionary)))
    starts = np.concatenate([[0], stops[:-1]])
    n, ambiguous = np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
    seen = np.zeros(len(spoken), bool)
    for i, end in enumerate(ends):
        begin = ends[i - 1] if i else 0
        lists = [(starts[f], stops[f], m) for f, m in zip(own[begin:end], many[begin:end], strict=True) if stops[f] > starts[f]]
        if len(lists) == 1:
            n[i] = lists[0][1] - lists[0][0]
        elif lists:
            for a, b, _ in lists:
                seen[of[a:b]] = True
            n[i] = np.count_nonzero(seen)
            for a, b, _ in lists:
                seen[of[a:b]] = False
        ambiguous[i] = any(m for _, _, m in lists)
    some = pa.array(n > 0)
    return pa.table({"year": sets["year"], "forms": sets["forms"], "chapters": pa.array(n), "ambiguous": pa.array(ambiguous)}).filter(some).cast(_CITING)


def verify(claims: DataFrame, pages: DataFrame, threshold: float = 0.9) -> DataFrame:
    """item_id, doc_id, status, page, start, end, ratio of claims (item_id, doc_id, quote) on pages (doc_id, page, text).

    exact: the quote occurs after weak normalization, on the first such page. snapped: the best window of its length over
    all pages, fully normalized, reaches the threshold; of equal ones the first page's, and the first on it. no-match: with
    the best ratio. no-textlayer: all pages are blank, or there are none. start and end are code points of the page as it
    is given. A document's pages meet only its own claims; the kernels see what is not exact.
    """
    ids = ["item_id", "doc_id"]
    readable = pages.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("doc_id").distinct().withColumn("readable", F.lit(True))
    known = cut(claims.select(*ids, F.coalesce("quote", F.lit("")).alias("quote")).join(readable, "doc_id", "left"))
    seen = cut(known.where("readable").join(pages.where(F.col("text").isNotNull()).select("doc_id", "page", "text"), "doc_id").withColumn("q", text.weak_normal("quote")).withColumn("exact", (F.col("q") != "") & text.weak_normal("text").contains(F.col("q"))))
    exact = seen.where("exact").groupBy(*ids).agg(F.min_by(F.struct("page", "quote", "text"), "page").alias("hit")).select(*ids, F.lit("exact").alias("status"), "hit.*", F.lit(1.0).alias("ratio"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("size"))
    rest = cut(seen.where("q <> ''").join(exact.select(*ids), ids, "left_anti").select(*ids, "quote", "page", "text"))
    scored = rest.withColumn("a", alignment(text.full_normal("quote"), text.full_normal("text"), partial=False))
    order = F.struct(F.col("a.score"), -F.col("page"))
    best = scored.groupBy(*ids).agg(F.max_by(F.struct("page", "quote", "text", "a"), order).alias("hit"))
    near = best.select(*ids, F.when(F.col("hit.a.score") >= 100 * threshold, "snapped").otherwise("no-match").alias("status"), "hit.page", "hit.quote", "hit.text", (F.col("hit.a.score") / 100).alias("ratio"), "hit.a.at", "hit.a.size")
    found = cut(exact.unionByName(near))
    shown = found.where("status <> 'no-match'").withColumn("s", spans.located(F.col("text"), F.col("quote"), F.when(F.col("status") == "exact", "weak").otherwise("full"), F.col("at"), F.col("size")))
    placed = shown.select(*ids, "status", "page", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "ratio")
    none = found.where("status = 'no-match'").select(*ids, "status", "ratio")
    blank = known.where(F.col("readable").isNull() | (text.weak_normal("quote") == "")).select(*ids, F.when(F.col("readable").isNull(), "no-textlayer").otherwise("no-match").alias("status"), F.lit(0.0).alias("ratio"))
    return placed.unionByName(none.unionByName(blank), allowMissingColumns=True)


# Limits of the wording ladder.
FUZZY_LEAST, FRAGMENT_LEAST, FRAGMENTS_LEAST = 82.0, 6, 40
AMBIGUITY_MARGIN, LENGTH_BAND, FUZZY_LENGTH = 2.0, 0.7, 40


def wording(claims: DataFrame, shortest: int = 0, page_break: str = "\f") -> DataFrame:
    """item_id, doc_id, step, start, end, page: the first step of the ladder on which a quote is found in its text, and where.

    exact, weak (quotation marks, blanks), full (also hyphenation, ligatures), casefold, ellipsis (fragments around "..."
    in order), fuzzy, none, no-textlayer (the text is blank). The fuzzy step ranks the texts that are left of each quote: the
    best is taken, unless one with other wording comes within AMBIGUITY_MARGIN; texts under LENGTH_BAND of the quote's length,
    and quotes of fewer than ``shortest`` characters, are left out. The kernels see what the steps before them leave. start
    and end are code points of the text as it is given, page the number of page breaks before, plus one.
    """
    ids = ["item_id", "doc_id"]
    weak = F.when(F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == "", "no-textlayer").when(F.col("text").contains(F.col("quote")), "exact").when(text.weak_normal("text").contains(text.weak_normal("quote")), "weak")
    all_ = cut(claims)
    rows = cut(all_.select(*ids, "quote", "text", weak.alias("step")))
    rest = cut(rows.where("step is null").select(*ids, text.full_normal("quote").alias("q"), text.full_normal("text").alias("t")))
    q, t = F.col("q"), F.col("t")
    fq, ft = text.casefold(q), text.casefold(t)
    parts = F.filter(F.transform(F.split(fq, r"\s*(?:\.\.\.|…|\[\.\.\.\])\s*"), lambda x: F.trim(x)), lambda x: x != "")
    ellipsis = (F.size(parts) >= 2) & F.forall(parts, lambda x: F.length(x) >= FRAGMENT_LEAST) & (F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x)) >= FRAGMENTS_LEAST)
    rest = rest.withColumn("step", F.when(q != "", F.when(t.contains(q), "full").when(ft.contains(fq), "casefold").when(ellipsis & _in_order(parts, ft), "ellipsis")))
    left = rest.where("step is null").select(*ids, fq.alias("fq"), ft.alias("ft"))
    able = (F.length("fq") >= shortest) & (F.length("ft") >= F.floor(F.length("fq") * LENGTH_BAND))
    scored = cut(left.select(*ids, alignment(F.when(able, F.col("fq")), F.col("ft")).alias("a"), F.xxhash64("ft").alias("h")).select(*ids, "a.*", "h"))
    best = scored.where(F.col("score") >= FUZZY_LEAST).groupBy(F.col("item_id").alias("of")).agg(F.max("score").alias("best"))
    ranked = scored.join(best, (F.col("item_id") == F.col("of")) & (F.col("score") >= F.col("best") - AMBIGUITY_MARGIN), "left")
    one = ranked.where((F.col("best").isNotNull()) & (F.col("score") >= FUZZY_LEAST)).groupBy("of").agg(F.min("h").alias("h1"), F.max("h").alias("h2")).where("h1 = h2").select(F.col("of").alias("sure"))
    step = F.when((F.col("score") >= FUZZY_LEAST) & (F.col("score") == F.col("best")) & F.col("sure").isNotNull(), "fuzzy").otherwise("none")
    last = ranked.join(one, F.col("of") == F.col("sure"), "left").select(*ids, step.alias("step"), "at", "size")
    steps = cut(rows.where("step is not null").select(*ids, "step").union(rest.where("step is not null").select(*ids, "step")).unionByName(last, allowMissingColumns=True))
    lost = ("none", "no-textlayer")
    hits = steps.where(~F.col("step").isin(*lost)).join(all_, ids)
    placed = hits.withColumn("s", spans.located(F.col("text"), F.col("quote"), F.col("step"), F.when(F.col("step") == "fuzzy", F.col("at")), F.col("size")))
    shown = placed.select(*ids, "step", F.col("s.start").alias("start"), F.col("s.end").alias("end"), spans.page_of("text", F.col("s.start"), page_break).cast("int").alias("page"))
    return shown.unionByName(steps.where(F.col("step").isin(*lost)).select(*ids, "step"), allowMissingColumns=True)


def _in_order(parts: Column, body: Column) -> Column:
    """Whether the parts occur in body one after the other: what is left of body behind each, null once one is missing."""
    left = F.aggregate(parts, body, lambda rest, x: F.when(rest.contains(x), F.substring(rest, F.position(x, rest) + F.length(x), F.length(rest))))
    return left.isNotNull()
