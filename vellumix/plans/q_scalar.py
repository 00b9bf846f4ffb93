"""Scalar functions (survey §2.8) applied to whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citing, scores, text
from ..sources.tables import table
from .registry import query
from .views import view, with_views

YEAR = 2026
DOI_SQL = "nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^(https://dx\\.doi\\.org/|http://dx\\.doi\\.org/|https://doi\\.org/|http://doi\\.org/|dx\\.doi\\.org/|doi\\.org/|urn:doi:|doi:)', ''), '[.,;]+$', ''), '')"
RECENCY_SQL = f"coalesce(least(exp(-ln(2) * ({YEAR} - year) / 5.0), 1.0), 0.0)"
QUALITY_SQL = f"CASE WHEN fwci IS NOT NULL THEN greatest(0.0, least(fwci / 2, 1.0)) ELSE coalesce(least(log10(coalesce(citations, 0) / greatest(1, {YEAR} - year) + 1) / 2, 1.0), 0.0) END"
AUTHORITY_SQL = "CASE WHEN regexp_matches(lower(venue), 'ieee|acm|springer|nature|elsevier') THEN 1.0 WHEN regexp_matches(lower(venue), 'journal') THEN 0.7 WHEN regexp_matches(lower(venue), 'conference|proceedings|workshop|symposium') THEN 0.4 ELSE 0.2 END"
ACCESS_SQL = "CASE WHEN coalesce(oa_url, '') <> '' THEN 1.0 WHEN coalesce(doi, '') <> '' THEN 0.5 WHEN coalesce(url, '') <> '' THEN 0.2 ELSE 0.0 END"
PRESCORE_SQL = f"greatest(0.0, least((0.20 * {RECENCY_SQL} + 0.15 * {QUALITY_SQL} + 0.15 * {AUTHORITY_SQL} + 0.15 * {ACCESS_SQL}) / 0.65, 1.0))"


def dimensions() -> dict:
    return {
        "recency": scores.recency(F.col("year"), YEAR),
        "quality": scores.quality(F.col("citations"), F.col("year"), YEAR, F.col("fwci")),
        "authority": scores.authority(F.col("venue")),
        "access": scores.access(F.col("oa_url"), F.col("doi"), F.col("url")),
    }


def prescore():
    return scores.weighted(dimensions())


@query("f01_normalize_doi", with_views(f"SELECT paper_id, {DOI_SQL} AS doi FROM papers"))
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", text.normalize_doi("doi").alias("doi"))


@query(
    "f02_identifiers",
    with_views(
        f"SELECT paper_id, nullif(regexp_extract({DOI_SQL}, '^10\\.48550/arxiv\\.(.+)$', 1), '') AS arxiv, nullif(regexp_extract(url, '(?i)pubmed\\.ncbi\\.nlm\\.nih\\.gov/(\\d+)', 1), '') AS pmid, "
        "upper(nullif(regexp_extract(url, '(?i)openalex\\.org/(w\\d+)', 1), '')) AS openalex FROM papers"
    ),
)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", text.arxiv_id(text.normalize_doi("doi")).alias("arxiv"), text.pmid("url").alias("pmid"), text.openalex_id("url").alias("openalex"))


@query("f03_tokenize", "SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9äöüß]+'), lambda t: t <> '') AS tokens FROM documents")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("tokens"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
WORDS_SQL = f"list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP_SQL}))"


@query("f04_words", f"SELECT doc_id, len(w) AS n_words, list_aggregate(w, 'string_agg', ' ') AS words FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    w = text.words("text")
    joined = F.when(F.size(w) > 0, F.array_join(w, " "))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), joined.alias("words"))


@query("f05_safe_filename", with_views("SELECT paper_id, substring(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS name FROM papers"))
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", text.safe_filename("title").alias("name"))


FOLD_SQL = "regexp_replace(" + "replace(" * 7 + "lower(trim({0}))" + "".join(f", '{a}', '{b}')" for a, b in text.UMLAUTS.items()) + ", '[^a-z]', '', 'g')"
STRIP_SQL = "regexp_replace(translate(lower(trim({0})), '" + text.ACCENTS + "', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z]', '', 'g')"
FAMILY_SQL = "list_element(string_split_regex(trim(title), '\\s+'), -1)"


@query("f06_family_variants", with_views(f"SELECT paper_id, {FOLD_SQL.format(FAMILY_SQL)} AS folded, {STRIP_SQL.format(FAMILY_SQL)} AS stripped FROM papers"))
def f06(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.split(F.trim("title"), r"\s+"), -1)
    return view(spark, sf, "papers").select("paper_id", text.fold(name).alias("folded"), text.strip_accents(name).alias("stripped"))


#: Names as catalogues give them, and what becomes of them: family, given (empty: none), or null where they stay as they are.
NAMES = (
    ("Meyer, Jo B.", "Meyer", "Jo B."), ("O'Brien, J. R.", "O'Brien", "J. R."), ("Universität Leipzig, Institut für Wirtschaftsinformatik", None, None), ("OECD, Paris", None, None), ("Vries, Jan de", "Vries", "Jan de"),
    ("Statistisches Bundesamt, Wiesbaden", None, None), ("Bankhofer, Udo", "Bankhofer", "Udo"), ("Solo,", "Solo", ""), ("Anna Schmidt", None, None), ("Li, one two three four", None, None), ("Kim, soo jin", None, None), ("Example Inc., Boston", "Example Inc.", "Boston"),
)
quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
NAMES_SQL = ", ".join(f"({i}, {quoted(a)}, {quoted(b)}, {quoted(c)})" for i, (a, b, c) in enumerate(NAMES))


@query("f07_parse_author", f"SELECT c_custkey, family, nullif(given, '') AS given, CASE WHEN family IS NULL THEN raw END AS literal, family IS NOT NULL AS parsed FROM customer JOIN (VALUES {NAMES_SQL}) n(i, raw, family, given) ON i = c_custkey % {len(NAMES)}")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.get(F.array(*(F.lit(n[0]) for n in NAMES)), (F.col("c_custkey") % len(NAMES)).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", text.parse_author(raw).alias("a")).select("c_custkey", "a.*")


@query("f08_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, nullif(regexp_extract(CAST(ts AS STRING), '\\b(1[0-9]{3}|2[0-9]{3})\\b', 1), '') AS year FROM events")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.nullif(F.regexp_extract(F.col("ts").cast("string"), r"\b(1[0-9]{3}|2[0-9]{3})\b", 1), F.lit("")).alias("year"))


@query("f09_weak_normal", "SELECT doc_id, md5(trim(regexp_replace(translate(text, '“”„«»‘’‚´`', '\"\"\"\"\"'''''''''''), '\\s+', ' ', 'g'))) AS digest FROM documents")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.weak_normal("text")).alias("digest"))


@query("f09_full_normal")
def f09_full(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.full_normal("text").alias("normal"))


BROKEN_SQL = "replace(replace(replace(text, ' a', '-' || chr(10) || 'a'), ' e', '- ' || chr(10) || '  e'), ' d', '-' || chr(10) || chr(10) || 'd')"
GUARD_SQL = "und|oder|bzw|sowie|wie|als|aber|doch|sondern|noch|entweder|da|weil|obwohl|wenn|falls|solange|bis|nachdem|bevor|kaum|ehe|damit|sodass|weshalb|um|zu|statt|anstatt"


@query(
    "f10_join_hyphens",
    "SELECT doc_id, md5(replace(regexp_replace(regexp_replace(regexp_replace(t, '(\\p{L})-[ \\t]*\\n[ \\t]*(\\p{L}+)', '\\1' || chr(65535) || '\\2', 'g'), chr(65535) || '((?i:" + GUARD_SQL + "))([^\\p{L}]|$)', '- \\1\\2', 'g'), chr(65535) || '(\\p{Ll})', '\\1', 'g'), chr(65535), '- ')) AS digest "
    f"FROM (SELECT doc_id, {BROKEN_SQL} AS t FROM documents)",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.join_hyphens(F.expr(BROKEN_SQL))).alias("digest"))


@query("f11_normalize_number", "SELECT o_orderkey, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '0'), '.') AS canonical FROM orders")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written in the German, the English and the Swiss way come back as one canonical form."""
    english = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    german = F.translate(english, ",.", ".,")
    swiss = F.replace(english, F.lit(","), F.lit("'"))
    shown = F.when(F.col("o_orderkey") % 3 == 0, german).when(F.col("o_orderkey") % 3 == 1, F.concat(english, F.lit(" %"))).otherwise(swiss)
    return table(spark, sf, "orders").select("o_orderkey", text.normalize_number(shown).alias("canonical"))


@query("f12_cell_blanks", "SELECT page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS cell FROM pages")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(F.trim(F.regexp_replace("html", r"\s+", " "))).alias("cell"))


@query("f13_inverted_index_text", "SELECT item_id, list_aggregate(string_split(text, ' '), 'string_agg', ' ') AS abstract FROM benchmark")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """Words with positions, as an inverted index holds them, put in order again."""
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("pos").alias("positions"))
    flat = index.select("item_id", F.explode("positions").alias("pos"), "word")
    return flat.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("abstract"))


@query("f14_sanitize_query", "SELECT item_id, list_filter(regexp_extract_all(text || ' AND \"NOT\" x-y near(3)', '[\\p{L}\\p{N}_]+'), lambda t: upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS terms FROM benchmark")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.sanitize_query(F.concat("text", F.lit(' AND "NOT" x-y near(3)'))).alias("terms"))


@query("f15_trigram_terms", "SELECT item_id, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 4 AND upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS terms FROM benchmark")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.filter(text.sanitize_query("text"), lambda t: F.length(t) >= 4).alias("terms"))


@query("f18_recency", with_views(f"SELECT paper_id, round({RECENCY_SQL}, 6) AS recency FROM papers"))
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", F.round(dimensions()["recency"], 6).alias("recency"))


@query("f19_quality", with_views(f"SELECT paper_id, round({QUALITY_SQL}, 6) AS quality, CASE WHEN fwci IS NOT NULL THEN 'fwci' ELSE 'raw' END AS origin FROM papers"))
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", F.round(dimensions()["quality"], 6).alias("quality"), F.when(F.col("fwci").isNotNull(), "fwci").otherwise("raw").alias("origin"))


@query("f20_authority_access", with_views(f"SELECT paper_id, CAST({AUTHORITY_SQL} AS DOUBLE) AS authority, CAST({ACCESS_SQL} AS DOUBLE) AS access FROM papers"))
def f20(spark: SparkSession, sf: str) -> DataFrame:
    d = dimensions()
    return view(spark, sf, "papers").select("paper_id", d["authority"].alias("authority"), d["access"].alias("access"))


def relevance():
    return F.col("n_chars") % 101 / 100
TOTAL_SQL = f"greatest(0.0, least(0.35 * (n_chars % 101 / 100) + 0.20 * {RECENCY_SQL} + 0.15 * {QUALITY_SQL} + 0.15 * {AUTHORITY_SQL} + 0.15 * {ACCESS_SQL}, 1.0))"


@query("f21_scores", with_views(f"SELECT paper_id, round({PRESCORE_SQL}, 6) AS prescore, round({TOTAL_SQL}, 6) AS total FROM papers"))
def f21(spark: SparkSession, sf: str) -> DataFrame:
    total = scores.weighted({"relevance": relevance(), **dimensions()})
    return view(spark, sf, "papers").select("paper_id", F.round(prescore(), 6).alias("prescore"), F.round(total, 6).alias("total"))


LABEL_SQL = "CASE WHEN total >= 0.75 AND rel >= 0.80 THEN 'core' WHEN methods THEN 'methods' WHEN total >= 0.50 AND rel >= 0.50 THEN 'supplementary' WHEN total >= 0.30 THEN 'background' ELSE 'peripheral' END"


@query("f22_cluster_label", with_views(f"SELECT paper_id, {LABEL_SQL} AS label FROM (SELECT paper_id, round({TOTAL_SQL}, 6) AS total, n_chars % 101 / 100 AS rel, contains(lower(title), 'meth') AS methods FROM papers)"))
def f22(spark: SparkSession, sf: str) -> DataFrame:
    total = F.round(scores.weighted({"relevance": relevance(), **dimensions()}), 6)
    return view(spark, sf, "papers").select("paper_id", scores.cluster_label(total, relevance(), F.lower("title").contains("meth")).alias("label"))


@query(
    "f23_topic_score",
    "SELECT p_partkey, CAST(greatest(0, least(10, round_even(p_size / 5.0 + CASE p_brand WHEN 'Brand#11' THEN -1.5 WHEN 'Brand#22' THEN 0.5 ELSE 0 END, 1))) AS DOUBLE) AS feasibility, "
    "CAST(least(2.0, 0.5 * len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'a')))) AS DOUBLE) AS overlap FROM part",
)
def f23(spark: SparkSession, sf: str) -> DataFrame:
    mod = F.when(F.col("p_brand") == "Brand#11", -1.5).when(F.col("p_brand") == "Brand#22", 0.5).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.bround(F.col("p_size") / 5.0 + mod, 1)))
    overlap = F.least(F.lit(2.0), 0.5 * F.size(F.filter(F.split("p_name", " "), lambda w: w.contains("a"))))
    return table(spark, sf, "part").select("p_partkey", score.alias("feasibility"), overlap.alias("overlap"))


@query(
    "f25_vector_math",
    "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, "
    "round(list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 4) AS dot, "
    "round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 4) AS l2 FROM embeddings, q",
)
def f25(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import dot, l2

    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(norm, 4).alias("norm"), F.round(dot(F.col("embedding"), F.col("q")), 4).alias("dot"), F.round(l2(F.col("embedding"), F.col("q")), 4).alias("l2"))


@query("f27_approx_tokens", "SELECT doc_id, greatest(len(w), CAST(ceil(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) / 2.5) AS BIGINT)) AS tokens FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents)")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.approx_tokens("text").alias("tokens"))


HEADING_SQL = "length(line) <= 80 AND regexp_matches(line, '^(?:\\d+(?:\\.\\d+)*\\.?\\s+)?[A-ZÄÖÜ][\\p{L}\\p{N}_\\-]*(?:\\s+[A-ZÄÖÜ][\\p{L}\\p{N}_\\-]*){0,6}$')"


@query("f28_headings", f"SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {HEADING_SQL}")
def f28(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(text.is_heading("line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("f30_sentences")
def f30(spark: SparkSession, sf: str) -> DataFrame:
    """Look-behind has no twin in DuckDB's expressions; a test compares with the standard library's."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


@query("f31_quote_spans", "SELECT doc_id, unnest(regexp_extract_all('„' || replace(text, ', ', '“ „') || '“', '„([^“]{20,})“', 1)) AS span FROM documents")
def f31(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.concat(F.lit("„"), F.replace("text", F.lit(", "), F.lit("“ „")), F.lit("“"))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(quoted, F.lit("„([^“]{20,})“"), F.lit(1))).alias("span"))


CLAIM_SQL = "concat(CASE paper_id % 3 WHEN 0 THEN '' ELSE body END, CASE paper_id % 4 WHEN 0 THEN ' Das trifft  nicht zu.' WHEN 1 THEN ' X DENIES it.' WHEN 2 THEN ' Keineswegs.' ELSE ' nicht' END)"


@query(
    "f33_guards",
    with_views(
        f"SELECT paper_id, title <> '' AND contains(trim(regexp_replace(claim, '\\s+', ' ', 'g')), trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS attributed, regexp_matches(lower(claim), '{'|'.join(citing.NEGATION)}') AS negated FROM (SELECT paper_id, title, {CLAIM_SQL} AS claim FROM papers)"
    ),
)
def f33(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a claim holds the quotation (the title) itself, and whether it contradicts."""
    claims = view(spark, sf, "papers").select("paper_id", "title", F.expr(CLAIM_SQL).alias("claim"))
    return claims.select("paper_id", citing.guards("claim", "title").alias("g")).select("paper_id", "g.*")


#: Passages behind each title ({p} a page, {y} a year, which go by the record), and what each of them cites: the words, family, further authors, year, page, last page, secondary, confidence.
CITING = (
    (" (Meyer, 2004, S. {p}-99) und Meyer (1999) zeigt", [("Meyer, 2004, S. {p}-99", "Meyer", "", "2004", "{p}", "99", False, "strong"), ("Meyer (1999)", "Meyer", "", "1999", None, None, False, "corroborated")]),
    (" sowie (Cho et al. {y}; vgl. Kim & Lee 2001), (Corona 2020), (Januar 2021)", [("Cho et al. {y}", "Cho", "et al.", "{y}", None, None, False, "strong"), ("vgl. Kim & Lee 2001", "Kim", "& Lee", "2001", None, None, False, "strong"), ("Corona 2020", "Corona", "", "2020", None, None, False, "weak")]),
    (" (Roth, 1990, zitiert nach Beck, {y}, S. {p}).", [("Roth, 1990", "Roth", "", "1990", None, None, False, "weak"), ("Beck, {y}, S. {p}", "Beck", "", "{y}", "{p}", None, True, "strong")]),
    (" `(Meier 2019, S. {p})` <!-- Bär ({y}) zeigt --> Bär ({y}) war da.", []),
    (" Bär und Kurz ({y}) erklären; Wien (2016) nicht; siehe Öz 2003: {p}", [("Bär und Kurz ({y})", "Bär", "und Kurz", "{y}", None, None, False, "strong"), ("siehe Öz 2003: {p}", "Öz", "", "2003", "{p}", None, False, "strong")]),
    (" (Lang 1984, 2001)\n## Literatur\nLang ({y}, S. {p})", [("Lang 1984", "Lang", "", "1984", None, None, False, "weak")]),
)


def _filled(x: str | None, kind: str = "STRING") -> str:
    if x is None:
        return f"CAST(NULL AS {kind})"
    parts = [f"CAST({'paper_id % 90 + 1' if part == '{p}' else '1900 + paper_id % 100'} AS STRING)" if part in ("{p}", "{y}") else "'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for part in re.split(r"(\{[py]\})", x) if part]
    return f"CAST({' || '.join(parts) or repr('')} AS {kind})"


PASSAGE_SQL = f"CASE paper_id % {len(CITING)} " + " ".join(f"WHEN {i} THEN {_filled(x)}" for i, (x, _) in enumerate(CITING)) + " END"
CITED_SQL = " UNION ALL ".join(
    f"SELECT paper_id, length(title) + instr({_filled(x)}, {_filled(words)}) AS start, length({_filled(words)}) AS n, {_filled(family)} AS family, {_filled(others)} AS others, {_filled(year, 'INT')} AS year, {_filled(page, 'INT')} AS page, {_filled(last, 'INT')} AS page_end, {secondary} AS secondary, '{confidence}' AS confidence FROM p WHERE paper_id % {len(CITING)} = {i}"
    for i, (x, cited) in enumerate(CITING)
    for words, family, others, year, page, last, secondary, confidence in cited
)


@query(
    "f34_citations",
    with_views(f"WITH p AS (SELECT paper_id, substring(title, 1, 200) AS title FROM papers) SELECT paper_id, start::INT AS start, (start + n)::INT AS \"end\", family, others, year, page, page_end, secondary, confidence FROM ({CITED_SQL})"),
)
def f34(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in the start of titles with a passage behind it that goes by the record, near misses among them."""
    shown = view(spark, sf, "papers").select("paper_id", F.concat(F.substring("title", 1, 200), F.lit("."), F.expr(PASSAGE_SQL)).alias("t"))
    return shown.select("paper_id", F.inline(citing.citations("t")))


OWN_NAMES_SQL = "list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda t: t <> '')[1:4]"


@query(
    "f35_candidate_score",
    with_views(
        f"WITH p AS (SELECT paper_id, {DOI_SQL} AS d, year, {OWN_NAMES_SQL} AS names FROM papers), f AS (SELECT d, min(paper_id) AS first FROM p WHERE d IS NOT NULL GROUP BY d), "
        "r AS (SELECT p.paper_id, p.names AS a, q.names AS b, abs(q.year - p.year) AS gap, list_filter(p.names[2:], lambda x: list_contains(q.names, x)) AS found FROM p JOIN f ON f.d = p.d JOIN p q ON q.paper_id = f.first) "
        "SELECT *, CASE WHEN score >= 80 THEN 'confirmed' WHEN score >= 65 THEN 'probable' WHEN paper_id % 2 = 0 THEN 'unavailable' ELSE 'no-match' END AS verdict FROM (SELECT paper_id, CAST(CASE WHEN NOT list_contains(b, a[1]) OR len(a) = 0 THEN 0 ELSE 40 + CASE gap WHEN 0 THEN 30 WHEN 1 THEN 15 ELSE 0 END "
        "+ CASE WHEN len(a) > 1 THEN floor(30.0 * len(found) / (len(a) - 1 + len(b) - len(found)) + 0.5) ELSE 0 END END AS BIGINT) AS score FROM r)"
    ),
)
def f35(spark: SparkSession, sf: str) -> DataFrame:
    """Records as citations, held against the first record of their DOI; the words of a title stand for its authors."""
    names = F.slice(F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda t: t != ""), 1, 4)
    p = view(spark, sf, "papers").select("paper_id", text.normalize_doi("doi").alias("d"), "year", names.alias("names")).where("d is not null")
    first = p.groupBy("d").agg(F.min_by(F.struct("names", "year"), "paper_id").alias("q"))
    score = scores.candidate_score(F.get("names", F.lit(0)), F.col("year"), F.col("names"), F.col("q.names"), F.col("q.year"))
    rows = p.join(first, "d").select("paper_id", F.coalesce(score, F.lit(0)).alias("score"))
    return rows.withColumn("verdict", scores.candidate_class(F.col("score"), F.col("paper_id") % 2 == 0))


CONTEXT_SQL = {
    "before": "concat(body, CASE paper_id % 5 WHEN 0 THEN ' Critics  argue that' WHEN 1 THEN ' it may be' ELSE '' END)",
    "after": "concat(CASE paper_id % 3 WHEN 0 THEN 'This, however,  is so. ' ELSE '' END, body)",
    "chapter": "concat(title, CASE paper_id % 7 WHEN 0 THEN ' Kritisch ist' WHEN 1 THEN ' This always holds' WHEN 2 THEN ' beweist' ELSE '' END)",
    "similarity": "CASE WHEN paper_id % 4 = 0 THEN NULL ELSE CAST(paper_id % 10 AS DOUBLE) / 10 END",
}


def marked_sql(c: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(' ' || lower({c}) || ' ', '[^\\p{{L}}]({'|'.join(words)})[^\\p{{L}}]')"


@query(
    "f36_context_signals",
    with_views(
        f"SELECT paper_id, NOT open AND {marked_sql('first', citing.CONTRAST)} AS contrast, NOT open AND {marked_sql('last', citing.FRAMING)} AS framing, "
        f"{marked_sql('source', citing.HEDGE)} AND NOT {marked_sql('chapter', citing.HEDGE)} AND {marked_sql('chapter', citing.ABSOLUTE)} AS hedge_loss, coalesce(similarity < 0.5, false) AS distant, open AS suppressed FROM "
        "(SELECT *, substring(regexp_extract(trim(regexp_replace(after, '\\s+', ' ', 'g')), '^[^.!?]*'), 1, 80) AS first, right(trim(regexp_replace(before, '\\s+', ' ', 'g')), 80) AS last, "
        f"before || ' ' || title || ' ' || after AS source, {marked_sql('chapter', citing.CONTRAST + citing.DISCLOSURE)} AS open FROM (SELECT paper_id, title, {', '.join(f'{v} AS {k}' for k, v in CONTEXT_SQL.items())} FROM papers))"
    ),
)
def f36(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "papers").select("paper_id", "title", *(F.expr(v).alias(k) for k, v in CONTEXT_SQL.items()))
    s = rows.select("paper_id", citing.context_signals("before", "title", "after", "chapter", F.col("similarity"), 0.5).alias("s"))
    return s.select("paper_id", *(F.col(f"s.{k}").isNotNull().alias(k) for k in ("contrast", "framing", "hedge_loss")), "s.distant", "s.suppressed")


@query(
    "f39_isbn13",
    "SELECT p_partkey, '978' || s || CAST((10 - (38 + list_sum(list_transform(range(1, 10), lambda i: CAST(s[i] AS INT) * CASE WHEN (i + 3) % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10 AS STRING) AS isbn FROM (SELECT p_partkey, lpad(CAST(p_partkey AS STRING), 9, '0') AS s FROM part)",
)
def f39(spark: SparkSession, sf: str) -> DataFrame:
    ten = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("X"))
    return table(spark, sf, "part").select("p_partkey", text.isbn13(F.concat(F.substring(ten, 1, 3), F.lit("-"), F.substring(ten, 4, 7))).alias("isbn"))


@query(
    "f40_snippet",
    "WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents), "
    "h AS (SELECT *, list_transform(w, lambda t: regexp_replace(lower(t), '[^\\p{L}\\p{N}_]', '', 'g')) AS words FROM d), "
    "i AS (SELECT *, list_transform(words, lambda x: x IN ('the', 'der', 'und', 'of')) AS hits FROM h), "
    "c AS (SELECT doc_id, greatest(1, least(k, len(w) - 9)) AS s, words FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda k: hits[k])) AS k FROM i)), "
    "b AS (SELECT doc_id, list_filter(words[s:s + 9], lambda x: x IN ('the', 'der', 'und', 'of')) AS inside, s FROM c), "
    "p AS (SELECT i.*, coalesce(best, 1) AS s FROM i LEFT JOIN (SELECT doc_id, arg_max(s, [len(list_distinct(inside)), len(inside), -s]) AS best FROM b GROUP BY doc_id) USING (doc_id)) "
    "SELECT doc_id, CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substring(flat, 1, 240)) || '...' END AS snippet, "
    "CASE WHEN s > 1 THEN '...' ELSE '' END || coalesce(array_to_string(list_transform(range(s, least(s + 10, len(w) + 1)), lambda i: CASE WHEN hits[i] THEN '<b>' || w[i] || '</b>' ELSE w[i] END), ' '), '') || CASE WHEN s + 10 <= len(w) THEN '...' ELSE '' END AS around FROM p",
)
def f40(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", citing.snippet("text").alias("snippet"), citing.highlight("text", ("the", "der", "und", "of")).alias("around"))


@query("f41_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 6) AS six, CAST(format('{:.8g}', o_totalprice / 7) AS DOUBLE) AS significant FROM orders")
def f41(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_totalprice") / 7
    digits = F.lit(7) - F.floor(F.log10(F.abs(x))).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", F.round(x, 6).alias("six"), (F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).alias("significant"))


@query("f42_model_version", "SELECT c_custkey, split_part(c_name, '#', 1) AS model, split_part(c_name, '#', 2) AS version FROM customer")
def f42(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.substring_index("c_name", "#", 1).alias("model"), F.when(F.col("c_name").contains("#"), F.regexp_extract("c_name", "#([^#]*)", 1)).otherwise("").alias("version"))
