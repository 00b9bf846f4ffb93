"""What is left: plug-ins, guards and codecs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, text
from ..operators import plugins
from ..operators import retrieval as ret
from ..sources.tables import table
from .q_retrieval import by_vector
from .registry import query
from .views import view, with_views


@query("p12_lock_guard", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 30)")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    """Writes to locked keys are kept back."""
    e = table(spark, sf, "events")
    return e.join(e.where("event_type = 'signup' and value > 30").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("f26_vector_codec", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS size FROM embeddings")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors packed as little-endian 32-bit floats and unpacked again."""
    e = table(spark, sf, "embeddings").select("vec_id", plugins.pack_vector(F.col("embedding")).alias("blob"))
    v = e.select("vec_id", plugins.unpack_vector(F.col("blob")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.size("v").cast("long").alias("size"))


NAMED_SQL = "regexp_extract_all(title, '\\p{L}{3,}')[1:CAST(paper_id % 4 AS INT)]"
FITS_SQL = "greatest(len(list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')), ceil(length(regexp_replace({0}, '\\s+', '', 'g')) / 2.5)) <= 60"
CONTEXT_SQL = (
    f"WITH p AS (SELECT paper_id, CASE WHEN paper_id % 11 = 0 THEN ' ' ELSE title END AS title, year, source_module AS section, {NAMED_SQL} AS names FROM papers), "
    "a AS (SELECT *, nullif(trim(title), '') AS t, CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 THEN names[1] || ' und ' || names[2] WHEN len(names) > 2 THEN names[1] || ' et al.' END AS who FROM p), "
    "b AS (SELECT *, coalesce(' von ' || who, '') || coalesce(' (' || year || ')', '') AS tail, ', Abschnitt \"' || section || '\" (' AS place, string_split_regex(t, '\\s+') AS w FROM a), "
    "k AS (SELECT *, list_max(list_filter(range(1, least(len(w) - 1, 60) + 1), lambda k: "
    + FITS_SQL.format("('Dieser Abschnitt stammt aus \"' || array_to_string(w[1:k], ' ') || '...\"' || tail || place || 'Seite ???-???, Chunk 0).')")
    + ")) AS k, "
    + FITS_SQL.format("('Dieser Abschnitt stammt aus \"' || t || '\"' || tail || place || 'Seite ???-???, Chunk 0).')")
    + " AS whole FROM b), "
    "s AS (SELECT *, CASE WHEN whole THEN t WHEN NOT contains(t, ' ') THEN t[1] || '...' ELSE array_to_string(w[1:coalesce(k, 1)], ' ') || '...' END AS short, 'Seite ' || paper_id % 7 || '-' || (paper_id % 7 + 2) || ', Chunk ' || paper_id % 5 || ').' AS pages FROM k) "
    "SELECT paper_id, CASE WHEN t IS NOT NULL THEN 'Dieser Abschnitt stammt aus \"' || short || '\"' || tail || place || pages WHEN who IS NOT NULL THEN 'Dieser Abschnitt stammt' || tail || place || pages ELSE 'Dieser Abschnitt stammt aus \"' || section || '\" (' || pages END AS context FROM s"
)


@query("f29_context_sentence", with_views(CONTEXT_SQL))
def f29(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that place a chunk in its source; words of titles stand for authors, and some titles are blank."""
    id_ = F.col("paper_id")
    names = F.slice(F.regexp_extract_all("title", F.lit(r"(\p{L}{3,})")), F.lit(1), (id_ % 4).cast("int"))
    p = view(spark, sf, "papers").select("paper_id", F.when(id_ % 11 == 0, " ").otherwise(F.col("title")).alias("t"), "year", "source_module", names.alias("names"))
    return p.select("paper_id", text.context_sentence(F.col("source_module"), id_ % 7, id_ % 7 + 2, id_ % 5, F.col("t"), F.col("names"), F.col("year")).alias("context"))


LINE_SQL = r"[ \t]*(?:#{1,6}[ \t][^\n]*|(?:[-*+]|\d+[.)])[ \t][^\n]*)?"
CLAIM_SQL = rf"""
WITH h AS (SELECT item_id, doc_id, d.text AS t, b.text AS q, instr(d.text, b.text) AS p FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
c AS (SELECT *, substring(t, 1, p - 1) AS before, substring(t, p + length(q)) AS behind FROM h),
l AS (SELECT *, NOT regexp_full_match(list_last(string_split(before, chr(10))) || q || string_split(behind, chr(10))[1], '{LINE_SQL}') AS free,
list_last(string_split(regexp_replace(regexp_replace(before, '(?m)^{LINE_SQL}\n', '￿', 'g') || q[1], '([.!?])\s+([A-ZÄÖÜ])', '\1￿\2', 'g'), '￿')) AS head,
string_split(regexp_replace(q[-1] || regexp_replace(regexp_replace(behind, '\n{LINE_SQL}\n', chr(10) || '￿', 'g'), '\n{LINE_SQL}\z', chr(10) || '￿'), '([.!?])\s+([A-ZÄÖÜ])', '\1￿\2', 'g'), '￿')[1] AS tail FROM c)
SELECT item_id, doc_id, CASE WHEN free THEN regexp_replace(left(head, -1) || q || substring(tail, 2), '^\s+|\s+$', '', 'g') END AS sentence,
CASE WHEN NOT free THEN regexp_replace(substring(t, greatest(1, p - 200), least(p - 1, 200) + length(q) + 200), '^\s+|\s+$', '', 'g') END AS around FROM l
"""


@query("f32_claim_sentence", CLAIM_SQL)
def f32(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence around each benchmark passage in a document; a window where headings or list items leave none."""
    from ..operators.evidence import containment

    hits = containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=True)
    start = F.expr("instr(text, quote) - 1")
    return hits.select("item_id", "doc_id", F.inline(F.array(spans.claim_sentence("text", start, start + F.length("quote")))))


@query("r07_rerank")
def r07(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of each query put in order by a pair scorer, which is a plug-in; this one counts shared words."""
    near = by_vector(spark, sf, 10)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = near.join(F.broadcast(q), "query_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    scored = plugins.score_pairs(rows, "query", "text", keep=("query_id", "doc_id", "rank"))
    return ret.top(scored.withColumnRenamed("rank", "before"), "doc_id", F.desc("pair_score"), 10).select("query_id", "doc_id", "before", "rank", "pair_score")


@query("r08_query_embedding")
def r08(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.embed import embed

    q = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("query: "), "text").alias("text"))
    return embed(q, "item_id", "text")


@query("r09_claim_verdicts")
def r09(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts: attributed or negated claims go to people, the rest to a scorer, a plug-in, with a threshold."""
    d = table(spark, sf, "documents").select("doc_id", F.get(text.sentences("text"), F.lit(0)).alias("claim"), F.col("text").alias("evidence"))
    return plugins.verdicts(d, "doc_id", 0.95)
