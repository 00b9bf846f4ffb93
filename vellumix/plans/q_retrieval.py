"""Retrieval, evidence, entity resolution and learning (survey §2.9 and what depends on it) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citing, text
from ..operators import chunks, evidence, learn, resolve
from ..operators import relational as rel
from ..operators import retrieval as ret
from ..operators.embed import letter_shares
from ..operators.fuzzy import fuzzy, sequence_ratio, word_diffs
from ..session import cut
from ..sources.tables import table
from .q_scalar import WORDS_SQL
from .registry import query
from .views import view, with_views

#: Queries: the two topic words of each benchmark item that sort first; they are the query set, run against all documents.
QUERIES_SQL = f"SELECT item_id AS query_id, w AS terms FROM (SELECT item_id, list_sort(list_distinct({WORDS_SQL})) AS w FROM benchmark) WHERE len(w) >= 1"


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    w = F.sort_array(F.array_distinct(text.words("text")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w")).where(F.size("w") >= 1).select("query_id", F.col("w").alias("terms"))


BM25_SQL = (
    f"WITH q AS ({QUERIES_SQL}), d AS (SELECT doc_id, {WORDS_SQL} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avg_size FROM d), "
    "tf AS (SELECT doc_id, len(t) AS size, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT unnest(terms) FROM q) GROUP BY ALL), "
    "idf AS (SELECT term, greatest(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, s GROUP BY term), "
    "bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_size))) AS score FROM (SELECT query_id, len(terms) AS need, unnest(terms) AS term FROM q) JOIN tf USING (term) JOIN idf USING (term), s GROUP BY 1, 2 HAVING count(*) = max(need)), "
    "lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM bm)) "
)


def lexical(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    hits = ret.bm25(table(spark, sf, "documents"), "doc_id", text.words("text"), text_queries(spark, sf)).withColumn("score", F.round("score", 6))
    return ret.top(hits, "doc_id", F.desc("score"), k)


@query("r01_bm25", BM25_SQL + "SELECT query_id, doc_id, round(score, 4) AS score FROM lex")
def r01(spark: SparkSession, sf: str) -> DataFrame:
    hits = ret.bm25(table(spark, sf, "documents"), "doc_id", text.words("text"), text_queries(spark, sf))
    return hits.select("query_id", "doc_id", F.round(F.round("score", 6), 4).alias("score"))


@query("r02_substring_search", f"WITH q AS ({QUERIES_SQL}) SELECT query_id, doc_id FROM q JOIN documents ON len(list_filter(terms, lambda x: NOT contains(lower(text), x))) = 0")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    """All terms as substrings: an automaton of the queries' terms goes over each text once."""
    low = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    terms = text_queries(spark, sf).select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n"))
    hits = evidence.containment(low, terms.select(F.col("term").alias("item_id"), F.col("term").alias("text")).distinct())
    found = hits.withColumnRenamed("item_id", "term").join(rel.checked_broadcast(terms), "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("found"))
    return found.where("found = n").select("query_id", "doc_id")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all vectors."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


L2_SQL = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))))"
KNN_SQL = f"SELECT q.vec_id AS query_id, e.vec_id, {L2_SQL} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2_SQL}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"


@query("r03_knn", f"SELECT query_id, vec_id, round(distance, 4) AS distance FROM ({KNN_SQL}) WHERE rank <= 5")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    return ret.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", vector_queries(spark, sf), 5).select("query_id", "vec_id", F.round("distance", 4).alias("distance"))


@query("r04_overfetch_knn", f"SELECT query_id, label, min(rank) AS rank FROM (SELECT k.*, label FROM ({KNN_SQL}) k JOIN embeddings m ON m.vec_id = k.vec_id) WHERE rank <= 20 GROUP BY 1, 2")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    """Four times as many neighbours as asked for, then the best of each group."""
    near = ret.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", vector_queries(spark, sf), 20)
    return near.join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.min("rank").cast("long").alias("rank"))


LETTERS_SQL = "[" + ", ".join(f"floor(1000.0 * (length(lower({{0}})) - length(replace(lower({{0}}), '{x}', ''))) / greatest(length({{0}}), 1))" for x in "enirstadhulcgmob") + "]"
#: The nearest documents by a vector of their letters, which stands for an embedding that both engines can compute.
NEAR_SQL = (
    f"SELECT q.id AS query_id, d.id AS doc_id, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(d.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), d.id) AS rank FROM (SELECT item_id AS id, {LETTERS_SQL.format('text')} AS v FROM benchmark) q, (SELECT doc_id AS id, {LETTERS_SQL.format('text')} AS v FROM documents) d"
)


def by_vector(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """The k nearest documents of each query by the vectors of the stand-in embedder."""
    docs = table(spark, sf, "documents").select("doc_id", letter_shares(F.col("text")).alias("v"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), letter_shares(F.col("text")).alias("q"))
    return ret.knn(docs, "doc_id", "v", queries, k)


@query("j06_fuse", BM25_SQL + f", vec AS (SELECT * FROM ({NEAR_SQL}) WHERE rank <= 20) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(a.rank AS INT) AS lexical_rank, CAST(b.rank AS INT) AS vector_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS score FROM (SELECT * FROM lex WHERE rank <= 20) a FULL JOIN vec b ON a.query_id = b.query_id AND a.doc_id = b.doc_id")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    return ret.fuse(lexical(spark, sf), by_vector(spark, sf), "doc_id").withColumn("score", F.round("score", 6))


FUSED_SQL = BM25_SQL + f", vec AS (SELECT * FROM ({NEAR_SQL}) WHERE rank <= 20), fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM vec) GROUP BY 1, 2), "


def fused(spark: SparkSession, sf: str) -> DataFrame:
    lists = lexical(spark, sf).select("query_id", F.lit(0).alias("list"), "doc_id", "rank").unionByName(by_vector(spark, sf).select("query_id", F.lit(1).alias("list"), "doc_id", "rank"))
    return ret.rrf(lists, "doc_id")


@query("a14_rrf", FUSED_SQL[:-2] + " SELECT query_id, doc_id, round(score, 6) AS score FROM fused")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "a13_best_child",
    FUSED_SQL + "p AS (SELECT f.query_id, source, round(f.score, 6) AS score, f.doc_id, l.score AS lexical_score FROM fused f JOIN documents USING (doc_id) LEFT JOIN (SELECT * FROM lex WHERE rank <= 20) l ON l.query_id = f.query_id AND l.doc_id = f.doc_id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM p) SELECT query_id, source, max(score) AS score, min(doc_id) FILTER (r = 1) AS doc_id, arg_min(lexical_score, r) FILTER (lexical_score IS NOT NULL) AS lexical_score FROM o GROUP BY 1, 2",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by their best child; the lexical score is carried over from the best child that has one."""
    rows = fused(spark, sf).withColumn("score", F.round("score", 6)).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    known = lexical(spark, sf).select("query_id", "doc_id", F.col("score").alias("lexical_score"))
    return ret.carried(rows.join(known, ["query_id", "doc_id"], "left"), "source", "doc_id", "score", "lexical_score")


@query("r05_hybrid_search", FUSED_SQL + "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM fused) WHERE r <= 20), g AS (SELECT query_id, source, max(round(score, 6)) AS score FROM top JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT query_id, source, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS INT) AS rank FROM g) WHERE rank <= 5")
def r05(spark: SparkSession, sf: str) -> DataFrame:
    """The best 4k of a lexical and a vector search, fused by rank and cut to 4k, aggregated to groups, of which the best k are given."""
    rows = ret.top(fused(spark, sf).withColumn("score", F.round("score", 6)), "doc_id", F.desc("score"), 20).drop("rank").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ret.top(rows.groupBy("query_id", "source").agg(F.max("score").alias("score")), "source", F.desc("score"), 5)


@query("r06_multi_query", f"SELECT query_id - query_id % 100 AS query_id, vec_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM ({KNN_SQL}) WHERE rank <= 10 GROUP BY 1, 2")
def r06(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of a query (here the five query vectors of each hundred) searched one by one and fused by rank."""
    near = ret.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", vector_queries(spark, sf), 10)
    lists = near.select((F.col("query_id") - F.col("query_id") % 100).alias("query_id"), F.col("query_id").alias("list"), "vec_id", "rank")
    return ret.rrf(lists, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "j16_best_chunk",
    BM25_SQL + f", vec AS (SELECT query_id, source, doc_id, rank FROM ({NEAR_SQL}) JOIN documents USING (doc_id) WHERE rank <= 20), l AS (SELECT query_id, source, arg_min(doc_id, rank) AS doc_id FROM lex JOIN documents USING (doc_id) GROUP BY 1, 2), "
    "v AS (SELECT query_id, source, arg_min(doc_id, rank) AS doc_id FROM vec GROUP BY 1, 2), p AS (SELECT query_id, source FROM l UNION SELECT query_id, source FROM v) "
    "SELECT p.query_id, p.source, coalesce(CAST(l.doc_id AS VARCHAR), 'parent::' || p.source) AS key, coalesce(l.doc_id, v.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'lexical' ELSE 'vector' END AS by "
    "FROM p LEFT JOIN l ON l.query_id = p.query_id AND l.source = p.source LEFT JOIN v ON v.query_id = p.query_id AND v.source = p.source",
)
def j16(spark: SparkSession, sf: str) -> DataFrame:
    """The document that stands for each source: the best by words, else the nearest by vector under a key of the source's own."""
    of = table(spark, sf, "documents").select("doc_id", "source")
    words = ret.bm25(table(spark, sf, "documents"), "doc_id", text.words("text"), text_queries(spark, sf)).withColumn("score", F.round("score", 6)).join(of, "doc_id")
    near = by_vector(spark, sf).join(of, "doc_id")
    return ret.attach_chunks(words.select("query_id", "source").union(near.select("query_id", "source")), words, near, "source", "doc_id")


@query("a15_shared_references", "SELECT l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey HAVING count(*) >= 20 ORDER BY n DESC, l_partkey LIMIT 50")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    return rows.where("n >= 20").orderBy(F.desc("n"), "l_partkey").limit(50)


MEASURES_SQL = (
    f"WITH r AS ({KNN_SQL}), rel AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), "
    "h AS (SELECT r.query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM r JOIN rel USING (query_id, vec_id) WHERE rank <= 10 GROUP BY 1) "
    "SELECT n.query_id, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS rr FROM n LEFT JOIN h USING (query_id)"
)


def nearest_ten(spark: SparkSession, sf: str) -> DataFrame:
    return ret.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", vector_queries(spark, sf), 10)


def measured(spark: SparkSession, sf: str, near: DataFrame) -> DataFrame:
    """Measures at ten of what is near, with each query's label."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    m = ret.class_measures(near, q, e, "vec_id", "label")
    return m.join(q, "query_id").select("query_id", "label", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "rr")))


@query("a16_measures", MEASURES_SQL)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf, nearest_ten(spark, sf)).drop("label")


MACRO_SQL = "SELECT label, count(*) AS n, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(rr) AS mrr FROM ({}) m JOIN embeddings e ON e.vec_id = m.query_id GROUP BY label"


@query("a16_macro", f"SELECT label, n, round(recall, 4) AS recall, round(ndcg, 4) AS ndcg, round(mrr, 4) AS mrr FROM ({MACRO_SQL.format(MEASURES_SQL)})")
def a16_macro(spark: SparkSession, sf: str) -> DataFrame:
    return ret.macro(measured(spark, sf, nearest_ten(spark, sf)), "label").select("label", "n", *(F.round(c, 4).alias(c) for c in ("recall", "ndcg", "mrr")))


@query(
    "a16_gate",
    f"SELECT label, round(a.recall - b.recall, 4) AS d_recall, round(a.ndcg - b.ndcg, 4) AS d_ndcg, round(a.mrr - b.mrr, 4) AS d_mrr, a.ndcg >= 0.1 AND a.mrr >= 0.2 AS passed FROM ({MACRO_SQL.format(MEASURES_SQL)}) a JOIN ({MACRO_SQL.format(MEASURES_SQL.replace('rank <= 10', 'rank <= 5'))}) b USING (label)",
)
def a16_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest against the five nearest as two rankings."""
    near = cut(nearest_ten(spark, sf))  # searched once: ten rows a query
    ten, five = (ret.macro(measured(spark, sf, near.where(F.col("rank") <= k)), "label") for k in (10, 5))
    d = ret.gate(five, ten, "label", {"ndcg": 0.1, "mrr": 0.2})
    return d.select("label", *(F.round(c, 4).alias(c) for c in ("d_recall", "d_ndcg", "d_mrr")), "passed")


@query("r13_known_items", with_views("SELECT lower(title) AS q, min(block) AS block FROM (SELECT title, 0 AS block FROM papers WHERE is_retracted UNION ALL (SELECT title, 1 FROM papers ORDER BY coalesce(citations, 0) DESC, paper_id LIMIT 10)) GROUP BY 1 ORDER BY block, q LIMIT 8"))
def r13(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    own = p.where("is_retracted").select("title", F.lit(0).alias("block"))
    cited = p.orderBy(F.coalesce("citations", F.lit(0)).desc(), "paper_id").limit(10).select("title", F.lit(1))
    return own.union(cited).groupBy(F.lower("title").alias("q")).agg(F.min("block").alias("block")).orderBy("block", "q").limit(8)


def records(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").withColumn("doi", text.normalize_doi("doi"))
    return p.select("paper_id", "title", "doi", text.arxiv_id("doi").alias("arxiv"), text.pmid("url").alias("pmid"), text.openalex_id("url").alias("openalex"))


@query(
    "r15_id_clusters",
    with_views(
        "WITH RECURSIVE k AS (SELECT paper_id, 'd' || nullif(regexp_replace(regexp_replace(lower(trim(doi)), '^(https://doi\\.org/|doi:)', ''), '[.,;]+$', ''), '') AS v FROM papers UNION ALL SELECT paper_id, 'p' || nullif(regexp_extract(url, 'nih\\.gov/(\\d+)', 1), '') FROM papers UNION ALL SELECT paper_id, 'o' || nullif(regexp_extract(url, 'openalex\\.org/(W\\d+)', 1), '') FROM papers), "
        "f AS (SELECT v, min(paper_id) AS m FROM k WHERE v IS NOT NULL GROUP BY v), e AS (SELECT DISTINCT paper_id AS u, m AS w FROM k JOIN f USING (v)), b AS (SELECT u, w FROM e UNION SELECT w, u FROM e), "
        "reach(u, w) AS (SELECT u, w FROM b UNION SELECT r.u, b.w FROM reach r JOIN b ON r.w = b.u) SELECT p.paper_id, coalesce(min(w), p.paper_id) AS cluster FROM papers p LEFT JOIN reach ON u = paper_id GROUP BY p.paper_id"
    ).replace("WITH papers", "WITH RECURSIVE papers", 1).replace(", RECURSIVE k AS", ", k AS", 1),
)
def r15(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    comp = resolve.connected(resolve.id_links(rows, "paper_id", ("doi", "arxiv", "pmid", "openalex"))).withColumnRenamed("node", "paper_id")
    return rows.select("paper_id").join(comp, "paper_id", "left").select("paper_id", F.coalesce("component", "paper_id").alias("cluster"))


@query("r14_entity_resolution")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """Order-sensitive merging has no SQL form; a test holds it against a plain version."""
    return resolve.resolve(records(spark, sf))


@query("f16_title_ratio")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", "text")
    return b.select("item_id", sequence_ratio(F.col("text"), F.reverse(F.lower("text"))).alias("ratio"))


@query("f16_levenshtein_sibling", "SELECT item_id, round(1 - levenshtein(t, reverse(t)) / greatest(length(t), 1), 6) AS similarity FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)")
def f16s(spark: SparkSession, sf: str) -> DataFrame:
    ascii_ = F.regexp_replace("text", "[^ -~]", "")  # the twin's distance counts bytes
    distance = F.levenshtein(ascii_, F.reverse(ascii_))
    return table(spark, sf, "benchmark").select("item_id", F.round(1 - distance / F.greatest(F.length(ascii_), F.lit(1)), 6).alias("similarity"))


@query("f17_fuzzy_ratio")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select("item_id", fuzzy(F.col("text"), F.reverse("text")).alias("ratio"), fuzzy(F.substring("text", 5, 40), F.col("text"), partial=True).alias("partial"))


@query("f38_word_diff")
def f38(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", word_diffs(F.col("text"), F.replace("text", F.lit(" the "), F.lit(" a "))).alias("changes"))


@query(
    "f37_claim_drift",
    "SELECT item_id, CASE WHEN item_id % 4 = 0 AND length(replace(text, '“', '')) >= 20 THEN [replace(text, '“', '')] ELSE [] END AS drifted FROM benchmark",
)
def f37(spark: SparkSession, sf: str) -> DataFrame:
    """Edits around a quotation: of the wording (every fourth), of blanks, of what is cited, of the quotation."""
    quote = F.concat(F.lit("„"), F.replace("text", F.lit("“"), F.lit("")), F.lit("“"))
    kind = F.col("item_id") % 4
    before = F.concat(F.lit("This may be so: "), quote, F.lit(" (Kim 1999)."))
    after = F.when(kind == 0, F.concat(F.lit("This is so: "), quote, F.lit(" (Kim 1999)."))).when(kind == 1, F.concat(F.lit("This may  be so: "), quote, F.lit(" (Kim 1999).")))
    after = after.when(kind == 2, F.concat(F.lit("This is so: "), quote, F.lit(" (Lee 2001)."))).otherwise(F.concat(F.lit("This is so: "), F.replace(quote, F.lit("“"), F.lit("!“")), F.lit(" (Kim 1999).")))
    return table(spark, sf, "benchmark").select("item_id", citing.drifted_quotes(before, after).alias("drifted"))


@query("f24_naive_bayes", f"WITH d AS (SELECT doc_id, quality, {WORDS_SQL} AS t FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT token, count(*) FILTER (quality = 1) AS y, count(*) FILTER (quality = 0) AS n FROM (SELECT quality, unnest(t) AS token FROM d WHERE quality IS NOT NULL) GROUP BY token), s AS (SELECT sum(y) AS ty, sum(n) AS tn, count(*) AS v FROM c), p AS (SELECT count(*) FILTER (quality = 1) AS dy, count(*) FILTER (quality = 0) AS dn FROM d WHERE len(t) > 0), w AS (SELECT token, ln((y + 1) / (ty + v)) - ln((n + 1) / (tn + v)) AS w FROM c, s) SELECT d.doc_id, round(ln(dy / (dy + dn)) - ln(dn / (dy + dn)) + coalesce(sum(w), 0), 4) AS score FROM (SELECT doc_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS token FROM d) d LEFT JOIN w USING (token), p GROUP BY d.doc_id, dy, dn")
def f24(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return learn.naive_bayes(rows, "doc_id", "quality", 1, 0).select("doc_id", F.round("score", 4).alias("score"))


@query("r10_verify_quotes")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes with blanks doubled, and ones with a letter at their end, on the pages (lines) of documents that have them."""
    docs = table(spark, sf, "documents")
    claims = evidence.containment(docs, table(spark, sf, "benchmark"), keep=True).select("item_id", "doc_id", F.when(F.col("item_id") % 2 == 0, F.replace("quote", F.lit(" "), F.lit("  "))).otherwise(F.concat("quote", F.lit("x"))).alias("quote"))
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return evidence.verify(claims, pages.withColumn("page", F.col("page") + 1)).withColumn("ratio", F.round("ratio", 6))


@query("r11_wording_ladder")
def r11(spark: SparkSession, sf: str) -> DataFrame:
    hits = evidence.containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=True)
    third = F.floor(F.length("quote") / 3).cast("int")
    cut = F.concat(F.substring(F.col("quote"), F.lit(1), third), F.lit(" ... "), F.substring(F.col("quote"), 2 * third, F.length("quote")))
    told = F.when(F.col("item_id") % 4 == 0, F.col("quote")).when(F.col("item_id") % 4 == 1, F.upper("quote")).when(F.col("item_id") % 4 == 2, cut).otherwise(F.replace("quote", F.lit("the "), F.lit("teh ")))
    return evidence.wording(hits.withColumn("quote", told), evidence.FUZZY_LENGTH, "\n")


FORM_SQL = "[regexp_replace(replace(replace(replace(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), '[^a-z]', '', 'g'), regexp_replace(strip_accents(lower({0})), '[^a-z]', '', 'g')]"
CHAPTER_SQL = "text || ' (' || CAST(1985 + paper_id % 41 AS STRING) || ')'"
TITLE_WORDS_SQL = "regexp_extract_all(title, '\\p{L}{4,}')[1:3]"
CITED_SQL = (
    f"WITH f AS (SELECT DISTINCT paper_id, year, unnest({FORM_SQL.format('w')}) AS form FROM (SELECT paper_id, year, unnest({TITLE_WORDS_SQL}) AS w FROM papers WHERE year IS NOT NULL)), "
    f"c AS (SELECT paper_id AS chapter_id, seq, {CHAPTER_SQL} AS t FROM segments), "
    f"s AS (SELECT DISTINCT chapter_id, seq, unnest({FORM_SQL.format('w')}) AS form FROM (SELECT chapter_id, seq, unnest(regexp_extract_all(t, '\\p{{L}}+')) AS w FROM c)), "
    "y AS (SELECT DISTINCT chapter_id, seq, c.year FROM (SELECT chapter_id, seq, t, unnest(range(1985, 2026)) AS year FROM c) c WHERE contains(t, CAST(c.year AS VARCHAR))), "
    "h AS (SELECT f.paper_id, s.chapter_id, s.seq, n FROM s JOIN f ON f.form = s.form AND s.form <> '' JOIN y ON y.chapter_id = s.chapter_id AND y.seq = s.seq AND y.year = f.year JOIN (SELECT form, year, count(DISTINCT paper_id) AS n FROM f GROUP BY form, year) g ON g.form = f.form AND g.year = f.year), "
    "p AS (SELECT paper_id, count(DISTINCT [chapter_id, seq]) AS chapters, bool_or(n > 1) AS ambiguous FROM h GROUP BY paper_id) "
    "SELECT paper_id, CASE WHEN coalesce(doi, '') = '' THEN 'no_doi' WHEN is_retracted THEN 'retracted' ELSE 'clear' END AS status, coalesce(chapters, 0) AS chapters, coalesce(ambiguous, false) AS ambiguous FROM papers LEFT JOIN p USING (paper_id)"
)


@query("r16_retraction_sweep", with_views(CITED_SQL))
def r16(spark: SparkSession, sf: str) -> DataFrame:
    """Retraction status, and in how many chapters (turns of conversations, with a year behind) a paper seems to be cited; long words
    of titles stand for authors."""
    chapters = view(spark, sf, "segments").select(F.struct("paper_id", "seq").alias("chapter_id"), F.expr(CHAPTER_SQL).alias("text"))
    names = F.slice(F.regexp_extract_all("title", F.lit(r"(\p{L}{4,})")), 1, 3)
    papers = view(spark, sf, "papers")
    cited = evidence.cited_in(papers.select("paper_id", names.alias("families"), "year"), chapters)
    status = F.when(F.coalesce("doi", F.lit("")) == "", "no_doi").when(F.col("is_retracted"), "retracted").otherwise("clear")
    return papers.join(cited, "paper_id", "left").select("paper_id", status.alias("status"), F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


@query("r17_carry_over", "SELECT d.doc_id, o.first_id FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) o ON sha256(d.text) = o.h")
def r17(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on a chunk are carried to re-ingested chunks with the same text, matched by digest."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


@query("r18_batched_index")
def r18(spark: SparkSession, sf: str) -> DataFrame:
    """An embedder plugged in as a kernel over Arrow batches; this one hashes words into 16 places."""
    from ..operators.embed import embed

    return embed(table(spark, sf, "documents"), "doc_id", "text")


@query("r19_skip_reasons", "SELECT event_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN n_chars < 100 THEN 'empty' WHEN n_chars > 5000 THEN 'too_long' END AS reason FROM events LEFT JOIN documents d ON d.doc_id = user_id * 3")
def r19(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") * 3).alias("doc_id")).join(d, "doc_id", "left")
    return rows.select("event_id", F.when(F.col("n_chars").isNull(), "not_found").when(F.col("n_chars") < 100, "empty").when(F.col("n_chars") > 5000, "too_long").alias("reason"))


@query("w11_section_chunks")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.section_chunks(table(spark, sf, "documents"))


@query("r12_active_learning")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of training and reordering; a test holds the order against a plain version."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return learn.simulate(rows, "source", "doc_id", "quality", 0, 1, interval=10)


@query("j13_anchor_exclusion")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that are the anchor itself, by DOI or by title, are dropped."""
    p = records(spark, sf).select("paper_id", "title", "doi")
    anchor = p.where("paper_id = 1").select("doi", "title").head(1)  # one row
    if not anchor:
        return p.select("paper_id")
    doi, title = anchor[0]
    return p.where(~F.coalesce(F.col("doi") == F.lit(doi), F.lit(False))).where(~F.coalesce(sequence_ratio(F.col("title"), F.lit(title), 0.85) >= 0.85, F.lit(False))).select("paper_id")
