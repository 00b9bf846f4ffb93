"""Files, connectors and streams (survey §2.1, 2.10) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..session import cut
from ..sources import connectors, files
from ..sources.tables import table
from ..streaming import ledgers, rounds
from .registry import query
from .views import view, with_views


@query("s02_json_records", "SELECT doc_id, lang, n_chars FROM documents")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    path = files.work_dir(spark, "json")
    files.write_records(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path)
    return files.read_records(spark, path, "doc_id long, lang string, n_chars long")


@query("s03_jsonl_ledger", with_views("SELECT ord, paper_id, decision, round FROM ledger WHERE ord % 7 <> 3"))
def s03(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger with torn lines and lines without a paper, as a crash leaves it."""
    path = files.work_dir(spark, "ledger")
    rows = view(spark, sf, "ledger").withColumn("paper_id", F.when(F.col("ord") % 14 != 3, F.col("paper_id")))
    line = F.to_json(F.struct("ord", "paper_id", "decision", "round", "stage"))
    torn = F.when(F.col("ord") % 14 == 10, F.substring(line, 1, 20)).otherwise(line)
    rows.select(torn.alias("value")).write.text(path)
    return files.read_ledger(spark, path).select("ord", "paper_id", "decision", "round")


@query("s04_csv_dataset", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    path = files.work_dir(spark, "csv")
    c = table(spark, sf, "customer")
    shown = F.when(F.col("c_custkey") % 10 == 0, "NA").when(F.col("c_custkey") % 5 == 0, "-99").otherwise(F.format_string(" %s ", F.col("c_acctbal").cast("string")))
    c.select("c_custkey", shown.alias("c_acctbal"), "c_mktsegment").write.csv(path, header=True)
    rows = files.typed(files.read_dataset(spark, path, ["c_custkey", "c_acctbal", "c_mktsegment"]), {"c_acctbal": "metric"})
    return rows.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s05_profile", "SELECT source, CASE WHEN n % 3 = 0 THEN n / 10.0 ELSE 3.0 END::DOUBLE AS half_life, CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.2 END::DOUBLE AS recency FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    """A profile for each source, some settings broken or missing, over defaults."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    good = F.concat(F.lit("half_life: often\nhalf_life:  "), (F.col("n") / 10).cast("string"), F.lit("  # years"))
    body = F.concat(F.when(F.col("n") % 3 == 0, good).otherwise("half_life: 5 years"), F.when(F.col("n") % 2 == 0, "\n recency: 0.5").otherwise("\nrecent: 0.5"))
    return files.profiles(n.select("source", body.alias("text")), "source", "text", {"half_life": 3.0, "recency": 0.2})


@query("s06_connectors", "SELECT doc_id, 'crossref' AS module, lang AS language, 1 AS n_authors FROM documents UNION ALL SELECT doc_id, 'semantic_scholar', NULL, 2 FROM documents")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    """Responses in two services' formats, one record each, normalised to the common record."""
    d = table(spark, sf, "documents")
    one = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("DOI"), F.array(F.lit("t")).alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.lit("B").alias("family"))).alias("author"), F.col("lang").alias("language"))).alias("items")).alias("message")))
    two = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("title"), F.create_map(F.lit("DOI"), F.col("doc_id").cast("string")).alias("externalIds"), F.array(F.struct(F.lit("A B").alias("name")), F.struct(F.lit("C").alias("name"))).alias("authors"))).alias("data")))
    responses = d.select(F.lit("crossref").alias("module"), one.alias("body")).union(d.select(F.lit("semantic_scholar"), two))
    return connectors.normalize(responses, ("crossref", "semantic_scholar")).select(F.col("doi").cast("long").alias("doc_id"), F.col("source_module").alias("module"), "language", F.size("authors").alias("n_authors"))


@query(
    "s09_text_scan",
    "SELECT page_id, length(t) AS n_chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS n_words, t <> '' AS readable FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)",
)
def s09(spark: SparkSession, sf: str) -> DataFrame:
    """What pages show, as a scan of documents' pages gives it, and which have no text at all."""
    return files.page_texts(table(spark, sf, "pages"), "page_id", "html").drop("text")


@query("s10_sections")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    return files.sections(table(spark, sf, "pages"), "page_id", "html")


@query("s11_tables")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.concat("html", F.lit("<table><tr><th>a</th><td> 1 <b>x</b></td></tr><tr><td>2</table>")).alias("html"))
    return files.tables(p, "page_id", "html")


@query("s12_replace_sets", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS state, source FROM documents WHERE source <> 'src1' OR doc_id % 40 = 1")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    path = files.work_dir(spark, "sets")
    d = table(spark, sf, "documents").select("doc_id", F.lit("old").alias("state"), "source")
    files.replace_sets(d, path, "source")
    files.replace_sets(d.where("source = 'src1' and doc_id % 40 = 1").withColumn("state", F.lit("new")), path, "source")
    return spark.read.schema(d.schema).parquet(path).select("doc_id", "state", "source")


@query("s16_session_index", "SELECT 'session/' || user_id AS path, max(event_id) AS event_id, arg_max(event_type, event_id) AS topic FROM events GROUP BY user_id")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("session/"), F.col("user_id").cast("string")).alias("path"), "event_id", F.col("event_type").alias("topic"))
    return rel.latest(e, ["path"], [F.col("event_id")])


@query("s17_state_fields", "SELECT doc_id, field, value FROM (SELECT doc_id, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    md = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource:  "), "source", F.lit("\n---\n"), "text")
    return files.state_fields(table(spark, sf, "documents").select("doc_id", md.alias("md")), "doc_id", "md")


def run(spark: SparkSession, slices: list[DataFrame], merge) -> DataFrame:
    """Slices of rows that arrive one after the other, each streamed into a table once it is there."""
    base = files.work_dir(spark, "stream")
    out = ledgers.Table(spark, f"{base}/table")
    for rows in slices:
        rows.write.mode("append").parquet(f"{base}/in")
        ledgers.merge_stream(ledgers.stream(spark, f"{base}/in", None), out, merge, f"{base}/checkpoint").awaitTermination()
    return out.read()


@query("z01_ledger_stream", with_views("SELECT paper_id, stage, round, min(ord) AS ord, min_by(decision, ord) AS decision FROM ledger GROUP BY 1, 2, 3"))
def z01(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ledger").select("paper_id", "stage", "round", "ord", "decision")
    return run(spark, [rows.where(F.col("ord") % 3 == i) for i in range(3)], ledgers.first_wins(["paper_id", "stage", "round"], "ord"))


@query("z02_index_upkeep", "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9äöüß]+'), lambda t: t <> '')) AS term FROM documents) GROUP BY 1, 2")
def z02(spark: SparkSession, sf: str) -> DataFrame:
    """Every document comes as another text first and as itself later; the postings end up with the last."""
    d = table(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("t"))
    slices = [d.withColumn("t", F.slice("t", 1, 3)), d]
    return run(spark, slices, ledgers.postings_upkeep("doc_id", "t")).select("term", "doc_id", "tf")


@query("z03_supersede", with_views("SELECT paper_id, arg_max(ord, ord) AS ord, arg_max(decision, ord) AS decision FROM (SELECT *, lag(decision) OVER (PARTITION BY paper_id ORDER BY ord) AS before FROM ledger) WHERE decision IS DISTINCT FROM before GROUP BY paper_id"))
def z03(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that come in three slices by their order; one that repeats what is in force changes nothing."""
    rows = view(spark, sf, "ledger").select("paper_id", "ord", "decision")
    a, b = rows.agg(F.min("ord"), F.max("ord")).first()
    third = F.width_bucket("ord", F.lit(float(a or 0)), F.lit(float((b or 0) + 1)), F.lit(3))
    slices = [rows.where(third == i) for i in (1, 2, 3)]
    return run(spark, slices, ledgers.superseding(["paper_id"], "decision", "ord"))


@query("z05_stale", "SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01' - ts) / 86400 AS BIGINT) >= 7 OR ts IS NULL AS stale FROM events")
def z05(spark: SparkSession, sf: str) -> DataFrame:
    days = F.bround((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("t")) / 86_400_000_000).cast("long")
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t")).select("event_id", ((days >= 7) | F.col("t").isNull()).alias("stale"))


@query("z06_label_rounds", with_views("SELECT CAST(floor(ord / 100) AS BIGINT) AS round, count(*) AS n FROM ledger GROUP BY 1"))
def z06(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of one hundred labels, the points at which a ranking is made anew."""
    return view(spark, sf, "ledger").groupBy(F.floor(F.col("ord") / 100).alias("round")).agg(F.count("*").alias("n"))


@query("z06_model_rounds")
def z06m(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of documents arrive in two deliveries; after every fiftieth label of a language its model is made anew, and shows the
    ten documents that come next. A test holds the rounds against a plain version."""
    buckets, interval = 4096, 50
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    rows = rows.select("lang", "doc_id", (F.col("quality") == 0).alias("hit"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("delivery"), rounds.hashed_tokens("text", buckets).alias("tokens"))
    placed = rel.positions(rows.select("lang", "delivery", "doc_id"), ["lang", "delivery", "doc_id"])
    first = placed.groupBy("lang").agg(F.min("pos").alias("first"))
    rows = cut(rows.join(placed.join(first, "lang").select("doc_id", (F.col("pos") - F.col("first") + 1).alias("place")), "doc_id"))
    base = files.work_dir(spark, "rounds")
    for i in range(2):
        rows.where(F.col("delivery") == i).select("lang", "place", "hit", "tokens").write.mode("append").parquet(f"{base}/in")
        models = rounds.model_rounds(ledgers.stream(spark, f"{base}/in", None), "lang", "place", "hit", "tokens", interval, buckets)
        models.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("lang string, round long, labels long, w array<double>").parquet(f"{base}/out")
    return rounds.next_in_line(done, rows, "lang", "doc_id", "tokens", "place", 10)
