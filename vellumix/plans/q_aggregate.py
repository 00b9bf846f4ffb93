"""Aggregations and statistics (survey §2.4) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..operators import screening, stats
from ..sources.tables import table
from .q_relational import ISLANDS_SQL
from .q_scalar import DOI_SQL, WORDS_SQL
from .registry import query
from .views import view, with_views


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("a01_counts", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_ones, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"), F.countDistinct("source").alias("sources"))


@query("a02_code_book", with_views("SELECT code, count(*) AS n, list_sort(list(DISTINCT speaker)) AS speakers, arg_min(memo, paper_id * 1000 + seq) FILTER (memo IS NOT NULL) AS memo FROM segments WHERE code IS NOT NULL GROUP BY code"))
def a02(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segments").where("code is not null")
    return s.groupBy("code").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("speaker")).alias("speakers"), F.min_by("memo", F.when(F.col("memo").isNotNull(), F.struct("paper_id", "seq"))).alias("memo"))


@query("a03_methods", "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS manual FROM events")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("manual"))


@query("a04_per_module", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY n_name")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """Modules without rows keep their zero: counted first, joined after."""
    counts = table(spark, sf, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("a05_sheets", "SELECT sheet, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'shelf' ELSE 'licence needed' END AS sheet FROM orders) GROUP BY sheet")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    sheet = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "shelf").otherwise("licence needed")
    return table(spark, sf, "orders").groupBy(sheet.alias("sheet")).agg(F.count("*").alias("n"))


MERGED = "SELECT paper_id, max_by(decision, ord) AS decision FROM ledger WHERE stage = '{}' AND (round = '1' OR decided_by = 'rule') GROUP BY paper_id"
PRISMA = "SELECT count(*) FILTER (decision = 'exclude') AS e, count(*) FILTER (decision = 'unclear') AS u, count(*) FILTER (decision = 'include') AS i, count(*) AS n FROM ({})"


@query(
    "a06_prisma",
    with_views(
        f"SELECT s.e + s.u + s.i AS n_identified, s.e + s.u + s.i AS n_after_dedup, s.e AS n_excluded_screening, g.e AS n_excluded_eligibility, CASE WHEN g.n > 0 THEN s.i - g.e - g.u ELSE s.i END AS n_included, s.u AS n_unclear_screening "
        f"FROM ({PRISMA.format(MERGED.format('screening'))}) s, ({PRISMA.format(MERGED.format('eligibility'))}) g"
    ),
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    ledger = view(spark, sf, "ledger")

    def counts(stage: str) -> DataFrame:
        of = lambda d: F.count_if(F.col("decision") == d)
        return screening.merged(ledger, stage).agg(of("exclude").alias(f"{stage}_e"), of("unclear").alias(f"{stage}_u"), of("include").alias(f"{stage}_i"), F.count("*").alias(f"{stage}_n"))

    row = counts("screening").crossJoin(counts("eligibility"))  # one row each
    total = F.col("screening_e") + F.col("screening_u") + F.col("screening_i")
    included = F.when(F.col("eligibility_n") > 0, F.col("screening_i") - F.col("eligibility_e") - F.col("eligibility_u")).otherwise(F.col("screening_i"))
    return row.select(total.alias("n_identified"), total.alias("n_after_dedup"), F.col("screening_e").alias("n_excluded_screening"), F.col("eligibility_e").alias("n_excluded_eligibility"), included.alias("n_included"), F.col("screening_u").alias("n_unclear_screening"))


ROUNDS_SQL = "SELECT paper_id, max_by(decision, ord) FILTER (round = '1') AS r1, max_by(decision, ord) FILTER (round = '2') AS r2, max_by(decision, ord) FILTER (round = 'human') AS human FROM ledger WHERE stage = 'screening' AND decided_by <> 'rule' GROUP BY paper_id"
BUCKET_SQL = f"SELECT paper_id, coalesce(human, CASE WHEN r1 = r2 THEN r1 ELSE 'dissent' END) AS bucket FROM ({ROUNDS_SQL}) WHERE r1 IS NOT NULL AND r2 IS NOT NULL UNION ALL SELECT DISTINCT paper_id, 'exclude' FROM ledger WHERE stage = 'screening' AND decided_by = 'rule' AND decision = 'exclude'"


@query("a07_prisma_double", with_views(f"SELECT count(*) AS n_after_dedup, count(*) FILTER (bucket = 'exclude') AS n_excluded, count(*) FILTER (bucket IN ('unclear', 'dissent')) AS n_unclear, count(*) FILTER (bucket = 'include') AS n_included FROM ({BUCKET_SQL})"))
def a07(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda *d: F.count_if(F.col("bucket").isin(*d))
    return screening.consolidate(view(spark, sf, "ledger")).agg(F.count("*").alias("n_after_dedup"), of("exclude").alias("n_excluded"), of("unclear", "dissent").alias("n_unclear"), of("include").alias("n_included"))


@query("a08_rounds", with_views(ROUNDS_SQL))
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return screening.rounds(view(spark, sf, "ledger"))


@query("a09_consolidate", with_views(BUCKET_SQL))
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return screening.consolidate(view(spark, sf, "ledger"))


@query(
    "a10_kappa",
    with_views(
        f"WITH p AS (SELECT * FROM ({ROUNDS_SQL}) WHERE r1 IS NOT NULL AND r2 IS NOT NULL) SELECT round(CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 4) AS kappa, n, round(po, 4) AS po, round(pe, 4) AS pe FROM (SELECT count(*) AS n, avg(CAST(r1 = r2 AS INT)) AS po, "
        "(SELECT sum(x.c * y.c) FROM (SELECT r1, count(*) AS c FROM p GROUP BY r1) x JOIN (SELECT r2, count(*) AS c FROM p GROUP BY r2) y ON r1 = r2) / (count(*) * count(*)) AS pe FROM p)"
    ),
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return screening.kappa(screening.rounds(view(spark, sf, "ledger")))


@query("a11_dissent", with_views(f"SELECT paper_id, r1, r2 FROM ({ROUNDS_SQL}) WHERE r1 <> r2 AND human IS NULL"))
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return screening.rounds(view(spark, sf, "ledger")).where("r1 <> r2 and human is null").select("paper_id", "r1", "r2")


@query("a11_open_cases", with_views("SELECT paper_id, stage, min(ord) AS ord FROM ledger WHERE decision = 'unclear' AND round = '1' GROUP BY paper_id, stage"))
def a11b(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ledger").where("decision = 'unclear' and round = '1'").groupBy("paper_id", "stage").agg(F.min("ord").alias("ord"))


NAMES_SQL = "list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda t: t <> '')[1:4]"
FILLED_SQL = " + ".join(f"CAST(coalesce(CAST({c} AS STRING), '') <> '' AS INT)" for c in ("d", "title", "year", "citations", "fwci", "venue", "oa_url"))
MERGED_SQL = (
    f"WITH r AS (SELECT *, {DOI_SQL} AS d, {NAMES_SQL} AS names FROM papers WHERE url IS NOT NULL), "
    f"o AS (SELECT *, {FILLED_SQL} AS filled, row_number() OVER (PARTITION BY url ORDER BY coalesce(d, ''), lower(trim(title)), source_module, paper_id) AS k FROM r), "
    "b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY filled DESC, coalesce(citations, 0) DESC, k) = 1), "
    "a AS (SELECT url, list(author ORDER BY k, p) AS authors FROM (SELECT url, author, min([k, p]) AS place, place[1] AS k, place[2] AS p FROM (SELECT url, k, unnest(names) AS author, generate_subscripts(names, 1) AS p FROM o) GROUP BY url, author) GROUP BY url), "
    "g AS (SELECT url, count(*) AS n, arg_min(d, k) FILTER (coalesce(d, '') <> '') AS d, arg_min(oa_url, k) FILTER (coalesce(oa_url, '') <> '') AS u, max(coalesce(citations, 0)) AS citations, bool_or(is_retracted) AS is_retracted, list_sort(list(DISTINCT source_module)) AS sources FROM o GROUP BY url) "
    "SELECT g.url, g.n, b.paper_id AS best, b.title, b.year, b.venue, coalesce(nullif(b.d, ''), g.d) AS doi, coalesce(nullif(b.oa_url, ''), g.u) AS oa_url, coalesce(a.authors, []) AS authors, g.citations, g.is_retracted, g.sources FROM g JOIN b ON b.url = g.url LEFT JOIN a ON a.url = g.url"
)


@query("a12_survivorship", with_views(MERGED_SQL))
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one address merged; the first words of a title stand for its authors."""
    from ..operators.resolve import merged

    names = F.slice(F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda t: t != ""), 1, 4)
    return merged(view(spark, sf, "papers").withColumn("doi", text.normalize_doi("doi")).withColumn("authors", names), "url")


@query("a17_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, list_element(list_sort(list(value)), CAST(floor(count(*) * 0.95) AS BIGINT) + 1) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Median and nearest-rank percentile from counts of distinct values and their positions in ranges, so that no task has
    all values of an event type."""
    e = table(spark, sf, "events").where("value is not null")
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("__n"))
    up = rel.positions_of_groups(counts, "value", within=["event_type"]).withColumn("upto", F.col("__before") + F.col("__n"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    low, high, p95 = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2)), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1))
    return up.join(rel.checked_broadcast(n), "event_type").groupBy("event_type", "mean", "n").agg(F.round((low + high) / 2, 6).alias("p50"), p95.alias("p95"))


@query("a18_descriptives", "SELECT o_orderstatus, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.describe(table(spark, sf, "orders"), "o_totalprice", ("o_orderstatus",)))


@query("a19_crosstab", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return stats.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("a20_group_stats", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS m, round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY c_mktsegment")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("m"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"))


MOMENTS_SQL = "SELECT count(*) FILTER (o_orderstatus = 'O') AS n1, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m1, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v1, count(*) FILTER (o_orderstatus = 'F') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m2, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v2 FROM orders"


def orders_moments(spark: SparkSession, sf: str) -> DataFrame:
    return stats.moments(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "O", "F")


@query("a21_t_test", f"SELECT round((m1 - m2) / sqrt(p * (1.0 / n1 + 1.0 / n2)), 4) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df, round((m1 - m2) / sqrt(p), 4) AS cohen_d, round((m1 - m2) / sqrt(p) * (1 - 3.0 / (4 * (n1 + n2) - 9)), 4) AS hedges_g FROM (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS p FROM ({MOMENTS_SQL}))")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.t_test(orders_moments(spark, sf)))


@query("a21_welch", f"SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM ({MOMENTS_SQL})")
def a21w(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.t_test(orders_moments(spark, sf), welch=True).select("t", "df"))


@query("a21_paired", "SELECT n, round(m / (s / sqrt(n)), 4) AS t, n - 1 AS df, round(m / s, 6) AS d_z FROM (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT l_extendedprice - l_extendedprice * (1 - l_discount) * (1 + l_tax) AS d FROM lineitem))")
def a21p(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("b"))
    return stats.paired_t(rows, "a", "b").select("n", F.round("t", 4).alias("t"), "df", F.round("d_z", 6).alias("d_z"))


@query("a21_p_values")
def a21v(spark: SparkSession, sf: str) -> DataFrame:
    """t test with its p value, which SQL has no function for; a test holds the tails against known values."""
    return stats.t_test(orders_moments(spark, sf)).withColumn("p", stats.p_column("t", F.col("t"), F.col("df")))


RANKED_SQL = "SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}"


@query("a22_mann_whitney", "SELECT round(r1 - n1 * (n1 + 1) / 2.0, 4) AS u, n1, n2, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) AS rank_biserial FROM (SELECT CAST(sum(r) FILTER (g = 'click') AS DOUBLE) AS r1, count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'view') AS n2 FROM (" + RANKED_SQL.format(g="event_type", v="value", t="(SELECT * FROM events WHERE event_type IN ('click', 'view'))") + "))")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mann_whitney(table(spark, sf, "events"), "event_type", "value", "click", "view").select(F.round("u", 4).alias("u"), "n1", "n2", F.round("rank_biserial", 6).alias("rank_biserial"))


@query("a22_wilcoxon", "SELECT round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 2) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 2) AS w_minus, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r), 6) AS matched_rank_biserial FROM (SELECT d, CAST(rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS DOUBLE) AS r FROM (SELECT l_quantity - l_linenumber * 6 AS d FROM lineitem) WHERE d <> 0)")
def a22w(spark: SparkSession, sf: str) -> DataFrame:
    w = stats.wilcoxon(table(spark, sf, "lineitem").withColumn("b", F.col("l_linenumber") * 6), "l_quantity", "b")
    return w.select(F.round("w_plus", 2).alias("w_plus"), F.round("w_minus", 2).alias("w_minus"), "n", F.round("matched_rank_biserial", 6).alias("matched_rank_biserial"))


@query("a23_anova", "SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, k - 1 AS df_between, n - k AS df_within, round(ssb / (ssb + ssw), 6) AS eta_squared FROM (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * power(m - grand, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM (SELECT count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), (SELECT avg(o_totalprice) AS grand FROM orders))")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return stats.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select(F.round("f", 4).alias("f"), "df_between", "df_within", F.round("eta_squared", 6).alias("eta_squared"))


@query("a23_kruskal", "SELECT round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (power(n, 3) - n)), 4) AS h, k - 1 AS df FROM (SELECT sum(power(rs, 2) / c) AS s, CAST(sum(c) AS BIGINT) AS n, count(*) AS k FROM (SELECT sum(r) AS rs, count(*) AS c FROM (" + RANKED_SQL.format(g="event_type", v="value", t="events") + ") GROUP BY g)), (SELECT sum(power(t, 3) - t) AS ties FROM (SELECT count(*) AS t FROM events GROUP BY value))")
def a23k(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kruskal(table(spark, sf, "events"), "event_type", "value").select(F.round("h", 4).alias("h"), "df")


@query("a24_chi_square", "SELECT *, CASE WHEN df = 1 AND min_expected < 5 THEN 'fisher' END AS hint FROM (SELECT round(sum(power(coalesce(o, 0) - e, 2) / e), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, round(min(e), 4) AS min_expected FROM (SELECT ra.a, rb.b, o, ra.c * rb.c / n AS e FROM (SELECT o_orderstatus AS a, count(*) AS c FROM orders GROUP BY 1) ra CROSS JOIN (SELECT o_orderpriority AS b, count(*) AS c FROM orders GROUP BY 1) rb CROSS JOIN (SELECT count(*) AS n FROM orders) LEFT JOIN (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2) x ON x.a = ra.a AND x.b = rb.b))")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("chi2", 4).alias("chi2"), "df", F.round("min_expected", 4).alias("min_expected"), "hint")


@query("a25_pearson", "SELECT round(r, 6) AS r, n, round(tanh(0.5 * ln((1 + r) / (1 - r)) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(0.5 * ln((1 + r) / (1 - r)) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@query("a25_spearman", "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS ry FROM lineitem)")
def a25s(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount"), 6)


@query("a26_effect_sizes", f"SELECT round((m1 - m2) / sqrt(p), 6) AS d, round(0.5 * (m1 - m2) / sqrt(p), 6) AS half FROM (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS p FROM ({MOMENTS_SQL}))")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return stats.t_test(orders_moments(spark, sf)).select(F.round("cohen_d", 6).alias("d"), F.round(F.col("cohen_d") / 2, 6).alias("half"))


@query("a27_levene", "WITH d AS (SELECT o_orderpriority AS g, abs(o_totalprice - med) AS x FROM orders JOIN (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1) ON p = o_orderpriority) SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS w, k - 1 AS df_between, n - k AS df_within FROM (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * power(m - grand, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY g), (SELECT avg(x) AS grand FROM d))")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return stats.levene(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select(F.round("w", 4).alias("w"), "df_between", "df_within")


@query("a27_skewness", "SELECT round((sum(power(value - m, 3)) / count(*)) / power(sum(power(value - m, 2)) / count(*), 1.5), 6) AS skew FROM events, (SELECT avg(value) AS m FROM events)")
def a27s(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.skewness(table(spark, sf, "events"), "value"), 6)


@query("a27_shapiro_wilk")
def a27w(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the normal distribution have no SQL form; tests hold W and p against a plain version and known values."""
    return rounded(stats.shapiro_wilk(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey"), 6)


@query("a27_group_size", "SELECT arg_min(g, (1000000000 + n)::VARCHAR || g) AS smallest, min(n) AS n, min(n) < 300 AS violated FROM (SELECT o_orderpriority AS g, count(o_totalprice) AS n FROM orders GROUP BY 1)")
def a27g(spark: SparkSession, sf: str) -> DataFrame:
    return stats.group_sizes(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 300)


# Replicates of an analysis plan that names none, and of a paired difference.
STANDARD_BOOTSTRAP, BOOTSTRAP_RESAMPLES = 2_000, 10_000


@query("a28_bootstrap")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of a mean, a paired difference, and a difference of two groups, plain and standardized. Resampling by hash; tests
    check the intervals against the normal ones."""
    o = table(spark, sf, "orders")
    pairs = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"))
    groups = lambda standardized: stats.bootstrap_groups(o, "o_orderkey", "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW", STANDARD_BOOTSTRAP, standardized=standardized)
    kinds = {
        "one": stats.bootstrap_means(table(spark, sf, "events"), "event_id", "value", STANDARD_BOOTSTRAP).withColumnRenamed("mean", "value"),
        "paired": stats.bootstrap_paired(pairs, "k", "a", "b", STANDARD_BOOTSTRAP),
        "independent": groups(False),
        "standardized": groups(True),
    }
    out = [stats.interval(r, "value").withColumn("kind", F.lit(k)) for k, r in kinds.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).select("kind", "low", "high", "usable")


@query("a29_paired_bootstrap")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of a mean difference, and whether it carries: zero lies outside."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_extendedprice") * F.col("l_discount") - F.col("l_extendedprice") * F.col("l_tax")).alias("d"))
    return stats.interval(stats.bootstrap_means(rows, "k", "d", BOOTSTRAP_RESAMPLES)).withColumn("carries", (F.col("low") > 0) | (F.col("high") < 0))


STUDIES_SQL = "SELECT avg(o_totalprice) AS yi, var_samp(o_totalprice) / count(*) AS vi FROM orders GROUP BY o_orderpriority"


@query(
    "a30_random_effects",
    f"WITH s AS ({STUDIES_SQL}), f AS (SELECT count(*) AS k, sum(1 / vi) AS w, sum(1 / (vi * vi)) AS w2, sum(yi / vi) AS wy, sum(yi * yi / vi) AS wyy FROM s), t AS (SELECT k, wyy - wy * wy / w AS q, greatest(0.0, (wyy - wy * wy / w - (k - 1)) / (w - w2 / w)) AS tau2 FROM f) "
    "SELECT k, round(q, 4) AS q, round(tau2, 1) AS tau2, round(sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)), 4) AS pooled, round(1 / sqrt(sum(1 / (vi + tau2))), 4) AS se, round(CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q * 100) ELSE 0 END, 4) AS i2 FROM s, t GROUP BY k, q, tau2",
)
def a30(spark: SparkSession, sf: str) -> DataFrame:
    studies = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("yi"), (F.var_samp("o_totalprice") / F.count("*")).alias("vi"))
    return stats.random_effects(studies).select("k", F.round("q", 4).alias("q"), F.round("tau2", 1).alias("tau2"), F.round("pooled", 4).alias("pooled"), F.round("se", 4).alias("se"), F.round("i2", 4).alias("i2"))


@query("a31_nb_counts", f"SELECT quality, w, count(*) AS n FROM (SELECT quality, unnest({WORDS_SQL}) AS w FROM documents JOIN labels USING (doc_id)) GROUP BY quality, w")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.learn import token_counts

    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return token_counts(rows, "quality").select("quality", F.col("token").alias("w"), "n")


@query("a32_blocks", with_views("SELECT CAST(floor((ord - first) / 50) AS BIGINT) AS block, count(*) AS n, count(*) FILTER (decision = 'include') AS included FROM (SELECT *, min(ord) OVER () AS first FROM ledger) GROUP BY 1"))
def a32(spark: SparkSession, sf: str) -> DataFrame:
    ledger = rel.positions(view(spark, sf, "ledger"), ["ord"])
    return ledger.groupBy(F.floor((F.col("pos") - 1) / 50).alias("block")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "include").alias("included"))


@query("a33_recall_curve", "SELECT share, CAST(greatest(1, round_even(n * share / 100.0, 0)) AS BIGINT) AS seen, round((SELECT count(*) FROM e WHERE hit AND r <= greatest(1, round_even(n * share / 100.0, 0))) / (SELECT count(*) FROM e WHERE hit), 6) AS recall FROM (SELECT unnest([10, 25, 50, 75, 100]) AS share), (SELECT count(*) AS n FROM e)".replace("SELECT share,", "WITH e AS (SELECT event_type = 'purchase' AS hit, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events) SELECT share,", 1))
def a33(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.learn import recall_curve

    ranked = rel.positions(table(spark, sf, "events").select((-F.col("value")).alias("o"), "event_id", (F.col("event_type") == "purchase").alias("hit")), ["o", "event_id"], "rank")
    return recall_curve(ranked, "rank", "hit", (10, 25, 50, 75, 100))


@query("a34_density", f"SELECT e.user_id, count(*) AS total, count(*) FILTER (value >= 20) AS covered, coalesce(any_value(i.length), 0) AS longest FROM events e LEFT JOIN (SELECT user_id, max(length) AS length FROM ({ISLANDS_SQL}) GROUP BY user_id) i ON i.user_id = e.user_id GROUP BY e.user_id")
def a34(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("bare", F.col("value") < 20)
    runs = rel.gaps_and_islands(e, ["user_id"], "event_id", "bare").groupBy("user_id").agg(F.max("length").alias("longest"))
    return e.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~F.col("bare")).alias("covered")).join(runs, "user_id", "left").select("user_id", "total", "covered", F.coalesce("longest", F.lit(0)).alias("longest"))


@query("a35_audit_balance", "SELECT user_id, count(*) FILTER (event_type = 'view') AS faithful, count(*) FILTER (event_type = 'error') AS finding, count(*) FILTER (event_type NOT IN ('view', 'error')) AS open, min(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 2 ELSE 1 END) AS worst FROM events GROUP BY user_id")
def a35(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(t == "view").alias("faithful"), F.count_if(t == "error").alias("finding"), F.count_if(~t.isin("view", "error")).alias("open"), F.min(F.when(t == "error", 0).when(t == "view", 2).otherwise(1)).alias("worst"))


def overlap_sql(n: int) -> str:
    grams = f"list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ')"
    return (
        f"SELECT id AS item_id, {n} AS n, count(*) AS grams, count(c.g) AS shared, round(100.0 * count(c.g) / count(*), 4) AS percent FROM (SELECT DISTINCT item_id AS id, {grams} AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT item_id, string_split_regex(trim(lower(text)), '\\s+') AS w FROM benchmark) WHERE len(w) >= {n})) g "
        f"LEFT JOIN (SELECT DISTINCT {grams} AS g FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT string_split_regex(trim(lower(text)), '\\s+') AS w FROM documents) WHERE len(w) >= {n})) c ON c.g = g.g GROUP BY id"
    )


LEVELS_SQL = " UNION ALL ".join(f"SELECT *, percent > {limit} AS flagged FROM ({overlap_sql(n)})" for n, limit in ((3, 40), (4, 25), (5, 15), (6, 8), (7, 5)))


@query("a36_ngram_overlap", LEVELS_SQL)
def a36(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.style import overlap_levels

    return overlap_levels(table(spark, sf, "benchmark"), "item_id", table(spark, sf, "documents"))


@query("a36_severity", f"SELECT item_id, CASE WHEN bool_or(n = 7 AND flagged) THEN 'high' WHEN bool_or(n = 5 AND flagged) THEN 'medium' WHEN bool_or(n = 4 AND flagged) THEN 'low' ELSE 'none' END AS severity FROM ({LEVELS_SQL}) GROUP BY item_id")
def a36s(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.style import overlap_levels, overlap_severity

    return overlap_severity(overlap_levels(table(spark, sf, "benchmark"), "item_id", table(spark, sf, "documents"), (4, 5, 7)), "item_id")


@query(
    "a37_style",
    "WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{L}+') AS w, list_filter(string_split_regex(lower(text), '[.!?]+\\s+'), lambda t: regexp_matches(t, '\\p{L}')) AS s FROM documents), "
    "m AS (SELECT *, list_transform(s, lambda t: len(regexp_extract_all(t, '\\p{L}+'))) AS l, list_filter(w, lambda t: length(t) >= 4) AS content FROM d), "
    "c AS (SELECT doc_id, sum(n) FILTER (r <= 10) AS top FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(content) AS x FROM m) GROUP BY 1, 2)) GROUP BY doc_id), "
    "g AS (SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, x FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)) GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY doc_id) "
    "SELECT m.doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_types, round(coalesce(list_sum(l), 0) / greatest(len(s), 1), 4) AS mean_sentence, CAST(coalesce(list_median(l), 0) AS DOUBLE) AS median_sentence, round(coalesce(list_stddev_pop(l), 0), 4) AS sd_sentence, "
    "round(len(list_filter(s, lambda t: regexp_matches(t, '\\b(wird|werden|wurde|wurden)\\b(.|\\n)*\\b(ge\\p{L}+(t|en)|\\p{L}+iert)\\b'))) / greatest(len(s), 1), 6) AS passive_share, "
    "round(len(list_filter(s, lambda t: len(list_filter(regexp_extract_all(t, '\\p{L}+'), lambda x: regexp_matches(x, '(ung|heit|keit|tion)$'))) >= 3)) / greatest(len(s), 1), 6) AS nominal_share, "
    "round(len(list_filter(w, lambda t: t IN ('quasi', 'eigentlich', 'irgendwie', 'sozusagen', 'gewissermaßen'))) / greatest(len(w), 1), 6) AS filler_share, round(1000.0 * len(regexp_extract_all(lower(text), 'darüber hinaus|furthermore|moreover|zusätzlich|in conclusion')) / greatest(len(w), 1), 4) AS transitions, "
    "round(1000.0 * len(regexp_extract_all(text, '\\([^()]*(?:19|20)[0-9][0-9][^()]*\\)')) / greatest(len(w), 1), 4) AS sources, CASE WHEN len(content) > 0 THEN round(coalesce(top, 0) / len(content), 6) ELSE 0 END AS top10_share, coalesce(repeated, 0) AS repeated "
    "FROM m LEFT JOIN c ON c.doc_id = m.doc_id LEFT JOIN g ON g.doc_id = m.doc_id",
)
def a37(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.style import style_metrics

    return style_metrics(table(spark, sf, "documents"))


@query("a38_cluster_sheet", with_views("SELECT CASE WHEN citations >= 500 THEN 'core' WHEN citations >= 200 THEN 'middle' ELSE 'rest' END AS cluster, count(*) AS n, round(avg(citations), 4) AS mean, min(year) AS first_year, max(year) AS last_year FROM papers GROUP BY 1"))
def a38(spark: SparkSession, sf: str) -> DataFrame:
    cluster = F.when(F.col("citations") >= 500, "core").when(F.col("citations") >= 200, "middle").otherwise("rest")
    return view(spark, sf, "papers").groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("citations"), 4).alias("mean"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("a39_active_decisions", with_views("SELECT ord, paper_id, decision, nxt AS superseded_by FROM (SELECT *, lead(ord) OVER (PARTITION BY paper_id, stage ORDER BY ord) AS nxt FROM ledger)"))
def a39(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("paper_id", "stage").orderBy("ord")
    return view(spark, sf, "ledger").select("ord", "paper_id", "decision", F.lead("ord").over(w).alias("superseded_by"))


@query("a40_name_audit", "SELECT DISTINCT a.c_custkey FROM (SELECT c_custkey, c_nationkey, lower(c_mktsegment) AS family FROM customer WHERE c_acctbal >= 0) a JOIN (SELECT c_nationkey, lower(c_mktsegment) AS given FROM customer WHERE c_acctbal < 0) b ON a.c_nationkey = b.c_nationkey AND family = given")
def a40(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lower("c_mktsegment").alias("name"))
    return c.where("c_acctbal >= 0").join(c.where("c_acctbal < 0"), ["c_nationkey", "name"], "left_semi").select("c_custkey")


@query("a41_manifest", "SELECT lang, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS manifest FROM documents GROUP BY lang")
def a41(spark: SparkSession, sf: str) -> DataFrame:
    """A digest per language over the texts' own digests: what is gathered per group is one line per text."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("x"))
    return rows.select("lang", F.sha2(F.array_join(F.transform("x", lambda r: r["l"]), "\n"), 256).alias("manifest"))
