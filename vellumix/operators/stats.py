"""Statistics from sufficient statistics: aggregates over the rows, closed forms over the few figures that come out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut
from .relational import checked_broadcast, positions, positions_of_groups, value_ranks

# Codes for missing data.
MISSING = ("", "NA", "N/A", "na", ".", "-99")


def known(c: Column) -> Column:
    """A value, or null for a code of missing data."""
    return F.when(~F.trim(c).isin(*MISSING), F.trim(c))


def describe(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, missing, mean, sd, median, iqr, min, max."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.min(value).alias("low"), F.max(value).alias("high")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", "missing", "mean", "sd", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "low", "high")


def moments(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """n1, m1, v1, n2, m2, v2 of two groups, in one row."""
    x, y = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    return df.agg(F.count(x).alias("n1"), F.avg(x).alias("m1"), F.var_samp(x).alias("v1"), F.count(y).alias("n2"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2"))


def t_test(m: DataFrame, welch: bool = False) -> DataFrame:
    """t, df, cohen_d, hedges_g of a row of moments; pooled or Welch."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    diff = F.col("m1") - F.col("m2")
    if welch:
        se, df = F.sqrt(v1 / n1 + v2 / n2), F.pow(v1 / n1 + v2 / n2, 2) / (F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1))
    else:
        se, df = F.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
    d = F.when(pooled > 0, diff / F.sqrt(pooled)).otherwise(0.0)
    return m.select((diff / se).alias("t"), df.cast("double").alias("df"), d.alias("cohen_d"), (d * (1 - 3 / (4 * (n1 + n2) - 9))).alias("hedges_g"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return s.select("n", (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), (F.col("m") / F.col("s")).alias("d_z"))


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, rank_sum over average ranks of all rows."""
    ranks = value_ranks(df.select(group, value).where(F.col(group).isNotNull() & F.col(value).isNotNull()), value, [group])
    return ranks.select("rank", F.inline("cells")).groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("c")).alias("rank_sum"))


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """u, n1, n2, rank_biserial of group a against b."""
    sums = rank_sums(df.where(F.col(group).isin(a, b)), group, value)
    one = sums.agg(*(F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}{i}") for i, g in ((1, a), (2, b)) for c in ("n", "rank_sum")))
    u = F.col("rank_sum1") - F.col("n1") * (F.col("n1") + 1) / 2
    return one.select(u.alias("u"), "n1", "n2", (2 * u / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """w_plus, w_minus, n, matched_rank_biserial; zero differences are dropped."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranks = value_ranks(d.select("size", (F.col("d") > 0).alias("up")), "size", ["up"]).select("rank", F.inline("cells"))
    of = lambda up: F.sum(F.when(F.col("up") == up, F.col("rank") * F.col("c")).otherwise(0.0))
    s = ranks.agg(of(True).alias("w_plus"), of(False).alias("w_minus"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return s.withColumn("matched_rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """f, df_between, df_within, eta_squared."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    ss = g.crossJoin(F.broadcast(t.select("grand"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    row = ss.crossJoin(F.broadcast(t))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return row.select(f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_squared"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """The same over absolute deviations from the groups' medians."""
    med = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    return anova(df.select(group, value).join(F.broadcast(med) if med.count() <= 100_000 else med, group).select(group, F.abs(F.col(value) - F.col("med")).alias("dev")), group, "dev").select(F.col("f").alias("w"), "df_between", "df_within")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (corrected for ties), df, epsilon_squared."""
    rows = df.where(F.col(value).isNotNull())
    sums = rank_sums(rows, group, value).agg(F.sum(F.pow("rank_sum", 2) / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    return sums.crossJoin(F.broadcast(ties)).select(h.alias("h"), (F.col("k") - 1).alias("df"), (h / (n - 1)).alias("epsilon_squared"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, df, min_expected, cramers_v of a contingency table, without correction; empty cells count. hint: 'fisher' for a table of
    two by two with an expected count below five, where the exact test is the better one; else null."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    whole = ra.crossJoin(rb).join(cells, ["a", "b"], "left").crossJoin(F.broadcast(cells.agg(F.sum("o").alias("n"))))  # categories by categories
    e = F.col("ra") * F.col("rb") / F.col("n")
    s = whole.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), F.min(e).alias("min_expected"), F.max("n").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    return s.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), "min_expected", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"), F.when((F.col("r") == 2) & (F.col("c") == 2) & (F.col("min_expected") < 5), "fisher").alias("hint"))


def pearson(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """r, n, low, high (Fisher's interval)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    at = 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r")))
    half = z / F.sqrt(F.col("n") - 3)
    return both.select("r", "n", F.tanh(at - half).alias("low"), F.tanh(at + half).alias("high"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n: from the counts of distinct pairs of values, so that a value which most rows share is one row in a join."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    rank = lambda v: positions_of_groups(cells.groupBy(v).agg(F.sum("c").alias("__n")), v).select(v, (F.col("__before") + (F.col("__n") + 1) / 2).alias(f"r{v}"))
    total = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    mean = (F.col("n") + 1) / 2
    dx, dy, c = F.col("rx") - mean, F.col("ry") - mean, F.col("c")
    sums = cells.join(rank("x"), "x").join(rank("y"), "y").crossJoin(F.broadcast(total)).agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return sums.select((F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


# Rows that are weighed at once, and replicates that an interval needs.
BOOTSTRAP_ROWS, USABLE = 64, 100


def bootstrap(df: DataFrame, key: str, sums: dict[str, Column], effect: Column, replicates: int = 200, seed: int = 1) -> DataFrame:
    """replicate, value: a Poisson bootstrap of an effect, a column over weighted sums of the given terms (null counts as 0).

    Each row's weight in each replicate comes from a hash of its key, so the result does not depend on how rows are
    partitioned (but for rounding), and no replicate is ever collected. Values of one row share its weight, so pairs stay
    pairs; rows of different groups are weighed independently. Tasks sum up all replicates; a hash of 64 bits gives the
    weights of four, so their probabilities are rounded to 2**-16."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    weights = np.searchsorted(edges, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.float64)
    names = list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, -(-replicates // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total = np.zeros((len(names), len(steps) * 4))
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), np.stack([batch.column(i + 1).to_numpy() for i in range(len(names))])
            for at in range(0, len(keys), BOOTSTRAP_ROWS):
                h = keys[at : at + BOOTSTRAP_ROWS, None] + steps  # SplitMix64
                h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                total += values[:, at : at + BOOTSTRAP_ROWS] @ weights[(h ^ h >> np.uint64(31)).view(np.uint16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *(pa.array(x[:replicates]) for x in total)], ["replicate", *names])

    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()))
    parts = rows.mapInArrow(run, "replicate int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("replicate").agg(*(F.sum(n).alias(n) for n in names)).select("replicate", effect.alias("value"))


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.nullif(F.col(n), F.lit(0.0))


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """replicate, mean of one sample."""
    x = F.col(value)
    return bootstrap(df.where(x.isNotNull()), key, {"n": F.lit(1), "x": x}, _mean("x", "n"), replicates, seed).withColumnRenamed("value", "mean")


def bootstrap_paired(df: DataFrame, key: str, a: str, b: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """replicate, value: the mean difference of pairs, drawn as pairs."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return bootstrap(both, key, {"n": F.lit(1), "d": F.col(a) - F.col(b)}, _mean("d", "n"), replicates, seed)


def bootstrap_groups(df: DataFrame, key: str, group: str, value: str, a: object, b: object, replicates: int = 200, seed: int = 1, standardized: bool = False) -> DataFrame:
    """replicate, value: the difference of two groups' means, each drawn on its own; standardized: over their pooled deviation."""
    x = F.col(value).cast("double")
    rows = df.where(F.col(group).isin(a, b) & x.isNotNull())
    of = lambda g, c: F.when(F.col(group) == F.lit(g), c)
    sums = {f"{n}{i}": of(g, c) for i, g in enumerate((a, b)) for n, c in (("n", F.lit(1)), ("x", x), ("xx", x * x))}
    effect = _mean("x0", "n0") - _mean("x1", "n1")
    if standardized:
        rest = sum(F.col(f"xx{i}") - F.col(f"x{i}") * F.col(f"x{i}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)) for i in (0, 1))
        free = F.col("n0") + F.col("n1") - 2
        effect = effect / F.sqrt(F.when((free > 0) & (rest > 0), rest / free))
    return bootstrap(rows, key, sums, effect, replicates, seed)


def interval(replicates: DataFrame, value: str = "mean", level: float = 0.95, least: int = USABLE) -> DataFrame:
    """low, high, usable: the percentiles of the replicates that have a finite value; none if these are fewer than least."""
    good = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    q = F.percentile(good, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    s = replicates.agg(q.alias("q"), F.count(good).alias("usable"))
    return s.select(*(F.when(F.col("usable") >= least, F.col("q")[i]).alias(n) for i, n in enumerate(("low", "high"))), "usable")


# Coefficients of Royston's approximation (algorithm AS R94), lowest power first.
LAST, BEFORE_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_LOG_SD = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_LOG_SD, BOUND = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302), (-2.273, 0.459)


def _poly(c: tuple[float, ...], x: Column | float) -> Column | float:
    out = c[-1]
    for k in reversed(c[:-1]):
        out = out * x + k
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, which the JVM side lacks."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(NormalDist().inv_cdf, na_action="ignore").astype("float64")

    return F.pandas_udf(run, DoubleType())(p)


def normal_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def shapiro_p(w: float, n: float) -> float:
    """The p value of W by Royston."""
    if n < 4:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        bound = _poly(BOUND, n)
        return 0.0 if y >= bound else normal_tail((-math.log(bound - y) - _poly(SMALL_MEAN, n)) / math.exp(_poly(SMALL_LOG_SD, n)))
    return normal_tail((y - _poly(LARGE_MEAN, math.log(n))) / math.exp(_poly(LARGE_LOG_SD, math.log(n))))


def shapiro_wilk(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """group, n, w, p of the Shapiro-Wilk test of each group's values; w and p are null for fewer than three or equal ones.

    Ranks are global positions in the order of group, value and key (which tells rows apart), less those of the groups
    before, so that no task sorts a group. Expected normal order statistics go with the ranks, and W comes from one
    aggregate of sums of weights, values and their products, and of the two values at either end.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.col(key).alias("k"))
    placed = positions(rows, ["g", "x", "k"])
    sizes = cut(placed.groupBy("g").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.avg("x").alias("mean")))
    ranked = placed.join(checked_broadcast(sizes), "g").withColumn("i", F.col("pos") - F.col("first") + 1)
    m = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    d = F.col("x") - F.col("mean")
    at = lambda i: F.max(F.when(F.col("i") == i, d))
    s = ranked.withColumn("m", m).groupBy("g", "n").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * d).alias("mx"), F.sum(d * d).alias("xx"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(F.col("n") - 1).alias("y2"), at(F.col("n")).alias("y1"))
    top = normal_quantile((F.col("n") - 0.375) / (F.col("n") + 0.25)), normal_quantile(F.when(F.col("n") > 1, (F.col("n") - 1.375) / (F.col("n") + 0.25)))
    s = cut(s.withColumn("m1", top[0]).withColumn("m2", top[1]))
    n, u = F.col("n"), 1 / F.sqrt("n")
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(F.col("m1") / F.sqrt("mm") + _poly(LAST, u))
    a2 = F.col("m2") / F.sqrt("mm") + _poly(BEFORE_LAST, u)
    two = n > 5
    left = F.col("mm") - 2 * F.col("m1") * F.col("m1") - F.when(two, 2 * F.col("m2") * F.col("m2")).otherwise(0.0)
    share = F.sqrt(left / (1 - 2 * a1 * a1 - F.when(two, 2 * a2 * a2).otherwise(0.0)))
    ends = F.col("m1") * (F.col("y1") - F.col("x1")) + F.when(two, F.col("m2") * (F.col("y2") - F.col("x2"))).otherwise(0.0)
    inner = F.when(n > 3, (F.col("mx") - ends) / share).otherwise(0.0)
    total = a1 * (F.col("y1") - F.col("x1")) + F.when(two, a2 * (F.col("y2") - F.col("x2"))).otherwise(0.0) + inner
    w = F.when((n >= 3) & (F.col("xx") > 0), F.least(F.lit(1.0), total * total / F.col("xx")))
    out = cut(s.select(F.col("g").alias(group), "n", w.alias("w")))
    return out.withColumn("p", F.when(F.col("w").isNotNull(), p_column("shapiro", F.col("w"), F.col("n"))))


def group_sizes(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """smallest (the group with the fewest values, the first of equal ones), n, violated: whether that is below least."""
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"))
    return counts.agg(F.min_by("g", F.struct("n", "g")).alias("smallest"), F.min("n").alias("n")).where("n is not null").withColumn("violated", F.col("n") < least)


def random_effects(studies: DataFrame, yi: str = "yi", vi: str = "vi") -> DataFrame:
    """k, q, tau2, pooled, se, low, high, i2 by DerSimonian and Laird; needs three studies and positive variances."""
    w = 1 / F.col(vi)
    good = studies.where(F.col(yi).isNotNull() & (F.col(vi) > 0))
    s = good.agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(yi)).alias("wy"), F.sum(w * F.col(yi) * F.col(yi)).alias("wyy"))
    q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    tau2 = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w")))
    one = s.where("k >= 3").select("k", q.alias("q"), tau2.alias("tau2"))
    star = good.crossJoin(F.broadcast(one)).groupBy("k", "q", "tau2").agg(F.sum(1 / (F.col(vi) + F.col("tau2"))).alias("ws"), F.sum(F.col(yi) / (F.col(vi) + F.col("tau2"))).alias("wsy"))
    pooled, se = F.col("wsy") / F.col("ws"), 1 / F.sqrt("ws")
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q") * 100)).otherwise(0.0)
    return star.select("k", "q", "tau2", pooled.alias("pooled"), se.alias("se"), (pooled - 1.96 * se).alias("low"), (pooled + 1.96 * se).alias("high"), i2.alias("i2"))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out / a


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p_value(x: float, df: float) -> float:
    """Upper tail of chi-square: series for the regularised incomplete gamma function, or its continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    out = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def p_column(kind: str, *columns: Column) -> Column:
    """p values of statistics: kind t (t, df), f (f, df1, df2), chi2 (x, df) or shapiro (w, n). A pandas UDF over result rows, of which there are few."""
    f = {"t": t_p_value, "f": f_p_value, "chi2": chi2_p_value, "shapiro": shapiro_p}[kind]

    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(map(pd.isna, row)) else f(*map(float, row)) for row in zip(*args, strict=True)], dtype="float64")

    return F.pandas_udf((_three if kind == "f" else _two)(run), DoubleType())(*columns)


def _two(run):
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return f


def _three(run):
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return f


def skewness(df: DataFrame, value: str) -> DataFrame:
    """Population skewness."""
    return df.agg(F.skewness(value).alias("skew"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
