"""Statistics: sufficient sums in Spark, probabilities from a few numbers on the driver (no scipy)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import small
from ledgerline.operators.ranks import ordered
from ledgerline.scratch import once


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties averaged.  Values are counted first, so only distinct ones are put in order.

    Ranks meet their rows by value, so ``df`` must give the same values each time it is computed (``scratch.once``).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = ordered(counts, value, by=by, measure="_n").select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """n and correlation of complete pairs."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """n and rank correlation of complete pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = once(pairs, "pairs")
    ranked = average_ranks(average_ranks(pairs, "_x", "_rx", by), "_y", "_ry", by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, rho) for every pair of columns."""
    out, df = None, once(df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns))), "columns")
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i + 1 :], i + 1):
            one = spearman(df, f"_{i}", f"_{j}").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho")
            out = one if out is None else out.unionByName(one)
    return out


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Simple regression: n, slope, intercept, r2 and the slope's standard error."""
    fit = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    error = F.when(F.col("n") > 2, F.sqrt((1 - F.col("r2")) * F.col("_syy") / (F.col("n") - 2) / F.col("_sxx")))
    return fit.withColumn("slope_error", error).drop("_sxx", "_syy")


def chi_square(df: DataFrame, a: str, b: str, yates: bool = False) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table; cells without rows count, by margins.

    Only the table of counts is windowed: its size is the number of value pairs.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o").alias("n"))
    grid = rows.join(small(columns), how="cross").join(cells, [a, b], "left").join(F.broadcast(total), how="cross")
    expected = F.col("ra") * F.col("cb") / F.col("n")
    off = F.abs(F.coalesce("o", F.lit(0)) - expected) - (F.least(F.lit(0.5), F.abs(F.coalesce("o", F.lit(0)) - expected)) if yates else F.lit(0.0))
    return grid.agg(F.sum(off * off / expected).alias("statistic"), ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"), F.max("n").alias("n"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H, corrected for ties, its degrees of freedom, and n."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("_v"), F.col(group).alias("_g"))
    rows = once(rows, "values")
    ranked = average_ranks(rows, "_v", "_r")
    sums = ranked.groupBy("_g").agg(F.sum("_r").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = rows.groupBy("_v").agg(F.count("*").alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return sums.crossJoin(F.broadcast(ties)).select(h.alias("h"), (F.col("k") - 1).alias("df"), "n")


def signed_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wilcoxon signed-rank sums of paired differences; zero differences drop out."""
    diff = df.select((F.col(x) - F.col(y)).alias("_d")).where("_d is not null and _d != 0").withColumn("_a", F.abs("_d"))
    ranked = average_ranks(once(diff, "differences"), "_a", "_r")
    plus, minus = (F.coalesce(F.sum(F.when(F.col("_d") * s > 0, F.col("_r"))), F.lit(0.0)) for s in (1, -1))
    return ranked.agg(F.count("*").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"))


def rank_sum(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """Mann-Whitney U of one group against all others."""
    ranked = average_ranks(once(df.select(value, group).where(F.col(value).isNotNull()), "values"), value, "_r")
    mine = F.col(group) == first
    n1 = F.count_if(mine)
    return ranked.agg(n1.alias("n_first"), (F.count("*") - n1).alias("n_rest"), (F.sum(F.when(mine, F.col("_r"))) - n1 * (n1 + 1) / 2).alias("u"))


def quantile_sweep(df: DataFrame, x: str, y: str, shares: Sequence[float]) -> DataFrame:
    """For each quantile q: rows low in x (at most its quantile 1 - q), high in y (at least its quantile q), both, and the overlap expected by chance."""
    edges = df.agg(F.percentile(x, F.array(*(F.lit(1 - s) for s in shares))).alias("ex"), F.percentile(y, F.array(*map(F.lit, shares))).alias("ey"))
    flags = df.select(x, y).crossJoin(F.broadcast(edges))
    each = flags.select(x, y, F.posexplode(F.zip_with("ex", "ey", lambda a, b: F.struct(a.alias("ex"), b.alias("ey")))).alias("i", "e"))
    low, high = F.col(x) <= F.col("e.ex"), F.col(y) >= F.col("e.ey")
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    out = each.groupBy(share.alias("share")).agg(F.count_if(low).alias("low"), F.count_if(high).alias("high"), F.count_if(low & high).alias("both"), F.count("*").alias("n"))
    return out.withColumn("expected", F.col("low") * F.col("high") / F.col("n"))


def quantile_breaks(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Distinct edges of equal-count bins."""
    edges = F.percentile(x, F.array(*(F.lit(i / bins) for i in range(bins + 1))))
    return df.agg(F.array_sort(F.array_distinct(edges)).alias("edges")).select(F.posexplode("edges").alias("place", "edge"))


# --- probabilities -------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * front


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by the t distribution."""
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def chi_square_p(statistic: float, df: int) -> float:
    return gamma_tail(df / 2, statistic / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact: the probability of all outcomes no likelier than the observed one."""
    if p <= 0 or p >= 1:
        return float(k == (0 if p <= 0 else n))
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    at = log(k) + 1e-7
    return min(1.0, math.fsum(math.exp(x) for x in map(log, range(n + 1)) if x <= at))


def permutation_p(table: Sequence[Sequence[int]], rounds: int = 2000, seed: int = 0) -> float:
    """Monte-Carlo p of the uncorrected chi-square statistic, margins fixed; ``table`` is a small count table."""
    import numpy as np

    o = np.asarray(table)
    rows, columns = np.repeat(np.arange(o.shape[0]), o.sum(1)), np.repeat(np.arange(o.shape[1]), o.sum(0))
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    stat = lambda x: float(((x - e) ** 2 / np.where(e > 0, e, 1)).sum())
    own, rng, over = stat(o), np.random.default_rng(seed), 0
    for _ in range(rounds):
        rng.shuffle(columns)
        over += stat(np.bincount(rows * o.shape[1] + columns, minlength=o.size).reshape(o.shape)) >= own - 1e-9
    return (over + 1) / (rounds + 1)

