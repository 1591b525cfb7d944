"""Ranks, p-values, false discovery rates and seeded orders."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mid_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank within ``keys``, ties sharing the mean of their ranks."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def corr(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where a side has no spread, which the built-in treats as an error."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    sa, sb = (F.stddev_pop(F.when(both, F.col(c).cast("double"))) for c in (a, b))
    return F.when((sa > 0) & (sb > 0), F.covar_pop(a, b) / (sa * sb))


def tie_sum(value: str, keys: Sequence[str]) -> Column:
    """For each row t^2 - 1 of its t tied rows, whose sum over rows is the sum of t^3 - t over ties."""
    t = F.count(F.lit(1)).over(W.partitionBy(*keys, value)).cast("double")
    return t * t - 1


def bh(df: DataFrame, p: str, keys: Sequence[str], out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg q-values of ``p`` within ``keys``; equal p share one."""
    w = W.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(p))
    scaled = F.col(p) * F.count(p).over(w) / F.col("__bh_place")
    df = df.withColumn("__bh_place", place).withColumn("__bh_q", scaled)
    back = w.orderBy(F.desc("__bh_place")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.least(F.lit(1.0), F.min("__bh_q").over(back))).drop("__bh_place", "__bh_q")


def erfc_sql(x: str) -> str:
    """The complementary error function of x >= 0 as SQL, to a relative error of 1.2e-7 (a published rational fit)."""
    t = f"(1 / (1 + 0.5 * ({x})))"
    out = "0.17087277"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368"):
        out = f"({c} + {t} * {out})"
    return f"({t} * exp(-({x}) * ({x}) - 1.26551223 + {t} * {out}))"


def two_sided_sql(z: str) -> str:
    """Two-sided p of a standard normal z."""
    return f"least(1.0, {erfc_sql(f'abs({z}) / 1.4142135623730951')})"


def mwu_z_sql(u: str, n1: str, n2: str, ties: str) -> str:
    """Mann-Whitney z with tie term and continuity correction; null if all values are equal."""
    n = f"({n1} + {n2})"
    var = f"(CAST({n1} AS DOUBLE) * {n2} / 12 * ({n} + 1 - ({ties}) / ({n} * ({n} - 1.0))))"
    return f"(CASE WHEN {var} > 0 THEN greatest(abs({u} - CAST({n1} AS DOUBLE) * {n2} / 2) - 0.5, 0) / sqrt({var}) END)"


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method on the even and odd terms.
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null in, null out."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype=float)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs."""
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(F.abs(r) >= 1, 0.0).otherwise(student_p(t, n - 2))


def exact_mwu_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of Mann-Whitney's U without ties."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    # Each of n1 ranks lies above 0..n2 of the others: Gaussian binomial coefficients.
    for i in range(1, n1 + 1):
        up = n2 + i
        for s in range(len(ways) - 1, up - 1, -1):
            ways[s] -= ways[s - up]
        for s in range(i, len(ways)):
            ways[s] += ways[s - i]
    ways /= ways.sum()
    k = int(min(u, n1 * n2 - u))
    return float(min(1.0, 2 * ways[: k + 1].sum()))


def exact_wilcoxon_p(t: float, n: int) -> float:
    """Two-sided exact p of the smaller signed-rank sum of n differences without ties and zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    ways /= ways.sum()
    return float(min(1.0, 2 * ways[: int(t) + 1].sum()))


def student_p_sql(t: str, df: str, steps: int = 2000) -> str:
    """DuckDB SQL of the two-sided p of Student's t, by Simpson's rule over its density."""
    f = f"pow(1 + pow(abs({t}) * i / {steps}, 2) / ({df}), -(({df}) + 1) / 2.0)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}))"
    return f"greatest(0.0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * 3.141592653589793) * abs({t}) / {steps} / 3 * {area})"


#: The exact law of the two-sample statistic is worked out for sections up to this size.
KS_EXACT = 10_000


def asymptotic_ks_p(d: float, n1: int, n2: int) -> float:
    """Two-sided p of the two-sample Kolmogorov-Smirnov statistic by its asymptotic series."""
    lam = d * math.sqrt(n1 * n2 / (n1 + n2))
    if lam < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))))


def exact_ks_p(d: float, n1: int, n2: int) -> float:
    """Two-sided exact p: the share of all orders of both samples whose distributions come at least ``d`` apart.

    An order is a path over a grid; those that stay within the band are counted row by row,
    each row scaled to one so that the counts stay finite.
    """
    far = round(d * n1 * n2)
    if far <= 0:
        return 1.0
    j = np.arange(n2 + 1)
    row, log = np.where(j * n1 < far, 1.0, 0.0), 0.0
    for i in range(1, n1 + 1):
        inside = np.abs(i * n2 - j * n1) < far
        row = np.cumsum(np.where(inside, row, 0.0)) * inside
        top = row.max()
        if top == 0:
            return 1.0
        row, log = row / top, log + math.log(top)
    if row[-1] <= 0:
        return 1.0
    every = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return float(min(1.0, max(0.0, 1 - math.exp(math.log(row[-1]) + log - every))))


def ks_p(d: float, n1: int, n2: int) -> float:
    """The exact p for samples up to ``KS_EXACT``, else the asymptotic one."""
    return exact_ks_p(d, n1, n2) if max(n1, n2) <= KS_EXACT else asymptotic_ks_p(d, n1, n2)


@F.pandas_udf(DoubleType())
def mwu_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, p: pd.Series) -> pd.Series:
    """The exact p where a side has at most 8 values and none are tied, else the given asymptotic one; 1 where that is null."""
    out = []
    for a, m, n, t, q in zip(u, n1, n2, ties, p, strict=True):
        exact = min(m, n) <= 8 and t == 0 and m > 0 and n > 0
        out.append(exact_mwu_p(a, int(m), int(n)) if exact else 1.0 if pd.isna(q) else q)
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def wilcoxon_p(t: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series, p: pd.Series) -> pd.Series:
    """The exact p for at most 50 differences without ties and zeros, else the given asymptotic one; 1 where that is null."""
    out = []
    for a, m, s, z, q in zip(t, n, ties, zeros, p, strict=True):
        exact = 0 < m <= 50 and s == 0 and z == 0
        out.append(exact_wilcoxon_p(a, int(m)) if exact else 1.0 if pd.isna(q) else q)
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def ks_p_column(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([ks_p(float(a), int(m), int(n)) for a, m, n in zip(d, n1, n2, strict=True)], dtype=float)


#: Below this a value of nine places is the nearest double to a whole number of billionths.
BILLIONTHS = 4e6


def billionths(x: Column) -> Column:
    """A value of nine places as a whole number of billionths."""
    return F.floor(x * 1e9 + 0.5)


def from_billionths(n: Column) -> Column:
    """Whole numbers of billionths as decimals of nine places."""
    return (n.cast("decimal(28,0)") * F.lit(Decimal("0.000000001"))).cast("decimal(30,9)")


def billionths_total(n: Column, over: WindowSpec | None = None) -> Column:
    """The sum of whole numbers of billionths as a decimal of nine places; upper and lower bits are added as longs."""
    own = (lambda c: c.over(over)) if over else (lambda c: c)
    high, low = own(F.sum(F.shiftright(n, 30))).cast("decimal(19,0)"), own(F.sum(n.bitwiseAND(F.lit((1 << 30) - 1)))).cast("decimal(19,0)")
    return from_billionths(high * F.lit(1 << 30).cast("decimal(10,0)") + low)


def exact_total(x: Column, over: WindowSpec | None = None) -> Column:
    """The sum of values of nine places as a decimal: the same in whatever order rows are added.

    A value is a whole number of billionths, of which the upper and lower bits are added as longs; large ones are added as decimals.
    """
    own = (lambda c: c.over(over)) if over else (lambda c: c)
    small = F.abs(x) < BILLIONTHS
    few = billionths_total(F.when(small, billionths(x)), over)
    rest = own(F.sum(F.when(~small, x.cast("decimal(20,9)")))).cast("decimal(30,9)")
    return F.when(rest.isNull(), few).when(few.isNull(), rest).otherwise(few + rest).cast("decimal(30,9)")


def exact_sum(x: Column) -> Column:
    """The sum of values of nine places, as decimals: the same in whatever order rows are added."""
    return exact_total(x).cast("double")


def exact_mean(x: Column, over: WindowSpec | None = None) -> Column:
    """The mean by ``exact_total``; null over no values. What values have beyond nine places is added in floating point."""
    own = (lambda c: c.over(over)) if over else (lambda c: c)
    whole = F.when(F.abs(x) < BILLIONTHS, fixed(x)).otherwise(x.cast("decimal(20,9)").cast("double"))
    return exact_total(x, over).cast("double") / own(F.count(x)) + own(F.avg(x - whole))


def fixed(x: Column, places: int = 9) -> Column:
    """Rounded half up by plain double arithmetic, which every engine does alike, at halves too."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded as DuckDB's ``round`` does: halves of the scaled double away from zero, where Spark's own takes halves of the printed digits."""
    scaled = F.abs(x) * float(10**places)
    up = F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)
    return F.when(F.abs(x) < BILLIONTHS, F.signum(x) * (up / float(10**places))).otherwise(F.round(x, places))


def exact_sum_sql(x: str, rest: str = "") -> str:
    """DuckDB SQL of ``exact_sum``; ``rest`` is a filter or window behind the aggregate."""
    return f"CAST(sum(CAST({x} AS DECIMAL(20, 9))){rest} AS DOUBLE)"


def exact_mean_sql(x: str, rest: str = "") -> str:
    return f"({exact_sum_sql(x, rest)} / count({x}){rest})"


def fixed_sql(x: str, places: int = 9) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def empirical_p(at_least: Column, permutations: Column) -> Column:
    return (1 + at_least) / (1 + permutations)


def seeded(seed: int | str, *keys: str) -> Column:
    """A seeded order that any engine reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def in_parts(df: DataFrame, value: str, keys: Sequence[str], parts: int = 64) -> DataFrame:
    """Add ``__part``: rows of a key dealt to ranges of values, by cuts that a sketch of the key's values gives; equal values share one.

    So a key that holds much of a table is ranked by many tasks. The cuts decide nothing but the ranges' sizes.
    They are written once: a sketch merges in whatever order tasks end, so a second reading could deal rows to other ranges.
    """
    from gridloom.sources.tables import written

    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("__cuts"))
    cuts = written(cuts.select(*[F.col(k).alias(f"__cut_{k}") for k in keys], "__cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"__cut_{k}")) for k in keys]
    out = df.join(cuts, same, "left").withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value))))
    return out.drop("__cuts", *[f"__cut_{k}" for k in keys])


def ahead_of_parts(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``__part``, ``__ahead``, ``__in``, ``__all``): rows in the parts before, in the part, and in the key; a row for each part."""
    counts = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__in"))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__in").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__ahead", before).withColumn("__all", F.sum("__in").over(w))


def spread_ranks(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Add ``__r``, the mid-rank of ``value`` within ``keys``, and ``__t``, t^2 - 1 of its t tied rows, without a task that holds a whole key."""
    placed = in_parts(df, value, keys)
    ahead = ahead_of_parts(placed, keys).drop("__in", "__all").withColumnsRenamed({k: f"__a_{k}" for k in keys} | {"__part": "__a_part"})
    same = [F.col(k).eqNullSafe(F.col(f"__a_{k}")) for k in keys] + [F.col("__part") == F.col("__a_part")]
    both = placed.join(F.broadcast(ahead), same)  # a row for each range
    out = both.withColumn("__r", mid_rank(value, [*keys, "__part"]) + F.col("__ahead")).withColumn("__t", tie_sum(value, [*keys, "__part"]))
    return out.drop("__part", "__a_part", "__ahead", *[f"__a_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float], out: str = "edges") -> DataFrame:
    """Exact interpolated quantiles of ``value`` for each key: (keys, ``out``, an array in the order of ``shares``, ``__n``).

    Rows are counted by ranges of values; only ranges that hold a wanted rank are sorted, each
    by its own task. Nulls are left out; a key of nulls alone is absent.
    """
    from gridloom.sources.tables import written

    by = [*keys] or ["__one"]
    own = df if keys else df.withColumn("__one", F.lit(0))
    own = written(own.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull()))
    placed = in_parts(own, "__v", by)
    ahead = ahead_of_parts(placed, by)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)]))
    at = ahead.withColumn("__e", each).withColumn("__pos", F.col("__e.s") * (F.col("__all") - 1))
    at = at.withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.when(F.col("__side") == 0, F.floor("__pos")).otherwise(F.ceil("__pos"))
    at = at.withColumn("__place", rank - F.col("__ahead")).where("__place >= 0 and __place < __in")
    at = written(at.select(*by, "__part", "__place", F.col("__e.i").alias("__i"), "__side", "__pos", "__all"))
    name = lambda d, *more: d.withColumnsRenamed({c: f"__w_{c}" for c in (*by, "__part", *more)})
    same = lambda *more: [F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in (*by, "__part", *more)]
    some = placed.join(name(at.select(*by, "__part").distinct()), same(), "left_semi")
    ranked = some.withColumn("__place", F.row_number().over(W.partitionBy(*by, "__part").orderBy("__v")) - 1)
    picked = ranked.join(name(at, "__place"), same("__place")).groupBy(*by, "__i", "__pos", "__all").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("low"), F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("high"))
    pos = F.col("__pos")
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(pos) - pos) * F.col("low") + (pos - F.floor(pos)) * F.col("high"))
    rows = picked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__i", mixed.alias("q")))).alias("__q"), F.max("__all").alias("__n"))
    return rows.select(*keys, F.transform("__q", lambda x: x["q"]).alias(out), "__n")
