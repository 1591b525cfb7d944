"""Differential tests between two groups of spots, for every feature of every sample at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import stats


def tails(df: DataFrame, value: str, keys: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Add ``disc`` (value at or above the upper quantile) and ``conc`` (at or below the lower one); a row can be both."""
    edges = stats.quantiles(df, value, keys, [low, high], "__q").drop("__n")
    out = df.join(F.broadcast(edges), list(keys))  # a row for each group
    return out.withColumn("disc", F.col(value) >= F.col("__q")[1]).withColumn("conc", F.col(value) <= F.col("__q")[0]).drop("__q")


def sides(df: DataFrame) -> DataFrame:
    """Rows of either tail with ``side`` 1 (disc) or 0 (conc); a row of both counts on both sides."""
    side = F.explode(F.filter(F.array(F.when(F.col("disc"), 1), F.when(F.col("conc"), 0)), lambda x: x.isNotNull()))
    return df.where("disc or conc").withColumn("side", side)


def _counted_rank_sums(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Counts, rank sums, ties, means, variances and positive fractions of both sides, from how often each side has each value."""
    one, v, t = F.col("side") == 1, F.col(value), F.col("__t")
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__t"), F.count_if(one).alias("__disc"), F.count_if(~one).alias("__conc"))
    w = W.partitionBy(*keys)
    ahead = F.coalesce(F.sum("__t").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__r", ahead + (t + 1) / 2)
    there = {x: F.when((F.col(f"__{x}") > 0) & v.isNotNull(), F.col(f"__{x}")) for x in ("disc", "conc")}
    for x, n in there.items():
        own = F.when(n.isNotNull(), v)
        mean = F.when(F.min(own).over(w) == F.max(own).over(w), F.min(own).over(w)).otherwise(F.sum(n * v).over(w) / F.sum(n).over(w))
        counts = counts.withColumn(f"__mean_{x}", mean)
    out = [F.sum("__disc").alias("n_disc"), F.sum("__conc").alias("n_conc"), F.sum(F.when(F.col("__disc") > 0, F.col("__r") * F.col("__disc"))).alias("rank_sum"), F.sum(t.cast("double") * (t.cast("double") * t - 1)).alias("ties")]
    for x, n in there.items():
        gap = v - F.col(f"__mean_{x}")
        out.append(F.first(f"__mean_{x}").alias(f"mean_{x}"))
        out.append(F.when(F.sum(n) > 1, F.sum(n * gap * gap) / (F.sum(n) - 1)).alias(f"var_{x}"))
        out.append((F.coalesce(F.sum(F.when(v > 0, n)), F.lit(0)) / F.sum(n)).alias(f"frac_{x}"))
    return counts.groupBy(*keys).agg(*out)


def rank_sums(df: DataFrame, value: str, keys: Sequence[str], spread: bool = False) -> DataFrame:
    """Mann-Whitney statistics of side 1 against side 0: n1, n0, rank sum, U of side 1, ties and the asymptotic p.

    Rows are counted by value first, so that only distinct values are sorted. With ``spread`` keys that hold
    much of the table are ranked by many tasks.
    """
    if spread:
        ranked = stats.spread_ranks(df, value, keys)
        one = F.col("side") == 1
        out = ranked.groupBy(*keys).agg(
            F.count_if(one).alias("n_disc"),
            F.count_if(~one).alias("n_conc"),
            F.sum(F.when(one, F.col("__r"))).alias("rank_sum"),
            F.sum("__t").alias("ties"),
            F.avg(F.when(one, F.col(value))).alias("mean_disc"),
            F.avg(F.when(~one, F.col(value))).alias("mean_conc"),
            F.var_samp(F.when(one, F.col(value))).alias("var_disc"),
            F.var_samp(F.when(~one, F.col(value))).alias("var_conc"),
            F.avg(F.when(one, (F.col(value) > 0).cast("double"))).alias("frac_disc"),
            F.avg(F.when(~one, (F.col(value) > 0).cast("double"))).alias("frac_conc"),
        )
    else:
        out = _counted_rank_sums(df, value, keys)
    out = out.where("n_disc > 0 and n_conc > 0").withColumn("u", F.col("rank_sum") - F.col("n_disc") * (F.col("n_disc") + 1) / 2)
    z = stats.mwu_z_sql("u", "n_disc", "n_conc", "ties")
    return out.withColumn("pval", F.coalesce(F.expr(stats.two_sided_sql(z)), F.lit(1.0)))


def pooled(kind: str = "samp") -> str:
    """SQL of the pooled deviation of both sides."""
    return "sqrt(((n_disc - 1) * coalesce(var_disc, 0) + (n_conc - 1) * coalesce(var_conc, 0)) / greatest(n_disc + n_conc - 2, 1))"


def de_table(df: DataFrame, keys: Sequence[str], feature: str = "gene", value: str = "y", min_fraction: float = 0.1, exact: bool = True) -> DataFrame:
    """Differential expression of side 1 against side 0: fractions, means, log2 fold change, Cohen's d, p and q over the tested features."""
    out = rank_sums(df, value, [*keys, feature])
    if exact:
        out = out.withColumn("pval", stats.mwu_p("u", "n_disc", "n_conc", "ties", "pval"))
    out = out.where(F.greatest("frac_disc", "frac_conc") >= min_fraction)
    sd = F.expr(pooled())
    out = out.withColumn("log2fc", F.log2((F.col("mean_disc") + 1e-6) / (F.col("mean_conc") + 1e-6)))
    out = out.withColumn("cohens_d", F.when(sd > 0, (F.col("mean_disc") - F.col("mean_conc")) / sd).otherwise(0.0))
    return stats.bh(out, "pval", keys).select(*keys, feature, "pval", "log2fc", "cohens_d", "frac_disc", "frac_conc", "mean_disc", "mean_conc", "n_disc", "n_conc", "fdr")


def score_test(df: DataFrame, keys: Sequence[str], feature: str, value: str, exact: bool = True, fdr: bool = True, least: int = 1, spread: bool = False) -> DataFrame:
    """The same tests on scores: delta, Cohen's d (deviation 1e-6 where there is none), p and q; sides need ``least`` values."""
    out = rank_sums(df, value, [*keys, feature], spread).where((F.col("n_disc") >= least) & (F.col("n_conc") >= least))
    if exact:
        out = out.withColumn("pval", stats.mwu_p("u", "n_disc", "n_conc", "ties", "pval"))
    sd = F.expr(pooled())
    delta = F.col("mean_disc") - F.col("mean_conc")
    out = out.withColumn("delta", delta).withColumn("cohens_d", delta / F.when(sd > 0, sd).otherwise(1e-6))
    out = stats.bh(out, "pval", keys) if fdr else out.withColumn("fdr", F.lit(None).cast("double"))
    return out.select(*keys, feature, "mean_disc", "mean_conc", "delta", "cohens_d", "pval", "fdr", "n_disc", "n_conc")


def plain_d(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cohen's d with the unweighted mean of population variances; 0 without spread."""
    one = F.col("side") == 1
    out = df.groupBy(*keys).agg(*[f(F.when(c, F.col(value))).alias(n) for n, f, c in (("m1", F.avg, one), ("m0", F.avg, ~one), ("v1", F.var_pop, one), ("v0", F.var_pop, ~one))])
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return out.select(*keys, F.when(sd > 0, (F.col("m1") - F.col("m0")) / sd).otherwise(0.0).alias("cohens_d"))


def meta(de: DataFrame, keys: Sequence[str], fdr: float = 0.05, effect: float = 0.25, log2fc: str = "log2fc", d: str = "cohens_d") -> DataFrame:
    """Over samples: how many tested a feature, how many found it, their share, median log2 fold change and mean d."""
    found = (F.col("fdr") < fdr) & (F.abs(log2fc) > effect)
    out = de.groupBy(*keys).agg(F.count_if(found).alias("n_samples_sig"), F.count("*").alias("n_samples_tested"), F.percentile(log2fc, F.lit(0.5)).alias("median_log2fc"), F.avg(d).alias("mean_cohens_d"))
    return out.withColumn("reproducibility", F.col("n_samples_sig") / F.col("n_samples_tested"))


def set_consistency(tests: DataFrame, keys: Sequence[str], fdr: float = 0.05) -> DataFrame:
    """Of a set over samples: significant ones, signs of delta, the share of the commoner sign, median delta, mean d."""
    out = tests.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("fdr") < fdr).alias("n_sig_fdr05"), F.count_if(F.col("delta") > 0).alias("n_positive_delta"), F.count_if(F.col("delta") < 0).alias("n_negative_delta"),
        F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.avg("cohens_d").alias("mean_cohens_d"),
    )
    return out.withColumn("reproducibility", F.col("n_sig_fdr05") / F.col("n_samples")).withColumn("direction_consistency", F.greatest("n_positive_delta", "n_negative_delta") / F.col("n_samples"))


def direction(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """'up' where more effects are above zero than below, else 'down', and the share of that side."""
    out = tests.groupBy(*keys).agg(F.count_if(F.col("cohens_d") > 0).alias("n_pos"), F.count_if(F.col("cohens_d") < 0).alias("n_neg"), F.count("*").alias("n"))
    return out.withColumn("direction", F.when(F.col("n_pos") > F.col("n_neg"), "up").otherwise("down")).withColumn("consistency", F.greatest("n_pos", "n_neg") / F.col("n"))


def type_summary(tests: DataFrame, keys: Sequence[str], fdr: float = 0.05) -> DataFrame:
    """Of a cell type over samples; an effect of zero counts as negative."""
    out = tests.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.count_if(F.col("fdr") < fdr).alias("n_sig"), F.count_if(F.col("cohens_d") > 0).alias("n_positive"), F.avg("cohens_d").alias("mean_cohens_d"), F.percentile("cohens_d", F.lit(0.5)).alias("median_cohens_d"))
    return out.withColumn("n_negative", F.col("n_samples") - F.col("n_positive")).withColumn("direction_consistency", F.greatest("n_positive", "n_negative") / F.col("n_samples"))


def signed_ranks(deltas: DataFrame, keys: Sequence[str], value: str = "delta", least: int = 5, exact: bool = True) -> DataFrame:
    """Wilcoxon signed-rank test of differences against zero: zeros are dropped, and features with fewer than ``least`` others."""
    moved = deltas.where(F.col(value) != 0).withColumn("__a", F.abs(value))
    ranked = moved.withColumn("__r", stats.mid_rank("__a", keys)).withColumn("__t", stats.tie_sum("__a", keys))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("m"), F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0)).alias("w_pos"), F.sum("__t").alias("ties")).where(F.col("m") >= least)
    every = deltas.groupBy(*keys).agg(F.count(value).alias("n_matched"), F.percentile(value, F.lit(0.5)).alias("median_delta"), F.avg(value).alias("mean_delta"), F.stddev_samp(value).alias("sd"))
    out = sums.join(every, list(keys)).withColumn("t_stat", F.least("w_pos", F.col("m") * (F.col("m") + 1) / 2 - F.col("w_pos")))
    z = "(abs(t_stat - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2.0 * m + 1) / 24 - ties / 48))"
    out = out.withColumn("pval", F.expr(stats.two_sided_sql(z)))
    if exact:
        out = out.withColumn("pval", stats.wilcoxon_p("t_stat", "m", "ties", F.col("n_matched") - F.col("m"), "pval"))
    return out.withColumn("effect_size", F.when(F.col("sd") > 0, F.col("mean_delta") / F.col("sd")).otherwise(0.0))


def matched_table(deltas: DataFrame, keys: Sequence[str], feature: str = "gene", exact: bool = True) -> DataFrame:
    out = signed_ranks(deltas, [*keys, feature], exact=exact)
    return stats.bh(out, "pval", keys).select(*keys, feature, "pval", "median_delta", "mean_delta", "effect_size", "n_matched", "fdr")


def overlap(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sizes of two sets, of both, and their Jaccard similarity, 0 if both are empty."""
    x, y = a.select(*on).distinct().withColumn("__a", F.lit(1)), b.select(*on).distinct().withColumn("__b", F.lit(1))
    out = x.join(y, list(on), "full").agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count(F.col("__a") + F.col("__b")).alias("n_both"), F.count("*").alias("n_any"))
    return out.select("n_a", "n_b", "n_both", F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(0.0).alias("jaccard"))


def set_jaccard(df: DataFrame, group: str, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """Jaccard similarity of the item sets of each pair of groups, within ``keys``."""
    own = df.select(*keys, group, item).distinct()
    sizes = own.groupBy(*keys, group).agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed(group, "a"), own.withColumnRenamed(group, "b")
    both = a.join(b, [*keys, item]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("n_both"))
    x, y = sizes.select(*keys, F.col(group).alias("a"), F.col("n").alias("n_a")), sizes.select(*keys, F.col(group).alias("b"), F.col("n").alias("n_b"))
    pairs = x.join(y, list(keys)).where("a < b") if keys else x.join(y, F.col("a") < F.col("b"))  # groups are few: configurations or encoders
    out = pairs.join(both, [*keys, "a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))


def top_features(de: DataFrame, keys: Sequence[str], n: int = 50, by: str = "pval", feature: str = "gene") -> DataFrame:
    """The n first features of each key, ties to the name."""
    return de.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(by, feature))).where(F.col("__n") <= n).drop("__n")


def gate(df: DataFrame, keys: Sequence[str], passed: str, least: float) -> DataFrame:
    """How many samples pass, their share, and whether that is at least ``least``; ``overall`` over all keys."""
    out = df.groupBy(*keys).agg(F.count_if(passed).alias("n_pass"), F.count("*").alias("n_total"))
    out = out.withColumn("fraction", F.col("n_pass") / F.col("n_total")).withColumn("gate_pass", F.col("fraction") >= least)
    return out.withColumn("overall", F.min("gate_pass").over(W.partitionBy()))
