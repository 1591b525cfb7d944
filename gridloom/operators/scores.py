"""Residual scores: raw, corrected for depth, studentised, and averaged over gene sets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.stats import exact_mean, exact_sum, fixed, quantiles


def raw_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute residual and total expression of each spot."""
    return predictions.groupBy(*keys).agg(fixed(exact_mean(F.abs("residual"))).alias("d_raw"), exact_sum(F.col("y")).alias("total"))


def bins_for(n: Column, n_bins: int, least: int) -> Column:
    """As many bins as asked for, or fewer where they would hold under ``least`` rows, but two at least."""
    return F.when(n < n_bins * least, F.greatest(F.lit(2), F.floor(n / least))).otherwise(n_bins).cast("int")


def quantile_bins(df: DataFrame, value: str, keys: Sequence[str], n_bins: int = 10, least: int = 30, spread: bool = True) -> DataFrame:
    """Add ``bin``: the number of inner quantile edges of the group that are not above the value. Ties stay together.

    Without ``spread`` a task counts the distinct values of a whole group, which is less work for many small groups.
    """
    # One pass for every number of bins that may be wanted.
    grid = sorted({i / k for k in range(2, n_bins + 1) for i in range(1, k)})
    edges = quantiles(df, value, keys, grid, "__edges_all") if spread else df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, grid))).alias("__edges_all"), F.count(value).alias("__n"))
    edges = edges.withColumn("__k", bins_for(F.col("__n"), n_bins, least))
    place = F.map_from_arrays(F.array(*map(F.lit, range(2, n_bins + 1))), F.array(*[F.array(*[F.lit(grid.index(i / k)) for i in range(1, k)]) for k in range(2, n_bins + 1)]))
    picked = F.transform(F.element_at(place, F.col("__k")), lambda i: F.element_at(F.col("__edges_all"), i + 1))
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], picked.alias("__edges"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = df.join(F.broadcast(edges), same)  # a row for each group
    x = F.col(value)
    return out.withColumn("bin", F.size(F.filter("__edges", lambda e: x >= e))).drop("__edges", *[f"__{k}" for k in keys])


def merged_small(counts: list[int], least: int, left_always: bool = False) -> list[int]:
    """New bins for bins with these counts: a bin under ``least`` joins its smaller neighbour (the left one if equal, or always), down to two bins."""
    groups = [[i] for i, c in enumerate(counts) if c]
    size = [counts[g[0]] for g in groups]
    while len(groups) > 2:
        small = next((i for i, s in enumerate(size) if s < least), None)
        if small is None:
            break
        left = small > 0 and (small == len(groups) - 1 or left_always or size[small - 1] <= size[small + 1])
        other = small - 1 if left else small + 1
        a, b = sorted((small, other))
        groups[a], size[a] = groups[a] + groups[b], size[a] + size[b]
        del groups[b], size[b]
    out = [0] * len(counts)
    for new, g in enumerate(groups):
        for i in g:
            out[i] = new
    return out


def merge_bins(df: DataFrame, keys: Sequence[str], least: int, left_always: bool = False, bin_col: str = "bin") -> DataFrame:
    """Merge bins with too few rows. Only histograms, a row for each bin, come together."""
    counts = df.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    fields = ", ".join(f"`__{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in keys)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(bin_col)
        new = merged_small(group["n"].tolist(), least, left_always)
        return pd.DataFrame({**{f"__{k}": group[k] for k in keys}, "__bin": group[bin_col], "__new": new})

    table = counts.groupBy(*keys).applyInPandas(merge, f"{fields}, __bin int, __new int")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(bin_col) == F.col("__bin")]
    return df.join(F.broadcast(table), same).withColumn(bin_col, F.col("__new")).drop("__bin", "__new", *[f"__{k}" for k in keys])


def conditional_scores(df: DataFrame, keys: Sequence[str], score: str = "d_raw", covariate: str = "total", n_bins: int = 10, least: int = 30, merge: bool = True) -> DataFrame:
    """Add ``bin`` of the covariate within ``keys`` and ``d_cond``, the score less its bin's mean."""
    binned = quantile_bins(df, covariate, keys, n_bins, least)
    if merge:
        binned = merge_bins(binned, keys, least)
    means = binned.groupBy(*keys, "bin").agg(exact_mean(F.col(score)).alias("__mean")).withColumnsRenamed({c: f"__{c}" for c in (*keys, "bin")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "bin")]
    out = binned.join(F.broadcast(means), same)  # a row for each bin; a window would sort all rows
    return out.withColumn("d_cond", F.col(score) - F.col("__mean")).drop("__mean", *[f"__{c}" for c in (*keys, "bin")])


def studentised(df: DataFrame, keys: Sequence[str], residual: str = "residual", value: str = "y", n_bins: int = 20, floor: float = 1.0) -> DataFrame:
    """Add ``studentised``: a residual by the population deviation of absolute residuals in its expression bin.

    Bins of fewer than three rows or without spread take the group's deviation; no
    deviation is below the group's ``floor``-th percentile of them.
    """
    from gridloom.sources.tables import written

    # Read four times, so worked out once; rows meet a bin's deviation, and no window sorts them.
    df = written(df)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    sizes = sizes.select(*keys, F.least(F.lit(n_bins), F.greatest(F.lit(2), F.floor(F.col("__n") / 10))).cast("int").alias("__bins"))
    sized = df.join(F.broadcast(sizes), list(keys))  # a row for each group
    many = sized.where(F.col("__bins") == n_bins)
    few = sized.where(F.col("__bins") < n_bins)
    parts = [quantile_bins(many.drop("__bins"), value, keys, n_bins, 0, spread=False), quantile_bins(few.drop("__bins"), value, keys, n_bins - 1, 10, spread=False)]
    binned = written(parts[0].unionByName(parts[1]))
    each = binned.groupBy(*keys, "bin").agg(F.count("*").alias("__n"), F.stddev_pop(F.abs(residual)).alias("__sd"))
    every = binned.groupBy(*keys).agg(F.stddev_pop(F.abs(residual)).alias("__every"))
    bins = each.join(every, list(keys)).withColumn("sigma", F.coalesce(F.when((F.col("__n") >= 3) & (F.col("__sd") > 0), F.col("__sd")), "__every"))
    bins = written(bins.select(*keys, "bin", "sigma"))
    low = bins.groupBy(*keys).agg(F.percentile("sigma", F.lit(floor / 100)).alias("__low"))
    bins = bins.join(low, list(keys)).withColumn("sigma", F.greatest("sigma", "__low")).drop("__low")
    out = binned.join(F.broadcast(bins), [*keys, "bin"])  # a row for each bin
    return out.withColumn("studentised", F.when(F.col("sigma") > 0, F.col(residual) / F.col("sigma")).otherwise(0.0))


def members(sets: DataFrame, panel: DataFrame, least: int = 3, name: str = "pathway") -> DataFrame:
    """Gene sets within the panel, those with fewer than ``least`` genes left out."""
    own = sets.join(panel.select("gene").distinct(), "gene", "left_semi").distinct()
    return own.withColumn("__n", F.count("*").over(W.partitionBy(name))).where(F.col("__n") >= least).drop("__n")


def set_scores(df: DataFrame, sets: DataFrame, keys: Sequence[str], value: str, name: str = "pathway", least: int = 3, panel: DataFrame | None = None) -> DataFrame:
    """Mean of ``value`` over each set's genes, for each of ``keys``; ``panel`` has the genes of ``df``, which else are looked up in it."""
    own = members(sets, df.select("gene") if panel is None else panel, least, name)
    return df.join(F.broadcast(own), "gene").groupBy(*keys, name).agg(exact_mean(F.col(value)).alias("score"))


def averaged_residuals(predictions: DataFrame) -> DataFrame:
    """Residuals averaged over encoders."""
    return predictions.groupBy("cohort", "patient", "sample_id", "spot_id", "gene").agg(fixed(exact_mean(F.col("residual"))).alias("residual"), F.max("y").alias("y"))
