"""Quality control, panels, folds, per-gene metrics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.columns import is_control_probe
from gridloom.functions.stats import corr, quantiles


def sample_qc(expression: DataFrame, prefixes: Sequence[str], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Spots, real and control probes, median and mean counts, and median genes detected of each sample."""
    control = is_control_probe(F.col("gene"), prefixes)
    spot = expression.groupBy(*keys, "spot_id").agg(F.sum(F.when(~control, F.col("value")).otherwise(0.0)).alias("total"), F.count_if(~control & (F.col("value") > 0)).alias("detected"))
    genes = expression.groupBy(*keys).agg(F.countDistinct(F.when(~control, F.col("gene"))).alias("n_real"), F.countDistinct(F.when(control, F.col("gene"))).alias("n_control"))
    out = spot.groupBy(*keys).agg(F.count("*").alias("n_spots"), F.percentile("total", F.lit(0.5)).alias("median_counts"), F.avg("total").alias("mean_counts"), F.percentile("detected", F.lit(0.5)).alias("median_genes"))
    return out.join(genes, list(keys))


def shared_panel(expression: DataFrame, keys: Sequence[str] = ("cohort",)) -> DataFrame:
    """Each gene of a cohort with the samples that have it, and whether all do."""
    n = expression.groupBy(*keys).agg(F.countDistinct("sample_id").alias("n_samples"))
    have = expression.groupBy(*keys, "gene").agg(F.countDistinct("sample_id").alias("n_with"))
    return have.join(n, list(keys)).withColumn("in_panel", F.col("n_with") == F.col("n_samples"))


def sample_extras(expression: DataFrame, panel: DataFrame, keys: Sequence[str] = ("cohort", "sample_id")) -> DataFrame:
    """Genes of a sample outside the panel."""
    return expression.select(*keys, "gene").distinct().join(panel, "gene", "left_anti")


def mapping_gaps(have: DataFrame, want: DataFrame, key: str = "sample_id") -> DataFrame:
    """Keys that only one side has; empty if the mapping is right."""
    a, b = have.select(key).distinct().withColumn("have", F.lit(True)), want.select(key).distinct().withColumn("want", F.lit(True))
    return a.join(b, key, "full").where("have is null or want is null").select(key, F.coalesce("have", F.lit(False)).alias("have"), F.coalesce("want", F.lit(False)).alias("want"))


def folds(dim: DataFrame, unit: str = "patient", keys: Sequence[str] = ("cohort",)) -> DataFrame:
    """Leave-one-out folds over a cohort's units: a row for each fold and sample with its role."""
    fold = F.dense_rank().over(W.partitionBy(*keys).orderBy(unit)) - 1
    own = dim.withColumn("own", fold)
    each = own.select(*keys, F.col("own").alias("fold"), F.col(unit).alias(f"test_{unit}")).distinct()
    return own.join(each, list(keys)).select(*keys, "fold", f"test_{unit}", unit, "sample_id", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("role"))


def fold_arrays(rows: DataFrame, unit: str = "patient", keys: Sequence[str] = ("cohort",)) -> DataFrame:
    """One row for each fold with its samples and units as sorted arrays."""
    pick = lambda c, role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col(c))))
    out = rows.groupBy(*keys, "fold", f"test_{unit}").agg(pick("sample_id", "test").alias("test_samples"), pick("sample_id", "train").alias("train_samples"), pick(unit, "train").alias(f"train_{unit}s"))
    return out.withColumn("n_test_samples", F.size("test_samples")).withColumn("n_train_samples", F.size("train_samples"))


def pseudobulk(expression: DataFrame, keys: Sequence[str] = ("sample_id",), value: str = "y", least: int = 10) -> DataFrame:
    """Mean of each sample and gene, samples with under ``least`` genes left out."""
    own = expression.groupBy(*keys, "gene").agg(F.avg(value).alias("mean"))
    return own.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def set_coverage(sets: DataFrame, panel: DataFrame, least: int = 5) -> DataFrame:
    """Of each set: genes, those in the panel, their share, whether enough, and their names."""
    own = sets.distinct().join(panel.select("gene", F.lit(1).alias("__in")), "gene", "left")
    have = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__in") == 1, F.col("gene")))), ",")
    out = own.groupBy("pathway").agg(F.count("*").alias("n_total"), F.count("__in").alias("n_overlap"), have.alias("genes"))
    return out.withColumn("fraction", F.round(F.col("n_overlap") / F.col("n_total"), 3)).withColumn("usable", F.col("n_overlap") >= least)


def membership(genes: DataFrame, sets: DataFrame) -> DataFrame:
    return genes.join(sets.distinct(), "gene", "left").groupBy("gene").agg(F.count("pathway").alias("pathway_count"))


def signature_report(signatures: DataFrame, panel: DataFrame, least: int = 2) -> DataFrame:
    """Of each signature: genes, those available, and whether it can be used."""
    own = signatures.join(panel.select("gene", F.lit(1).alias("__in")), "gene", "left")
    return own.groupBy("cell_type").agg(F.count("*").alias("n_genes"), F.count("__in").alias("n_available")).withColumn("usable", F.col("n_available") >= least)


def gene_pearson(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson's r of y and its prediction for each of ``keys``; 0 where a side has no spread."""
    out = predictions.groupBy(*keys).agg(corr("y", "yhat").alias("r"), F.stddev_pop("y").alias("sy"), F.stddev_pop("yhat").alias("sp"), F.count("*").alias("n"))
    flat = (F.col("sy") < 1e-10) | (F.col("sp") < 1e-10)
    return out.select(*keys, F.when(flat, 0.0).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("r"), "n")


def pearson_summary(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.percentile("r", F.lit(0.5)).alias("median_r"), F.count_if(F.col("r") > 0).alias("n_positive"), F.count("*").alias("n_genes"), F.max("n").alias("n_spots")).withColumn("passed", F.col("mean_r") > 0)


def gene_statistics(expression: DataFrame, value: str = "y") -> DataFrame:
    """Mean, pooled variance within samples, and coefficient of variation of each gene."""
    own = expression.groupBy("sample_id", "gene").agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    out = own.groupBy("gene").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("var"))
    return out.withColumn("cv", F.sqrt("var") / (F.col("mean") + 1e-6))


def value_limits(df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98, keys: Sequence[str] = ()) -> DataFrame:
    """Robust limits over several columns stacked."""
    long = df.select(*keys, F.explode(F.array(*columns)).alias("v"))
    q = quantiles(long, "v", keys, [low, high], "q")
    return q.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def box_statistics(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 interquartile ranges of them."""
    q = quantiles(df, value, keys, [0.25, 0.5, 0.75], "q").drop("__n")
    own = df.join(q, list(keys))
    span = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col(value) >= F.col("q")[0] - span) & (F.col(value) <= F.col("q")[2] + span)
    out = own.groupBy(*keys).agg(F.first("q").alias("q"), F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    return out.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))], "whisker_low", "whisker_high", "n_outliers")


def top_and_bottom(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n largest and the n smallest rows."""
    return df.orderBy(F.desc(by), tie).limit(n).withColumn("end", F.lit("top")).unionByName(df.orderBy(by, tie).limit(n).withColumn("end", F.lit("bottom")))


def quartile_label(df: DataFrame, value: str, keys: Sequence[str] = (), right_closed: bool = True) -> DataFrame:
    """Add ``quartile`` 0 to 3: edges above which (right-closed) or from which (left-closed) a value lies."""
    q = quantiles(df, value, keys, [0.25, 0.5, 0.75], "__q").drop("__n")
    own = df.join(q, list(keys)) if keys else df.crossJoin(q)  # one row of edges
    return own.withColumn("quartile", F.size(F.filter("__q", lambda e: F.col(value) > e if right_closed else F.col(value) >= e))).drop("__q")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units of work that are not yet done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
