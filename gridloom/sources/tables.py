"""Table scans: expression, coordinates, embeddings, predictions and their checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared folder, ``spark.checkpoint.dir``; in local mode below a temporary one where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again: worked out once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def densified(spots: DataFrame, expression: DataFrame, panel: DataFrame, keys: Sequence[str], gene: str = "gene", value: str = "value") -> DataFrame:
    """Every spot with every gene of the panel, missing values as 0.

    The panel is one sorted array on each spot, so the dense rows come from a generator;
    the result has spots x genes rows by definition. A spot meets its values as one array, so
    spots are shuffled and not cells, and the cells of a spot stay together in one task.
    """
    genes = panel.agg(F.array_sort(F.collect_set(gene)).alias("__genes"))
    within = expression.join(F.broadcast(panel.select(gene).distinct()), gene, "left_semi")  # a row for each gene of the panel
    have = within.groupBy(*keys).agg(F.collect_list(F.struct(F.col(gene), F.coalesce(value, F.lit(0.0)).alias(value))).alias("__have"))
    wide = spots.join(have, list(keys), "left").crossJoin(F.broadcast(genes))  # one row: the panel
    lacking = F.array_except("__genes", F.coalesce(F.col("__have")[gene], F.array().cast(f"array<{dict(panel.dtypes)[gene]}>")))
    zeros = F.transform(lacking, lambda g: F.struct(g.alias(gene), F.lit(0.0).alias(value)))
    cells = F.when(F.col("__have").isNull(), zeros).otherwise(F.concat("__have", zeros))
    return wide.withColumn("__cell", F.explode(cells)).select(*keys, f"__cell.{gene}", *[c for c in spots.columns if c not in keys], f"__cell.{value}")


def available(expression: DataFrame, panel: DataFrame, gene: str = "gene") -> DataFrame:
    """The expression of genes of the panel only, without zeros for missing ones."""
    return expression.join(panel.select(gene).distinct(), gene, "left_semi")


def one_gene(spots: DataFrame, expression: DataFrame, name: str, keys: Sequence[str], gene: str = "gene", value: str = "value") -> DataFrame:
    """One gene for every spot, 0 where it is absent."""
    own = expression.where(F.col(gene) == name).select(*keys, value)
    return spots.join(own, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose names match a pattern with * for any letters, in their order."""
    return [c for c in df.columns if fnmatchcase(c, pattern)]


def row_mean(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Add the mean over columns, of those that are not null."""
    have = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    return df.withColumn(out, F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have)))


def strict_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its row of ``table``; a key that the table lacks is an error when the rows are read."""
    found = df.join(table.withColumn("__found", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.concat(F.lit("no row for key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return found.where(F.when(F.col("__found"), True).otherwise(missing.cast("boolean"))).drop("__found")


def coordinates(spots: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spots.select(*keys, "x", "y")


def embeddings_of(embeddings: DataFrame, samples: Sequence[str], encoder: str | None = None) -> DataFrame:
    """Embeddings of samples and an encoder; both filters reach the files."""
    out = embeddings.where(F.col("sample_id").isin(list(samples)))
    return out.where(F.col("encoder") == encoder) if encoder else out


def repeated_spots(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spots in more than one fold; empty if the folds are sound."""
    return folds.groupBy(*keys).agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


def table_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table, or no rows of its schema where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.format(form).schema(schema).load(path)
