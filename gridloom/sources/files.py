"""Text, JSON and CSV sources, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.columns import NUCLEUS_CLASSES, mapped, polygon_area, ring_centroid


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets from tab-separated lines of name, description and genes; shorter lines and empty genes are left out."""
    return parsed_sets(spark.read.text(path))


def parsed_sets(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("pathway"), F.explode(F.slice(parts, F.lit(3), F.size(parts))).alias("gene"))
    return rows.where("gene <> ''")


POINT = "array<double>"
GEO = f"features array<struct<properties: struct<centroid: {POINT}, type_tissue: string, class: string, classification: string, area: double>, geometry: struct<type: string, coordinates: string>>>"
DICT = f"nuc map<string, struct<centroid: {POINT}, type: string, contour: array<{POINT}>>>"


def geojson_nuclei(spark: SparkSession, path: str) -> DataFrame:
    """Nuclei of GeoJSON features: the centroid property, else the point, else the mean of the outer ring; others are skipped. The area is the property, else that of the ring."""
    files = spark.read.schema(GEO).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f"))
    p, g = F.col("f.properties"), F.col("f.geometry")
    point = F.when(g["type"] == "Point", F.from_json(g["coordinates"], POINT))
    ring = F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], f"array<array<{POINT}>>")[0])
    mean = F.when(F.size(ring) > 0, ring_centroid(ring))
    has = lambda a: a.isNotNull() & (F.size(a) >= 2)
    x = F.when(has(p["centroid"]), p["centroid"][0]).when(has(point), point[0]).otherwise(mean["x"])
    y = F.when(has(p["centroid"]), p["centroid"][1]).when(has(point), point[1]).otherwise(mean["y"])
    label = F.coalesce(p["type_tissue"], p["class"], p["classification"], F.lit("unknown"))
    return files.select("file", x.alias("x"), y.alias("y"), label.alias("class_label"), F.coalesce(p["area"], F.when(F.size(ring) > 0, polygon_area(ring))).alias("area"), ring.alias("ring")).where("x is not null and y is not null")


def dict_nuclei(spark: SparkSession, path: str) -> DataFrame:
    """Nuclei of a dictionary by id: the centroid, class codes as names, and the contour."""
    files = spark.read.schema(DICT).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("nuc").alias("id", "n"))
    code = F.col("n.type")
    label = F.coalesce(mapped(code.try_cast("int"), NUCLEUS_CLASSES), code, F.lit("unknown"))
    return files.where("n.centroid is not null").select("file", "id", F.col("n.centroid")[0].alias("x"), F.col("n.centroid")[1].alias("y"), label.alias("class_label"), F.col("n.contour").alias("ring"))


def sample_files(spark: SparkSession, folder: str, sample: str) -> DataFrame:
    """The file of a sample below a folder: *.geojson before *.json, flat before nested: (path, preference)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    own = files.where(name.contains(sample) & (name.endswith(".geojson") | name.endswith(".json")))
    depth = F.size(F.split("path", "/"))
    order = W.orderBy(F.when(name.endswith(".geojson"), 0).otherwise(1), depth, "path")
    return own.withColumn("preference", F.row_number().over(order)).select("path", "preference")


def csv_folder(spark: SparkSession, pattern: str, schema: str, sample_pattern: str) -> DataFrame:
    """All CSV files of a pattern, the sample's name taken from the file's."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), sample_pattern, 1).alias("sample_id"))


def gene_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """Gene metrics from JSON text of gene -> {pearson, pvalue}; names that begin with two underscores are summaries."""
    m = F.from_json(value, "map<string, struct<pearson: double, pvalue: double>>")
    return lines.select(F.explode(m).alias("gene", "m")).where(~F.col("gene").startswith("__")).select("gene", "m.pearson", "m.pvalue")


LOCATIONS = "results array<struct<comments: array<struct<commentType: string, type: string, subcellularLocations: array<struct<location: struct<value: string>>>>>>>"


def locations(records: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    """From JSON text of records: the locations of the first result, joined by '; ', 'Unknown' if there are none."""
    r = F.from_json(value, LOCATIONS)
    own = F.filter(F.coalesce(r["results"][0]["comments"], F.array()), lambda c: F.coalesce(c["commentType"], c["type"]) == "SUBCELLULAR LOCATION")
    found = F.array_distinct(F.filter(F.flatten(F.transform(own, lambda c: F.transform(F.coalesce(c["subcellularLocations"], F.array()), lambda x: x["location"]["value"]))), lambda x: x.isNotNull()))
    return records.select(gene, F.coalesce(found, F.array()).alias("locations")).withColumn("all_localizations", F.when(F.size("locations") > 0, F.array_join("locations", "; ")).otherwise("Unknown"))


def terms(rows: DataFrame, gene: str = "gene", term: str = "term", most: int = 5) -> DataFrame:
    """Terms of each gene: the first ``most`` by name, joined."""
    own = rows.where(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(gene).agg(F.array_sort(F.collect_set(term)).alias("terms"))
    return own.withColumn("all_functions", F.array_join(F.slice("terms", 1, most), "; "))


def cached_annotations(spark: SparkSession, path: str, genes: DataFrame) -> DataFrame:
    return spark.read.option("header", True).csv(path).join(genes.select("gene").distinct(), "gene", "left_semi")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length) of all files below a folder, empty ones among them, which Spark's own sources leave out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().getName(), f.getLen()))
    return spark.createDataFrame(rows, "name string, length long")


def completeness(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Expected files (sample_id, kind, name) below a folder: whether each exists and has bytes."""
    out = expected.join(listed(spark, folder), "name", "left")
    return out.withColumn("exists", F.col("length").isNotNull()).withColumn("complete", F.coalesce(F.col("length") > 0, F.lit(False)))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder for each key; only the partitions at hand are replaced."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON objects."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
