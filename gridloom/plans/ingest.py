"""Queries: files and folders, written from the given tables and read back, and strict or renamed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import stats
from gridloom.operators import expression_tests as T
from gridloom.operators import linear, scores
from gridloom.plans import differential as D
from gridloom.plans import spatial as P
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.scores import edges_sql, r6
from gridloom.plans.views import with_views
from gridloom.sources import files, tables
from gridloom.sources.tables import scratch


def named(df: DataFrame, folder: str, name: str, form: str = "text", **options: object) -> None:
    """Write a small table as one file of this name."""
    spark, part = df.sparkSession, scratch(df.sparkSession)
    df.coalesce(1).write.options(**options).format(form).save(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for s in fs.listStatus(path(part)):
        if s.getPath().getName().startswith("part-"):
            fs.rename(s.getPath(), path(f"{folder}/{name}"))


_WIDE = with_views("scores") + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + ", c AS (SELECT sample_id, spot_id, encoder, d_raw - " + V.BIN_MEAN + " AS v FROM binned)"


def wide_scores(spark: SparkSession, d: str) -> DataFrame:
    """A file as wide as its encoders: raw and corrected scores of each."""
    own = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    out = own.groupBy("sample_id", "spot_id").pivot("encoder", ["m1", "m2", "m3"]).agg(F.max("d_raw").alias("raw"), F.max("d_cond").alias("cond"))
    return out.toDF("sample_id", "spot_id", *[f"{k}_{e}_ridge" for e in ("m1", "m2", "m3") for k in ("D_raw", "D_cond")])


@query(_WIDE + " SELECT sample_id, spot_id, round(avg(v), 6) AS d_cond FROM c GROUP BY ALL")
def s7_averaged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from a wide file and averaged over its encoders."""
    path = scratch(spark)
    wide_scores(spark, d).write.parquet(path)
    own = spark.read.parquet(path)
    return tables.row_mean(own, tables.columns_like(own, "D_cond_*_ridge"), "d_cond").select("sample_id", "spot_id", r6("d_cond"))


@query(_WIDE + " SELECT spot_id, round(max(v) FILTER (encoder = 'm1'), 6) AS D_cond_m1_ridge, round(max(v) FILTER (encoder = 'm2'), 6) AS D_cond_m2_ridge, round(max(v) FILTER (encoder = 'm3'), 6) AS D_cond_m3_ridge FROM c GROUP BY ALL")
def p11_columns_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    own = wide_scores(spark, d)
    return own.select("spot_id", *[r6(c) for c in tables.columns_like(own, "D_cond_*_ridge")])


@query(_WIDE + ", k AS (SELECT sample_id, spot_id, avg(v) AS v FROM c GROUP BY ALL) SELECT sample_id, spot_id, round(v, 6) AS mean_score FROM k")
def p12_mean_over_encoders(spark: SparkSession, d: str) -> DataFrame:
    own = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    return own.groupBy("sample_id", "spot_id").agg(r6(F.avg("d_cond"), "mean_score"))


# Nuclei in both layouts.

_NU = with_views("points") + "SELECT round({x}, 6) AS x, round({y}, 6) AS y, {label} AS class_label, {area} AS area FROM points"
_SQUARE = "abs(((x - 1) * (y - 1) - (x + 1) * (y - 1)) + ((x + 1) * (y + 1) - (x + 1) * (y - 1)) + ((x + 1) * (y + 1) - (x - 1) * (y + 1))) / 2"


@query(_NU.format(x="x", y="y", label="CASE spot_id % 3 WHEN 0 THEN CAST(label AS VARCHAR) WHEN 1 THEN 'c' ELSE 'unknown' END", area=f"round(CASE spot_id % 3 WHEN 0 THEN abs(z) WHEN 2 THEN {_SQUARE} END, 6)"))
def s9_geojson_nuclei(spark: SparkSession, d: str) -> DataFrame:
    """Points as features: with a centroid, as a point, or as a polygon, a file for each sample."""
    text = lambda *cols: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cols])
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    side = lambda c, s: (F.col(c) + s).cast("string")
    ring = F.concat_ws(",", *[text("[", side("x", a), ",", side("y", b), "]") for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    feature = (
        F.when(F.col("spot_id") % 3 == 0, text('{"properties":{"centroid":[', x, ",", y, '],"type_tissue":"', F.col("label").cast("string"), '","area":', F.abs("z").cast("string"), "}}"))
        .when(F.col("spot_id") % 3 == 1, text('{"properties":{"class":"c"},"geometry":{"type":"Point","coordinates":[', x, ",", y, "]}}"))
        .otherwise(text('{"properties":{},"geometry":{"type":"Polygon","coordinates":[[', ring, "]]}}"))
    )
    own = V.points(spark, d).select("sample_id", feature.alias("f"))
    # A file is one document, so a sample's features come together here, as in any such file.
    docs = own.groupBy("sample_id").agg(text('{"features":[', F.array_join(F.collect_list("f"), ","), "]}").alias("value"))
    path = scratch(spark)
    docs.write.partitionBy("sample_id").text(path)
    return files.geojson_nuclei(spark, path).select(r6("x"), r6("y"), "class_label", r6("area"))


@query(with_views("points") + "SELECT CAST(spot_id AS VARCHAR) AS id, round(x, 6) AS x, round(y, 6) AS y, CASE label WHEN 1 THEN 'neoplastic' WHEN 2 THEN 'inflammatory' ELSE 'other' END AS kind FROM points")
def s9_dict_nuclei(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.array("x", "y").alias("centroid"), F.col("label").cast("string").alias("type"))
    own = V.points(spark, d).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("spot_id").cast("string"), entry))).alias("nuc"))
    path = scratch(spark)
    own.select("sample_id", F.to_json(F.struct("nuc")).alias("value")).write.partitionBy("sample_id").text(path)
    out = files.dict_nuclei(spark, path)
    kind = F.when(F.col("class_label").isin("neoplastic", "inflammatory"), F.col("class_label")).otherwise("other")
    return out.select("id", r6("x"), r6("y"), kind.alias("kind"))


@query("SELECT * FROM (SELECT CAST(n_regionkey AS BIGINT) AS region, n_name || '.geojson' AS name, 1 AS preference FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_regionkey, n_name || '_cells.json', 2 FROM nation WHERE n_nationkey < 3)")
def s10_sample_files(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's files below a folder, the GeoJSON first, then nested ones."""
    folder = scratch(spark)
    rows = V.read_table(spark, d, "nation").where("n_nationkey < 3").select("n_name", "n_regionkey")
    parts = []
    for name, region in rows.collect():  # three samples
        line = rows.where(F.col("n_name") == name).select(F.lit("{}").alias("value"))
        named(line, f"{folder}/deep", f"{name}_cells.json")
        named(line, folder, f"{name}.geojson")
        own = files.sample_files(spark, folder, name)
        parts.append(own.select(F.lit(region).cast("long").alias("region"), F.element_at(F.split("path", "/"), -1).alias("name"), "preference"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_views("scores") + D._DE + " SELECT patient AS sample_id, 'unmatched' AS de_type, gene, round(pval, 6) AS pval FROM de WHERE patient IN ('ASIA', 'EUROPE')")
def s11_csv_folder(spark: SparkSession, d: str) -> DataFrame:
    """Result tables of samples as CSV files, read together with the sample from the file's name."""
    folder, own = scratch(spark), tables.written(D.de(spark, d).select("patient", "gene", r6("pval")))
    for sample in ("ASIA", "EUROPE"):
        named(own.where(F.col("patient") == sample).drop("patient"), folder, f"{sample}_unmatched.csv", "csv", header=True)
    out = files.csv_folder(spark, f"{folder}/*_unmatched.csv", "gene string, pval double", "^(.*)_unmatched")
    return out.select("sample_id", F.lit("unmatched").alias("de_type"), "gene", "pval")


@query("SELECT 'there' AS name, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'missing', 0")
def s12_missing_tables(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    V.read_table(spark, d, "nation").select("n_name").write.parquet(path)
    count = lambda name, p: tables.table_or_empty(spark, p, "n_name string").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("there", path).unionByName(count("missing", scratch(spark)))


@query("SELECT p_brand AS gene, max(p_type) AS kind FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY ALL")
def s16_cached_annotations(spark: SparkSession, d: str) -> DataFrame:
    path, part = scratch(spark), V.read_table(spark, d, "part")
    files.write_csv(part.groupBy(F.col("p_brand").alias("gene")).agg(F.max("p_type").alias("kind")), path)
    return files.cached_annotations(spark, path, part.where("p_size = 50").select(F.col("p_brand").alias("gene"))).select("gene", "kind")


@query("SELECT n_name AS sample_id, kind, kind = 'counts' OR n_nationkey % 2 = 0 AS exists, kind = 'counts' AS complete FROM nation, (SELECT unnest(['counts', 'nuclei']) AS kind) WHERE n_nationkey < 4")
def s17_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Two files for each of four samples: all counts, and an empty file of nuclei for every second."""
    folder, dim = scratch(spark), V.read_table(spark, d, "nation").where("n_nationkey < 4").select("n_name", "n_nationkey")
    for name, key in dim.collect():  # four samples
        named(dim.where(F.col("n_nationkey") == key).select(F.col("n_name").alias("value")), folder, f"{name}.counts")
        if key % 2 == 0:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.nuclei")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
    kinds = F.explode(F.array(F.lit("counts"), F.lit("nuclei")))
    want = dim.select(F.col("n_name").alias("sample_id"), kinds.alias("kind")).withColumn("name", F.concat_ws(".", "sample_id", "kind"))
    return files.completeness(spark, folder, want).select("sample_id", "kind", "exists", "complete")


# Joins and filters.


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL")
def p5_drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    both = V.read_table(spark, d, "customer").select("c_custkey").join(V.read_table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.dropna(subset=["o_orderkey", "o_totalprice"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def j5_strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = V.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return tables.strict_lookup(V.read_table(spark, d, "lineitem"), part, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query(with_views("scores", "gene_sets") + D._COND + ", t AS (SELECT spot_id, pathway AS cell_type, " + stats.fixed_sql(stats.exact_mean_sql('y'), 6) + " AS score FROM cells JOIN gene_sets USING (gene) GROUP BY ALL HAVING count(*) >= 2) SELECT c.sample_id, spot_id, cell_type, round(d_cond, 6) AS d_cond, score FROM cond c JOIN t USING (spot_id)")
def j6_scores_and_types(spark: SparkSession, d: str) -> DataFrame:
    """Corrected scores with the cell-type scores of the same spot."""
    sets = V.gene_sets(spark, d).withColumnRenamed("pathway", "cell_type")
    own = scores.set_scores(V.cells(spark, d), sets, ["sample_id", "spot_id"], "y", name="cell_type", least=2)
    return D.cond(spark, d).join(own, ["sample_id", "spot_id"]).select("sample_id", "spot_id", "cell_type", r6("d_cond"), stats.fixed(F.col("score"), 6).alias("score"))


@query(with_views("scores", "gene_sets") + D._SCORES + ", s AS (SELECT pathway, min(fdr) AS f, round(avg(abs(cohens_d)), 9) AS m FROM sets_de GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY m DESC, pathway) AS place, count(*) FILTER (f < 0.05) OVER () AS found FROM s) SELECT pathway, round(m, 6) AS mean_abs_d, f < 0.05 AS significant FROM k WHERE found >= 5 AND f < 0.05 OR found < 5 AND place <= 15")
def l4b_top_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets that any sample finds if they are five or more, else the 15 with the largest effects."""
    s = D.set_de(spark, d).groupBy("pathway").agg(F.min("fdr").alias("f"), F.round(F.avg(F.abs("cohens_d")), 9).alias("m"))
    found, place = F.sum((F.col("f") < 0.05).cast("int")).over(W.partitionBy()), F.row_number().over(W.orderBy(F.desc("m"), "pathway"))  # a row for each set
    out = s.withColumn("found", found).withColumn("place", place).where("found >= 5 and f < 0.05 or found < 5 and place <= 15")
    return out.select("pathway", r6("m", "mean_abs_d"), (F.col("f") < 0.05).alias("significant"))


# Small functions by themselves.


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 9) AS y FROM lineitem")
def p3_log1p(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.log1p("l_quantity"), 9).alias("y"))


@query(with_views("predictions") + "SELECT spot_id, encoder, gene, " + stats.fixed_sql("residual - " + stats.exact_mean_sql("residual", " OVER (PARTITION BY sample_id, encoder, gene)"), 6) + " AS centred FROM predictions")
def p7_centred_residuals(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("sample_id", "encoder", "gene")
    return V.predictions(spark, d).select("spot_id", "encoder", "gene", stats.fixed(F.col("residual") - stats.exact_mean(F.col("residual"), w), 6).alias("centred"))


@query(with_views("cells") + "SELECT sample_id, spot_id, round(sum(y), 6) AS total FROM cells GROUP BY ALL")
def p9_total_expression(spark: SparkSession, d: str) -> DataFrame:
    return V.cells(spark, d).groupBy("sample_id", "spot_id").agg(r6(F.sum("y"), "total"))


@query(with_views("predictions") + "SELECT sample_id, spot_id, gene, encoder, round(residual, 6) AS residual FROM predictions WHERE gene IN (SELECT p_brand FROM part WHERE p_size = 50)")
def p10_gene_subset(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("gene")).distinct()
    return V.predictions(spark, d).join(own, "gene", "left_semi").select("sample_id", "spot_id", "gene", "encoder", r6("residual"))


@query(with_views("points") + ", l AS (SELECT spot_id, 'x' AS f, x AS v FROM points UNION ALL SELECT spot_id, 'one', 1.0 FROM points) SELECT spot_id, f, round((v - avg(v) OVER (PARTITION BY f)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY f) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY f) END, 6) + 0.0 AS z FROM l")
def p16_column_scores(spark: SparkSession, d: str) -> DataFrame:
    """Standardised columns, one of them constant, whose deviation counts as one."""
    own = V.points(spark, d).select("spot_id", "x", F.lit(1.0).alias("one")).unpivot(["spot_id"], ["x", "one"], "f", "v")
    return C.standardised(own, "v", ["f"], zero_as_one=True).select("spot_id", "f", (F.round("z", 6) + 0.0).alias("z"))


@query(with_views("points") + P._KNN + " SELECT k.sample_id, src, dst, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine FROM knn k JOIN points a ON a.sample_id = k.sample_id AND a.spot_id = src JOIN points b ON b.sample_id = k.sample_id AND b.spot_id = dst")
def p20_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = V.points(spark, d)
    both = P.edges(spark, d).join(p.select("sample_id", F.col("spot_id").alias("src"), F.col("vector").alias("va")), ["sample_id", "src"]).join(p.select("sample_id", F.col("spot_id").alias("dst"), F.col("vector").alias("vb")), ["sample_id", "dst"])
    return both.select("sample_id", "src", "dst", r6(C.cosine(F.col("va"), F.col("vb")), "cosine"))


_TERMS = {"PROMO": "protein kinase activity", "ECONOMY": "receptor binding", "LARGE": "ion channel", "MEDIUM": "cytoskeleton", "SMALL": "DNA binding", "STANDARD": "cell signaling"}


@query("SELECT p_partkey, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"PROMO": "Enzymatic", "ECONOMY": "Receptor", "LARGE": "Transporter", "MEDIUM": "Structural", "SMALL": "Transcription factor", "STANDARD": "Signaling"}.items()) + " ELSE 'Other' END AS function FROM part")
def p22_term_classes(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select("p_partkey", C.term_class(F.array(C.mapped(F.col("p_type"), _TERMS))).alias("function"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Structural' WHEN p_size % 5 = 1 THEN 'Receptor/Immune' WHEN p_size % 5 = 2 THEN 'Signaling/Cytokine' WHEN p_size % 5 = 3 THEN 'Transporter' ELSE 'Other' END AS by_name FROM part")
def p23_name_classes(spark: SparkSession, d: str) -> DataFrame:
    gene = F.concat(F.element_at(F.array(*map(F.lit, ["Krt", "CD", "il", "SLC", "Brand"])), (F.col("p_size") % 5 + 1).cast("int")), F.col("p_size").cast("string"))
    return V.read_table(spark, d, "part").select("p_partkey", C.name_class(gene).alias("by_name"))


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'neoplastic' WHEN 2 THEN 'inflammatory' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def p25_code_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select("p_partkey", C.mapped(F.col("p_size"), {1: "neoplastic", 2: "inflammatory"}).alias("label"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'Third nation' ELSE 'Nation ' || string_split(n_name, '_')[2] END AS display FROM nation")
def p27_display_names(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "nation").select("n_nationkey", C.pathway_name(F.concat(F.lit("HALLMARK_"), F.col("n_name")), {"NATION_3": "Third nation"}).alias("display"))


@query("SELECT o_orderpriority, round(count(*) FILTER (o_totalprice > 100000) / count(*), 3) AS fraction FROM orders GROUP BY ALL")
def p29_rounded_fraction(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.count_if(F.col("o_totalprice") > 100000) / F.count("*"), 3).alias("fraction"))


@query("SELECT l_orderkey, l_linenumber, round(-log10(greatest(l_discount, 1e-300)), 6) AS height, round(-log10(1 - least(l_discount * 10, 0.9999) + 1e-10), 6) + 0.0 AS repro FROM lineitem")
def p30_volcano(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(C.volcano(F.col("l_discount")), "height"), (F.round(C.reproducibility_height(F.col("l_discount") * 10), 6) + 0.0).alias("repro"))


@query(with_views("points") + "SELECT spot_id, CAST(sign(x) AS DOUBLE) AS sign_x, sign(x) = sign(y) AS same FROM points")
def p31_signs(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).select("spot_id", F.signum("x").alias("sign_x"), C.same_sign(F.col("x"), F.col("y")).alias("same"))


@query("SELECT p_partkey, CAST(least(9, floor((p_size - 1) / 49.0 * 10 + 1e-9)) AS INTEGER) AS cell FROM part")
def p33_cell_index(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select("p_partkey", C.grid_cell((F.col("p_size") - 1) / 49.0 + 1e-10, 10).alias("cell"))


@query("SELECT o_custkey, count(*) FILTER (o_totalprice > 150000) > 3 AS over, count(*) FILTER (o_totalprice > 150000) / count(*) >= 0.5 AS enough FROM orders GROUP BY ALL")
def p36_gate_predicates(spark: SparkSession, d: str) -> DataFrame:
    high = F.count_if(F.col("o_totalprice") > 150000)
    return V.read_table(spark, d, "orders").groupBy("o_custkey").agg((high > 3).alias("over"), (high / F.count("*") >= 0.5).alias("enough"))


@query("SELECT p_type, round(avg(p_retailprice) - 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS low, round(avg(p_retailprice) + 1.96 * stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS high FROM part GROUP BY ALL")
def p38_intervals(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("m"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count("*"))).alias("se"))
    ends = C.interval95(F.col("m"), F.col("se"))
    return own.select("p_type", r6(ends["low"], "low"), r6(ends["high"], "high"))


@query("SELECT c_mktsegment, CAST(count(*) FILTER (coalesce(flag, true)) AS BIGINT) AS n_in, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal > 0 END AS flag FROM customer) GROUP BY ALL")
def p39_in_tissue(spark: SparkSession, d: str) -> DataFrame:
    """A mask with gaps, which count as inside."""
    flag = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0)
    return V.read_table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(C.in_tissue(flag)).alias("n_in"), F.count("*").alias("n"))


@query(with_views("points") + D._DELTAS + ", mv AS (SELECT *, abs(delta) AS a FROM deltas WHERE delta <> 0) SELECT sample_id, spot_id, gene, sign(delta) * (rank() OVER (PARTITION BY sample_id, gene ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, gene, a) - 1) / 2.0) AS signed_rank FROM mv")
def w2_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    own = D.deltas(spark, d).where("delta <> 0").withColumn("a", F.abs("delta"))
    return own.select("sample_id", "spot_id", "gene", (F.signum("delta") * stats.mid_rank("a", ["sample_id", "gene"])).alias("signed_rank"))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) + 0.0 AS gap FROM orders")
def w5_group_mean_subtract(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") - F.avg("o_totalprice").over(W.partitionBy("o_custkey")), 6) + 0.0).alias("gap"))


@query("SELECT o_custkey, round(sum(area), 4) AS area FROM (SELECT o_custkey, (o_totalprice + lag(o_totalprice) OVER w) / 2 AS area FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) GROUP BY ALL HAVING count(area) > 0")
def w7_trapezoids(spark: SparkSession, d: str) -> DataFrame:
    """Area under each customer's order values, an order apart."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    own = V.read_table(spark, d, "orders").select("o_custkey", ((F.col("o_totalprice") + F.lag("o_totalprice").over(w)) / 2).alias("area"))
    return own.groupBy("o_custkey").agg(F.round(F.sum("area"), 4).alias("area")).where("area is not null")


@query(with_views("points") + P._KNN + " SELECT sample_id, src, CAST(max(rank) AS INTEGER) AS k, list(dst ORDER BY rank)[1] AS first FROM knn GROUP BY ALL")
def w8_neighbour_ranks(spark: SparkSession, d: str) -> DataFrame:
    return P.edges(spark, d).groupBy("sample_id", "src").agg(F.max("rank").alias("k"), F.max(F.when(F.col("rank") == 1, F.col("dst"))).alias("first"))


@query("WITH o AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat_ws('|', '4', c_custkey)), c_custkey) AS q FROM customer) SELECT a.c_custkey, b.c_acctbal AS drawn FROM o a JOIN o b ON a.c_nationkey = b.c_nationkey AND a.p = b.q")
def w9_shuffle_within(spark: SparkSession, d: str) -> DataFrame:
    """Balances shuffled among the customers of a nation."""
    w = W.partitionBy("c_nationkey")
    own = V.read_table(spark, d, "customer").withColumn("p", F.row_number().over(w.orderBy("c_custkey"))).withColumn("q", F.row_number().over(w.orderBy(stats.seeded(4, "c_custkey"), "c_custkey")))
    return own.select("c_custkey", "c_nationkey", "p").join(own.select("c_nationkey", F.col("q").alias("p"), F.col("c_acctbal").alias("drawn")), ["c_nationkey", "p"]).select("c_custkey", "drawn")


# Exact laws of small samples: ten rows a group, all ways to choose a side or the signs.

_TEN = with_views("points") + ", t AS (SELECT spot_id // 10 AS g, spot_id, z, CASE WHEN spot_id % 10 IN (1, 4, 6, 9) THEN 1 ELSE 0 END AS side FROM points)"
_MASKS = "(SELECT unnest(range(0, 1024)) AS m)"
_SUM = "list_sum(list_transform(range(0, 10), lambda i: ((m >> i) & 1) * (i + 1)))"


@query(_TEN + f", r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY z) AS r FROM t), u AS (SELECT g, sum(r) FILTER (side = 1) - 10 AS u FROM r GROUP BY ALL HAVING count(*) = 10), w AS (SELECT {_SUM} - 10 AS u FROM {_MASKS} WHERE bit_count(CAST(m AS BIGINT)) = 4) SELECT CAST(g AS BIGINT) AS g, round(least(1.0, 2.0 * (SELECT count(*) FROM w WHERE w.u <= least(x.u, 24 - x.u)) / (SELECT count(*) FROM w)), 9) AS pval FROM u x")
def m2_exact_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    """Groups of ten points, four against six, by the exact law."""
    own = V.points(spark, d).select(F.floor(F.col("spot_id") / 10).alias("g"), "z", (F.col("spot_id") % 10).isin(1, 4, 6, 9).cast("int").alias("side"))
    out = T.rank_sums(own, "z", ["g"]).where("n_disc = 4 and n_conc = 6")
    return out.select("g", F.round(stats.mwu_p("u", "n_disc", "n_conc", "ties", "pval"), 9).alias("pval"))


@query(_TEN + f", r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(z)) AS r FROM t), u AS (SELECT g, least(sum(r) FILTER (z > 0), 55 - coalesce(sum(r) FILTER (z > 0), 0)) AS t FROM r GROUP BY ALL HAVING count(*) = 10), w AS (SELECT {_SUM} AS t FROM {_MASKS}) SELECT CAST(g AS BIGINT) AS g, round(least(1.0, 2.0 * (SELECT count(*) FROM w WHERE w.t <= coalesce(x.t, 0)) / 1024), 9) AS pval FROM u x")
def m3_exact_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).select(F.floor(F.col("spot_id") / 10).alias("g"), F.col("z").alias("delta"))
    return T.signed_ranks(own, ["g"]).where("n_matched = 10").select("g", F.round("pval", 9).alias("pval"))


@query(with_views("points") + P._NULL + " SELECT o.sample_id, CAST(count(*) FILTER (n.i >= o.i) AS BIGINT) AS at_least, (1 + count(*) FILTER (n.i >= o.i)) / (1.0 + count(*)) AS p FROM null_ n JOIN null_ o ON o.sample_id = n.sample_id AND o.perm = 0 WHERE n.perm > 0 GROUP BY ALL")
def m6_empirical_p(spark: SparkSession, d: str) -> DataFrame:
    null = P.null(spark, d)
    seen = null.where("perm = 0").select("sample_id", F.col("morans_i").alias("o"))
    high = F.count_if(F.col("morans_i") >= F.col("o"))
    return null.where("perm > 0").join(seen, "sample_id").groupBy("sample_id").agg(high.alias("at_least"), stats.empirical_p(high, F.count("*")).alias("p"))


# Scaling and components.


@query(with_views("points") + ", f AS (SELECT spot_id, CAST(label % 5 AS VARCHAR) AS u, x FROM points), m AS (SELECT a.u, avg(b.x) AS m, stddev_pop(b.x) AS s FROM (SELECT DISTINCT u FROM f) a JOIN f b ON a.u <> b.u GROUP BY ALL) SELECT spot_id, round((x - m) / s, 6) AS z FROM f JOIN m USING (u)")
def r1_train_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Values by the mean and deviation of all other folds."""
    own = V.points(spark, d).select("spot_id", (F.col("label") % 5).cast("string").alias("u"), "x")
    sums = own.groupBy("u").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    every = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    rest = sums.crossJoin(F.broadcast(every)).select("u", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nsq"])  # one row of sums
    mean = F.col("s") / F.col("n")
    fit = rest.select("u", mean.alias("m"), F.sqrt(F.col("q") / F.col("n") - mean * mean).alias("sd"))
    return own.join(fit, "u").select("spot_id", r6((F.col("x") - F.col("m")) / F.col("sd"), "z"))


@query(with_views("points") + ", m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM points), e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l FROM m), v AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS vx, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS vy FROM e), s AS (SELECT *, CASE WHEN abs(vx) >= abs(vy) THEN sign(vx) ELSE sign(vy) END AS g FROM v) SELECT spot_id, round(g * ((x - mx) * vx + (y - my) * vy), 6) AS pc1, round(l / (a + c), 6) AS explained FROM points, s")
def r2_first_component(spark: SparkSession, d: str) -> DataFrame:
    """The first principal component of two columns, its largest loading positive."""
    pc, shares = linear.components(V.points(spark, d).withColumn("v", F.array("x", "y")), "v", ["spot_id"], 2)
    return pc.select("spot_id", r6(F.col("pc")[0], "pc1"), F.round(F.lit(float(shares[0])), 6).alias("explained"))
