"""Queries: scans, scores, panels and per-gene metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import stats
from gridloom.operators import profile, scores
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.views import with_views
from gridloom.sources import tables

SPOT = ["cohort", "patient", "sample_id", "spot_id"]


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


@query(with_views("cells") + "SELECT cohort, sample_id, gene, CAST(count(*) AS BIGINT) AS n_spots, CAST(count(*) FILTER (value > 0) AS BIGINT) AS n_nonzero, round(sum(y), 6) AS sum_y FROM cells GROUP BY ALL")
def s1_expression_scan(spark: SparkSession, d: str) -> DataFrame:
    return V.cells(spark, d).groupBy("cohort", "sample_id", "gene").agg(F.count("*").alias("n_spots"), F.count_if(F.col("value") > 0).alias("n_nonzero"), r6(F.sum("y"), "sum_y"))


@query(with_views("expression") + "SELECT spot_id, gene, value FROM expression WHERE gene IN (SELECT p_brand FROM part WHERE p_size > 40)")
def s2_available_genes(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").where("p_size > 40").select(F.col("p_brand").alias("gene"))
    return tables.available(V.expression(spark, d), own).select("spot_id", "gene", "value")


@query(with_views("cells") + "SELECT spot_id, value, y FROM cells WHERE gene = 'Brand#7'")
def s3_one_gene(spark: SparkSession, d: str) -> DataFrame:
    return tables.one_gene(V.spots(spark, d), V.expression(spark, d), "Brand#7", ["spot_id"]).select("spot_id", "value", F.round(F.log1p("value"), 9).alias("y"))


@query(with_views("points") + "SELECT sample_id, spot_id, x, y FROM points")
def s4_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return tables.coordinates(V.points(spark, d), ["sample_id", "spot_id"])


@query(with_views("points") + "SELECT sample_id, spot_id, CAST(len(vector) AS INTEGER) AS dim, round(list_sum(vector), 6) AS total FROM points WHERE sample_id = 's1'")
def s5_embeddings(spark: SparkSession, d: str) -> DataFrame:
    own = tables.embeddings_of(V.points(spark, d), ["s1"])
    return own.select("sample_id", "spot_id", F.size("vector").alias("dim"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), "total"))


@query(with_views("predictions") + "SELECT cohort, encoder, patient, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT spot_id) AS BIGINT) AS n_spots, round(sum(residual), 5) AS sum_residual FROM predictions GROUP BY ALL")
def s6_stacked_folds(spark: SparkSession, d: str) -> DataFrame:
    return V.predictions(spark, d).groupBy("cohort", "encoder", "patient").agg(F.count("*").alias("n_rows"), F.countDistinct("spot_id").alias("n_spots"), F.round(F.sum("residual"), 5).alias("sum_residual"))


@query("SELECT CAST(props->>'$.k' AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s13_json_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read_table(spark, d, "events").select(F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE NOT starts_with(p_brand, 'Brand#2') GROUP BY ALL")
def p1_control_probes(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").where(~C.is_control_probe(F.col("p_brand"), ["Brand#2"])).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(with_views("spots") + "SELECT spot_id, sample_id || '_' || spot_id AS key, CAST(spot_id AS VARCHAR) AS barcode FROM spots")
def p2_spot_keys(spark: SparkSession, d: str) -> DataFrame:
    key = C.spot_key(F.col("sample_id"), F.col("spot_id").cast("string"))
    return V.spots(spark, d).withColumn("key", key).select("spot_id", "key", C.barcode_of(F.col("key"), F.col("sample_id")).alias("barcode"))


@query(with_views("predictions") + "SELECT spot_id, encoder, gene, residual, round(y - residual, 6) AS yhat_back, " + stats.fixed_sql("residual - " + stats.exact_mean_sql("residual", " OVER (PARTITION BY encoder, gene)"), 6) + " AS centred FROM predictions")
def p6_residuals(spark: SparkSession, d: str) -> DataFrame:
    own = V.predictions(spark, d)
    means = own.groupBy("encoder", "gene").agg(stats.exact_mean(F.col("residual")).alias("m"))
    own = own.join(F.broadcast(means), ["encoder", "gene"])  # a row for each encoder and gene
    return own.select("spot_id", "encoder", "gene", "residual", r6(F.col("y") - F.col("residual"), "yhat_back"), stats.fixed(F.col("residual") - F.col("m"), 6).alias("centred"))


@query(with_views("scores") + "SELECT cohort, patient, sample_id, spot_id, encoder, d_raw, total FROM scores")
def p8_raw_scores(spark: SparkSession, d: str) -> DataFrame:
    return V.spot_scores(spark, d)


@query(with_views("scores") + """, wide AS (
  SELECT sample_id, spot_id, max(d_raw) FILTER (encoder = 'm1') AS a, max(d_raw) FILTER (encoder = 'm2') AS b, max(d_raw) FILTER (encoder = 'm3') AS c FROM scores GROUP BY ALL)
SELECT sample_id, spot_id, round(least(a, b, c), 6) AS row_min, round(greatest(a, b, c), 6) AS row_max, round((a + b + c) / 3, 6) AS row_mean, round(greatest(a, b, c) - least(a, b, c), 6) AS row_range FROM wide""")
def p13_row_summary(spark: SparkSession, d: str) -> DataFrame:
    wide = V.spot_scores(spark, d).groupBy("sample_id", "spot_id").pivot("encoder", ["m1", "m2", "m3"]).agg(F.max("d_raw"))
    return wide.select("sample_id", "spot_id", *[r6(v, k) for k, v in C.row_summary([F.col(c) for c in ("m1", "m2", "m3")]).items()])


@query("""WITH s AS (SELECT p_type, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part GROUP BY ALL)
SELECT p_partkey, round(coalesce(CASE WHEN sd > 0 THEN (p_retailprice - m) / sd END, 0), 6) AS z FROM part JOIN s USING (p_type)""")
def p15_z_scores(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return C.standardised(own, "p_retailprice", ["p_type"]).select("p_partkey", r6("z"))


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_type = '{t}' AS DOUBLE) AS \"p_type_{t}\"" for t in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def p17_one_hot(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").select("p_partkey", "p_type")
    return C.one_hot(own, "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).drop("p_type")


@query("SELECT p_partkey, coalesce(TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE), 0) AS n, coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS zero FROM part")
def p18_numbers(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select("p_partkey", C.number(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("n"), C.number(F.col("p_name")).alias("zero"))


@query(with_views("points") + ", n AS (SELECT *, sqrt(list_inner_product(vector, vector)) AS l FROM points) SELECT spot_id, round(l, 6) AS length, round(x / l, 6) AS unit_x FROM n")
def p19_normalise(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).select("spot_id", r6(C.norm(F.col("vector")), "length"), r6(C.normalised(F.col("vector"))[0], "unit_x"))


_LOC = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(s, {w!r})' for w in ws)} THEN '{label}'" for label, ws in [("Membrane", ["gear", "ring"]), ("Nucleus", ["bolt"])]) + " ELSE 'Other' END"


@query(f"SELECT p_partkey, {_LOC} AS kind, CASE WHEN starts_with(upper(p_brand), 'BRAND#1') THEN 'one' WHEN starts_with(upper(p_brand), 'BRAND#2') THEN 'two' ELSE 'Other' END AS by_name FROM (SELECT *, lower(p_name) AS s FROM part)")
def p21_keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower("p_name")
    kind = C.cases([("Membrane", F.contains(s, F.lit("gear")) | F.contains(s, F.lit("ring"))), ("Nucleus", F.contains(s, F.lit("bolt")))], F.lit("Other"))
    return V.read_table(spark, d, "part").select("p_partkey", kind.alias("kind"), C.name_class(F.col("p_brand"), [("one", ["BRAND#1"]), ("two", ["BRAND#2"])]).alias("by_name"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'SMALL' WHEN 'ECONOMY' THEN 'SMALL' ELSE p_type END AS merged, CASE p_size WHEN 1 THEN 'neoplastic' WHEN 2 THEN 'inflammatory' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def p24_category_maps(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select("p_partkey", C.mapped(F.col("p_type"), {"PROMO": "SMALL", "ECONOMY": "SMALL"}).alias("merged"), C.mapped(F.col("p_size"), {1: "neoplastic", 2: "inflammatory"}).alias("label"))


@query("SELECT n_nationkey, CASE WHEN starts_with(n_name, 'NATION_1') THEN 'one' WHEN starts_with(n_name, 'NATION_2') THEN 'two' ELSE 'rest' END AS source, 'Nation ' || string_split(n_name, '_')[2] AS display FROM nation")
def p26_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    source = C.cases([("one", n.startswith("NATION_1")), ("two", n.startswith("NATION_2"))], F.lit("rest"))
    return V.read_table(spark, d, "nation").select("n_nationkey", source.alias("source"), C.pathway_name(n).alias("display"))


@query("SELECT l_orderkey, l_linenumber, l_discount AS p, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars, round(-log10(greatest(l_discount, 1e-300)), 6) AS height, round(-log10(1 - least(l_discount, 0.9999) + 1e-10), 6) + 0.0 AS repro, round(l_tax - 1.96 * l_discount, 6) AS low, round(l_tax + 1.96 * l_discount, 6) AS high, sign(l_tax - 0.02) = sign(l_discount - 0.03) AS same FROM lineitem")
def p28_report_columns(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_discount")
    own = V.read_table(spark, d, "lineitem")
    ends = C.interval95(F.col("l_tax"), p)
    return own.select("l_orderkey", "l_linenumber", p.alias("p"), C.stars(p).alias("stars"), r6(C.volcano(p), "height"), (F.round(C.reproducibility_height(p), 6) + 0.0).alias("repro"), r6(ends["low"], "low"), r6(ends["high"], "high"), C.same_sign(F.col("l_tax") - 0.02, p - 0.03).alias("same"))


@query(with_views("points") + """, b AS (SELECT sample_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY ALL),
n AS (SELECT p.sample_id, spot_id, (x - lx) / CASE WHEN hx = lx THEN 1 ELSE hx - lx END AS nx, (y - ly) / CASE WHEN hy = ly THEN 1 ELSE hy - ly END AS ny FROM points p JOIN b USING (sample_id))
SELECT sample_id, spot_id, round(nx, 6) AS nx, round(ny, 6) AS ny,
  CAST(len(list_filter(range(1, 20), lambda i: nx >= i / 20.0)) AS INTEGER) AS cx, CAST(len(list_filter(range(1, 20), lambda i: ny >= i / 20.0)) AS INTEGER) AS cy FROM n""")
def p32_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    own = V.points(spark, d).withColumn("nx", C.min_max(F.col("x"), ["sample_id"])).withColumn("ny", C.min_max(F.col("y"), ["sample_id"]))
    return own.select("sample_id", "spot_id", r6("nx"), r6("ny"), C.grid_cell(F.col("nx"), 20).alias("cx"), C.grid_cell(F.col("ny"), 20).alias("cy"))


@query(with_views("points") + ", r AS (SELECT spot_id, vector AS v FROM points) SELECT spot_id, round(abs(list_sum(list_transform(range(1, 4), lambda i: v[2 * i - 1] * v[2 * i + 2] - v[2 * i + 1] * v[2 * i]))) / 2, 6) AS area, round((v[1] + v[3] + v[5] + v[7]) / 4, 6) AS cx FROM r")
def p34_polygons(spark: SparkSession, d: str) -> DataFrame:
    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("vector")[2 * i], F.col("vector")[2 * i + 1]))
    own = V.points(spark, d).withColumn("ring", ring)
    return own.select("spot_id", r6(C.polygon_area(F.col("ring")), "area"), r6(C.ring_centroid(F.col("ring"))["x"], "cx"))


@query("""WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part GROUP BY ALL)
SELECT p_partkey, CAST(len(list_filter(q, lambda e: p_retailprice > e)) AS INTEGER) AS quartile FROM part JOIN q USING (p_type)""")
def p35_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return profile.quartile_label(V.read_table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), "p_retailprice", ["p_type"]).select("p_partkey", "quartile")


@query(with_views("cells") + """, s AS (SELECT sample_id, spot_id, sum(CASE WHEN NOT starts_with(gene, 'Brand#2') THEN value ELSE 0 END) AS total,
  count(*) FILTER (NOT starts_with(gene, 'Brand#2') AND value > 0) AS detected FROM cells GROUP BY ALL)
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_spots, round(quantile_cont(total, 0.5), 6) AS median_counts, round(avg(total), 6) AS mean_counts, CAST(quantile_cont(detected, 0.5) AS DOUBLE) AS median_genes,
  CAST((SELECT count(DISTINCT gene) FROM cells WHERE NOT starts_with(gene, 'Brand#2')) AS BIGINT) AS n_real, CAST((SELECT count(DISTINCT gene) FROM cells WHERE starts_with(gene, 'Brand#2')) AS BIGINT) AS n_control FROM s GROUP BY sample_id""")
def a1_sample_qc(spark: SparkSession, d: str) -> DataFrame:
    out = profile.sample_qc(V.cells(spark, d), ["Brand#2"])
    return out.select("sample_id", "n_spots", r6("median_counts"), r6("mean_counts"), F.col("median_genes").cast("double").alias("median_genes"), "n_real", "n_control")


@query(with_views("spots", "expression") + """, e AS (SELECT DISTINCT cohort, sample_id, gene FROM expression JOIN spots USING (spot_id)),
n AS (SELECT cohort, count(DISTINCT sample_id) AS n_samples FROM e GROUP BY ALL)
SELECT cohort, gene, n_with, CAST(n_samples AS BIGINT) AS n_samples, n_with = n_samples AS in_panel
FROM (SELECT cohort, gene, CAST(count(*) AS BIGINT) AS n_with FROM e GROUP BY ALL) JOIN n USING (cohort)""")
def a2_shared_panel(spark: SparkSession, d: str) -> DataFrame:
    own = V.expression(spark, d).join(V.spots(spark, d), "spot_id")
    return profile.shared_panel(own).select("cohort", "gene", "n_with", "n_samples", "in_panel")


@query(with_views("sample_dim") + "SELECT sample_id, true AS have, false AS want FROM sample_dim WHERE n_nationkey >= 20 UNION ALL SELECT sample_id, false, true FROM sample_dim WHERE n_nationkey < 5")
def a3_mapping_gaps(spark: SparkSession, d: str) -> DataFrame:
    dim = V.sample_dim(spark, d)
    return profile.mapping_gaps(dim.where("n_nationkey >= 5"), dim.where("n_nationkey < 20"))


@query(with_views("sample_dim") + """, f AS (SELECT *, dense_rank() OVER (PARTITION BY cohort ORDER BY patient) - 1 AS own FROM sample_dim),
e AS (SELECT DISTINCT cohort, own AS fold, patient AS test_patient FROM f)
SELECT e.cohort, CAST(fold AS INTEGER) AS fold, test_patient, CAST(count(*) FILTER (own = fold) AS INTEGER) AS n_test_samples, CAST(count(*) FILTER (own <> fold) AS INTEGER) AS n_train_samples, string_agg(sample_id, ',' ORDER BY sample_id) FILTER (own = fold) AS test_samples FROM f JOIN e USING (cohort) GROUP BY ALL""")
def a4_folds(spark: SparkSession, d: str) -> DataFrame:
    out = profile.fold_arrays(profile.folds(V.sample_dim(spark, d)))
    return out.select("cohort", "fold", "test_patient", "n_test_samples", "n_train_samples", F.array_join("test_samples", ",").alias("test_samples"))


@query(with_views("cells") + "SELECT sample_id, gene, round(avg(y), 6) AS mean FROM cells GROUP BY ALL")
def a5_pseudobulk(spark: SparkSession, d: str) -> DataFrame:
    return profile.pseudobulk(V.cells(spark, d)).select("sample_id", "gene", r6("mean"))


@query(with_views("gene_sets") + ", p AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_brand < 'Brand#2') SELECT pathway, CAST(count(*) AS BIGINT) AS n_total, CAST(count(p.gene) AS BIGINT) AS n_overlap, coalesce(string_agg(p.gene, ',' ORDER BY p.gene), '') AS genes, round(count(p.gene) / count(*), 3) AS fraction, count(p.gene) >= 5 AS usable FROM gene_sets g LEFT JOIN p ON p.gene = g.gene GROUP BY ALL")
def a6_set_coverage(spark: SparkSession, d: str) -> DataFrame:
    return profile.set_coverage(V.gene_sets(spark, d), V.panel(spark, d).where("gene < 'Brand#2'"))


@query(with_views("gene_sets", "panel") + "SELECT gene, CAST(count(pathway) AS BIGINT) AS pathway_count FROM panel LEFT JOIN gene_sets USING (gene) GROUP BY ALL")
def a7_membership(spark: SparkSession, d: str) -> DataFrame:
    return profile.membership(V.panel(spark, d), V.gene_sets(spark, d))


@query(with_views("gene_sets") + "SELECT pathway AS cell_type, CAST(count(*) AS BIGINT) AS n_genes, CAST(count(*) FILTER (gene < 'Brand#2') AS BIGINT) AS n_available, count(*) FILTER (gene < 'Brand#2') >= 2 AS usable FROM gene_sets GROUP BY ALL")
def a8_signatures(spark: SparkSession, d: str) -> DataFrame:
    return profile.signature_report(V.gene_sets(spark, d).withColumnRenamed("pathway", "cell_type"), V.panel(spark, d).where("gene < 'Brand#2'"))


_PEARSON = """, g AS (SELECT cohort, patient, encoder, gene, CASE WHEN stddev_pop(y) < 1e-10 OR stddev_pop(yhat) < 1e-10 THEN 0 ELSE coalesce(corr(y, yhat), 0) END AS r, count(*) AS n FROM predictions GROUP BY ALL)"""
_PEARSON_ALL = """, g AS (SELECT encoder, gene, CASE WHEN stddev_pop(y) < 1e-10 OR stddev_pop(yhat) < 1e-10 THEN 0 ELSE coalesce(corr(y, yhat), 0) END AS r, count(*) AS n FROM predictions GROUP BY ALL)"""


@query(with_views("predictions") + _PEARSON + " SELECT cohort, patient, encoder, gene, round(r, 6) + 0 AS r, CAST(n AS BIGINT) AS n FROM g")
def a9_gene_pearson(spark: SparkSession, d: str) -> DataFrame:
    # Within a patient the predictions of m1 are constant, which counts as no correlation.
    return profile.gene_pearson(V.predictions(spark, d), ["cohort", "patient", "encoder", "gene"]).withColumn("r", F.round("r", 6))


@query(with_views("predictions") + _PEARSON_ALL + ", a AS (SELECT gene, avg(r) AS r FROM g GROUP BY ALL) SELECT gene, round(r, 6) AS r FROM a")
def a10_gene_pearson_mean(spark: SparkSession, d: str) -> DataFrame:
    return profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]).groupBy("gene").agg(r6(F.avg("r"), "r"))


@query(with_views("predictions") + _PEARSON_ALL + " SELECT encoder, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r, CAST(count(*) FILTER (r > 0) AS BIGINT) AS n_positive, CAST(count(*) AS BIGINT) AS n_genes, CAST(max(n) AS BIGINT) AS n_spots, avg(r) > 0 AS passed FROM g GROUP BY ALL")
def a11_quality(spark: SparkSession, d: str) -> DataFrame:
    out = profile.pearson_summary(profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]), ["encoder"])
    return out.select("encoder", r6("mean_r"), r6("median_r"), "n_positive", "n_genes", "n_spots", "passed")


@query(with_views("predictions") + _PEARSON_ALL + " SELECT gene, round(max(r) FILTER (encoder = 'm1'), 6) AS m1, round(max(r) FILTER (encoder = 'm2'), 6) AS m2, round(max(r) FILTER (encoder = 'm3'), 6) AS m3 FROM g GROUP BY ALL")
def a12_pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]).groupBy("gene").pivot("encoder", ["m1", "m2", "m3"]).agg(F.max("r"))
    return wide.select("gene", *[r6(c) for c in ("m1", "m2", "m3")])


def binned_sql(source: str, value: str, keys: str, n: int, least: int, out: str = "binned") -> str:
    """SQL of quantile bins: edges of as many bins as fit, and the number of inner edges not above a value."""
    k = f"CASE WHEN count(*) < {n} * {least} THEN greatest(2, count(*) // {max(least, 1)}) ELSE {n} END"
    at = "(i * (n - 1.0) / k)"
    low, high = f"a[CAST(floor({at}) AS INTEGER) + 1]", f"a[least(CAST(floor({at}) AS INTEGER) + 2, n)]"
    return f"""{out}_a AS (SELECT {keys}, CAST({k} AS INTEGER) AS k, CAST(count(*) AS INTEGER) AS n, list({value} ORDER BY {value}) AS a FROM {source} GROUP BY ALL),
{out}_e AS (SELECT {keys}, list_transform(range(1, k), lambda i: {low} + ({at} - floor({at})) * ({high} - {low})) AS edges FROM {out}_a),
{out} AS (SELECT s.*, CAST(len(list_filter(edges, lambda x: s.{value} >= x)) AS INTEGER) AS bin FROM {source} s JOIN {out}_e USING ({keys}))"""


def edges_sql(source: str, value: str, keys: str, n: int, out: str = "binned") -> str:
    """The same for a fixed number of bins."""
    shares = ", ".join(f"{i}.0 / {n}" for i in range(1, n))
    return f"""{out}_e AS (SELECT {keys}, quantile_cont({value}, [{shares}]) AS edges FROM {source} GROUP BY ALL),
{out} AS (SELECT s.*, CAST(len(list_filter(edges, lambda x: s.{value} >= x)) AS INTEGER) AS bin FROM {source} s JOIN {out}_e USING ({keys}))"""


@query(with_views("scores") + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + " SELECT sample_id, spot_id, encoder, bin, round(d_raw - " + V.BIN_MEAN + ", 6) AS d_cond FROM binned")
def a13_conditional_score(spark: SparkSession, d: str) -> DataFrame:
    out = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    return out.select("sample_id", "spot_id", "encoder", "bin", r6("d_cond"))


def merged_sql(source: str, keys: str, least: int, left_always: bool = False, out: str = "merged") -> str:
    """SQL that adds ``new_bin`` to binned rows: a bin under ``least`` rows joins its smaller neighbour, again and again, down to two bins. Goes behind WITH RECURSIVE."""
    left = "true" if left_always else "size[i - 1] <= size[i + 1]"
    return f"""{out}_h AS (SELECT {keys}, bin, count(*) AS n FROM {source} GROUP BY ALL),
{out}_r AS (
  SELECT {keys}, list(bin ORDER BY bin) AS bins, list(n ORDER BY bin) AS size, range(1, count(*) + 1) AS grp FROM {out}_h GROUP BY ALL
  UNION ALL
  SELECT {keys}, bins, size[1:a - 1] || [size[a] + size[a + 1]] || size[a + 2:], list_transform(grp, lambda g: CASE WHEN g > a THEN g - 1 ELSE g END)
  FROM (SELECT *, CASE WHEN i > 1 AND (i = len(size) OR {left}) THEN i - 1 ELSE i END AS a FROM (SELECT *, list_position(list_transform(size, lambda s: s < {least}), true) AS i FROM {out}_r WHERE len(size) > 2) WHERE i > 0)),
{out}_f AS (SELECT {keys}, arg_min(bins, len(size)) AS bins, arg_min(grp, len(size)) AS grp FROM {out}_r GROUP BY ALL),
{out} AS (SELECT s.*, CAST(f.grp[list_position(f.bins, s.bin)] - 1 AS INTEGER) AS new_bin FROM {source} s JOIN {out}_f f USING ({keys}))"""


_BINNED = with_views("scores").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + ", "


@query(_BINNED + merged_sql("binned", "cohort, encoder", 120) + " SELECT cohort, encoder, new_bin AS bin, CAST(count(*) AS BIGINT) AS n, min(total) AS low, max(total) AS high FROM merged GROUP BY ALL")
def a14_merged_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of at least 120 spots, by cohort and encoder."""
    binned = scores.quantile_bins(V.spot_scores(spark, d), "total", ["cohort", "encoder"], 10, 0)
    return scores.merge_bins(binned, ["cohort", "encoder"], 120).groupBy("cohort", "encoder", "bin").agg(F.count("*").alias("n"), F.min("total").alias("low"), F.max("total").alias("high"))


@query(_BINNED + merged_sql("binned", "cohort, encoder", 120, True) + " SELECT cohort, encoder, new_bin AS bin, CAST(count(*) AS BIGINT) AS n FROM merged GROUP BY ALL")
def a15_left_merged_bins(spark: SparkSession, d: str) -> DataFrame:
    binned = scores.quantile_bins(V.spot_scores(spark, d), "total", ["cohort", "encoder"], 10, 0)
    return scores.merge_bins(binned, ["cohort", "encoder"], 120, left_always=True).groupBy("cohort", "encoder", "bin").agg(F.count("*").alias("n"))


_AVERAGED = ", averaged AS (SELECT cohort, patient, sample_id, spot_id, gene, " + stats.fixed_sql(stats.exact_mean_sql('residual')) + " AS residual, max(y) AS y FROM predictions GROUP BY ALL)"


@query(with_views("predictions") + _AVERAGED + " SELECT sample_id, gene, " + stats.fixed_sql(stats.exact_mean_sql('residual'), 6) + " AS mean_residual, " + stats.fixed_sql(stats.exact_mean_sql('abs(residual)'), 6) + " AS mar FROM averaged GROUP BY ALL")
def a16_averaged_residuals(spark: SparkSession, d: str) -> DataFrame:
    return V.averaged_residuals(spark, d).groupBy("sample_id", "gene").agg(stats.fixed(stats.exact_mean(F.col("residual")), 6).alias("mean_residual"), stats.fixed(stats.exact_mean(F.abs("residual")), 6).alias("mar"))


@query(with_views("predictions") + "SELECT patient, sample_id, encoder, gene, round(" + stats.fixed_sql(stats.exact_mean_sql('abs(residual)')) + ", 6) AS mar FROM predictions GROUP BY ALL")
def a17_section_profiles(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.agreement import profiles

    return profiles(V.predictions(spark, d), ["patient", "sample_id", "encoder"]).withColumn("mar", F.round("mar", 6))


@query(with_views("cells") + """, o AS (SELECT sample_id, gene, avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM cells GROUP BY ALL),
t AS (SELECT gene, sum(m * n) / sum(n) AS mean, sum(v * n) / sum(n) AS var FROM o GROUP BY ALL)
SELECT gene, round(mean, 6) AS mean, round(var, 6) AS var, round(sqrt(var) / (mean + 1e-6), 6) AS cv FROM t""")
def a18_gene_statistics(spark: SparkSession, d: str) -> DataFrame:
    return profile.gene_statistics(V.cells(spark, d)).select("gene", r6("mean"), r6("var"), r6("cv"))


_MEMBERS = ", members AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pathway) AS n FROM gene_sets) WHERE n >= 5)"


@query(with_views("predictions", "gene_sets") + _AVERAGED + _MEMBERS + " SELECT sample_id, spot_id, pathway, " + stats.fixed_sql(stats.exact_mean_sql('residual'), 6) + " AS score FROM averaged JOIN members USING (gene) GROUP BY ALL")
def a19_set_residuals(spark: SparkSession, d: str) -> DataFrame:
    out = scores.set_scores(V.averaged_residuals(spark, d), V.gene_sets(spark, d), ["sample_id", "spot_id"], "residual", least=5, panel=V.panel(spark, d))
    return out.withColumn("score", stats.fixed(F.col("score"), 6))


_STUDENT = (
    _AVERAGED
    + ", "
    + binned_sql("averaged", "y", "sample_id, gene", 20, 10, "sb")
    + """, s1 AS (SELECT *, CASE WHEN count(*) OVER b >= 3 AND stddev_pop(abs(residual)) OVER b > 0 THEN stddev_pop(abs(residual)) OVER b ELSE stddev_pop(abs(residual)) OVER g END AS sigma FROM sb
  WINDOW b AS (PARTITION BY sample_id, gene, bin), g AS (PARTITION BY sample_id, gene)),
s2 AS (SELECT sample_id, gene, quantile_cont(sigma, 0.01) AS low FROM (SELECT DISTINCT sample_id, gene, bin, sigma FROM s1) GROUP BY ALL),
student AS (SELECT s1.*, CASE WHEN greatest(sigma, low) > 0 THEN residual / greatest(sigma, low) ELSE 0 END AS studentised FROM s1 JOIN s2 USING (sample_id, gene))"""
)


def student_rows(spark: SparkSession, d: str) -> DataFrame:
    return scores.studentised(V.averaged_residuals(spark, d), ["sample_id", "gene"])


@query(with_views("predictions") + _STUDENT + " SELECT sample_id, spot_id, gene, round(studentised, 5) AS studentised FROM student")
def a20_studentised(spark: SparkSession, d: str) -> DataFrame:
    return student_rows(spark, d).select("sample_id", "spot_id", "gene", F.round("studentised", 5).alias("studentised"))


@query(with_views("predictions", "gene_sets") + _STUDENT + _MEMBERS + " SELECT sample_id, spot_id, pathway, round(avg(studentised), 5) AS score FROM student JOIN members USING (gene) GROUP BY ALL")
def a21_set_studentised(spark: SparkSession, d: str) -> DataFrame:
    return scores.set_scores(student_rows(spark, d), V.gene_sets(spark, d), ["sample_id", "spot_id"], "studentised", least=5, panel=V.panel(spark, d)).withColumn("score", F.round("score", 5))


@query(with_views("cells", "gene_sets") + " SELECT sample_id, spot_id, pathway AS cell_type, " + stats.fixed_sql(stats.exact_mean_sql('y'), 6) + " AS score FROM cells JOIN gene_sets USING (gene) GROUP BY ALL HAVING count(*) >= 2")
def a22_cell_type_scores(spark: SparkSession, d: str) -> DataFrame:
    sets = V.gene_sets(spark, d).withColumnRenamed("pathway", "cell_type")
    return scores.set_scores(V.cells(spark, d), sets, ["sample_id", "spot_id"], "y", name="cell_type", least=2, panel=V.panel(spark, d)).withColumn("score", stats.fixed(F.col("score"), 6))


@query(with_views("scores") + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + """, c AS (SELECT *, d_raw - """ + V.BIN_MEAN + """ AS d_cond FROM binned)
SELECT cohort, sample_id, spot_id, round(avg(d_raw), 6) AS d_raw, round(avg(d_cond), 6) AS d_cond, round(max(total), 6) AS total FROM c GROUP BY ALL""")
def q1_depth_scores(spark: SparkSession, d: str) -> DataFrame:
    """Depth-corrected scores of each spot, averaged over encoders."""
    out = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    return out.groupBy("cohort", "sample_id", "spot_id").agg(r6(F.avg("d_raw"), "d_raw"), r6(F.avg("d_cond"), "d_cond"), r6(F.max("total"), "total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad FROM (SELECT len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 AS bad FROM embeddings)")
def p4_nan_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(C.has_nan(F.col("embedding"))).alias("n_bad"))


@query("SELECT p_partkey, md5(concat_ws('|', '7', p_partkey)) AS h, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('|', '7', p_partkey))) AS INTEGER) AS place FROM part")
def w4_seeded_rows(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").withColumn("h", stats.seeded(7, "p_partkey"))
    return own.select("p_partkey", "h", F.row_number().over(W.partitionBy("p_brand").orderBy("h")).alias("place"))
