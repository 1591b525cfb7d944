"""Queries: composed runs and the tables of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import stats
from gridloom.operators import agreement as A
from gridloom.operators import expression_tests as T
from gridloom.operators import linear, profile, scores
from gridloom.operators import spatial as S
from gridloom.plans import differential as D
from gridloom.plans import spatial as P
from gridloom.plans import views as V
from gridloom.plans.registry import ORACLE_SQL, query
from gridloom.plans.scores import _MEMBERS, _STUDENT, edges_sql, merged_sql, r6, student_rows
from gridloom.plans.views import with_views
from gridloom.sources import tables

# Thresholds of the gates.
AGREEMENT, AGREEMENT_SHARE, RING_P, RING_SHARE, HALVES = 0.4, 0.5, 0.01, 0.5, 0.15


def metric(df: DataFrame, name: str, value: str, cohort: str | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("metric"), (F.col(cohort) if cohort else F.lit("all")).alias("cohort"), F.round(F.col(value).cast("double"), 6).alias("value"))


def metric_sql(parts: list[tuple[str, str, str, str]]) -> str:
    """(SQL of a table, metric, cohort expression, value expression) as one table of metrics."""
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, {cohort} AS cohort, round(CAST({value} AS DOUBLE), 6) AS value FROM ({sql})" for sql, name, cohort, value in parts)


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Gates.

_GATE1 = with_views("scores") + D._RANKED + f", s AS (SELECT cohort, sample_id, quantile_cont(rho, 0.5) > {AGREEMENT} AS passed FROM pairs GROUP BY ALL) SELECT cohort, count(*) FILTER (passed) AS n_pass, count(*) AS n_total FROM s GROUP BY ALL"
_RING_NULL = (
    with_views("points").replace("WITH ", "WITH RECURSIVE ", 1)
    + P.RINGS
    + P._KNN
    + """, pm AS (SELECT unnest(range(1000)) AS perm), zz AS (SELECT sample_id, spot_id, new_bin AS g, z - avg(z) OVER (PARTITION BY sample_id) AS z FROM ring_),
ord AS (SELECT perm, sample_id, spot_id, g, z, row_number() OVER (PARTITION BY perm, sample_id, g ORDER BY spot_id) AS p1, row_number() OVER (PARTITION BY perm, sample_id, g ORDER BY CASE WHEN perm = 0 THEN NULL ELSE md5(concat_ws('|', '1', perm, spot_id)) END, spot_id) AS p2 FROM zz CROSS JOIN pm),
sh AS (SELECT a.perm, a.sample_id, a.spot_id, b.z AS c FROM ord a JOIN ord b ON a.perm = b.perm AND a.sample_id = b.sample_id AND a.g = b.g AND a.p1 = b.p2),
lg AS (SELECT s.perm, k.sample_id, k.src, avg(s.c) AS l FROM knn k JOIN sh s ON s.sample_id = k.sample_id AND s.spot_id = k.dst GROUP BY ALL),
null_ AS (SELECT s.perm, s.sample_id, round(sum(s.c * l) / sum(s.c * s.c), 9) AS i FROM sh s JOIN lg ON lg.perm = s.perm AND lg.sample_id = s.sample_id AND lg.src = s.spot_id GROUP BY ALL),
rp AS (SELECT o.sample_id, max(o.i) AS observed, (1 + count(*) FILTER (n.i >= o.i)) / (1.0 + count(*)) AS p FROM null_ n JOIN null_ o ON o.sample_id = n.sample_id AND o.perm = 0 WHERE n.perm > 0 GROUP BY ALL)"""
)
_HALVES = D.split_sql("cohort, encoder, sample_id", "SELECT gene, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', gene))) <= (SELECT count(*) FROM panel) // 2 THEN 'A' ELSE 'B' END AS track FROM panel")
_GATE3 = with_views("predictions") + _HALVES + f", h AS (SELECT cohort, encoder, sample_id, corr(ra, rb) AS rho FROM sr GROUP BY ALL HAVING count(*) >= 10), m AS (SELECT cohort, sample_id, quantile_cont(rho, 0.5) > {HALVES} AS passed FROM h GROUP BY ALL) SELECT cohort, count(*) FILTER (passed) AS n_pass, count(*) AS n_total FROM m GROUP BY ALL"


def ring_p(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of each sample against shuffles within boundary rings."""
    own = S.rings(V.points(spark, d)).select("sample_id", "spot_id", "z", "ring")
    null = S.permuted_morans(P.edges(spark, d), own, "z", 999, 1, group="ring").withColumn("morans_i", F.round("morans_i", 9))
    return S.permutation_p(null, ["sample_id"], "morans_i")


@query(_RING_NULL + f" SELECT sample_id, round(observed, 6) AS observed, round(p, 6) AS p, p < {RING_P} AS passed FROM rp")
def q2_ring_gate(spark: SparkSession, d: str) -> DataFrame:
    return ring_p(spark, d).select("sample_id", r6("observed"), r6("p"), (F.col("p") < RING_P).alias("passed"))


@query(f"SELECT gate, cohort, CAST(n_pass AS BIGINT) AS n_pass, CAST(n_total AS BIGINT) AS n_total, round(n_pass / n_total, 6) AS fraction, n_pass / n_total >= least AS gate_pass FROM (SELECT 'agreement' AS gate, *, {AGREEMENT_SHARE} AS least FROM ({_GATE1}) UNION ALL SELECT 'structure', 'points', count(*) FILTER (p < {RING_P}), count(*), {RING_SHARE} FROM ({_RING_NULL} SELECT * FROM rp) UNION ALL SELECT 'halves', *, 0.5 FROM ({_GATE3}))")
def q2_gates(spark: SparkSession, d: str) -> DataFrame:
    """Samples that pass each of the three gates: encoders agree, structure within rings, and gene halves agree."""
    one = A.agreement_summary(D.encoder_pairs(spark, d), ["cohort", "sample_id"], AGREEMENT)
    two = ring_p(spark, d).select(F.lit("points").alias("cohort"), (F.col("p") < RING_P).alias("passed"))
    halves = A.split_half(V.predictions(spark, d), A.halves(V.panel(spark, d), 42), ["cohort", "encoder", "sample_id"])
    three = halves.groupBy("cohort", "sample_id").agg((F.percentile("rho", F.lit(0.5)) > HALVES).alias("passed"))
    parts = [T.gate(df, ["cohort"], "passed", least).withColumn("gate", F.lit(name)) for name, df, least in (("agreement", one, AGREEMENT_SHARE), ("structure", two, RING_SHARE), ("halves", three, 0.5))]
    return stacked(parts).select("gate", "cohort", "n_pass", "n_total", r6("fraction"), "gate_pass")


# Tests, unmatched and matched.

_Q3 = (
    with_views("points")
    + D._SIGNED
    + ", md AS (SELECT b.sample_id, b.gene, b.pval AS matched_pval, b.fdr AS matched_fdr, median_delta, CASE WHEN sd > 0 THEN mean_delta / sd ELSE 0 END AS effect_size, n_matched FROM bh b JOIN ev USING (sample_id, gene)), "
    + "rows_ AS (SELECT l.sample_id, l.gene, l.v, s.side FROM long l JOIN (SELECT sample_id, spot_id, 1 AS side FROM u WHERE disc UNION ALL SELECT sample_id, spot_id, 0 FROM u WHERE conc) s USING (sample_id, spot_id)), "
    + D.mwu_sql("rows_", "sample_id, gene", "v")
    + ", "
    + D.bh_sql("mwu", "sample_id", "ub")
)


def long_points(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).unpivot(["sample_id", "spot_id"], ["x", "y", "z"], "gene", "v")


@query(_Q3 + " SELECT u.sample_id, u.gene, round((u.mean_disc - u.mean_conc) / CASE WHEN u.sd > 0 THEN u.sd ELSE 1e-6 END, 6) AS cohens_d, round(u.pval, 6) AS pval, round(u.fdr, 6) AS fdr, round(matched_pval, 6) AS matched_pval, round(matched_fdr, 6) AS matched_fdr, round(median_delta, 6) AS median_delta, round(effect_size, 6) AS effect_size, CAST(n_matched AS BIGINT) AS n_matched, u.fdr < 0.05 AND matched_fdr < 0.05 AS both FROM ub u LEFT JOIN md ON md.sample_id = u.sample_id AND md.gene = u.gene")
def q3_tests(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched and matched tests of every feature of every sample side by side."""
    own = T.sides(T.tails(V.points(spark, d), "w", ["sample_id"])).select("sample_id", "spot_id", "side")
    plain = T.score_test(own.join(long_points(spark, d), ["sample_id", "spot_id"]), ["sample_id"], "gene", "v", exact=False)
    pairs = T.matched_table(D.deltas(spark, d), ["sample_id"], exact=False).withColumnsRenamed({"pval": "matched_pval", "fdr": "matched_fdr"})
    both = plain.join(pairs, ["sample_id", "gene"], "left")
    return both.select("sample_id", "gene", *[r6(c) for c in ("cohens_d", "pval", "fdr", "matched_pval", "matched_fdr", "median_delta", "effect_size")], "n_matched", ((F.col("fdr") < 0.05) & (F.col("matched_fdr") < 0.05)).alias("both"))


@query(with_views("scores") + D._DE + " SELECT patient, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_found FROM de GROUP BY ALL")
def q3_tests_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.de(spark, d).groupBy("patient").agg(F.count("*").alias("n"), F.count_if(F.col("fdr") < 0.05).alias("n_found"))


_BY_ENCODER = (
    ", "
    + edges_sql("scores", "total", "cohort, encoder", 10)
    + """, c AS (SELECT patient, encoder, spot_id, d_raw - """ + V.BIN_MEAN + """ AS d_cond FROM binned),
q AS (SELECT patient, encoder, quantile_cont(d_cond, [0.25, 0.75]) AS q FROM c GROUP BY ALL),
sd AS (SELECT c.patient, c.encoder, spot_id, 1 AS side FROM c JOIN q USING (patient, encoder) WHERE d_cond >= q[2] UNION ALL SELECT c.patient, c.encoder, spot_id, 0 FROM c JOIN q USING (patient, encoder) WHERE d_cond <= q[1]),
rows_ AS (SELECT s.patient, s.encoder, s.side, c.gene, c.y FROM sd s JOIN cells c USING (spot_id)), """
    + D.mwu_sql("rows_", "patient, encoder, gene", "y")
    + ", top AS (SELECT patient, encoder, gene FROM (SELECT *, row_number() OVER (PARTITION BY patient, encoder ORDER BY round(pval, 9), gene) AS n FROM mwu WHERE greatest(frac_disc, frac_conc) >= 0.1) WHERE n <= 10)"
)


@query(with_views("scores") + _BY_ENCODER + ", n AS (SELECT patient, encoder, count(*) AS n FROM top GROUP BY ALL), b AS (SELECT x.patient, x.encoder AS a, y.encoder AS b, count(*) AS n_both FROM top x JOIN top y ON x.patient = y.patient AND x.gene = y.gene AND x.encoder < y.encoder GROUP BY ALL) SELECT x.patient, x.encoder AS a, y.encoder AS b, CAST(coalesce(n_both, 0) AS BIGINT) AS n_both, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard FROM n x JOIN n y ON x.patient = y.patient AND x.encoder < y.encoder LEFT JOIN b ON b.patient = x.patient AND b.a = x.encoder AND b.b = y.encoder")
def q3_encoder_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the ten first features of a sample agree between encoders."""
    own = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    rows = T.sides(T.tails(own, "d_cond", ["patient", "encoder"])).select("patient", "encoder", "spot_id", "side")
    tests = T.de_table(rows.join(V.cells(spark, d).select("spot_id", "gene", "y"), "spot_id"), ["patient", "encoder"], exact=False).withColumn("pval", F.round("pval", 9))
    out = T.set_jaccard(T.top_features(tests, ["patient", "encoder"], 10), "encoder", "gene", ["patient"])
    return out.select("patient", "a", "b", "n_both", r6("jaccard"))


# Gene sets and cell types.

_Q4 = (
    with_views("scores", "gene_sets")
    + D._COND
    + _STUDENT
    + _MEMBERS
    + ", set_scores AS (SELECT spot_id, pathway, round(avg(studentised), 5) AS score FROM student JOIN members USING (gene) GROUP BY ALL), rows_ AS (SELECT s.patient, s.side, c.pathway, c.score FROM sides s JOIN set_scores c USING (spot_id)), "
    + D.mwu_sql("rows_", "patient, pathway", "score")
    + ", "
    + D.bh_sql("mwu", "patient")
    + ", sets_de AS (SELECT *, mean_disc - mean_conc AS delta, (mean_disc - mean_conc) / CASE WHEN sd > 0 THEN sd ELSE 1e-6 END AS cohens_d FROM bh)"
)


def student_sets(spark: SparkSession, d: str) -> DataFrame:
    own = scores.set_scores(student_rows(spark, d), V.gene_sets(spark, d), ["spot_id"], "studentised", least=5).withColumn("score", F.round("score", 5))
    return T.score_test(D.sided(spark, d).join(own, "spot_id"), ["patient"], "pathway", "score", exact=False)


@query(_Q4 + " SELECT pathway, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_sig_fdr05, round(greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0)) / count(*), 6) AS direction_consistency, round(quantile_cont(delta, 0.5), 5) AS median_delta, round(avg(cohens_d), 5) AS mean_cohens_d FROM sets_de GROUP BY ALL")
def q4_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Tests of studentised set scores in every sample, and their consistency."""
    out = T.set_consistency(student_sets(spark, d), ["pathway"])
    return out.select("pathway", "n_samples", "n_sig_fdr05", r6("direction_consistency"), F.round("median_delta", 5).alias("median_delta"), F.round("mean_cohens_d", 5).alias("mean_cohens_d"))


@query(with_views("scores", "gene_sets") + D._TYPES + ", g AS (SELECT pathway AS cell_type, count(*) AS n_genes FROM gene_sets GROUP BY ALL) SELECT cell_type, CAST(n_genes AS BIGINT) AS n_genes, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_sig, round(avg(cohens_d), 6) AS mean_cohens_d, round(greatest(count(*) FILTER (cohens_d > 0), count(*) - count(*) FILTER (cohens_d > 0)) / count(*), 6) AS direction_consistency FROM types_de JOIN g USING (cell_type) GROUP BY ALL")
def q5_cell_types(spark: SparkSession, d: str) -> DataFrame:
    """Signatures with their genes in the panel, and their tests over samples."""
    sets = V.gene_sets(spark, d).withColumnRenamed("pathway", "cell_type")
    have = profile.signature_report(sets, V.panel(spark, d)).where("usable").select("cell_type", F.col("n_available").alias("n_genes"))
    out = T.type_summary(D.type_de(spark, d), ["cell_type"]).join(have, "cell_type")
    return out.select("cell_type", "n_genes", "n_samples", "n_sig", r6("mean_cohens_d"), r6("direction_consistency"))


@query(P._NUCLEI + ", m AS (SELECT s.sample_id, s.spot_id, CAST(count(nucleus_id) AS DOUBLE) AS nuclear_count, avg(CASE WHEN area > 0 THEN area END) AS mean_area FROM sp s LEFT JOIN pr ON pr.sample_id = s.sample_id AND pr.spot_id = s.spot_id GROUP BY ALL), q AS (SELECT sample_id, quantile_cont(w, [0.25, 0.75]) AS q FROM points WHERE spot_id % 2 = 0 GROUP BY ALL), sd AS (SELECT sample_id, spot_id, 1 AS side FROM points JOIN q USING (sample_id) WHERE spot_id % 2 = 0 AND w >= q[2] UNION ALL SELECT sample_id, spot_id, 0 FROM points JOIN q USING (sample_id) WHERE spot_id % 2 = 0 AND w <= q[1]), rows_ AS (SELECT sample_id, side, 'nuclear_count' AS feature, nuclear_count AS v FROM sd JOIN m USING (sample_id, spot_id) UNION ALL SELECT sample_id, side, 'mean_area', round(mean_area, 9) FROM sd JOIN m USING (sample_id, spot_id) WHERE mean_area IS NOT NULL), " + D.mwu_sql("rows_", "sample_id, feature", "v") + " SELECT sample_id, feature, round(mean_disc - mean_conc, 6) AS delta, round(pval, 6) AS pval, CAST(n_disc AS BIGINT) AS n_disc, CAST(n_conc AS BIGINT) AS n_conc FROM mwu WHERE n_disc >= 10 AND n_conc >= 10")
def q5_morphometry_tests(spark: SparkSession, d: str) -> DataFrame:
    """Nuclear counts and areas of the tails, for features with ten spots on each side."""
    spots, own = P.nuclei(spark, d)
    m = S.morphometry(spots, own, 0.05, ["1"], ["sample_id"]).select("sample_id", "spot_id", F.col("nuclear_count").cast("double").alias("nuclear_count"), F.round("mean_area", 9).alias("mean_area"))
    sides = T.sides(T.tails(V.points(spark, d).where("spot_id % 2 = 0"), "w", ["sample_id"])).select("sample_id", "spot_id", "side")
    rows = sides.join(m, ["sample_id", "spot_id"]).unpivot(["sample_id", "spot_id", "side"], ["nuclear_count", "mean_area"], "feature", "v").where("v is not null")
    out = T.score_test(rows, ["sample_id"], "feature", "v", exact=False, fdr=False, least=10)
    return out.select("sample_id", "feature", r6("delta"), r6("pval"), "n_disc", "n_conc")


# Predictability of genes.

_FEATURES = (
    with_views("predictions", "points", "gene_sets")
    + P._KNN
    + """, g AS (SELECT gene, avg(r) AS mean_pearson FROM (SELECT encoder, gene, CASE WHEN stddev_pop(y) < 1e-10 OR stddev_pop(yhat) < 1e-10 THEN 0 ELSE coalesce(corr(y, yhat), 0) END AS r FROM predictions GROUP BY ALL) GROUP BY ALL),
e AS (SELECT gene, sum(m * n) / sum(n) AS mean_expression, sqrt(sum(v * n) / sum(n)) / (sum(m * n) / sum(n) + 1e-6) AS cv FROM (SELECT sample_id, gene, avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
ex AS (SELECT p.sample_id, p.spot_id, c.gene, c.y - avg(c.y) OVER (PARTITION BY p.sample_id, c.gene) AS z FROM cells c JOIN points p ON p.spot_id = c.spot_id),
lg AS (SELECT k.sample_id, k.src, x.gene, avg(x.z) AS l FROM knn k JOIN ex x ON x.sample_id = k.sample_id AND x.spot_id = k.dst GROUP BY ALL),
mi AS (SELECT gene, avg(i) AS moran FROM (SELECT x.sample_id, x.gene, CASE WHEN sum(z * z) > 0 THEN count(*) / count(l) * sum(z * coalesce(l, 0)) / sum(z * z) ELSE 0 END AS i FROM ex x LEFT JOIN lg ON lg.sample_id = x.sample_id AND lg.src = x.spot_id AND lg.gene = x.gene GROUP BY ALL) GROUP BY ALL),
ps AS (SELECT p.gene, count(s.pathway) AS pathway_count FROM panel p LEFT JOIN gene_sets s USING (gene) GROUP BY ALL)"""
)


def gene_features(spark: SparkSession, d: str) -> DataFrame:
    dense = V.written_cells(spark, d)  # read three times
    r = profile.gene_pearson(V.predictions(spark, d, dense=dense), ["encoder", "gene"]).groupBy("gene").agg(F.avg("r").alias("mean_pearson"))
    e = profile.gene_statistics(dense).select("gene", F.col("mean").alias("mean_expression"), "cv")
    own = dense.select("spot_id", "gene", "y").join(V.points(spark, d).select("sample_id", "spot_id"), "spot_id")
    moran = S.morans_i(P.edges(spark, d), own, "y", ["gene"]).groupBy("gene").agg(F.avg("morans_i").alias("moran"))
    terms = V.read_table(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.array_sort(F.collect_set("p_type")).alias("terms"))
    kinds = terms.select("gene", C.location_class(F.col("terms")).alias("location"), C.term_class(F.col("terms")).alias("function"), C.name_class(F.col("gene")).alias("by_name"))
    return r.join(e, "gene").join(moran, "gene").join(profile.membership(V.panel(spark, d), V.gene_sets(spark, d)), "gene").join(kinds, "gene")


@query(_FEATURES + " SELECT gene, round(mean_pearson, 6) AS mean_pearson, round(mean_expression, 6) AS mean_expression, round(cv, 6) AS cv, round(moran, 6) AS moran, CAST(pathway_count AS BIGINT) AS pathway_count, 'Other' AS location, 'Other' AS function, 'Other' AS by_name FROM g JOIN e USING (gene) JOIN mi USING (gene) JOIN ps USING (gene)")
def r9_gene_features(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of a gene: how well it is predicted, level, variation, structure, sets and classes."""
    return gene_features(spark, d).select("gene", *[r6(c) for c in ("mean_pearson", "mean_expression", "cv", "moran")], "pathway_count", "location", "function", "by_name")


def predictors(features: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Genes with their features standardised over the panel, written, as fits and folds read them; a feature without spread is 0."""
    w = W.partitionBy()  # a row for each gene of the panel
    z = lambda x: F.coalesce(F.when(F.stddev_pop(x).over(w) > 0, (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)), F.lit(0.0))
    return tables.written(features.select("gene", y, *[z(x).alias(x) for x in xs]))


@query()
def q6_predictability(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of genes' predictability on their standardised features, and the error on held-out genes."""
    xs = ["mean_expression", "cv", "moran", "pathway_count"]
    own = predictors(gene_features(spark, d), "mean_pearson", xs)
    fit = linear.ols(own, "mean_pearson", xs)
    held = linear.ols_folds(linear.fold_numbers(own, "gene", 5, 3), "mean_pearson", xs, "fold", ["gene"])
    error = held.agg(stats.corr("actual", "predicted").alias("r"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    return spark.createDataFrame(fit).crossJoin(F.broadcast(error)).select("feature", "coefficient", "std_error", "t_statistic", "p_value", "r2", F.col("r").alias("held_out_r"), "mae")  # one row of errors


# Reproducibility.

_Q7 = metric_sql(
    [
        (with_views("predictions") + P._PROFILE + P._WITHIN + " SELECT * FROM mwu", "within mean", "'all'", "mean_disc"),
        (with_views("predictions") + P._PROFILE + P._WITHIN + " SELECT * FROM mwu", "between mean", "'all'", "mean_conc"),
        (with_views("predictions") + P._PROFILE + P._WITHIN + " SELECT * FROM mwu", "within against between p", "'all'", "pval"),
        (with_views("predictions") + P._Z + " SELECT avg(CASE WHEN s.patient = t.patient THEN 1.0 ELSE 0.0 END) AS v FROM nn n JOIN sample_dim s ON s.sample_id = n.sample_id JOIN sample_dim t ON t.sample_id = neighbour", "nearest section accuracy", "'all'", "v"),
        (with_views("points") + P._GRID + ", bo AS (SELECT a.mean AS va, b.mean AS vb FROM gr a JOIN gr b ON a.cx = b.cx AND a.cy = b.cy WHERE a.sample_id = 's0' AND b.sample_id = 's1'), rk AS (SELECT rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0 AS ra, rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0 AS rb FROM bo) SELECT CASE WHEN count(*) >= 10 THEN corr(ra, rb) ELSE 0 END AS rho FROM rk", "grid rho", "'points'", "rho"),
        (with_views("points") + P._GRID + ", q AS (SELECT sample_id, quantile_cont(mean, 0.75) AS q FROM gr GROUP BY ALL), tp AS (SELECT gr.sample_id, cx, cy FROM gr JOIN q USING (sample_id) WHERE mean >= q) SELECT 2.0 * (SELECT count(*) FROM tp x JOIN tp y USING (cx, cy) WHERE x.sample_id = 's0' AND y.sample_id = 's1') / (SELECT count(*) FROM tp) AS dice", "grid dice", "'points'", "dice"),
    ]
)


@query(_Q7)
def q7_reproducibility(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of sections within and between patients, identification by nearest section, and agreement of grids."""
    # Each is a few rows that several metrics read: written, so that cells are worked out once and read once.
    profile, grid = P.section_profiles(spark, d), tables.written(P.grid(spark, d))
    w = tables.written(A.grouped_comparison(tables.written(P._within(spark, d, profile)), "r", "within"))
    near = P.nearest(spark, d, profile).agg(F.avg((F.col("true_label") == F.col("pred_label")).cast("double")).alias("v"))
    parts = [metric(w, n, c) for n, c in (("within mean", "mean_1"), ("between mean", "mean_0"), ("within against between p", "pval"))]
    return stacked([*parts, metric(near, "nearest section accuracy", "v"), metric(S.grid_rho(grid).withColumn("c", F.lit("points")), "grid rho", "rho", "c"), metric(S.grid_dice(grid).withColumn("c", F.lit("points")), "grid dice", "dice", "c")])


# Encoders and cohorts.


@query(metric_sql([(ORACLE_SQL["a62_encoder_agreement"], "encoder spearman", "a || ' ' || b", "spearman"), (ORACLE_SQL["a62_visible_genes"], "visible genes", "'all'", "v"), (ORACLE_SQL["a63_cohort_agreement"], "cohort pearson", "'all'", "pearson"), (ORACLE_SQL["a63_cohort_agreement"], "cohort spearman", "'all'", "spearman"), (ORACLE_SQL["a37_cohort_overlap"], "replicated genes", "'all'", "n_same")]).replace(f"FROM ({ORACLE_SQL['a62_visible_genes']})", f"FROM (SELECT count(*) FILTER (visible) AS v FROM ({ORACLE_SQL['a62_visible_genes']}))"))
def q8_encoders_and_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of encoders and of cohorts, genes that all encoders see, and genes that replicate."""
    pairs = D.a62_encoder_agreement(spark, d).withColumn("c", F.concat_ws(" ", "a", "b"))
    seen = D.a62_visible_genes(spark, d).agg(F.count_if("visible").alias("v"))
    cohorts = D.a63_cohort_agreement(spark, d)
    return stacked([metric(pairs, "encoder spearman", "spearman", "c"), metric(seen, "visible genes", "v"), metric(cohorts, "cohort pearson", "pearson"), metric(cohorts, "cohort spearman", "spearman"), metric(D.a37_cohort_overlap(spark, d), "replicated genes", "n_same")])


# Generalisation: leave one section out.

_LOSO = with_views("predictions", unit="sample_id")


@query(_LOSO + ", g AS (SELECT cohort, encoder, gene, CASE WHEN stddev_pop(y) < 1e-10 OR stddev_pop(yhat) < 1e-10 THEN 0 ELSE coalesce(corr(y, yhat), 0) END AS r, count(*) AS n, avg(abs(residual)) AS mar FROM predictions GROUP BY ALL) SELECT cohort, encoder, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r, CAST(count(*) FILTER (r > 0) AS BIGINT) AS n_positive, CAST(count(*) AS BIGINT) AS n_genes, CAST(max(n) AS BIGINT) AS n_spots, round(avg(mar), 6) AS mean_residual FROM g GROUP BY ALL")
def q9_generalisation(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that leave a section out instead of a patient, summed up by cohort and encoder."""
    own = V.predictions(spark, d, unit="sample_id")
    keys = ["cohort", "encoder", "gene"]
    mar = own.groupBy(*keys).agg(F.avg(F.abs("residual")).alias("mar")).groupBy("cohort", "encoder").agg(r6(F.avg("mar"), "mean_residual"))
    out = profile.pearson_summary(profile.gene_pearson(own, keys), ["cohort", "encoder"]).join(mar, ["cohort", "encoder"])
    return out.select("cohort", "encoder", r6("mean_r"), r6("median_r"), "n_positive", "n_genes", "n_spots", "mean_residual")


# Interior spots only.

_INSIDE = "SELECT spot_id FROM (" + ORACLE_SQL["a70_interior"] + ") WHERE interior"
_INNER_DE = (with_views("scores") + D._DE).replace("cond AS (\n", "cond_all AS (\n").replace(",\ntq AS", f", cond AS (SELECT * FROM cond_all WHERE spot_id IN ({_INSIDE})),\ntq AS")


def inner_de(spark: SparkSession, d: str) -> DataFrame:
    """The tests on interior spots alone."""
    inside = S.interior(P.edges(spark, d), V.points(spark, d)).where("interior").select("spot_id")
    rows = T.sides(T.tails(D.cond(spark, d).join(inside, "spot_id", "left_semi"), "d_cond", ["patient"])).select("patient", "spot_id", "side")
    return T.de_table(rows.join(V.cells(spark, d).select("spot_id", "gene", "y"), "spot_id"), ["patient"], exact=False)


def inner_and_full(spark: SparkSession, d: str) -> DataFrame:
    names = lambda df, x: df.select("patient", "gene", F.col("cohens_d").alias(f"{x}_d"), (F.col("fdr") < 0.05).alias(x))
    return names(D.de(spark, d), "full").join(names(inner_de(spark, d), "inner_"), ["patient", "gene"])


_BOTH = f"SELECT f.patient, f.gene, f.cohens_d AS full_d, f.fdr < 0.05 AS full_, i.cohens_d AS inner_d, i.fdr < 0.05 AS inner_ FROM ({with_views('scores') + D._DE} SELECT * FROM de) f JOIN ({_INNER_DE} SELECT * FROM de) i ON i.patient = f.patient AND i.gene = f.gene"


@query(f"SELECT patient, gene, round(full_d, 6) AS full_d, full_ AS full, round(inner_d, 6) AS inner__d, inner_ FROM ({_BOTH})".replace("full_ AS full", 'full_ AS "full"'))
def j9_renamed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two result tables side by side, on sample and feature."""
    return inner_and_full(spark, d).select("patient", "gene", r6("full_d"), "full", r6("inner__d"), "inner_")


@query(f"WITH b AS ({_BOTH}), k AS (SELECT *, rank() OVER (PARTITION BY patient ORDER BY round(full_d, 9)) + (count(*) OVER (PARTITION BY patient, round(full_d, 9)) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY patient ORDER BY round(inner_d, 9)) + (count(*) OVER (PARTITION BY patient, round(inner_d, 9)) - 1) / 2.0 AS ri FROM b) SELECT patient, round(corr(full_d, inner_d), 6) AS pearson, round(corr(rf, ri), 6) AS spearman, CAST(count(*) FILTER (full_ AND inner_) AS BIGINT) AS n_both, CAST(count(*) FILTER (full_ AND NOT inner_) AS BIGINT) AS n_full_only, CAST(count(*) FILTER (NOT full_ AND inner_) AS BIGINT) AS n_inner_only FROM k GROUP BY ALL")
def a71_interior_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Tests on interior spots against tests on all: correlations of effects, and features found by both or one."""
    both = inner_and_full(spark, d).withColumn("__f", F.round("full_d", 9)).withColumn("__i", F.round("inner__d", 9))
    both = both.withColumn("rf", stats.mid_rank("__f", ["patient"])).withColumn("ri", stats.mid_rank("__i", ["patient"]))
    f, i = F.col("full"), F.col("inner_")
    out = both.groupBy("patient").agg(stats.corr("full_d", "inner__d").alias("p"), stats.corr("rf", "ri").alias("s"), F.count_if(f & i).alias("n_both"), F.count_if(f & ~i).alias("n_full_only"), F.count_if(~f & i).alias("n_inner_only"))
    return out.select("patient", r6("p", "pearson"), r6("s", "spearman"), "n_both", "n_full_only", "n_inner_only")


@query(f"WITH i AS ({_INNER_DE} SELECT * FROM de) SELECT CASE WHEN patient IN (SELECT r_name FROM region WHERE r_regionkey < 3) THEN 'discovery' ELSE 'validation' END AS cohort, gene, CAST(count(*) AS BIGINT) AS n_samples_tested, CAST(count(*) FILTER (fdr < 0.05 AND abs(log2fc) > 0.25) AS BIGINT) AS n_samples_sig, round(quantile_cont(log2fc, 0.5), 6) AS median_log2fc, round(avg(cohens_d), 6) AS mean_cohens_d FROM i GROUP BY ALL")
def q10_interior_only(spark: SparkSession, d: str) -> DataFrame:
    """The table over samples from interior spots alone."""
    cohorts = V.sample_dim(spark, d).select("cohort", "patient").distinct()
    out = T.meta(inner_de(spark, d).join(cohorts, "patient"), ["cohort", "gene"])
    return out.select("cohort", "gene", "n_samples_tested", "n_samples_sig", r6("median_log2fc"), r6("mean_cohens_d"))


# Tables of all results.

_A72 = metric_sql(
    [
        (with_views("scores") + "SELECT cohort, count(DISTINCT spot_id) AS v FROM scores GROUP BY ALL", "spots", "cohort", "v"),
        (with_views("scores") + "SELECT cohort, avg(d_raw) AS v FROM scores GROUP BY ALL", "mean d_raw", "cohort", "v"),
        (with_views("scores") + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + " SELECT cohort, count(DISTINCT bin) AS v FROM binned GROUP BY ALL", "bins", "cohort", "v"),
        (with_views("scores") + D._RANKED + " SELECT cohort, quantile_cont(rho, 0.5) AS v FROM pairs GROUP BY ALL", "median agreement", "cohort", "v"),
        (_GATE3, "samples whose halves agree", "cohort", "n_pass"),
        (with_views("scores") + D._META + " SELECT cohort, count(*) FILTER (n_samples_sig > 0) AS v FROM meta GROUP BY ALL", "genes found", "cohort", "v"),
        (with_views("scores", "gene_sets") + D._SCORES + " SELECT count(DISTINCT pathway) FILTER (fdr < 0.05) AS v FROM sets_de", "sets found", "'all'", "v"),
        (with_views("scores", "gene_sets") + D._TYPES + " SELECT count(DISTINCT cell_type) FILTER (fdr < 0.05) AS v FROM types_de", "cell types found", "'all'", "v"),
        (_RING_NULL + f" SELECT count(*) FILTER (p < {RING_P}) AS v FROM rp", "samples with structure", "'points'", "v"),
        (ORACLE_SQL["a63_cohort_agreement"], "cohort agreement", "'all'", "spearman"),
    ]
)


@query(_A72)
def a72_summary(spark: SparkSession, d: str) -> DataFrame:
    """One table of the main figures of all phases."""
    # Cells are worked out once; scores and sides are written, as several figures read them.
    dense = V.written_cells(spark, d)
    seen = V.predicted(spark, d, dense=dense)
    own = V.spot_scores(spark, d, seen)
    sides = tables.written(D.sided(spark, d, own=own))
    by = lambda df, c: df.groupBy("cohort").agg(c.alias("v"))
    halves = A.halves_agree(V.half_scores(spark, d, A.halves(V.panel(spark, d), 42), seen), ["cohort", "encoder", "sample_id"])
    agree = by(halves.groupBy("cohort", "sample_id").agg((F.percentile("rho", F.lit(0.5)) > HALVES).alias("passed")), F.count_if("passed"))
    found = lambda df, c: df.agg(F.countDistinct(F.when(F.col("fdr") < 0.05, F.col(c))).alias("v"))
    rings = ring_p(spark, d).agg(F.count_if(F.col("p") < RING_P).alias("v")).withColumn("c", F.lit("points"))
    return stacked(
        [
            metric(by(own, F.countDistinct("spot_id")), "spots", "v", "cohort"),
            metric(by(own, F.avg("d_raw")), "mean d_raw", "v", "cohort"),
            metric(by(scores.quantile_bins(own, "total", ["cohort", "encoder"], 10, 0), F.countDistinct("bin")), "bins", "v", "cohort"),
            metric(by(D.encoder_pairs(spark, d, own), F.percentile("rho", F.lit(0.5))), "median agreement", "v", "cohort"),
            metric(agree, "samples whose halves agree", "v", "cohort"),
            metric(by(D.metas(spark, d, sides.join(dense.select("spot_id", "gene", "y"), "spot_id")), F.count_if(F.col("n_samples_sig") > 0)), "genes found", "v", "cohort"),
            metric(found(D.set_de(spark, d, seen, sides), "pathway"), "sets found", "v"),
            metric(found(D.type_de(spark, d, dense, sides), "cell_type"), "cell types found", "v"),
            metric(rings, "samples with structure", "v", "c"),
            metric(D.cohort_agreement(spark, d, seen), "cohort agreement", "spearman"),
        ]
    )


@query(with_views("scores") + ", s AS (SELECT cohort, patient, sample_id, count(DISTINCT spot_id) AS n_spots, avg(d_raw) AS d, avg(total) AS depth FROM scores GROUP BY ALL) SELECT cohort, patient, sample_id, CAST(n_spots AS BIGINT) AS n_spots, format('{:.3f}', d) AS mean_score, format('{:.1f}', depth) AS mean_depth, format('{:.1f}%', 100.0 * n_spots / sum(n_spots) OVER (PARTITION BY cohort)) AS share FROM s")
def q11_sample_table(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their spots, mean score, depth and share of the cohort, as they are printed."""
    own = V.spot_scores(spark, d).groupBy("cohort", "patient", "sample_id").agg(F.countDistinct("spot_id").alias("n_spots"), F.avg("d_raw").alias("d"), F.avg("total").alias("depth"))
    total = own.groupBy("cohort").agg(F.sum("n_spots").alias("all"))
    both = own.join(total, "cohort")
    return both.select("cohort", "patient", "sample_id", "n_spots", F.format_string("%.3f", "d").alias("mean_score"), F.format_string("%.1f", "depth").alias("mean_depth"), F.format_string("%.1f%%", 100.0 * F.col("n_spots") / F.col("all")).alias("share"))


@query(with_views("scores") + D._META + ", x AS (SELECT a.gene, a.n_samples_sig / a.n_samples_tested AS ra, b.n_samples_sig / b.n_samples_tested AS rb, a.mean_cohens_d AS da, b.mean_cohens_d AS db FROM meta a JOIN meta b ON a.gene = b.gene WHERE a.cohort = 'discovery' AND b.cohort = 'validation') SELECT gene, round(ra, 6) AS repro_a, round(rb, 6) AS repro_b, round(da, 6) AS d_a, round(db, 6) AS d_b, ra > 0.5 AND rb > 0.5 AND sign(da) = sign(db) AS replicated FROM x")
def p37_replication(spark: SparkSession, d: str) -> DataFrame:
    """Genes of both cohorts and whether they replicate: found by over half of the samples of each, with one sign."""
    m = tables.written(D.metas(spark, d))
    side = lambda c, x: m.where(F.col("cohort") == c).select("gene", F.col("reproducibility").alias(f"repro_{x}"), F.col("mean_cohens_d").alias(f"d_{x}"))
    both = side("discovery", "a").join(side("validation", "b"), "gene")
    return both.select("gene", r6("repro_a"), r6("repro_b"), r6("d_a"), r6("d_b"), C.replicates(F.col("repro_a"), F.col("repro_b"), F.col("d_a"), F.col("d_b")).alias("replicated"))
