"""Queries: neighbours, spatial statistics, sections, and linear models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.functions.stats import student_p_sql
from gridloom.operators import agreement as A
from gridloom.operators import linear, profile, trees
from gridloom.operators import spatial as S
from gridloom.plans import views as V
from gridloom.plans.differential import mwu_sql
from gridloom.plans.registry import query
from gridloom.plans.scores import edges_sql, merged_sql, r6
from gridloom.plans.views import with_views

_KNN = """, knn AS (SELECT * FROM (SELECT a.sample_id, a.spot_id AS src, b.spot_id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist,
  row_number() OVER (PARTITION BY a.sample_id, a.spot_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.spot_id) AS rank
  FROM points a JOIN points b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id) WHERE rank <= 6)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return S.knn(V.points(spark, d), 6)


@query(with_views("points") + _KNN + " SELECT sample_id, src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM knn")
def j14_spatial_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("sample_id", "src", "dst", r6("dist"), "rank")


_NUCLEI = with_views("points") + ", sp AS (SELECT sample_id, spot_id, x, y FROM points WHERE spot_id % 2 = 0), nu AS (SELECT sample_id, spot_id AS nucleus_id, x, y, CAST(label AS VARCHAR) AS class_label, round(abs(vector[5]), 9) AS area FROM points WHERE spot_id % 2 = 1), pr AS (SELECT s.sample_id, s.spot_id, n.* EXCLUDE (sample_id, x, y) FROM sp s JOIN nu n ON s.sample_id = n.sample_id AND pow(s.x - n.x, 2) + pow(s.y - n.y, 2) <= 0.05 * 0.05)"


def nuclei(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even rows as spots, odd rows as nuclei: both roles come from one table."""
    p = V.points(spark, d)
    spots = p.where("spot_id % 2 = 0").select("sample_id", "spot_id", "x", "y")
    return spots, p.where("spot_id % 2 = 1").select("sample_id", F.col("spot_id").alias("nucleus_id"), "x", "y", F.col("label").cast("string").alias("class_label"), F.round(F.abs(F.col("vector")[4]), 9).alias("area"))


@query(_NUCLEI + " SELECT sample_id, spot_id, nucleus_id FROM pr")
def j17_radius_join(spark: SparkSession, d: str) -> DataFrame:
    spots, own = nuclei(spark, d)
    return S.radius_pairs(spots, own, 0.05, ["sample_id"]).select("sample_id", "spot_id", "nucleus_id")


@query(_NUCLEI + " SELECT s.sample_id, s.spot_id, CAST(count(nucleus_id) AS BIGINT) AS nuclear_count, round(avg(CASE WHEN area > 0 THEN area END), 6) AS mean_area, round(var_pop(CASE WHEN area > 0 THEN area END), 6) AS var_area, round(avg(CASE WHEN class_label IS NOT NULL THEN CAST(class_label = '1' AS DOUBLE) END), 6) AS frac_1, round(count(nucleus_id) / (3.141592653589793 * 0.05 * 0.05), 6) AS nuclear_density FROM sp s LEFT JOIN pr ON pr.sample_id = s.sample_id AND pr.spot_id = s.spot_id GROUP BY ALL")
def a23_morphometry(spark: SparkSession, d: str) -> DataFrame:
    spots, own = nuclei(spark, d)
    out = S.morphometry(spots, own, 0.05, ["1"], ["sample_id"])
    return out.select("sample_id", "spot_id", "nuclear_count", r6("mean_area"), r6("var_area"), r6("frac_1"), r6("nuclear_density"))


_MORAN = _KNN + """, long AS (SELECT sample_id, spot_id, 'z' AS gene, z AS v FROM points UNION ALL SELECT sample_id, spot_id, 'w', w FROM points),
zz AS (SELECT *, v - avg(v) OVER (PARTITION BY sample_id, gene) AS c FROM long),
lag_ AS (SELECT k.sample_id, k.src, z.gene, avg(z.c) AS l FROM knn k JOIN zz z ON z.sample_id = k.sample_id AND z.spot_id = k.dst GROUP BY ALL),
moran AS (SELECT z.sample_id, z.gene, count(*) AS n, sum(z.c * l) / sum(z.c * z.c) AS i FROM zz z JOIN lag_ l ON l.sample_id = z.sample_id AND l.src = z.spot_id AND l.gene = z.gene GROUP BY ALL)"""


@query(with_views("points") + _MORAN + " SELECT sample_id, round(i, 6) AS morans_i, CAST(n AS BIGINT) AS n FROM moran WHERE gene = 'z'")
def a44_morans_i(spark: SparkSession, d: str) -> DataFrame:
    return S.morans_i(edges(spark, d), V.points(spark, d), "z").select("sample_id", r6("morans_i"), "n")


@query(with_views("points") + _MORAN + " SELECT gene, round(avg(i), 6) AS morans_i FROM moran GROUP BY ALL")
def a45_morans_by_gene(spark: SparkSession, d: str) -> DataFrame:
    long = V.points(spark, d).unpivot(["sample_id", "spot_id"], ["z", "w"], "gene", "v")
    return S.morans_i(edges(spark, d), long, "v", ["gene"]).groupBy("gene").agg(r6(F.avg("morans_i"), "morans_i"))


_NULL = _KNN + """, pm AS (SELECT unnest(range(1000)) AS perm),
ord AS (SELECT perm, sample_id, spot_id, z, row_number() OVER (PARTITION BY perm, sample_id ORDER BY spot_id) AS p1, row_number() OVER (PARTITION BY perm, sample_id ORDER BY CASE WHEN perm = 0 THEN NULL ELSE md5(concat_ws('|', '0', perm, spot_id)) END, spot_id) AS p2 FROM points CROSS JOIN pm),
sh AS (SELECT a.perm, a.sample_id, a.spot_id, b.z - avg(b.z) OVER (PARTITION BY a.perm, a.sample_id) AS c FROM ord a JOIN ord b ON a.perm = b.perm AND a.sample_id = b.sample_id AND a.p1 = b.p2),
lg AS (SELECT s.perm, k.sample_id, k.src, avg(s.c) AS l FROM knn k JOIN sh s ON s.sample_id = k.sample_id AND s.spot_id = k.dst GROUP BY ALL),
null_ AS (SELECT s.perm, s.sample_id, round(sum(s.c * l) / sum(s.c * s.c), 9) AS i FROM sh s JOIN lg ON lg.perm = s.perm AND lg.sample_id = s.sample_id AND lg.src = s.spot_id GROUP BY ALL)"""


def null(spark: SparkSession, d: str) -> DataFrame:
    return S.permuted_morans(edges(spark, d), V.points(spark, d), "z", 999, 0).withColumn("morans_i", F.round("morans_i", 9))


@query(with_views("points") + _NULL + " SELECT o.sample_id, round(max(o.i), 6) AS observed, (1 + count(*) FILTER (n.i >= o.i)) / (1.0 + count(*)) AS p FROM null_ n JOIN null_ o ON o.sample_id = n.sample_id AND o.perm = 0 WHERE n.perm > 0 GROUP BY ALL")
def a46_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return S.permutation_p(null(spark, d), ["sample_id"], "morans_i").select("sample_id", r6("observed"), "p")


@query(with_views("points") + _NULL + " SELECT sample_id, CAST(perm AS INTEGER) AS perm, round(i, 6) AS morans_i FROM null_")
def a47_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    return null(spark, d).select("sample_id", "perm", r6("morans_i"))


#: Hull edges are the pairs of points with no point to their right; no hull, no distance.
HULL = """, hull AS (SELECT a.sample_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM points a JOIN points b ON a.sample_id = b.sample_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM points c WHERE c.sample_id = a.sample_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
tt AS (SELECT p.sample_id, p.spot_id, p.x, p.y, p.z, h.*, least(1.0, greatest(0.0, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM points p JOIN hull h ON h.sample_id = p.sample_id),
far AS (SELECT sample_id, spot_id, any_value(z) AS z, round(min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2))), 9) AS edge_dist FROM tt GROUP BY ALL)"""
RINGS = HULL + ", " + edges_sql("far", "edge_dist", "sample_id", 10, "rb") + ", " + merged_sql("rb", "sample_id", 10, True, "ring_")


@query(with_views("points").replace("WITH ", "WITH RECURSIVE ", 1) + RINGS + " SELECT sample_id, spot_id, round(edge_dist, 6) AS edge_dist, new_bin AS ring FROM ring_")
def a48_boundary_rings(spark: SparkSession, d: str) -> DataFrame:
    return S.rings(V.points(spark, d)).select("sample_id", "spot_id", r6("edge_dist"), "ring")


_GRID = """, b AS (SELECT sample_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY ALL),
nm AS (SELECT p.*, (x - lx) / CASE WHEN hx = lx THEN 1 ELSE hx - lx END AS nx, (y - ly) / CASE WHEN hy = ly THEN 1 ELSE hy - ly END AS ny FROM points p JOIN b USING (sample_id)),
gr AS (SELECT sample_id, CAST(len(list_filter(range(1, 8), lambda i: nx >= i / 8.0)) AS INTEGER) AS cx, CAST(len(list_filter(range(1, 8), lambda i: ny >= i / 8.0)) AS INTEGER) AS cy, round(avg(z), 9) AS mean, count(*) AS n FROM nm GROUP BY ALL)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    return S.gridded(V.points(spark, d), "z", 8)


@query(with_views("points") + _GRID + " SELECT sample_id, cx, cy, round(mean, 6) AS mean, CAST(n AS BIGINT) AS n FROM gr")
def a49_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select("sample_id", "cx", "cy", r6("mean"), "n")


@query(with_views("points") + _GRID + ", bo AS (SELECT a.mean AS va, b.mean AS vb FROM gr a JOIN gr b ON a.cx = b.cx AND a.cy = b.cy WHERE a.sample_id = 's0' AND b.sample_id = 's1'), rk AS (SELECT rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0 AS ra, rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0 AS rb FROM bo) SELECT 's0' AS a, 's1' AS b, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 10 THEN corr(ra, rb) ELSE 0 END, 6) AS rho FROM rk")
def a50_grid_correlation(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_rho(grid(spark, d)).select("a", "b", "n", r6("rho"))


@query(with_views("points") + _GRID + ", q AS (SELECT sample_id, quantile_cont(mean, 0.75) AS q FROM gr GROUP BY ALL), tp AS (SELECT gr.sample_id, cx, cy FROM gr JOIN q USING (sample_id) WHERE mean >= q) SELECT 's0' AS a, 's1' AS b, round(2.0 * (SELECT count(*) FROM tp x JOIN tp y USING (cx, cy) WHERE x.sample_id = 's0' AND y.sample_id = 's1') / (SELECT count(*) FROM tp), 6) AS dice")
def a51_grid_dice(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_dice(grid(spark, d)).select("a", "b", r6("dice"))


_PROFILE = ", prof AS (SELECT patient, sample_id, gene, " + stats.fixed_sql(stats.exact_mean_sql('abs(residual)')) + " AS mar FROM predictions GROUP BY ALL), pairs AS (SELECT x.sample_id AS a, y.sample_id AS b, x.patient AS pa, y.patient AS pb, corr(x.mar, y.mar) AS r FROM prof x JOIN prof y ON x.gene = y.gene AND x.sample_id < y.sample_id GROUP BY ALL)"


def section_profiles(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_residuals(spark, d, ["patient", "sample_id"])


@query(with_views("predictions") + _PROFILE + " SELECT a, b, round(r, 6) AS r FROM pairs")
def a52_section_correlation(spark: SparkSession, d: str) -> DataFrame:
    return A.profile_pairs(section_profiles(spark, d), "sample_id").select("a", "b", r6("r"))


@query(with_views("predictions") + _PROFILE + " SELECT pa AS patient, round(avg(r), 6) AS mean_r, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE pa = pb GROUP BY GROUPING SETS ((pa), ())")
def a53_patient_means(spark: SparkSession, d: str) -> DataFrame:
    return A.profile_pairs(section_profiles(spark, d), "sample_id", keys=["patient"]).rollup("patient").agg(r6(F.avg("r"), "mean_r"), F.count("*").alias("n"))


_Z = _PROFILE + ", zs AS (SELECT sample_id, gene, round((mar - avg(mar) OVER (PARTITION BY gene)) / CASE WHEN stddev_pop(mar) OVER (PARTITION BY gene) = 0 THEN 1 ELSE stddev_pop(mar) OVER (PARTITION BY gene) END, 9) AS z FROM prof), dist AS (SELECT x.sample_id AS a, y.sample_id AS b, round(1 - corr(x.z, y.z), 9) AS distance FROM zs x JOIN zs y ON x.gene = y.gene AND x.sample_id < y.sample_id GROUP BY ALL), sym AS (SELECT a, b, distance FROM dist UNION ALL SELECT b, a, distance FROM dist), nn AS (SELECT a AS sample_id, b AS neighbour FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM sym) WHERE n = 1)"


def distances(spark: SparkSession, d: str, profile: DataFrame | None = None) -> DataFrame:
    z = A.z_profiles(section_profiles(spark, d) if profile is None else profile, "sample_id")
    return A.profile_pairs(z, "sample_id", "z").select("a", "b", F.round(1 - F.col("r"), 9).alias("distance"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return V.sample_dim(spark, d).select("sample_id", F.col("patient").alias("label"))


def nearest(spark: SparkSession, d: str, profile: DataFrame | None = None) -> DataFrame:
    return A.nearest_section(distances(spark, d, profile), labels(spark, d), "sample_id")


@query(with_views("predictions") + _Z + " SELECT a, b, round(distance, 6) AS distance FROM dist")
def a54_section_distance(spark: SparkSession, d: str) -> DataFrame:
    return distances(spark, d).select("a", "b", r6("distance"))


@query(with_views("predictions") + _Z + " SELECT n.sample_id, neighbour, s.patient AS true_label, t.patient AS pred_label FROM nn n JOIN sample_dim s ON s.sample_id = n.sample_id JOIN sample_dim t ON t.sample_id = neighbour")
def a55_nearest_section(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d).select("sample_id", "neighbour", "true_label", "pred_label")


@query(with_views("predictions") + _Z + ", pm AS (SELECT unnest(range(10001)) AS perm), ord AS (SELECT perm, sample_id, patient, row_number() OVER (PARTITION BY perm ORDER BY sample_id) AS p1, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN NULL ELSE md5(concat_ws('|', '0', perm, sample_id)) END, sample_id) AS p2 FROM sample_dim CROSS JOIN pm), sh AS (SELECT a.perm, a.sample_id, b.patient AS label FROM ord a JOIN ord b ON a.perm = b.perm AND a.p1 = b.p2) SELECT CAST(x.perm AS INTEGER) AS perm, round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM nn n JOIN sh x ON x.sample_id = n.sample_id JOIN sh y ON y.perm = x.perm AND y.sample_id = neighbour GROUP BY ALL")
def a56_label_null(spark: SparkSession, d: str) -> DataFrame:
    return A.label_null(nearest(spark, d), labels(spark, d), "sample_id", 10_000).select("perm", r6("accuracy"))


@query("WITH t AS (SELECT p_type AS a, p_brand AS b, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY a)), c AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((s - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) AS ari FROM s, r, c")
def a57_adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return A.adjusted_rand(V.read_table(spark, d, "part"), "p_type", "p_brand").select(r6("ari"))


@query("SELECT p_type AS true_label, p_brand AS pred_label, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def a57_confusion(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").groupBy(F.col("p_type").alias("true_label"), F.col("p_brand").alias("pred_label")).agg(F.count("*").alias("n"))


_SECTIONS = ", sv AS (SELECT sample_id, round(avg(d_raw), 9) AS v FROM scores GROUP BY sample_id, spot_id)"


def section_values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scores = [F.col(f"d_{m}") for m in V.ENCODERS]
    have = F.array_compact(F.array(*scores))
    mean = F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have)
    own = V.wide_scores(spark, d).where(F.coalesce(*scores).isNotNull()).select("sample_id", F.round(mean, 9).alias("v"))
    s = V.sample_dim(spark, d).select("patient", "sample_id")
    pairs = s.withColumnRenamed("sample_id", "a").join(s.withColumnRenamed("sample_id", "b"), "patient").where("a < b").select("a", "b")
    return own, pairs


@query(with_views("scores") + _SECTIONS + """, pr AS (SELECT x.sample_id AS a, y.sample_id AS b FROM sample_dim x JOIN sample_dim y ON x.patient = y.patient AND x.sample_id < y.sample_id),
st AS (SELECT a, b, v, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT a, b, v, 1 AS ca, 0 AS cb FROM pr JOIN sv ON sample_id = a UNION ALL SELECT a, b, v, 0, 1 FROM pr JOIN sv ON sample_id = b) GROUP BY ALL),
gp AS (SELECT a, b, ca, cb, abs(sum(ca) OVER o / sum(ca) OVER w - sum(cb) OVER o / sum(cb) OVER w) AS gap FROM st WINDOW o AS (PARTITION BY a, b ORDER BY v), w AS (PARTITION BY a, b))
SELECT a, b, round(max(gap), 6) AS d, CAST(sum(ca) AS BIGINT) AS n_a, CAST(sum(cb) AS BIGINT) AS n_b FROM gp GROUP BY ALL""")
def a58_ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    own, pairs = section_values(spark, d)
    return A.ks_pairs(own, "sample_id", "v", pairs).select("a", "b", r6("d"), "n_a", "n_b")


_KS = with_views("scores").replace("WITH ", "WITH RECURSIVE ", 1) + _SECTIONS + """, pr AS (SELECT x.sample_id AS a, y.sample_id AS b FROM sample_dim x JOIN sample_dim y ON x.patient = y.patient AND x.sample_id < y.sample_id),
st AS (SELECT a, b, v, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT a, b, v, 1 AS ca, 0 AS cb FROM pr JOIN sv ON sample_id = a UNION ALL SELECT a, b, v, 0, 1 FROM pr JOIN sv ON sample_id = b) GROUP BY ALL),
gp AS (SELECT a, b, ca, cb, abs(sum(ca) OVER o / sum(ca) OVER w - sum(cb) OVER o / sum(cb) OVER w) AS gap FROM st WINDOW o AS (PARTITION BY a, b ORDER BY v), w AS (PARTITION BY a, b)),
ks AS (SELECT a, b, max(gap) AS d, CAST(sum(ca) AS BIGINT) AS n_a, CAST(sum(cb) AS BIGINT) AS n_b FROM gp GROUP BY ALL),
far AS (SELECT *, CAST(round(d * n_a * n_b) AS BIGINT) AS far FROM ks),
path AS (
  SELECT a, b, n_a, n_b, far, CAST(0 AS BIGINT) AS i, list_transform(range(0, n_b + 1), lambda j: CASE WHEN j * n_a < far THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM far
  UNION ALL
  SELECT a, b, n_a, n_b, far, i + 1, list_transform(range(0, n_b + 1), lambda j: CASE WHEN abs((i + 1) * n_b - j * n_a) < far THEN list_sum(list_transform(range(0, j + 1), lambda m: CASE WHEN abs((i + 1) * n_b - m * n_a) < far THEN f[m + 1] ELSE 0.0::DOUBLE END)) ELSE 0.0::DOUBLE END)
  FROM path WHERE i < n_a)
SELECT a, b, round(d, 6) AS d, n_a, n_b, round(least(1.0, greatest(0.0, 1 - f[n_b + 1] / exp(lgamma(n_a + n_b + 1) - lgamma(n_a + 1) - lgamma(n_b + 1)))), 6) AS pval FROM path JOIN ks USING (a, b, n_a, n_b) WHERE i = n_a"""


@query(_KS)
def a58_ks_p(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.functions.stats import ks_p_column

    own, pairs = section_values(spark, d)
    # Dealt anew: the exact law of a pair takes n_a * n_b steps, and a small table would else be one task.
    found = A.ks_pairs(own, "sample_id", "v", pairs).repartition(64, "a", "b")
    return found.select("a", "b", r6("d"), "n_a", "n_b", r6(ks_p_column("d", "n_a", "n_b"), "pval"))


@query(with_views("scores") + _SECTIONS + """, pr AS (SELECT x.sample_id AS a, y.sample_id AS b FROM sample_dim x JOIN sample_dim y ON x.patient = y.patient AND x.sample_id < y.sample_id),
s AS (SELECT sample_id, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM sv GROUP BY ALL),
g AS (SELECT pr.a, pr.b, i, l0 - 0.05 * (h0 - l0) + ((h0 + 0.05 * (h0 - l0)) - (l0 - 0.05 * (h0 - l0))) * i / 999 AS g FROM (SELECT a, b, least(x.lo, y.lo) AS l0, greatest(x.hi, y.hi) AS h0 FROM pr JOIN s x ON x.sample_id = a JOIN s y ON y.sample_id = b) pr CROSS JOIN (SELECT unnest(range(1000)) AS i)),
fa AS (SELECT a, b, i, g, sum(exp(-0.5 * pow((g - v) / (sd * pow(n, -0.2)), 2)) / (sd * pow(n, -0.2) * sqrt(2 * 3.141592653589793) * n)) AS f FROM g JOIN sv ON sv.sample_id = a JOIN s ON s.sample_id = a GROUP BY ALL),
fb AS (SELECT a, b, i, sum(exp(-0.5 * pow((g - v) / (sd * pow(n, -0.2)), 2)) / (sd * pow(n, -0.2) * sqrt(2 * 3.141592653589793) * n)) AS f FROM g JOIN sv ON sv.sample_id = b JOIN s ON s.sample_id = b GROUP BY ALL),
m AS (SELECT fa.a, fa.b, fa.i, g, least(fa.f, fb.f) AS m FROM fa JOIN fb USING (a, b, i))
SELECT a, b, round(sum(area), 6) AS overlap FROM (SELECT a, b, (g - lag(g) OVER w) * (m + lag(m) OVER w) / 2 AS area FROM m WINDOW w AS (PARTITION BY a, b ORDER BY i)) GROUP BY ALL""")
def a59_density_overlap(spark: SparkSession, d: str) -> DataFrame:
    own, pairs = section_values(spark, d)
    return A.kde_overlap(own, "sample_id", "v", pairs, 1000).select("a", "b", r6("overlap"))


_WITHIN = ", rows_ AS (SELECT 1 AS one, CASE WHEN pa = pb THEN 1 ELSE 0 END AS side, round(r, 9) AS v FROM pairs), " + mwu_sql("rows_", "one", "v") + ", sds AS (SELECT stddev_pop(v) FILTER (side = 1) AS sd_1, stddev_pop(v) FILTER (side = 0) AS sd_0 FROM rows_)"


def _within(spark: SparkSession, d: str, profile: DataFrame | None = None) -> DataFrame:
    dim = V.sample_dim(spark, d).select("sample_id", "patient")
    pairs = A.profile_pairs(section_profiles(spark, d) if profile is None else profile, "sample_id").withColumn("r", F.round("r", 9))
    own = pairs.join(dim.toDF("a", "pa"), "a").join(dim.toDF("b", "pb"), "b")
    return own.withColumn("within", F.col("pa") == F.col("pb"))


@query(with_views("predictions") + _PROFILE + _WITHIN + " SELECT CAST(n_disc AS BIGINT) AS n_1, CAST(n_conc AS BIGINT) AS n_0, round(mean_disc, 6) AS mean_1, round(mean_conc, 6) AS mean_0, round(sd_1, 6) AS sd_1, round(sd_0, 6) AS sd_0, round(u, 6) AS u, round(pval, 6) AS pval, round(1 - 2 * u / (n_disc * n_conc), 6) AS rank_biserial FROM mwu, sds")
def a60_within_between(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped_comparison(_within(spark, d), "r", "within").select("n_1", "n_0", *[r6(c) for c in ("mean_1", "mean_0", "sd_1", "sd_0", "u", "pval", "rank_biserial")])


@query(with_views("predictions", "gene_sets") + ", m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pathway) AS n FROM gene_sets) WHERE n >= 3), pw AS (SELECT sample_id, pathway, round(avg(residual), 9) AS score FROM predictions JOIN m USING (gene) GROUP BY ALL) SELECT x.sample_id AS a, y.sample_id AS b, round(corr(x.score, y.score), 5) AS r, CAST(count(*) AS BIGINT) AS n FROM pw x JOIN pw y ON x.pathway = y.pathway AND x.sample_id < y.sample_id GROUP BY ALL")
def a61_set_profiles(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.scores import set_scores

    own = set_scores(V.predictions(spark, d), V.gene_sets(spark, d), ["sample_id"], "residual", panel=V.panel(spark, d)).withColumn("score", F.round("score", 9))
    # Where all sets hold the same genes, a section has no spread: NaN, as SQL has it.
    return A.profile_pairs(own, "sample_id", "score", "pathway", without=float("nan")).select("a", "b", F.round("r", 5).alias("r"), "n")


@query(with_views("points") + _KNN + ", lo AS (SELECT k.sample_id, k.src, round(min(list_cosine_similarity(a.vector, b.vector)), 9) AS c FROM knn k JOIN points a ON a.sample_id = k.sample_id AND a.spot_id = k.src JOIN points b ON b.sample_id = k.sample_id AND b.spot_id = k.dst GROUP BY ALL), m AS (SELECT sample_id, quantile_cont(c, 0.5) AS m FROM lo GROUP BY ALL) SELECT lo.sample_id, src AS spot_id, round(c, 6) AS min_cosine, c > m AS interior FROM lo JOIN m USING (sample_id)")
def a70_interior(spark: SparkSession, d: str) -> DataFrame:
    return S.interior(edges(spark, d), V.points(spark, d)).select("sample_id", "spot_id", r6("min_cosine"), "interior")


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY ALL), x AS (SELECT o_orderpriority, q, o_totalprice AS v, o_totalprice BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside FROM orders JOIN q USING (o_orderpriority)) SELECT o_orderpriority, round(max(q[1]), 6) AS q25, round(max(q[2]), 6) AS median, round(max(q[3]), 6) AS q75, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS n_outliers FROM x GROUP BY o_orderpriority")
def a73_box_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = profile.box_statistics(V.read_table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", r6("q25"), r6("median"), r6("q75"), "whisker_low", "whisker_high", "n_outliers")


@query(with_views("points") + ", s AS (SELECT x AS v FROM points UNION ALL SELECT y FROM points) SELECT round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM s")
def a74_value_limits(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_limits(V.points(spark, d), ["x", "y"]).select(r6("low"), r6("high"))


@query(with_views("points") + ", f AS (SELECT CAST(label % 5 AS VARCHAR) AS u, x, z AS y FROM points), s AS (SELECT u, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM f GROUP BY ALL), t AS (SELECT a.u, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM s a JOIN s b ON a.u <> b.u GROUP BY ALL), m AS (SELECT u, sx / n AS mx, sqrt(sxx / n - pow(sx / n, 2)) AS sd, (sxy - sx * sy / n) / sqrt(sxx / n - pow(sx / n, 2)) / (n + 2.0) AS beta FROM t) SELECT spot_id, round((p.x - mx) / sd * beta, 6) AS yhat, round(p.z - (p.x - mx) / sd * beta, 6) AS residual FROM points p JOIN m ON m.u = CAST(p.label % 5 AS VARCHAR)")
def r6_leave_one_out_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with one predictor and alpha 2, scaled by population deviations, without an intercept."""
    own = V.points(spark, d).withColumn("fold", (F.col("label") % 5).cast("string")).withColumn("px", F.array("x")).withColumn("py", F.array("z"))
    out = linear.leave_out(own, "px", "py", "fold", ["spot_id"], alpha=2.0)
    return out.select("spot_id", r6(F.col("yhat")[0], "yhat"), r6(F.col("residual")[0], "residual"))


def spot_models(spark: SparkSession, d: str) -> DataFrame:
    """Spots with their whole vector (``px``), all genes of the panel (``py``) and labels modulo five as patients (``fold``)."""
    own = V.points(spark, d).select("spot_id", (F.col("label") % 5).cast("string").alias("fold"), F.col("vector").alias("px"))
    genes = V.cells(spark, d, own.select("spot_id")).groupBy("spot_id").agg(F.array_sort(F.collect_list(F.struct("gene", "y"))).alias("g"))
    return own.join(genes, "spot_id").select("spot_id", "fold", "px", F.transform("g", lambda x: x["y"]).alias("py"))


@query()
def r3_multi_output_ridge(spark: SparkSession, d: str) -> DataFrame:
    """All genes on the first 32 principal components of the whole vector, a patient left out at a time."""
    out = linear.leave_out(spot_models(spark, d), "px", "py", "fold", ["spot_id"], components=32)
    return out.select("spot_id", "fold", "yhat", "residual")


@query()
def r4_ridge_grid(spark: SparkSession, d: str) -> DataFrame:
    """The error of twenty alphas over five folds, all components and genes, with an intercept."""
    errors = linear.ridge_grid(spot_models(spark, d), "px", "py", "fold", intercept=True)
    return spark.createDataFrame([(float(a), float(e)) for a, e in errors.items()], "alpha double, mse double")


@query("SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(corr(p_retailprice, p_size), 6) AS r, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part")
def r11_line(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").agg(r6(F.regr_slope("p_retailprice", "p_size"), "slope"), r6(F.regr_intercept("p_retailprice", "p_size"), "intercept"), r6(F.corr("p_retailprice", "p_size"), "r"), r6(F.regr_r2("p_retailprice", "p_size"), "r2"))


_OLS = """WITH f AS (SELECT l_extendedprice / 1000 AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) * 100 AS b FROM lineitem),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) * count(*) AS saa, covar_pop(b, b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, covar_pop(y, y) * count(*) AS syy FROM f),
c AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM m),
v AS (SELECT *, my - ba * ma - bb * mb AS b0, (syy - ba * say - bb * sby) / (n - 3) AS s2, 1 - (syy - ba * say - bb * sby) / syy AS r2 FROM c),
t AS (
  SELECT 'intercept' AS feature, b0 AS coefficient, sqrt(s2 * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS std_error, r2, n FROM v
  UNION ALL SELECT 'quantity', ba, sqrt(s2 * sbb / det), r2, n FROM v UNION ALL SELECT 'discount', bb, sqrt(s2 * saa / det), r2, n FROM v)
"""


@query(_OLS + f"SELECT feature, round(coefficient, 6) AS coefficient, round(std_error, 6) AS std_error, round(coefficient / std_error, 4) AS t_statistic, round({student_p_sql('coefficient / std_error', 'n - 3')}, 6) AS p_value, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2, CAST(n AS BIGINT) AS n FROM t")
def r7_least_squares(spark: SparkSession, d: str) -> DataFrame:
    """Price on quantity and discount: a row for each coefficient."""
    own = V.read_table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_discount").cast("double") * 100).alias("discount"))
    out = spark.createDataFrame(linear.ols(own, "price", ["quantity", "discount"]))
    return out.select("feature", r6("coefficient"), r6("std_error"), F.round("t_statistic", 4).alias("t_statistic"), r6("p_value"), r6("r2"), r6("adj_r2"), F.col("n").cast("long").alias("n"))


@query("SELECT round(1 / (1 - pow(corr(p_retailprice, p_size), 2)), 6) AS vif FROM part")
def r8_variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    out = linear.vif(V.read_table(spark, d, "part"), ["p_retailprice", "p_size"])
    return spark.createDataFrame([(round(out["p_size"], 6),)], "vif double")


@query("WITH f AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, (row_number() OVER (ORDER BY md5(concat_ws('|', '3', p_partkey))) - 1) % 5 AS fold FROM part), m AS (SELECT a.fold, regr_slope(b.y, b.x) AS s, regr_intercept(b.y, b.x) AS i FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY ALL) SELECT p_partkey, CAST(f.fold AS INTEGER) AS fold, y AS actual, round(i + s * x, 4) AS predicted FROM f JOIN m ON m.fold = f.fold")
def r10_fold_predictions(spark: SparkSession, d: str) -> DataFrame:
    own = linear.fold_numbers(V.read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 5, 3)
    out = linear.ols_folds(own, "p_retailprice", ["p_size"], "fold", ["p_partkey"])
    return out.select("p_partkey", "fold", "actual", F.round("predicted", 4).alias("predicted"))


def section_means(spark: SparkSession, d: str) -> DataFrame:
    """Sections with the mean of every gene (``v``)."""
    own = V.cells(spark, d).groupBy("patient", "sample_id", "gene").agg(F.round(F.avg("y"), 9).alias("m"))
    wide = own.groupBy("patient", "sample_id").agg(F.array_sort(F.collect_list(F.struct("gene", "m"))).alias("g"))
    return wide.select("patient", "sample_id", F.transform("g", lambda x: x["m"]).alias("v"))


@query()
def r12_components(spark: SparkSession, d: str) -> DataFrame:
    """Five principal components of the sections' mean expression."""
    pc, shares = linear.components(section_means(spark, d), "v", ["sample_id", "patient"], 5)
    return pc.select("sample_id", "patient", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(5)], F.lit(float(sum(shares))).alias("explained"))


@query(with_views("predictions") + ", pb AS (SELECT patient, sample_id, list(m ORDER BY gene) AS v FROM (SELECT patient, sample_id, gene, round(avg(y), 9) AS m FROM cells GROUP BY ALL) GROUP BY ALL), pr AS (SELECT a.sample_id AS i, a.patient AS la, b.patient AS lb, avg(list_distance(a.v, b.v)) AS m FROM pb a JOIN pb b ON a.sample_id <> b.sample_id GROUP BY ALL), s AS (SELECT i, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM pr GROUP BY ALL) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def r13_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return linear.silhouette(section_means(spark, d), "v", "patient", "sample_id").select(r6("silhouette"))


@query()
def r5_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of every gene by boosted trees on the whole vector, a patient left out at a time."""
    return trees.boosted(spot_models(spark, d), "px", "py", "fold", ["spot_id"], trees.Boosting(rounds=10))
