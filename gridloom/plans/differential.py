"""Queries: differential tests, matching, agreement and replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.operators import agreement as A
from gridloom.operators import expression_tests as T
from gridloom.operators import matching, profile, scores
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.scores import _AVERAGED, _MEMBERS, edges_sql, r6
from gridloom.plans.views import with_views
from gridloom.sources import tables

#: Samples of the tests are regions (patients), whose tails hold enough spots.
_COND = ", " + edges_sql("scores", "total", "cohort, encoder", 10) + """, cond AS (
  SELECT cohort, patient, sample_id, spot_id, """ + stats.exact_mean_sql('d') + """ AS d_cond FROM (SELECT *, d_raw - """ + V.BIN_MEAN + """ AS d FROM binned) GROUP BY ALL),
tq AS (SELECT patient, quantile_cont(d_cond, [0.25, 0.75]) AS q FROM cond GROUP BY ALL),
tails AS (SELECT cond.*, d_cond >= q[2] AS disc, d_cond <= q[1] AS conc FROM cond JOIN tq USING (patient)),
sides AS (SELECT patient, spot_id, 1 AS side FROM tails WHERE disc UNION ALL SELECT patient, spot_id, 0 FROM tails WHERE conc)"""


def cond(spark: SparkSession, d: str, dense: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Written, as tails read it twice; of nine places, so that equal spots tie whatever the order of their encoders. ``own`` has the spots' scores, if they are there."""
    out = scores.conditional_scores(V.spot_scores(spark, d, dense) if own is None else own, ["cohort", "encoder"], merge=False, least=0)
    return tables.written(out.groupBy("cohort", "patient", "sample_id", "spot_id").agg(stats.exact_mean(F.col("d_cond").cast("decimal(20,9)").cast("double")).alias("d_cond")))


def sided(spark: SparkSession, d: str, dense: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    return T.sides(T.tails(cond(spark, d, dense, own), "d_cond", ["patient"])).select("patient", "spot_id", "side")


def sided_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of spots of either tail; scores and tests read the same written cells."""
    dense = V.written_cells(spark, d)
    return sided(spark, d, dense).join(dense.select("spot_id", "gene", "y"), "spot_id")


def mwu_sql(source: str, keys: str, value: str, out: str = "mwu") -> str:
    """SQL of rank sums of side 1 against side 0, with moments and the asymptotic p."""
    z = stats.mwu_z_sql("u", "n_disc", "n_conc", "ties")
    return f"""{out}_r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {keys}, {value}) AS t FROM {source}),
{out}_s AS (SELECT {keys}, count(*) FILTER (side = 1) AS n_disc, count(*) FILTER (side = 0) AS n_conc, sum(r) FILTER (side = 1) AS rank_sum, CAST(sum(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS ties,
  avg({value}) FILTER (side = 1) AS mean_disc, avg({value}) FILTER (side = 0) AS mean_conc, var_samp({value}) FILTER (side = 1) AS var_disc, var_samp({value}) FILTER (side = 0) AS var_conc,
  avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END) FILTER (side = 1) AS frac_disc, avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END) FILTER (side = 0) AS frac_conc
  FROM {out}_r GROUP BY {keys}),
{out}_u AS (SELECT *, rank_sum - n_disc * (n_disc + 1) / 2.0 AS u FROM {out}_s WHERE n_disc > 0 AND n_conc > 0),
{out} AS (SELECT *, coalesce({stats.two_sided_sql(z)}, 1.0) AS pval, {T.pooled()} AS sd FROM {out}_u)"""


def bh_sql(source: str, keys: str, out: str = "bh") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{out}_p AS (SELECT *, row_number() OVER ({part} ORDER BY pval) AS place, count(*) OVER ({part}) AS tests FROM {source}),
{out} AS (SELECT *, least(1.0, min(pval * tests / place) OVER ({part} ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM {out}_p)"""


_DE = (
    _COND
    + ", rows_ AS (SELECT s.patient, s.side, c.gene, c.y FROM sides s JOIN cells c USING (spot_id)), "
    + mwu_sql("rows_", "patient, gene", "y")
    + ", tested AS (SELECT * FROM mwu WHERE greatest(frac_disc, frac_conc) >= 0.1), "
    + bh_sql("tested", "patient")
    + ", de AS (SELECT patient, gene, pval, fdr, log2((mean_disc + 1e-6) / (mean_conc + 1e-6)) AS log2fc, CASE WHEN sd > 0 THEN (mean_disc - mean_conc) / sd ELSE 0 END AS cohens_d, frac_disc, frac_conc, mean_disc, mean_conc, n_disc, n_conc FROM bh)"
)


def de(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    rows = sided_cells(spark, d) if rows is None else rows
    return T.de_table(rows, ["patient"], exact=False)


@query(with_views("scores") + _COND + " SELECT patient, spot_id, d_cond, disc, conc FROM tails")
def a24_tails(spark: SparkSession, d: str) -> DataFrame:
    return T.tails(cond(spark, d), "d_cond", ["patient"]).select("patient", "spot_id", "d_cond", "disc", "conc")


@query(with_views("scores") + _DE + " SELECT patient, gene, round(pval, 6) AS pval, round(fdr, 6) AS fdr, round(log2fc, 6) AS log2fc, round(cohens_d, 6) AS cohens_d, round(frac_disc, 6) AS frac_disc, round(frac_conc, 6) AS frac_conc, CAST(n_disc AS BIGINT) AS n_disc, CAST(n_conc AS BIGINT) AS n_conc FROM de")
def a25_differential_expression(spark: SparkSession, d: str) -> DataFrame:
    return de(spark, d).select("patient", "gene", *[r6(c) for c in ("pval", "fdr", "log2fc", "cohens_d", "frac_disc", "frac_conc")], "n_disc", "n_conc")


@query()
def a25_exact_p(spark: SparkSession, d: str) -> DataFrame:
    """The same table with exact p-values where a side is small and without ties."""
    rows = sided_cells(spark, d)
    return T.de_table(rows, ["patient"])


_SCORES = _COND + _AVERAGED + _MEMBERS + ", set_scores AS (SELECT spot_id, pathway, round(avg(residual), 9) AS score FROM averaged JOIN members USING (gene) GROUP BY ALL), rows_ AS (SELECT s.patient, s.side, c.pathway, c.score FROM sides s JOIN set_scores c USING (spot_id)), " + mwu_sql("rows_", "patient, pathway", "score") + ", " + bh_sql("mwu", "patient") + ", sets_de AS (SELECT *, mean_disc - mean_conc AS delta, (mean_disc - mean_conc) / CASE WHEN sd > 0 THEN sd ELSE 1e-6 END AS cohens_d FROM bh)"


def set_de(spark: SparkSession, d: str, dense: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    own = scores.set_scores(V.averaged_residuals(spark, d, dense), V.gene_sets(spark, d), ["spot_id"], "residual", least=5, panel=V.panel(spark, d)).withColumn("score", F.round("score", 9))
    return T.score_test((sided(spark, d) if sides is None else sides).join(own, "spot_id"), ["patient"], "pathway", "score", exact=False)


@query(with_views("scores", "gene_sets") + _SCORES + " SELECT patient, pathway, round(delta, 6) AS delta, round(cohens_d, 6) AS cohens_d, round(pval, 6) AS pval, round(fdr, 6) AS fdr, CAST(n_disc AS BIGINT) AS n_disc FROM sets_de")
def a26_set_tests(spark: SparkSession, d: str) -> DataFrame:
    return set_de(spark, d).select("patient", "pathway", *[r6(c) for c in ("delta", "cohens_d", "pval", "fdr")], "n_disc")


_TYPES = _COND + ", type_scores AS (SELECT spot_id, pathway AS cell_type, round(avg(y), 9) AS score FROM cells JOIN gene_sets USING (gene) GROUP BY ALL HAVING count(*) >= 2), rows_ AS (SELECT s.patient, s.side, c.cell_type, c.score FROM sides s JOIN type_scores c USING (spot_id)), " + mwu_sql("rows_", "patient, cell_type", "score") + ", " + bh_sql("mwu", "patient") + ", types_de AS (SELECT *, (mean_disc - mean_conc) / CASE WHEN sd > 0 THEN sd ELSE 1e-6 END AS cohens_d FROM bh)"


def type_de(spark: SparkSession, d: str, dense: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    sets = V.gene_sets(spark, d).withColumnRenamed("pathway", "cell_type")
    own = scores.set_scores(V.cells(spark, d) if dense is None else dense, sets, ["spot_id"], "y", name="cell_type", least=2, panel=V.panel(spark, d)).withColumn("score", F.round("score", 9))
    return T.score_test((sided(spark, d) if sides is None else sides).join(own, "spot_id"), ["patient"], "cell_type", "score", exact=False)


@query(with_views("scores", "gene_sets") + _TYPES + " SELECT patient, cell_type, round(cohens_d, 6) AS cohens_d, round(pval, 6) AS pval, round(fdr, 6) AS fdr FROM types_de")
def a27_cell_type_tests(spark: SparkSession, d: str) -> DataFrame:
    return type_de(spark, d).select("patient", "cell_type", *[r6(c) for c in ("cohens_d", "pval", "fdr")])


@query("WITH rows_ AS (SELECT l_shipmode_ AS mode, side, v FROM (SELECT l_returnflag AS l_shipmode_, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS side, l_quantity AS v FROM lineitem)), " + mwu_sql("rows_", "mode", "v") + " SELECT mode, round(mean_disc - mean_conc, 6) AS delta, round(pval, 6) AS pval, CAST(n_disc AS BIGINT) AS n_disc, CAST(n_conc AS BIGINT) AS n_conc FROM mwu WHERE n_disc >= 10 AND n_conc >= 10 AND n_disc + n_conc > 100")
def a28_guarded_tests(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), (F.col("l_linestatus") == "O").cast("int").alias("side"), F.col("l_quantity").alias("v"))
    out = T.score_test(rows.withColumn("one", F.lit("all")), ["one"], "mode", "v", exact=False, fdr=False, least=10, spread=True).where("n_disc + n_conc > 100")
    return out.select("mode", r6("delta"), r6("pval"), "n_disc", "n_conc")


@query(with_views("scores") + _COND + ", rows_ AS (SELECT s.patient, s.side, c.gene, c.y FROM sides s JOIN cells c USING (spot_id)), m AS (SELECT patient, gene, avg(y) FILTER (side = 1) AS m1, avg(y) FILTER (side = 0) AS m0, sqrt((var_pop(y) FILTER (side = 1) + var_pop(y) FILTER (side = 0)) / 2) AS sd FROM rows_ GROUP BY ALL) SELECT patient, gene, round(CASE WHEN sd > 0 THEN (m1 - m0) / sd ELSE 0 END, 6) AS cohens_d FROM m")
def a29_plain_d(spark: SparkSession, d: str) -> DataFrame:
    rows = sided_cells(spark, d)
    return T.plain_d(rows, ["patient", "gene"], "y").withColumn("cohens_d", F.round("cohens_d", 6))


_MATCH = """, q AS (SELECT sample_id, quantile_cont(w, [0.25, 0.75]) AS q FROM points GROUP BY ALL),
u AS (SELECT p.*, list_transform(vector, lambda v: v / sqrt(list_inner_product(vector, vector))) AS unit, w >= q[2] AS disc, w <= q[1] AS conc FROM points p JOIN q USING (sample_id)),
pr AS (SELECT a.sample_id, a.spot_id AS src, b.spot_id AS dst, round(sqrt(greatest(0, 2 - 2 * list_inner_product(a.unit, b.unit))), 9) AS dist FROM u a JOIN u b ON a.sample_id = b.sample_id WHERE a.disc AND b.conc),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY dist, dst) AS rank FROM pr) WHERE rank <= 5),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat_ws('|', '42', spot_id))) AS p FROM u WHERE conc) WHERE p <= 1000),
wp AS (SELECT a.sample_id, a.spot_id AS src, b.spot_id AS dst, round(sqrt(greatest(0, 2 - 2 * list_inner_product(a.unit, b.unit))), 9) AS dist FROM sm a JOIN sm b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id),
tau AS (SELECT sample_id, quantile_cont(dist, 0.9) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, src ORDER BY dist, dst) AS rank FROM wp) WHERE rank <= 5 GROUP BY ALL),
matches AS (SELECT *, nn1 <= tau AS is_matched FROM (SELECT near.*, tau, min(dist) OVER (PARTITION BY sample_id, src) AS nn1 FROM near JOIN tau USING (sample_id)))"""


def near6(c: str) -> F.Column:
    """Six places by the SQL's own arithmetic, as deltas of nine places and their medians do fall on halves."""
    return stats.rounded(F.col(c)).alias(c)


def matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = T.tails(V.points(spark, d), "w", ["sample_id"])
    conc = own.where("conc")
    return own, matching.matched(own.where("disc"), conc, matching.caliper(conc))


@query(with_views("points") + _MATCH + " SELECT sample_id, src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM near")
def j15_matched_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)[1].select("sample_id", "src", "dst", "rank", near6("dist"))


@query(with_views("points") + _MATCH + " SELECT sample_id, round(tau, 6) AS tau FROM tau")
def j16_caliper(spark: SparkSession, d: str) -> DataFrame:
    return matching.caliper(T.tails(V.points(spark, d), "w", ["sample_id"]).where("conc")).select("sample_id", near6("tau"))


_DELTAS = _MATCH + """, long AS (SELECT sample_id, spot_id, 'x' AS gene, x AS v FROM points UNION ALL SELECT sample_id, spot_id, 'y', y FROM points UNION ALL SELECT sample_id, spot_id, 'z', z FROM points),
ctl AS (SELECT m.sample_id, m.src, l.gene, avg(l.v) AS c FROM matches m JOIN long l ON l.sample_id = m.sample_id AND l.spot_id = m.dst WHERE is_matched GROUP BY ALL),
deltas AS (SELECT c.sample_id, c.src AS spot_id, c.gene, round(l.v - c.c, 9) AS delta FROM ctl c JOIN long l ON l.sample_id = c.sample_id AND l.spot_id = c.src AND l.gene = c.gene)"""


def deltas(spark: SparkSession, d: str) -> DataFrame:
    own, found = matches(spark, d)
    long = own.unpivot(["sample_id", "spot_id"], ["x", "y", "z"], "gene", "v")
    return matching.matched_deltas(found, long, value="v")


@query(with_views("points") + _DELTAS + " SELECT sample_id, spot_id, gene, round(delta, 6) AS delta FROM deltas")
def a30_matched_deltas(spark: SparkSession, d: str) -> DataFrame:
    return deltas(spark, d).select("sample_id", "spot_id", "gene", near6("delta"))


_SIGNED = _DELTAS + f""", mv AS (SELECT *, abs(delta) AS a FROM deltas WHERE delta <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY sample_id, gene ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, gene, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY sample_id, gene, a) AS t FROM mv),
sg AS (SELECT sample_id, gene, count(*) AS m, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_pos, CAST(sum(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS ties FROM rk GROUP BY ALL HAVING count(*) >= 5),
st AS (SELECT *, least(w_pos, m * (m + 1) / 2.0 - w_pos) AS t_stat FROM sg),
tested AS (SELECT *, {stats.two_sided_sql("(abs(t_stat - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2.0 * m + 1) / 24 - ties / 48))")} AS pval FROM st), {bh_sql("tested", "sample_id")},
ev AS (SELECT sample_id, gene, count(delta) AS n_matched, quantile_cont(delta, 0.5) AS median_delta, avg(delta) AS mean_delta, stddev_samp(delta) AS sd FROM deltas GROUP BY ALL)"""


@query(with_views("points") + _SIGNED + " SELECT sample_id, gene, round(pval, 6) AS pval, round(fdr, 6) AS fdr, round(median_delta, 6) AS median_delta, round(mean_delta, 6) AS mean_delta, round(CASE WHEN sd > 0 THEN mean_delta / sd ELSE 0 END, 6) AS effect_size, CAST(n_matched AS BIGINT) AS n_matched FROM bh JOIN ev USING (sample_id, gene)")
def a31_matched_tests(spark: SparkSession, d: str) -> DataFrame:
    return T.matched_table(deltas(spark, d), ["sample_id"], exact=False).select("sample_id", "gene", *[near6(c) for c in ("pval", "fdr", "median_delta", "mean_delta", "effect_size")], "n_matched")


@query(with_views("points") + _MATCH + " SELECT sample_id, CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (is_matched) AS BIGINT) AS n_matched, round(max(tau), 6) AS tau, round(quantile_cont(nn1, 0.5), 6) AS median_nn1, round(avg(nn1), 6) AS mean_nn1, round(quantile_cont(nn1, 0.9), 6) AS p90_nn1 FROM matches WHERE rank = 1 GROUP BY ALL")
def a32_match_quality(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_quality(matches(spark, d)[1]).select("sample_id", "n_total", "n_matched", *[near6(c) for c in ("tau", "median_nn1", "mean_nn1", "p90_nn1")])


_META = _DE + ", meta AS (SELECT CASE WHEN patient IN (SELECT r_name FROM region WHERE r_regionkey < 3) THEN 'discovery' ELSE 'validation' END AS cohort, gene, count(*) FILTER (fdr < 0.05 AND abs(log2fc) > 0.25) AS n_samples_sig, count(*) AS n_samples_tested, quantile_cont(log2fc, 0.5) AS median_log2fc, avg(cohens_d) AS mean_cohens_d FROM de GROUP BY ALL)"


def metas(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    cohorts = V.sample_dim(spark, d).select("cohort", "patient").distinct()
    return T.meta(de(spark, d, rows).join(cohorts, "patient"), ["cohort", "gene"])


@query(with_views("scores") + _META + " SELECT cohort, gene, CAST(n_samples_sig AS BIGINT) AS n_samples_sig, CAST(n_samples_tested AS BIGINT) AS n_samples_tested, round(n_samples_sig / n_samples_tested, 6) AS reproducibility, round(median_log2fc, 6) AS median_log2fc, round(mean_cohens_d, 6) AS mean_cohens_d FROM meta")
def a33_meta(spark: SparkSession, d: str) -> DataFrame:
    return metas(spark, d).select("cohort", "gene", "n_samples_sig", "n_samples_tested", *[r6(c) for c in ("reproducibility", "median_log2fc", "mean_cohens_d")])


@query(with_views("scores", "gene_sets") + _SCORES + " SELECT pathway, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_sig_fdr05, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS n_positive_delta, CAST(count(*) FILTER (delta < 0) AS BIGINT) AS n_negative_delta, round(greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0)) / count(*), 6) AS direction_consistency, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(avg(cohens_d), 6) AS mean_cohens_d, CASE WHEN count(*) FILTER (cohens_d > 0) > count(*) FILTER (cohens_d < 0) THEN 'up' ELSE 'down' END AS direction FROM sets_de GROUP BY ALL")
def a34_set_consistency(spark: SparkSession, d: str) -> DataFrame:
    own = set_de(spark, d)
    out = T.set_consistency(own, ["pathway"]).join(T.direction(own, ["pathway"]).select("pathway", "direction"), "pathway")
    return out.select("pathway", "n_samples", "n_sig_fdr05", "n_positive_delta", "n_negative_delta", *[r6(c) for c in ("direction_consistency", "median_delta", "mean_cohens_d")], "direction")


@query(with_views("scores", "gene_sets") + _TYPES + " SELECT cell_type, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (fdr < 0.05) AS BIGINT) AS n_sig, CAST(count(*) FILTER (cohens_d > 0) AS BIGINT) AS n_positive, round(avg(cohens_d), 6) AS mean_cohens_d, round(quantile_cont(cohens_d, 0.5), 6) AS median_cohens_d FROM types_de GROUP BY ALL")
def a35_cell_type_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.type_summary(type_de(spark, d), ["cell_type"]).select("cell_type", "n_samples", "n_sig", "n_positive", r6("mean_cohens_d"), r6("median_cohens_d"))


@query(with_views("scores") + _DE + ", top AS (SELECT * FROM (SELECT patient, gene, row_number() OVER (PARTITION BY patient ORDER BY pval, gene) AS n FROM de) WHERE n <= 10), s AS (SELECT DISTINCT patient FROM top) SELECT a.patient AS a, b.patient AS b, CAST((SELECT count(*) FROM top x JOIN top y ON x.gene = y.gene WHERE x.patient = a.patient AND y.patient = b.patient) AS BIGINT) AS n_both FROM s a JOIN s b ON a.patient < b.patient")
def a36_top_overlap(spark: SparkSession, d: str) -> DataFrame:
    return T.set_jaccard(T.top_features(de(spark, d), ["patient"], 10), "patient", "gene").select("a", "b", "n_both")


@query(with_views("scores") + _META + ", x AS (SELECT a.gene, a.n_samples_sig / a.n_samples_tested AS ra, b.n_samples_sig / b.n_samples_tested AS rb, a.mean_cohens_d AS da, b.mean_cohens_d AS db FROM meta a JOIN meta b ON a.gene = b.gene WHERE a.cohort = 'discovery' AND b.cohort = 'validation') SELECT CAST(count(*) FILTER (ra >= 0.5) AS BIGINT) AS n_a, CAST(count(*) FILTER (rb >= 0.5) AS BIGINT) AS n_b, CAST(count(*) FILTER (ra >= 0.5 AND rb >= 0.5) AS BIGINT) AS n_both, CAST(count(*) FILTER (ra >= 0.5 AND rb >= 0.5 AND sign(da) = sign(db)) AS BIGINT) AS n_same FROM x")
def a37_cohort_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = tables.written(metas(spark, d))
    side = lambda c, x: m.where(F.col("cohort") == c).select("gene", F.col("reproducibility").alias(f"r{x}"), F.col("mean_cohens_d").alias(f"d{x}"))
    both = side("discovery", "a").join(side("validation", "b"), "gene")
    ra, rb = F.col("ra") >= 0.5, F.col("rb") >= 0.5
    return both.agg(F.count_if(ra).alias("n_a"), F.count_if(rb).alias("n_b"), F.count_if(ra & rb).alias("n_both"), F.count_if(ra & rb & (F.signum("da") == F.signum("db"))).alias("n_same"))


_RANKED = ", rk AS (SELECT *, rank() OVER (PARTITION BY sample_id, encoder ORDER BY d_raw) + (count(*) OVER (PARTITION BY sample_id, encoder, d_raw) - 1) / 2.0 AS r FROM scores), pairs AS (SELECT x.cohort, x.sample_id, x.encoder AS a, y.encoder AS b, corr(x.r, y.r) AS rho, count(*) AS n FROM rk x JOIN rk y ON x.sample_id = y.sample_id AND x.spot_id = y.spot_id AND x.encoder < y.encoder GROUP BY ALL)"


def encoder_pairs(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    return A.pair_correlations(V.spot_scores(spark, d) if own is None else own, ["spot_id"], "d_raw", "encoder", ["cohort", "sample_id"])


@query(with_views("scores") + _RANKED + " SELECT sample_id, a, b, round(rho, 6) AS rho, CAST(n AS BIGINT) AS n FROM pairs")
def a39_encoder_agreement(spark: SparkSession, d: str) -> DataFrame:
    return encoder_pairs(spark, d).select("sample_id", "a", "b", r6("rho"), "n")


@query(with_views("scores") + _RANKED + ", s AS (SELECT cohort, sample_id, quantile_cont(rho, 0.5) > 0.3 AS passed FROM pairs GROUP BY ALL), g AS (SELECT cohort, count(*) FILTER (passed) AS n_pass, count(*) AS n_total FROM s GROUP BY ALL) SELECT cohort, CAST(n_pass AS BIGINT) AS n_pass, CAST(n_total AS BIGINT) AS n_total, round(n_pass / n_total, 6) AS fraction, n_pass / n_total >= 0.75 AS gate_pass, min(n_pass / n_total) OVER () >= 0.75 AS overall FROM g")
def a38_gate(spark: SparkSession, d: str) -> DataFrame:
    out = T.gate(A.agreement_summary(encoder_pairs(spark, d), ["cohort", "sample_id"]), ["cohort"], "passed", 0.75)
    return out.withColumn("fraction", F.round("fraction", 6))


def split_sql(keys: str, tracks: str) -> str:
    return f""", tracks AS ({tracks}), sp AS (SELECT {keys}, spot_id, {stats.fixed_sql(stats.exact_mean_sql('abs(residual)', " FILTER (track = 'A')"))} AS a, {stats.fixed_sql(stats.exact_mean_sql('abs(residual)', " FILTER (track = 'B')"))} AS b FROM predictions JOIN tracks USING (gene) GROUP BY ALL),
sr AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY a) + (count(*) OVER (PARTITION BY {keys}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {keys} ORDER BY b) + (count(*) OVER (PARTITION BY {keys}, b) - 1) / 2.0 AS rb FROM sp)"""


@query(with_views("predictions") + split_sql("encoder, sample_id", "SELECT gene, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', gene))) <= (SELECT count(*) FROM panel) // 2 THEN 'A' ELSE 'B' END AS track FROM panel") + " SELECT encoder, sample_id, round(corr(ra, rb), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM sr GROUP BY ALL HAVING count(*) >= 10")
def a40_split_half(spark: SparkSession, d: str) -> DataFrame:
    return A.split_half(V.predictions(spark, d), A.halves(V.panel(spark, d), 42), ["encoder", "sample_id"]).select("encoder", "sample_id", r6("rho"), "n")


_SPLITS = "SELECT gene, split, n_genes, CASE WHEN p <= n_genes THEN 'A' ELSE 'B' END AS track FROM (SELECT gene, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', '0', split, gene))) AS p FROM panel CROSS JOIN (SELECT unnest(range(100)) AS split)) CROSS JOIN (SELECT unnest([4, 8, 12]) AS n_genes) WHERE p <= 2 * n_genes"
_CURVE = split_sql("patient, n_genes, split", _SPLITS) + ", curve AS (SELECT patient, n_genes, split, corr(ra, rb) AS rho, count(*) AS n FROM sr GROUP BY ALL HAVING count(*) >= 50)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return A.subsampled(V.averaged_residuals(spark, d), V.panel(spark, d), [4, 8, 12], 100, ["patient"])


_CURVE_SQL = with_views("predictions").replace("predictions AS (", "predictions_all AS (") + ", predictions AS (SELECT cohort, patient, sample_id, spot_id, gene, " + stats.fixed_sql(stats.exact_mean_sql('residual')) + " AS residual FROM predictions_all GROUP BY ALL)" + _CURVE


@query(_CURVE_SQL + " SELECT patient, CAST(n_genes AS INTEGER) AS n_genes, CAST(split AS INTEGER) AS split, round(rho, 6) AS rho, CAST(n AS BIGINT) AS n FROM curve")
def a41_subsampling(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d).select("patient", "n_genes", "split", r6("rho"), "n")


@query(_CURVE_SQL + " SELECT CAST(n_genes AS INTEGER) AS n_genes, CAST(count(*) AS BIGINT) AS n, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS sd, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.75), 6) AS q75 FROM curve GROUP BY ALL")
def a42_subsampling_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(curve(spark, d), "rho", ["n_genes"]).select("n_genes", "n", *[r6(c) for c in ("mean", "sd", "q25", "median", "q75")])


@query(with_views("predictions") + split_sql("sample_id", "SELECT gene, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', gene))) <= (SELECT count(*) FROM panel) // 2 THEN 'A' ELSE 'B' END AS track FROM panel") + " SELECT sample_id, spot_id, round(a, 6) AS a, round(b, 6) AS b FROM sp")
def a43_tracks(spark: SparkSession, d: str) -> DataFrame:
    own = V.predictions(spark, d).join(A.halves(V.panel(spark, d), 42), "gene")
    return own.groupBy("sample_id", "spot_id").pivot("track", ["A", "B"]).agg(stats.fixed(stats.exact_mean(F.abs("residual")))).select("sample_id", "spot_id", r6("A", "a"), r6("B", "b"))


@query(with_views("scores") + ", " + edges_sql("scores", "total", "cohort, encoder", 10) + """, c AS (SELECT *, d_raw - """ + V.BIN_MEAN + """ AS d_cond FROM binned),
r AS (SELECT *, rank() OVER (PARTITION BY cohort, encoder ORDER BY total) + (count(*) OVER (PARTITION BY cohort, encoder, total) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY cohort, encoder ORDER BY d_raw) + (count(*) OVER (PARTITION BY cohort, encoder, d_raw) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY cohort, encoder ORDER BY d_cond) + (count(*) OVER (PARTITION BY cohort, encoder, d_cond) - 1) / 2.0 AS rc FROM c)
SELECT cohort, encoder, round(corr(rt, rr), 6) AS rho_raw, round(corr(rt, rc), 6) AS rho_cond FROM r GROUP BY ALL""")
def a68_covariate_check(spark: SparkSession, d: str) -> DataFrame:
    own = scores.conditional_scores(V.spot_scores(spark, d), ["cohort", "encoder"], merge=False, least=0)
    keys = ["cohort", "encoder"]
    raw, con = (A.rank_correlation(own, "total", c, keys).select(*keys, r6("rho", n)) for c, n in (("d_raw", "rho_raw"), ("d_cond", "rho_cond")))
    return raw.join(con, keys)


_GENE_R = ", g AS (SELECT encoder, gene, round(coalesce(corr(y, yhat), 0), 9) AS r FROM predictions GROUP BY ALL), wide AS (SELECT gene, max(r) FILTER (encoder = 'm1') AS m1, max(r) FILTER (encoder = 'm2') AS m2, max(r) FILTER (encoder = 'm3') AS m3 FROM g GROUP BY ALL)"


@query(with_views("predictions") + _GENE_R + " SELECT gene, round(least(m1, m2, m3), 6) AS row_min, round(greatest(m1, m2, m3), 6) AS row_max, CASE greatest(m1, m2, m3) WHEN m1 THEN 'm1' WHEN m2 THEN 'm2' ELSE 'm3' END AS best, CASE least(m1, m2, m3) WHEN m1 THEN 'm1' WHEN m2 THEN 'm2' ELSE 'm3' END AS worst FROM wide")
def p14_best_encoder(spark: SparkSession, d: str) -> DataFrame:
    g = profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]).withColumn("r", F.round("r", 9))
    return A.between_encoders(g, ["m1", "m2", "m3"]).select("gene", r6("row_min"), r6("row_max"), "best", "worst")


@query(with_views("predictions") + _GENE_R + ", s AS (SELECT gene, least(m1, m2, m3) AS lo, greatest(m1, m2, m3) - least(m1, m2, m3) AS span, (m1 + m2 + m3) / 3 AS mean FROM wide), q AS (SELECT quantile_cont(mean, 0.75) AS q75, quantile_cont(span, 0.9) AS q90 FROM s) SELECT gene, lo > q75 AS visible, span > q90 AS specific FROM s, q")
def a62_visible_genes(spark: SparkSession, d: str) -> DataFrame:
    g = profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]).withColumn("r", F.round("r", 9))
    wide = A.between_encoders(g, ["m1", "m2", "m3"])
    q = wide.agg(F.percentile("row_mean", F.lit(0.75)).alias("q75"), F.percentile("row_range", F.lit(0.9)).alias("q90"))
    return wide.crossJoin(F.broadcast(q)).select("gene", (F.col("row_min") > F.col("q75")).alias("visible"), (F.col("row_range") > F.col("q90")).alias("specific"))  # one row of thresholds


@query(with_views("predictions") + _GENE_R + ", k AS (SELECT *, rank() OVER (PARTITION BY encoder ORDER BY r) + (count(*) OVER (PARTITION BY encoder, r) - 1) / 2.0 AS k FROM g) SELECT x.encoder AS a, y.encoder AS b, round(corr(x.r, y.r), 6) AS pearson, round(corr(x.k, y.k), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM k x JOIN k y ON x.gene = y.gene AND x.encoder < y.encoder GROUP BY ALL")
def a62_encoder_agreement(spark: SparkSession, d: str) -> DataFrame:
    g = profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"]).withColumn("r", F.round("r", 9))
    p = A.pair_correlations(g, ["gene"], "r", "encoder", ranks=False).select("a", "b", r6("rho", "pearson"))
    return p.join(A.pair_correlations(g, ["gene"], "r", "encoder").select("a", "b", r6("rho", "spearman"), "n"), ["a", "b"])


def cohort_agreement(spark: SparkSession, d: str, dense: DataFrame | None = None) -> DataFrame:
    g = V.mean_residuals(spark, d, ["cohort"], dense)
    p = A.pair_correlations(g, ["gene"], "mar", "cohort", ranks=False).select("a", "b", r6("rho", "pearson"))
    s = A.pair_correlations(g, ["gene"], "mar", "cohort").select("a", "b", r6("rho", "spearman"), "n")
    return p.join(s, ["a", "b"]).select("pearson", "spearman", "n")


@query(with_views("predictions") + ", g AS (SELECT cohort, gene, " + stats.fixed_sql(stats.exact_mean_sql('abs(residual)')) + " AS m FROM predictions GROUP BY ALL), b AS (SELECT x.gene, x.m AS a, y.m AS b FROM g x JOIN g y ON x.gene = y.gene WHERE x.cohort = 'discovery' AND y.cohort = 'validation'), r AS (SELECT *, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM b) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM r")
def a63_cohort_agreement(spark: SparkSession, d: str) -> DataFrame:
    return cohort_agreement(spark, d)


@query(with_views("scores") + " SELECT cohort, encoder, CAST(count(*) AS BIGINT) AS n, round(avg(d_raw), 6) AS mean, round(quantile_cont(d_raw, 0.25), 6) AS q25, round(quantile_cont(d_raw, 0.5), 6) AS median, round(quantile_cont(d_raw, 0.75), 6) AS q75 FROM scores GROUP BY ALL")
def a64_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(V.spot_scores(spark, d), "d_raw", ["cohort", "encoder"]).select("cohort", "encoder", "n", *[r6(c) for c in ("mean", "q25", "median", "q75")])


@query("SELECT CAST(count(DISTINCT p_brand) AS BIGINT) AS brands, CAST(count(DISTINCT p_brand) FILTER (p_size > 45) AS BIGINT) AS large FROM part")
def a65_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct(F.when(F.col("p_size") > 45, F.col("p_brand"))).alias("large"))


@query("SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def a66_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query(with_views("scores") + ", s AS (SELECT sample_id, count(*) AS n, round(avg(d_raw), 9) AS m FROM scores GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rm FROM s) SELECT round(corr(rn, rm), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r")
def a67_size_association(spark: SparkSession, d: str) -> DataFrame:
    own = V.spot_scores(spark, d).groupBy("sample_id").agg(F.count("*").alias("size"), F.round(F.avg("d_raw"), 9).alias("m")).withColumn("one", F.lit(1))
    return A.rank_correlation(own, "size", "m", ["one"]).select(r6("rho"), "n")


@query("WITH rows_ AS (SELECT 1 AS one, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS side, p_retailprice AS v FROM part), " + mwu_sql("rows_", "one", "v") + " SELECT CAST(n_disc AS BIGINT) AS n_1, CAST(n_conc AS BIGINT) AS n_0, round(mean_disc, 6) AS mean_1, round(u, 6) AS u, round(pval, 6) AS pval, round(1 - 2 * u / (n_disc * n_conc), 6) AS rank_biserial FROM mwu")
def a69_category_rest(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").select("p_retailprice", (F.col("p_type") == "PROMO").alias("promo"))
    return A.grouped_comparison(own, "p_retailprice", "promo").select("n_1", "n_0", r6("mean_1"), r6("u"), r6("pval"), r6("rank_biserial"))
