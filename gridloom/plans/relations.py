"""Queries: joins, set operations, sorts, samples, sinks and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import stats
from gridloom.operators import agreement as A
from gridloom.operators import linear, profile
from gridloom.operators import spatial as S
from gridloom.plans import differential as D
from gridloom.plans import spatial as P
from gridloom.plans import views as V
from gridloom.plans.registry import query
from gridloom.plans.scores import r6
from gridloom.plans.views import with_views
from gridloom.sources import files
from gridloom.sources.tables import scratch


@query(with_views("points", "expression") + "SELECT p.sample_id, e.spot_id, CAST(count(*) AS BIGINT) AS n_genes FROM expression e JOIN points p ON p.spot_id = e.spot_id WHERE len(list_filter(p.vector, lambda v: isnan(v))) = 0 GROUP BY ALL")
def j1_aligned(spark: SparkSession, d: str) -> DataFrame:
    p = V.points(spark, d).where(~C.has_nan(F.col("vector"))).select("sample_id", "spot_id")
    return V.expression(spark, d).join(p, "spot_id").groupBy("sample_id", "spot_id").agg(F.count("*").alias("n_genes"))


@query(with_views("scores", "points") + "SELECT s.spot_id, s.encoder, round(s.d_raw, 6) AS d_raw, round(p.x, 6) AS x, round(e.v, 6) AS v FROM scores s JOIN points p ON p.spot_id = s.spot_id JOIN (SELECT spot_id, sum(value) AS v FROM expression GROUP BY ALL) e ON e.spot_id = s.spot_id")
def j2_three_way(spark: SparkSession, d: str) -> DataFrame:
    e = V.expression(spark, d).groupBy("spot_id").agg(F.sum("value").alias("v"))
    return V.spot_scores(spark, d).join(V.points(spark, d).select("spot_id", "x"), "spot_id").join(e, "spot_id").select("spot_id", "encoder", r6("d_raw"), r6("x"), r6("v"))


@query(with_views("spots", "points") + "SELECT s.spot_id, round(p.x, 6) AS x, round(p.y, 6) AS y FROM spots s LEFT JOIN points p ON p.spot_id = s.spot_id")
def j3_left_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return V.spots(spark, d).select("spot_id").join(V.points(spark, d).select("spot_id", r6("x"), r6("y")), "spot_id", "left")


@query(with_views("spots", "points") + "SELECT CAST(count(*) FILTER (p.spot_id IS NOT NULL) AS BIGINT) AS n_found, CAST(count(*) FILTER (p.spot_id IS NULL) AS BIGINT) AS n_dropped FROM spots s LEFT JOIN points p ON p.spot_id = s.spot_id")
def j4_dropped(spark: SparkSession, d: str) -> DataFrame:
    p = V.points(spark, d).select("spot_id", F.lit(True).alias("have"))
    both = V.spots(spark, d).select("spot_id").join(p, "spot_id", "left")
    return both.agg(F.count("have").alias("n_found"), F.count_if(F.col("have").isNull()).alias("n_dropped"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderpriority), 'none') AS priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j7_left_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    o = V.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("priority"))
    return V.read_table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"n": 0, "priority": "none"})


_PATH = ", x AS (SELECT pathway, avg(delta) AS da FROM sets_de WHERE patient < 'B' GROUP BY ALL), y AS (SELECT pathway, avg(delta) AS db FROM sets_de WHERE patient > 'B' GROUP BY ALL)"


@query(with_views("scores", "gene_sets") + D._SCORES + _PATH + " SELECT coalesce(x.pathway, y.pathway) AS pathway, round(coalesce(da, 0), 6) AS da, round(coalesce(db, 0), 6) AS db, x.pathway IS NOT NULL AS in_a, y.pathway IS NOT NULL AS in_b FROM x FULL JOIN y ON x.pathway = y.pathway")
def j8_full_merge(spark: SparkSession, d: str) -> DataFrame:
    own = D.set_de(spark, d)
    x = own.where("patient < 'B'").groupBy("pathway").agg(F.avg("delta").alias("da"), F.lit(True).alias("in_a"))
    y = own.where("patient > 'B'").groupBy("pathway").agg(F.avg("delta").alias("db"), F.lit(True).alias("in_b"))
    return x.join(y, "pathway", "full").fillna(0.0, ["da", "db"]).fillna(False, ["in_a", "in_b"]).select("pathway", r6("da"), r6("db"), "in_a", "in_b")


@query("SELECT l_orderkey, l_linenumber, s_name, p_brand, round(l_quantity * p_retailprice, 4) AS amount FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def j10_left_merges(spark: SparkSession, d: str) -> DataFrame:
    line, part, sup = (V.read_table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    out = line.join(part, F.col("p_partkey") == F.col("l_partkey"), "left").join(sup, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "s_name", "p_brand", F.round(F.col("l_quantity") * F.col("p_retailprice"), 4).alias("amount"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j11_semi(spark: SparkSession, d: str) -> DataFrame:
    o = V.read_table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return V.read_table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query(with_views("sample_dim") + "SELECT a.patient, a.sample_id AS a, b.sample_id AS b FROM sample_dim a JOIN sample_dim b ON a.patient = b.patient AND a.sample_id < b.sample_id")
def j12_section_pairs(spark: SparkSession, d: str) -> DataFrame:
    dim = V.sample_dim(spark, d).select("patient", "sample_id")
    return dim.toDF("patient", "a").join(dim.toDF("patient", "b"), "patient").where("a < b")


@query(with_views("spots") + "SELECT spot_id, sample_id, patient, cohort FROM spots")
def j13_dimension(spark: SparkSession, d: str) -> DataFrame:
    return V.spots(spark, d).select("spot_id", "sample_id", "patient", "cohort")


@query(with_views("points") + P.HULL + " SELECT sample_id, spot_id, round(edge_dist, 6) AS edge_dist FROM far")
def j18_hull_distance(spark: SparkSession, d: str) -> DataFrame:
    p = V.points(spark, d)
    return S.edge_distance(p, S.hulls(p)).select("sample_id", "spot_id", r6("edge_dist"))


@query(with_views("gene_sets") + "SELECT pathway, gene FROM (SELECT *, count(*) OVER (PARTITION BY pathway) AS n FROM gene_sets) WHERE n >= 5")
def j19_set_members(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.scores import members

    return members(V.gene_sets(spark, d), V.panel(spark, d), 5).select("pathway", "gene")


@query(with_views("points") + P._KNN + " SELECT k.sample_id, k.src, round(avg(p.z), 6) AS lag FROM knn k JOIN points p ON p.sample_id = k.sample_id AND p.spot_id = k.dst GROUP BY ALL")
def j20_neighbour_mean(spark: SparkSession, d: str) -> DataFrame:
    return S.lagged(P.edges(spark, d), V.points(spark, d), "z").select("sample_id", "src", r6("lag"))


@query("SELECT p_brand AS name, 'part' AS kind FROM part UNION ALL SELECT n_name, 'nation' FROM nation")
def u1_union(spark: SparkSession, d: str) -> DataFrame:
    a = V.read_table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lit("part").alias("kind"))
    return a.unionByName(V.read_table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")), allowMissingColumns=True)


@query("SELECT p_brand FROM part WHERE p_type = 'PROMO' INTERSECT SELECT p_brand FROM part WHERE p_size > 49")
def u2_intersection(spark: SparkSession, d: str) -> DataFrame:
    p = V.read_table(spark, d, "part")
    return p.where("p_type = 'PROMO'").select("p_brand").intersect(p.where("p_size > 49").select("p_brand"))


@query("SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 49 AND p_type = 'PROMO'")
def u3_difference(spark: SparkSession, d: str) -> DataFrame:
    p = V.read_table(spark, d, "part")
    return p.select("p_brand").subtract(p.where("p_size > 49 and p_type = 'PROMO'").select("p_brand"))


@query("SELECT p_type AS name FROM part UNION SELECT c_mktsegment FROM customer")
def u4_set_union(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "part").select(F.col("p_type").alias("name")).union(V.read_table(spark, d, "customer").select("c_mktsegment")).distinct()


@query("SELECT p_brand, p_type AS kind, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_type IN ('PROMO', 'LARGE') GROUP BY ALL")
def u5_pivot_and_back(spark: SparkSession, d: str) -> DataFrame:
    wide = V.read_table(spark, d, "part").groupBy("p_brand").pivot("p_type", ["PROMO", "LARGE"]).agg(F.count(F.lit(1)))
    return wide.unpivot(["p_brand"], ["PROMO", "LARGE"], "kind", "n").where("n is not null")


@query(with_views("scores") + D._DE + " SELECT patient, gene, round(cohens_d, 6) AS cohens_d, CAST(row_number() OVER (PARTITION BY patient ORDER BY abs(cohens_d) DESC, gene) AS INTEGER) AS place FROM de")
def l1_sorted_effects(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("patient").orderBy(F.abs("cohens_d").desc(), "gene"))
    return D.de(spark, d).select("patient", "gene", r6("cohens_d"), place.alias("place"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3")
def l2_top_orders(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return V.read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", place.alias("place")).where("place <= 3")


@query("(SELECT o_orderkey, o_totalprice, 'top' AS \"end\" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)")
def l3_both_ends(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_and_bottom(V.read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query(with_views("scores", "gene_sets") + D._SCORES + ", s AS (SELECT pathway, min(fdr) AS f, round(avg(abs(cohens_d)), 9) AS m FROM sets_de GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY m DESC, pathway) AS place, count(*) FILTER (f < 0.05) OVER () AS found FROM s) SELECT pathway, round(m, 6) AS mean_abs_d, f < 0.05 AS significant FROM (SELECT *, row_number() OVER (ORDER BY m DESC, pathway) AS rest FROM k WHERE found = 0 AND place <= 20 OR found > 0 AND f < 0.05) WHERE rest <= 25")
def l4_top_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets that any sample finds, or the 20 with the largest effects if there are none; 25 at most."""
    s = D.set_de(spark, d).groupBy("pathway").agg(F.min("fdr").alias("f"), F.round(F.avg(F.abs("cohens_d")), 9).alias("m"))
    s = s.withColumn("found", F.sum((F.col("f") < 0.05).cast("int")).over(W.partitionBy())).withColumn("place", F.row_number().over(W.orderBy(F.desc("m"), "pathway")))
    out = s.where("found = 0 and place <= 20 or found > 0 and f < 0.05").orderBy(F.desc("m"), "pathway").limit(25)
    return out.select("pathway", r6("m", "mean_abs_d"), (F.col("f") < 0.05).alias("significant"))


@query("WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part), r AS (SELECT p_partkey, round(p_retailprice - i - s * p_size, 6) AS residual FROM part, m) (SELECT p_partkey, residual, 'top' AS \"end\" FROM r ORDER BY residual DESC, p_partkey LIMIT 3) UNION ALL (SELECT p_partkey, residual, 'bottom' FROM r ORDER BY residual, p_partkey LIMIT 3)")
def l5_line_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = V.read_table(spark, d, "part")
    line = p.agg(F.regr_slope("p_retailprice", "p_size").alias("s"), F.regr_intercept("p_retailprice", "p_size").alias("i"))
    own = p.crossJoin(F.broadcast(line)).select("p_partkey", F.round(F.col("p_retailprice") - F.col("i") - F.col("s") * F.col("p_size"), 6).alias("residual"))  # one row: the line
    return profile.top_and_bottom(own, "residual", 3, "p_partkey")


@query(with_views("panel") + "SELECT gene, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', gene))) <= (SELECT count(*) FROM panel) // 2 THEN 'A' ELSE 'B' END AS track FROM panel")
def l6_gene_halves(spark: SparkSession, d: str) -> DataFrame:
    return A.halves(V.panel(spark, d), 42).select("gene", "track")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat_ws('|', '5', c_custkey))) AS p FROM customer) WHERE p <= 10")
def l7_subsample(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(stats.seeded(5, "c_custkey")))
    return V.read_table(spark, d, "customer").withColumn("p", place).where("p <= 10").select("c_custkey")


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '3', p_partkey))) - 1) % 5 AS INTEGER) AS fold FROM part")
def l8_folds(spark: SparkSession, d: str) -> DataFrame:
    return linear.fold_numbers(V.read_table(spark, d, "part").select("p_partkey"), "p_partkey", 5, 3)


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_custkey, o_orderdate) - 1) / 2.0 AS r FROM orders")
def w1_mid_ranks(spark: SparkSession, d: str) -> DataFrame:
    return V.read_table(spark, d, "orders").select("o_orderkey", "o_custkey", stats.mid_rank("o_orderdate", ["o_custkey"]).alias("r"))


@query("WITH p AS (SELECT p_partkey, p_type, row_number() OVER w AS place, count(*) OVER (PARTITION BY p_type) AS m, p_retailprice / 10000 AS pval FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice)) SELECT p_partkey, round(least(1.0, min(pval * m / place) OVER (PARTITION BY p_type ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM p")
def w3_false_discovery(spark: SparkSession, d: str) -> DataFrame:
    own = V.read_table(spark, d, "part").select("p_partkey", "p_type", (F.col("p_retailprice") / 10000).alias("pval"))
    return stats.bh(own, "pval", ["p_type"]).select("p_partkey", r6("fdr"))


@query("SELECT o_custkey, o_orderkey, cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS share, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 6) AS step FROM orders")
def w6_cumulative(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey")
    return V.read_table(spark, d, "orders").select("o_custkey", "o_orderkey", F.cume_dist().over(w.orderBy("o_totalprice")).alias("share"), r6(F.col("o_totalprice") - F.lag("o_totalprice").over(w.orderBy("o_totalprice", "o_orderkey")), "step"))


@query(with_views("scores") + "SELECT cohort, sample_id, spot_id, encoder, d_raw FROM scores")
def k1_partitioned_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Written by cohort and sample and read again."""
    path = scratch(spark)
    files.write_partitioned(V.spot_scores(spark, d).select("cohort", "sample_id", "spot_id", "encoder", "d_raw"), path, ["cohort", "sample_id"])
    return spark.read.parquet(path).select("cohort", "sample_id", "spot_id", "encoder", "d_raw")


@query(with_views("sample_dim") + "SELECT cohort, patient, sample_id FROM sample_dim")
def k2_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(V.sample_dim(spark, d).select("cohort", "patient", "sample_id"), path)
    return spark.read.schema("cohort string, patient string, sample_id string").option("header", True).csv(path)


@query(with_views("sample_dim") + "SELECT cohort, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT patient) AS BIGINT) AS patients FROM sample_dim GROUP BY ALL")
def k3_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    own = V.sample_dim(spark, d).groupBy("cohort").agg(F.struct(F.count("*").alias("n"), F.countDistinct("patient").alias("patients")).alias("sizes"))
    files.write_summary(own, path)
    return spark.read.schema("cohort string, sizes struct<n: bigint, patients: bigint>").json(path).select("cohort", "sizes.n", "sizes.patients")


@query(with_views("sample_dim") + "SELECT cohort, sample_id FROM sample_dim WHERE patient <> 'ASIA'")
def k4_pending(spark: SparkSession, d: str) -> DataFrame:
    dim = V.sample_dim(spark, d)
    return profile.pending(dim, dim.where("patient = 'ASIA'"), ["cohort", "sample_id"]).select("cohort", "sample_id")


@query("SELECT string_split(p_name, ' ')[1] AS pathway, unnest(string_split(p_name, ' ')[2:]) AS gene FROM part WHERE len(string_split(p_name, ' ')) >= 2")
def s8_gene_set_lines(spark: SparkSession, d: str) -> DataFrame:
    """Part names as lines of name, description and genes."""
    words = F.split("p_name", " ")
    line = F.concat_ws("\t", words[0], F.lit("about"), F.array_join(F.slice(words, F.lit(2), F.size(words)), "\t"))
    return files.parsed_sets(V.read_table(spark, d, "part").where(F.size(words) >= 2).select(line.alias("value")))


@query("SELECT p_brand AS gene, array_to_string(list_sort(list_distinct(list(p_type)))[1:5], '; ') AS all_functions FROM part GROUP BY ALL")
def s15_terms(spark: SparkSession, d: str) -> DataFrame:
    return files.terms(V.read_table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("term"))).select("gene", "all_functions")


@query("SELECT c_custkey AS gene, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Unknown' ELSE c_mktsegment || '; x' END AS all_localizations FROM customer")
def s14_locations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records of locations."""
    loc = lambda v: F.struct(F.struct(v.alias("value")).alias("location"))
    comment = F.struct(F.lit("SUBCELLULAR LOCATION").alias("commentType"), F.array(loc(F.col("c_mktsegment")), loc(F.lit("x"))).alias("subcellularLocations"))
    other = F.struct(F.lit("FUNCTION").alias("commentType"), F.array(loc(F.lit("y"))).alias("subcellularLocations"))
    record = F.struct(F.array(F.struct(F.array(F.when(F.col("c_mktsegment") == "BUILDING", other).otherwise(comment), other).alias("comments"))).alias("results"))
    rows = V.read_table(spark, d, "customer").select(F.col("c_custkey").alias("gene"), F.to_json(record).alias("value"))
    return files.locations(rows).select("gene", "all_localizations")


_ONE = ", one AS (SELECT c.sample_id, c.spot_id, c.y, coalesce(p.yhat, 0) AS yhat FROM cells c LEFT JOIN predictions p ON p.spot_id = c.spot_id AND p.gene = c.gene AND p.encoder = 'm2' WHERE c.gene = 'Brand#7')"


@query(with_views("predictions") + _ONE + ", r AS (SELECT sample_id, corr(y, yhat) AS r FROM one GROUP BY ALL) SELECT sample_id, spot_id, round(y, 6) AS observed, round(yhat, 6) AS predicted, round(r, 6) AS r FROM one JOIN r USING (sample_id)")
def a75_one_gene_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every spot's value of one gene and its prediction, 0 where there is none, with the sample's correlation."""
    own = V.cells(spark, d).where("gene = 'Brand#7'").select("sample_id", "spot_id", "y")
    p = V.predictions(spark, d).where("gene = 'Brand#7' and encoder = 'm2'").select("spot_id", "yhat")
    both = own.join(p, "spot_id", "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))
    r = both.groupBy("sample_id").agg(stats.corr("y", "yhat").alias("r"))
    return both.join(r, "sample_id").select("sample_id", "spot_id", r6("y", "observed"), r6("yhat", "predicted"), r6("r"))


_SIDE = "patient IN (SELECT r_name FROM region WHERE r_regionkey < 3)"


@query(with_views("scores", "gene_sets") + D._TYPES + f", k AS (SELECT cell_type, avg(cohens_d) FILTER ({_SIDE}) AS da, avg(cohens_d) FILTER (NOT {_SIDE}) AS db, avg(CAST(fdr < 0.05 AS DOUBLE)) FILTER ({_SIDE}) > 0.5 AS sa, avg(CAST(fdr < 0.05 AS DOUBLE)) FILTER (NOT {_SIDE}) > 0.5 AS sb FROM types_de GROUP BY ALL), t AS (SELECT *, round(greatest(abs(da), abs(db)), 6) AS top FROM k) SELECT cell_type, round(da, 6) AS da, round(db, 6) AS db, sa, sb, top, CAST(row_number() OVER (ORDER BY top DESC, cell_type) AS INTEGER) AS place FROM t")
def a76_direction_table(spark: SparkSession, d: str) -> DataFrame:
    """Effects of every cell type of either cohort, whether most of its samples find it, and its place by effect."""
    own = D.type_de(spark, d).join(V.sample_dim(spark, d).select("cohort", "patient").distinct(), "patient")
    found = F.avg((F.col("fdr") < 0.05).cast("double")) > 0.5
    side = lambda c, x: own.where(F.col("cohort") == c).groupBy("cell_type").agg(F.avg("cohens_d").alias(f"d{x}"), found.alias(f"s{x}"))
    both = side("discovery", "a").join(side("validation", "b"), "cell_type", "full").withColumn("top", F.round(F.greatest(F.abs("da"), F.abs("db")), 6))
    place = F.row_number().over(W.orderBy(F.desc("top"), "cell_type"))  # a row for each cell type
    return both.select("cell_type", r6("da"), r6("db"), "sa", "sb", "top", place.alias("place"))


@query(with_views("predictions") + f", g AS (SELECT encoder, gene, count(*) AS n, CASE WHEN stddev_pop(y) < 1e-10 OR stddev_pop(yhat) < 1e-10 THEN 0 ELSE coalesce(corr(y, yhat), 0) END AS r FROM predictions GROUP BY ALL) SELECT encoder, gene, round(r, 6) AS r, round({stats.student_p_sql('r * sqrt((n - 2) / greatest(1 - r * r, 1e-300))', 'n - 2')}, 6) AS pval FROM g")
def m1_correlation_p(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of each gene and encoder with their p-values."""
    g = profile.gene_pearson(V.predictions(spark, d), ["encoder", "gene"])
    return g.select("encoder", "gene", r6("r"), r6(stats.correlation_p(F.col("r"), F.col("n")), "pval"))
