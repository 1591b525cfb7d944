"""Column functions and statistics on small frames."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import stats


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_classes(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    assert one(spark, C.location_class(arr("Cell membrane", "Secreted"))) == "Secreted/Extracellular"  # the first rule counts
    assert one(spark, C.location_class(arr("Golgi apparatus"))) == "ER/Golgi"
    assert one(spark, C.location_class(arr("Lysosome"))) == "Other" and one(spark, C.location_class(arr())) == "Unknown"
    assert one(spark, C.term_class(arr("DNA binding", "ligand binding"))) == "Receptor"
    assert one(spark, C.term_class(arr("ion channel activity"))) == "Transporter"
    assert [one(spark, C.name_class(F.lit(g))) for g in ("krt8", "CD3D", "CXCL9", "MMP2", "SLC2A1", "XYZ")] == ["Structural", "Receptor/Immune", "Signaling/Cytokine", "Enzymatic", "Transporter", "Other"]
    assert [one(spark, C.mapped(F.lit(k), C.NUCLEUS_CLASSES)) for k in (1, 5, 9)] == ["neoplastic", "non_neoplastic_epithelial", "9"]
    assert [one(spark, C.data_source(F.lit(s))) for s in ("NCBI1", "TENX99", "X")] == ["Janesick", "10x Public", "Biomarkers"]
    assert one(spark, C.pathway_name(F.lit("HALLMARK_DNA_REPAIR"))) == "Dna Repair"
    assert one(spark, C.pathway_name(F.lit("HALLMARK_DNA_REPAIR"), {"DNA_REPAIR": "DNA repair"})) == "DNA repair"
    assert [one(spark, C.stars(F.lit(p))) for p in (0.0009, 0.001, 0.049, 0.05)] == ["***", "**", "*", ""]
    assert one(spark, C.is_control_probe(F.lit("BLANK_1"))) and not one(spark, C.is_control_probe(F.lit("ACTB")))


def test_keys_numbers_and_vectors(spark):
    key = C.spot_key(F.lit("S1"), F.lit("AAC-1"))
    assert one(spark, key) == "S1_AAC-1" and one(spark, C.barcode_of(key, F.lit("S1"))) == "AAC-1" and one(spark, C.barcode_of(key, F.lit("S2"))) is None
    assert [one(spark, C.number(F.lit(x))) for x in ("1.5", "x", "NaN", None)] == [1.5, 0.0, 0.0, 0.0]
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, C.normalised(v)) == [0.6, 0.8] and one(spark, C.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, C.cosine(v, v)) == pytest.approx(1) and one(spark, C.mean_abs(F.array(F.lit(-1.0), F.lit(3.0)))) == 2
    assert one(spark, C.has_nan(F.array(F.lit(1.0), F.lit(float("nan"))))) and one(spark, C.has_nan(F.lit(None).cast("array<double>")))


def test_polygon_has_no_closing_edge(spark):
    ring = lambda *ps: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ps])
    square = [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert one(spark, C.polygon_area(ring(*square, square[0]))) == 4
    assert one(spark, C.polygon_area(ring(*square))) == abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(square, square[1:], strict=False))) / 2 != 4
    assert one(spark, C.polygon_area(ring((1, 1)))) == 0
    assert tuple(one(spark, C.ring_centroid(ring(*square)))) == (2, 2)


def test_grid_cells_at_edges(spark):
    xs = [0.0, 1.0, -0.1, 1.1, *[i / 20 for i in range(20)]]
    got = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.grid_cell(F.col("x"), 20).alias("c")).collect()]
    assert got == [0, 19, 0, 19, *range(20)]


def test_grid_cells_beside_their_rounded_places(spark):
    df = spark.createDataFrame([(0.6499997879881964,), (0.65,), (None,)], "x double")
    got = df.select(F.round("x", 6).alias("x"), C.grid_cell(F.col("x"), 20).alias("c"))
    assert [(r.x, r.c) for r in got.collect()] == [(0.65, 12), (0.65, 13), (None, 0)]


def test_z_scores_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert sorted((r.k, r.z) for r in C.standardised(df, "v", ["k"]).collect()) == [("a", 0), ("a", 0), ("b", -1), ("b", 1)]
    hot = C.one_hot(spark.createDataFrame([("x",), ("y",), (None,)], "c string"), "c", ["y", "x", "z"])
    assert hot.columns == ["c", "c_y", "c_z"] and [r.c_y for r in hot.collect()] == [0, 1, 0]


def test_erfc(spark):
    for x in (0.0, 0.3, 1.0, 2.5, 6.0):
        assert one(spark, F.expr(stats.erfc_sql(f"{x}D"))) == pytest.approx(math.erfc(x), rel=2e-7)


def test_student_p():
    # Closed forms: one and two degrees of freedom.
    for t in (0.1, 1.0, 3.7):
        assert stats.incomplete_beta(0.5, 0.5, 1 / (1 + t * t)) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-10)
        assert stats.incomplete_beta(1.0, 0.5, 2 / (2 + t * t)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


@pytest.mark.parametrize(("n", "m"), [(3, 4), (4, 4), (1, 6)])
def test_exact_mwu_by_enumeration(n, m):
    us = [sum(a > b for a in own for b in set(range(n + m)) - set(own)) for own in itertools.combinations(range(n + m), n)]
    for u in range(n * m + 1):
        low = min(u, n * m - u)
        assert stats.exact_mwu_p(u, n, m) == pytest.approx(min(1, 2 * np.mean([x <= low for x in us])))


def test_exact_wilcoxon_by_enumeration():
    n = 7
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    for t in range(n * (n + 1) // 4):
        assert stats.exact_wilcoxon_p(t, n) == pytest.approx(min(1, 2 * np.mean([x <= t for x in sums])))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_false_discovery_rate(spark, ps):
    got = [r.fdr for r in stats.bh(spark.createDataFrame([(0, p) for p in ps], "k int, p double"), "p", ["k"]).orderBy("p").collect()]
    own = sorted(ps)
    want = [min(1.0, *[own[j] * len(own) / (j + 1) for j in range(i, len(own))]) for i in range(len(own))]
    # Equal p share the smallest of their q.
    assert got == pytest.approx([min(w for q, w in zip(own, want, strict=True) if q == p) for p in own])
    # p * n / n can fall one unit of the last place below p.
    assert all(q >= p * (1 - 1e-15) for p, q in zip(own, got, strict=True))


def test_mid_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0, 5.0)], "v double").withColumn("k", F.lit(1))
    assert sorted(r.r for r in df.select(stats.mid_rank("v", ["k"]).alias("r")).collect()) == [1, 2, 4, 4, 4]
    assert one(spark, stats.empirical_p(F.lit(0), F.lit(19))) == 0.05


def test_quantiles_and_spread_ranks(spark):
    """Against NumPy: ties, nulls, a null key, a group of one value and one hot group."""
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("small", 1.5), ("small", None), (None, 4.0), (None, 6.0), ("flat", 2.0), ("flat", 2.0), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.q, r["__n"]) for r in stats.quantiles(frame, "v", ["k"], shares, "q").collect()}
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert set(got) == set(own)
    for k, vs in own.items():
        assert got[k][1] == len(vs) and np.allclose(got[k][0], np.quantile(vs, shares), atol=1e-12)
    assert np.allclose(stats.quantiles(frame, "v", [], [0.5], "q").head().q, [np.quantile([v for _, v in rows if v is not None], 0.5)])
    ranked = stats.spread_ranks(frame.where("v is not null"), "v", ["k"]).collect()
    for k, vs in own.items():
        a = np.array(vs)
        want = sorted((v, (a < v).sum() + ((a == v).sum() + 1) / 2, float((a == v).sum() ** 2 - 1)) for v in vs)
        assert sorted((r.v, r["__r"], r["__t"]) for r in ranked if r.k == k) == want


def test_exact_two_sample_law():
    """Against all orders of small samples, and near the series for larger ones."""
    from itertools import combinations

    for n1, n2 in ((2, 3), (4, 4), (5, 3)):
        seen = []
        for first in combinations(range(n1 + n2), n1):
            a = np.isin(np.arange(n1 + n2), first)
            seen.append(round(np.abs(np.cumsum(a) * n2 - np.cumsum(~a) * n1).max()))
        for far in set(seen):
            assert stats.exact_ks_p(far / (n1 * n2), n1, n2) == pytest.approx(np.mean([s >= far for s in seen]))
    assert stats.exact_ks_p(0.05, 1500, 1500) == pytest.approx(stats.asymptotic_ks_p(0.05, 1500, 1500), abs=5e-3)
    assert stats.ks_p(0.0, 5, 5) == 1.0


def test_folds_are_even(spark):
    from gridloom.operators import linear

    out = [r.fold for r in linear.fold_numbers(spark.range(1003), "id", 5, 3).collect()]
    assert sorted(out.count(i) for i in range(5)) == [200, 200, 201, 201, 201]


def test_table_helpers(spark):
    from gridloom.sources import tables

    wide = spark.createDataFrame([(1, 2.0, 4.0, 9.0), (2, None, 6.0, 9.0), (3, None, None, 9.0)], "id int, D_cond_a_ridge double, D_cond_b_ridge double, D_raw_a_ridge double")
    names = tables.columns_like(wide, "D_cond_*_ridge")
    assert names == ["D_cond_a_ridge", "D_cond_b_ridge"]
    assert [r.m for r in tables.row_mean(wide, names, "m").orderBy("id").collect()] == [3.0, 6.0, None]
    known = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    assert tables.strict_lookup(wide.where("id < 3"), known, ["id"]).count() == 2
    with pytest.raises(Exception, match="no row for key 3"):
        tables.strict_lookup(wide, known, ["id"]).collect()


def test_oracle_rows_do_not_depend_on_threads():
    """Sums of rounded values are added as decimals, so rows agree in whatever order they are read."""
    import duckdb

    from gridloom.plans import composed, differential, ingest, scores, spatial  # noqa: F401
    from gridloom.plans.registry import ORACLE_SQL

    names = ["p6_residuals", "p7_centred_residuals", "p8_raw_scores", "p11_columns_by_pattern", "a13_conditional_score", "a16_averaged_residuals", "a24_tails", "a39_encoder_agreement", "q1_depth_scores", "q9_generalisation"]
    seen = {}
    for threads in (1, 2, 4, 8, 8):
        con = duckdb.connect(config={"threads": threads})
        for table in ("region", "nation", "customer", "orders", "lineitem", "part"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
        for name in names:
            rows = sorted(map(repr, con.execute(ORACLE_SQL[name]).fetchall()))
            assert seen.setdefault(name, rows) == rows, name


def test_exact_means_and_fixed_rounding(spark):
    """Halves round up by the same arithmetic in both engines; sums do not depend on order."""
    import duckdb
    from pyspark.sql import functions as F

    from gridloom.functions import stats

    values = [0.1, 0.2, 0.3, 1e-9, 2.5e-9 * 2, -0.7, 123456.789012345, 0.0000005, 0.0000015, -0.0000005, None]
    rows = [(i % 3, v) for i, v in enumerate(values * 7)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r[0]: tuple(r[1:]) for r in df.repartition(5).groupBy("k").agg(stats.exact_mean(F.col("v")).alias("m"), stats.exact_sum(F.col("v")).alias("s"), stats.fixed(stats.exact_mean(F.col("v")), 6).alias("f")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {r[0]: tuple(r[1:]) for r in con.execute(f"SELECT k, {stats.exact_mean_sql('v')}, {stats.exact_sum_sql('v')}, {stats.fixed_sql(stats.exact_mean_sql('v'), 6)} FROM t GROUP BY k").fetchall()}
    assert got == want
    empty = df.where("v > 1e9").agg(stats.exact_mean(F.col("v")).alias("m")).head()
    assert empty[0] is None


def test_ranges_of_ranks_are_cut_once(spark, monkeypatch):
    """A sketch may give other cuts each time it is read; quantiles and ranks stay exact."""
    import random

    sketch = F.percentile_approx
    moved = F.udf(lambda cuts: sorted(c + random.uniform(-20, 20) for c in cuts), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(sketch(*a)))
    rng = np.random.default_rng(4)
    rows = [(i % 2, float(v)) for i, v in enumerate(rng.integers(0, 500, 3000))]
    frame = spark.createDataFrame(rows, "k int, v double")
    shares = [i / 10 for i in range(1, 10)]
    for r in stats.quantiles(frame, "v", ["k"], shares, "q").collect():
        assert np.allclose(r.q, np.quantile([v for k, v in rows if k == r.k], shares)) and r["__n"] == 1500
    for k in (0, 1):
        own = sorted(v for j, v in rows if j == k)
        for r in stats.spread_ranks(frame.where(F.col("k") == k), "v", ["k"]).collect():
            assert r["__r"] == (np.searchsorted(own, r.v, "left") + np.searchsorted(own, r.v, "right") + 1) / 2


def test_halves_are_rounded_as_in_sql(spark):
    """nine places that end in 500 are rounded by the scaled double, as DuckDB does, and not by their digits."""
    import duckdb

    xs = [0.0078935, -0.0078935, *[(2 * i + 1) / 2e6 for i in range(0, 9000, 7)], 0.0, 5e-7, 1e9, float("inf"), float("nan"), None]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [xs]).fetchall()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r["x"] for r in df.select("i", stats.rounded(F.col("x")).alias("x")).orderBy("i").collect()]
    assert repr([None if x is None else x + 0.0 for x in got]) == repr([None if x is None else x + 0.0 for x in want])
    plain = [r["x"] for r in df.select("i", F.round("x", 6).alias("x")).orderBy("i").collect()]
    assert sum(a != b for a, b in zip(plain[:-2], want[:-2], strict=True)) > 0
