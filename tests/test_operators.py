"""Operators against small hand-made frames and plain NumPy."""

from __future__ import annotations

import hashlib
import json
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import columns
from gridloom.operators import agreement, expression_tests, linear, matching, profile, scores, spatial
from gridloom.sources import files, tables


def test_bins_keep_ties_together(spark):
    values = [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0, None]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    out = {r.v: r.bin for r in scores.quantile_bins(df.where("v is not null"), "v", ["k"], 4, 0).collect()}
    edges = np.percentile(values[:-1], [25, 50, 75])
    assert out == {v: int((edges <= v).sum()) for v in set(values[:-1])}


def test_bins_adapt_to_few_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=95)
    df = spark.createDataFrame([("g", float(v)) for v in x], "k string, v double")
    out = {r.v: r.bin for r in scores.quantile_bins(df, "v", ["k"], 10, 30).collect()}
    edges = np.percentile(x, [100 / 3, 200 / 3])  # 95 // 30 = 3 bins
    assert out == {float(v): int((edges <= v).sum()) for v in x}


@pytest.mark.parametrize(
    ("counts", "left", "want"),
    [
        ([5, 50, 50], False, [0, 0, 1]),
        ([50, 5, 40], False, [0, 1, 1]),  # the smaller neighbour
        ([40, 5, 40], False, [0, 0, 1]),  # the left one if equal
        ([50, 5, 40], True, [0, 0, 1]),  # always left
        ([50, 40, 5], True, [0, 1, 1]),
        ([1, 1], False, [0, 1]),  # never below two
        ([1, 1, 1, 1], False, [0, 0, 0, 1]),
        ([50, 0, 50], False, [0, 0, 1]),
    ],
)
def test_merge_rules(counts, left, want):
    got = scores.merged_small(counts, 30, left)
    own = [g for g, c in zip(got, counts, strict=True) if c]
    assert own == [w for w, c in zip(want, counts, strict=True) if c] or sorted(set(own)) == sorted(set(range(len(set(own)))))
    assert len(set(own)) >= 2


def test_conditional_means_vanish(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(rng.normal()), float(rng.gamma(2))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d_raw double, total double")
    out = scores.conditional_scores(df, ["k"])
    assert out.count() == 400
    assert all(abs(r.m) < 1e-12 and r.n >= 30 for r in out.groupBy("k", "bin").agg(F.avg("d_cond").alias("m"), F.count("*").alias("n")).collect())


def test_studentised_residuals(spark):
    rng = np.random.default_rng(2)
    y, r = rng.gamma(2, size=83), rng.normal(size=83)
    df = spark.createDataFrame([(i, "g", float(a), float(b)) for i, (a, b) in enumerate(zip(y, r, strict=True))], "i int, gene string, y double, residual double")
    got = {x.i: x.studentised for x in scores.studentised(df, ["gene"]).collect()}
    k = min(20, max(2, 83 // 10))
    bins = np.searchsorted(np.percentile(y, [100 * i / k for i in range(1, k)]), y, "right")
    sd = {b: np.std(np.abs(r[bins == b])) if (bins == b).sum() >= 3 else np.std(np.abs(r)) for b in set(bins)}
    low = np.percentile(list(sd.values()), 1)
    assert got == pytest.approx({i: r[i] / max(sd[bins[i]], low) for i in range(83)})


def test_tails_can_overlap(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 1.0)], "k string, v double")
    out = expression_tests.tails(df, "v", ["k"])
    assert all(r.disc and r.conc for r in out.collect()) and expression_tests.sides(out).count() == 8


def test_rank_sums(spark):
    a, b = [1.0, 4.0, 4.0, 9.0], [4.0, 5.0, 0.0]
    df = spark.createDataFrame([("g", 1, v) for v in a] + [("g", 0, v) for v in b], "gene string, side int, y double")
    r = expression_tests.rank_sums(df, "y", ["gene"]).head()
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and r.ties == 27 - 3
    t = expression_tests.de_table(df.withColumn("s", F.lit(1)), ["s"]).head()
    assert t.log2fc == pytest.approx(np.log2((4.5 + 1e-6) / (3 + 1e-6)))
    pooled = np.sqrt((3 * np.var(a, ddof=1) + 2 * np.var(b, ddof=1)) / 5)
    assert t.cohens_d == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    flat = spark.createDataFrame([("g", s, 2.0) for s in (0, 1) for _ in range(10)], "gene string, side int, y double")
    assert expression_tests.rank_sums(flat, "y", ["gene"]).head().pval == 1


def test_signed_ranks_drop_zeros(spark):
    d = [0.0, 1.0, -2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([("g", v) for v in d] + [("few", 1.0), ("few", 0.0)], "gene string, delta double")
    (r,) = expression_tests.signed_ranks(df, ["gene"]).collect()
    assert (r.gene, r.m, r.w_pos, r.t_stat, r.n_matched) == ("g", 6, 19, 2, 7)


@pytest.mark.parametrize("layout", ["random", "duplicates", "far"])
def test_knn_is_exact(spark, layout):
    rng = np.random.default_rng(3)
    p = rng.random((60, 2))
    if layout == "duplicates":
        p[10:30] = p[0]
    if layout == "far":
        p[50:] = p[50:] * 1e-3 + 1000
    rows = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [("one", 0, 0.0, 0.0), ("two", 1, 0.0, 0.0), ("two", 2, 5.0, 0.0), ("s", 99, None, 1.0)]
    out = spatial.knn(spark.createDataFrame(rows, "sample_id string, spot_id int, x double, y double"), 6)
    got = sorted((r.src, r.rank, r.dst) for r in out.where("sample_id = 's'").collect())
    want = []
    for i in range(60):
        gap = sorted((np.sqrt((p[i, 0] - p[j, 0]) ** 2 + (p[i, 1] - p[j, 1]) ** 2), j) for j in range(60) if j != i)[:6]
        want += [(i, k, j) for k, (_, j) in enumerate(gap, 1)]
    assert got == sorted(want)
    assert sorted((r.sample_id, r.src, r.dst) for r in out.where("sample_id <> 's'").collect()) == [("two", 1, 2), ("two", 2, 1)]


def test_radius_and_morphometry(spark):
    spots = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 9.0, 9.0)], "s string, spot_id int, x double, y double")
    nuclei = spark.createDataFrame([("a", 1, 1.0, 0.0, "n", 2.0), ("a", 2, 0.0, -1.0, "m", 0.0), ("a", 3, 1.0, 1.0, "n", 5.0)], "s string, nucleus_id int, x double, y double, class_label string, area double")
    out = {r.spot_id: r for r in spatial.morphometry(spots, nuclei, 1.0, ["n"], ["s"]).collect()}
    assert (out[1].nuclear_count, out[1].mean_area, out[1].frac_n) == (2, 2.0, 0.5)  # on the border counts
    assert (out[2].nuclear_count, out[2].mean_area, out[2].frac_n, out[2].nuclear_density) == (0, None, None, 0)


def test_morans_i(spark):
    n = 6
    rows = [("s", i * n + j, float(i), float(j), float(i), 1.0) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, spot_id int, x double, y double, slope double, flat double")
    edges = spatial.knn(df, 4).cache()
    assert spatial.morans_i(edges, df, "slope").head().morans_i > 0.5 and spatial.morans_i(edges, df, "flat").head().morans_i == 0
    w = np.zeros((36, 36))
    for r in edges.collect():
        w[r.src, r.dst] = 1 / 4
    z = np.array([r[4] for r in rows]) - 2.5
    assert spatial.morans_i(edges, df, "slope").head().morans_i == pytest.approx(36 / w.sum() * (z @ w @ z) / (z @ z))
    null = spatial.permuted_morans(edges, df, "slope", 19)
    assert null.count() == 20 and spatial.permutation_p(null, ["sample_id"], "morans_i").head().p == 0.05
    # Within rows of equal values nothing is moved.
    same = spatial.permuted_morans(edges, df.withColumn("g", F.col("x")), "slope", 5, group="g").select("morans_i").collect()
    assert np.ptp([r[0] for r in same]) < 1e-12


def test_shuffles_within_tasks(spark):
    from pathlib import Path

    rng = np.random.default_rng(13)
    rows = [("ab"[i % 3 == 0], i, float(x), float(y), float(z), i % 4) for i, (x, y, z) in enumerate(rng.random((900, 3)))] + [("one", 2000, 0.0, 0.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "sample_id string, spot_id int, x double, y double, z double, ring int")
    near = spatial.knn(df, 6)
    edges = spark.createDataFrame(near.collect(), near.schema)
    size = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("*") if p.is_file())
    for group in (None, "ring"):
        before = size()
        got = {(r.sample_id, r.perm): r.morans_i for r in spatial.permuted_morans(edges, df, "z", 299, 5, group).collect()}
        assert size() - before < 1e5  # 375 kB with an array of every spot's values under all shuffles
        want = {(r.sample_id, r.perm): r.morans_i for r in spatial.permuted_morans(edges, df, "z", 299, 5, group, held=400).collect()}  # the larger sample is sorted as rows
        assert len(got) == 900 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and got["one", 0] == 0
    # One shuffle by hand.
    z = np.array([r[4] for r in rows if r[0] == "b"])
    ids = [r[1] for r in rows if r[0] == "b"]
    order = sorted(range(len(ids)), key=lambda j: hashlib.md5(f"5|7|{ids[j]}".encode()).hexdigest())
    at = {i: v for i, v in zip(ids, (z - z.mean())[order], strict=True)}
    top = sum(at[r.src] * at[r.dst] / 6 for r in edges.where("sample_id = 'b'").collect())
    free = {r.perm: r.morans_i for r in spatial.permuted_morans(edges, df.where("sample_id = 'b'"), "z", 9, 5).collect()}
    assert free[7] == pytest.approx(top / ((z - z.mean()) ** 2).sum())


def test_rings(spark):
    rng = np.random.default_rng(4)
    p = rng.random((300, 2))
    df = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [("flat", i, float(i), 0.0) for i in range(3)], "sample_id string, spot_id int, x double, y double")
    out = spatial.rings(df).toPandas()
    own = out[out["sample_id"] == "s"]
    assert len(out) == 303 and set(out[out["sample_id"] == "flat"]["ring"]) == {0}
    assert own.groupby("ring").size().min() >= 10 and own["edge_dist"].min() < 1e-9
    assert (own.groupby("ring")["edge_dist"].max().to_numpy()[:-1] <= own.groupby("ring")["edge_dist"].min().to_numpy()[1:]).all()


def test_matching(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sample_id string, spot_id int, vector array<double>")
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = matching.nearest_vectors(df.where("spot_id < 15"), df.where("spot_id >= 15"), 5, block=8).collect()
    for i in range(15):
        gap = sorted((round(float(np.sqrt(max(0, 2 - 2 * u[i] @ u[j]))), 9), j) for j in range(15, 40))[:5]
        assert [(r.dist, r.dst) for r in sorted((r for r in out if r.src == i), key=lambda r: r.rank)] == gap
    few = matching.nearest_vectors(df.where("spot_id < 2"), df.where("spot_id in (7, 8)"), 5)
    assert few.count() == 4


def test_split_half_sizes(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(9)], "gene string")
    tracks = agreement.halves(genes, 42)
    assert sorted(r["count"] for r in tracks.groupBy("track").count().collect()) == [4, 5]
    assert tracks.exceptAll(agreement.halves(genes.repartition(5), 42)).isEmpty()


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, "xyz"[i % 3]) for i in range(30)], "a int, b string")
    assert agreement.adjusted_rand(same, "a", "b").head().ari == 1
    far = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "a int, b int")
    assert abs(agreement.adjusted_rand(far, "a", "b").head().ari) < 0.1


def test_ks(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 30), rng.integers(2, 12, 40)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "s string, v double")
    r = agreement.ks_pairs(df, "s", "v", spark.createDataFrame([("a", "b")], "a string, b string")).head()
    assert r.d == pytest.approx(max(abs((a <= t).mean() - (b <= t).mean()) for t in range(13))) and (r.n_a, r.n_b) == (30, 40)


def test_folds(spark):
    dim = spark.createDataFrame([("c", p, f"{p}{i}") for p in "abc" for i in range(2)], "cohort string, patient string, sample_id string")
    out = profile.fold_arrays(profile.folds(dim)).orderBy("fold").collect()
    assert [(r.fold, r.test_patient, r.test_samples, r.n_train_samples) for r in out] == [(0, "a", ["a0", "a1"], 4), (1, "b", ["b0", "b1"], 4), (2, "c", ["c0", "c1"], 4)]


def test_constant_gene_has_no_correlation(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)] + [("h", float(i), float(i)) for i in range(5)], "gene string, y double, yhat double")
    assert {r.gene: r.r for r in profile.gene_pearson(df, ["gene"]).collect()} == {"g": 0, "h": pytest.approx(1)}


@pytest.mark.parametrize("components", [None, 3])
def test_leave_out_ridge(spark, components):
    rng = np.random.default_rng(7)
    x, y, u = rng.normal(2, 3, (90, 5)), rng.normal(1, 1, (90, 2)), np.arange(90) % 4
    df = spark.createDataFrame([(i, str(k), a.tolist(), b.tolist()) for i, (k, a, b) in enumerate(zip(u, x, y, strict=True))], "i int, u string, x array<double>, y array<double>")
    got = {r.i: r.yhat for r in linear.leave_out(df, "x", "y", "u", ["i"], components).collect()}
    for k in range(4):
        t = u != k
        z, zt = ((v - x[t].mean(axis=0)) / x[t].std(axis=0) for v in (x[t], x[~t]))
        if components:
            v = np.linalg.svd(z, full_matrices=False)[2][:components].T
            z, zt = z @ v, zt @ v
        b = np.linalg.solve(z.T @ z + 100 / (z.shape[1] * 2) * np.eye(z.shape[1]), z.T @ y[t])
        for i, p in zip(np.flatnonzero(~t), zt @ b, strict=True):
            assert got[i] == pytest.approx(p.tolist())


def test_least_squares(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2, -1] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(float(a), float(b), float(a), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(1.0, None, 1.0, 1.0)], "a double, b double, a2 double, y double")
    out = linear.ols(df, "y", ["a", "b"])
    d = np.c_[np.ones(60), x]
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    rss = ((y - d @ beta) ** 2).sum()
    assert out["coefficient"].to_numpy() == pytest.approx(beta) and out["n"].iloc[0] == 60
    assert out["std_error"].to_numpy() == pytest.approx(np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * rss / 57))
    twice = linear.ols(df, "y", ["a", "a2"])
    assert twice["std_error"].isna().all() and twice["coefficient"].iloc[1] == pytest.approx(twice["coefficient"].iloc[2])
    v = linear.vif(df.where("b is not null"), ["a", "b", "a2"])
    assert v["a"] == float("inf") and v["b"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))


def test_predictors_without_spread(spark):
    from gridloom.plans.composed import predictors

    rng = np.random.default_rng(12)
    a = rng.normal(2, 3, 20)
    y = 0.5 * a + rng.normal(0, 0.1, 20)
    df = spark.createDataFrame([(f"g{i}", float(v), float(x), 8) for i, (v, x) in enumerate(zip(y, a, strict=True))], "gene string, y double, a double, sets long")
    own = predictors(df, "y", ["a", "sets"])
    z = (a - a.mean()) / a.std()
    assert {r.gene: (r.a, r.sets) for r in own.collect()} == {f"g{i}": (pytest.approx(x), 0) for i, x in enumerate(z)}
    fit = linear.ols(own, "y", ["a", "sets"])
    assert fit["coefficient"].to_numpy() == pytest.approx([*np.linalg.lstsq(np.c_[np.ones(20), z], y, rcond=None)[0], 0]) and fit["std_error"].isna().all()
    held = linear.ols_folds(linear.fold_numbers(own, "gene", 5, 3), "y", ["a", "sets"], "fold", ["gene"]).toPandas()
    assert len(held) == 20 and (held["actual"] - held["predicted"]).abs().max() < 0.5


def test_summary_works_cells_out_once(spark, monkeypatch):
    from gridloom.plans import composed, views

    d, plain, calls = "/root/testdata/sf0.001", views.cells, []
    monkeypatch.setattr(views, "cells", lambda *a, **k: calls.append(1) or plain(*a, **k))
    composed.a72_summary(spark, d)
    assert len(calls) == 1
    tracks, seen, keys = agreement.halves(views.panel(spark, d), 42), views.predicted(spark, d), ["cohort", "encoder"]
    plainly = agreement.split_half(views.predictions(spark, d, dense=seen), tracks, keys).select(*keys, "rho", "n").collect()
    shared = agreement.halves_agree(views.half_scores(spark, d, tracks, seen), keys).select(*keys, "rho", "n").collect()
    assert len(shared) == 6 and {tuple(r)[:2]: (pytest.approx(r.rho), r.n) for r in shared} == {tuple(r)[:2]: (r.rho, r.n) for r in plainly}


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9)))
def test_jaccard(spark, a, b):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "g int")
    r = expression_tests.overlap(one(a), one(b), ["g"]).head()
    assert r.n_both == len(a & b) and r.jaccard == pytest.approx(len(a & b) / len(a | b) if a | b else 0)


def test_text_sources(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("A\tabout\tg1\tg2\t\t\nB\tabout\n\nC\tabout\tg3\n")
    assert sorted(map(tuple, files.gene_sets(spark, str(tmp_path / "sets.gmt")).collect())) == [("A", "g1"), ("A", "g2"), ("C", "g3")]
    feature = lambda props, kind, xy: {"properties": props, "geometry": {"type": kind, "coordinates": xy}}
    geo = {"features": [feature({"centroid": [1, 2], "class": "n"}, "Polygon", [[[0, 0], [2, 0], [1, 3]]]), feature({"area": 3.5}, "Point", [5, 6]), feature({"type_tissue": "t", "class": "n"}, "Polygon", [[[0, 0], [2, 0], [1, 3]]]), feature({}, "LineString", [[0, 0]])]}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "S1.geojson").write_text(json.dumps(geo))
    assert sorted((r.x, r.y, r.class_label) for r in files.geojson_nuclei(spark, str(tmp_path / "g")).collect()) == [(1, 1, "t"), (1, 2, "n"), (5, 6, "unknown")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "S1.json").write_text(json.dumps({"nuc": {"7": {"centroid": [1, 2], "type": 2}, "8": {"centroid": [3, 4], "type": "own"}, "9": {"type": 1}}}))
    assert sorted((r.id, r.class_label) for r in files.dict_nuclei(spark, str(tmp_path / "d")).collect()) == [("7", "inflammatory"), ("8", "own")]
    best = files.sample_files(spark, str(tmp_path), "S1").where("preference = 1").head()
    assert best.path.endswith("S1.geojson")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "S9_de.csv").write_text("gene,p\na,0.5\n")
    assert list(map(tuple, files.csv_folder(spark, str(tmp_path / "c"), "gene string, p double", r"^(\w+)_de").collect())) == [("a", 0.5, "S9")]
    metrics = spark.createDataFrame([(json.dumps({"g": {"pearson": 0.5, "pvalue": 0.1}, "__summary__": {"pearson": 1}}),)], "value string")
    assert list(map(tuple, files.gene_metrics(metrics).collect())) == [("g", 0.5, 0.1)]
    want = spark.createDataFrame([("S1", "geo", "S1.geojson"), ("S2", "geo", "S2.geojson")], "sample_id string, kind string, name string")
    assert {r.sample_id: r.complete for r in files.completeness(spark, str(tmp_path), want).collect()} == {"S1": True, "S2": False}
    assert tables.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_dense_expression(spark):
    spots = spark.createDataFrame([(1,), (2,)], "spot_id int")
    panel = spark.createDataFrame([("a",), ("b",)], "gene string")
    expression = spark.createDataFrame([(1, "a", 3.0), (1, "zz", 9.0)], "spot_id int, gene string, value double")
    out = sorted(map(tuple, tables.densified(spots, expression, panel, ["spot_id"]).collect()))
    assert out == [(1, "a", 3.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0)]
    assert sorted(map(tuple, tables.one_gene(spots, expression, "a", ["spot_id"]).collect())) == [(1, 3.0), (2, 0.0)]


def test_permuted_morans_by_hand(spark):
    """Every shuffle against a plain loop, freely and within groups (a null is one); samples without edges or spread have 0."""
    import hashlib

    rng = np.random.default_rng(8)
    n = 40
    rows = [("a", i, float(rng.normal()), ["x", "y", None][i % 3]) for i in range(n)] + [("flat", i, 2.0, "x") for i in range(5)] + [("alone", 1, 1.0, "x"), ("alone", 2, 3.0, "x")]
    df = spark.createDataFrame(rows, "sample_id string, spot_id int, v double, g string")
    pairs = [(i, int(j)) for i in range(n - 2) for j in rng.choice([x for x in range(n) if x != i], rng.integers(1, 5), replace=False)]
    edges = spark.createDataFrame([("a", i, j) for i, j in pairs] + [("flat", 0, 1)], "sample_id string, src int, dst int")
    z = np.array([r[2] for r in rows[:n]])
    z -= z.mean()
    for group in (None, "g"):
        got = {(r.sample_id, r.perm): r.morans_i for r in spatial.permuted_morans(edges, df, "v", 7, 3, group).collect()}
        assert len(got) == 3 * 8 and all(v == 0 for (s, _), v in got.items() if s != "a")
        for perm in range(8):
            own = z.copy()
            if perm:
                for members in [list(range(n))] if group is None else [[i for i in range(n) if i % 3 == m] for m in range(3)]:
                    drawn = sorted(members, key=lambda i, perm=perm: (hashlib.md5(f"3|{perm}|{i}".encode()).hexdigest(), i))
                    own[members] = z[drawn]
            lag = {i: np.mean([own[j] for a, j in pairs if a == i]) for i in {a for a, _ in pairs}}
            want = n / len(lag) * sum(own[i] * v for i, v in lag.items()) / (own @ own)
            assert got["a", perm] == pytest.approx(want, abs=1e-12)


def test_close_vectors_meet_few_cells(spark):
    rng = np.random.default_rng(15)
    mids = rng.normal(size=(20, 16))
    x = mids[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    x[5], x[7] = x[6], x[6]
    df = spark.createDataFrame([("s" if i % 3 else "t", i, v.tolist()) for i, v in enumerate(x)], "sample_id string, spot_id int, vector array<double>")
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = matching.nearest_vectors(df.where("spot_id % 5 = 1"), df.where("spot_id % 5 <> 1"), 4, block=64).toPandas().sort_values(["src", "rank"])
    found = {src: list(zip(g["dist"], g["dst"], strict=True)) for src, g in out.groupby("src")}
    i, j = np.arange(3000)[np.arange(3000) % 5 == 1], np.arange(3000)[np.arange(3000) % 5 != 1]
    gap = np.round(np.sqrt(np.maximum(0, 2 - 2 * u[i] @ u[j].T)), 9)
    gap[(i % 3 == 0)[:, None] != (j % 3 == 0)[None]] = np.inf
    for row, src in zip(gap, i, strict=True):
        best = np.lexsort((j, row))[:4]
        assert [d for _, d in found[src]] == j[best].tolist() and np.allclose([d for d, _ in found[src]], row[best], atol=1e-8)
    own = matching.nearest_vectors(df, df, 1, block=64, same=True).where("src in (5, 6, 7)").collect()
    assert {(r.src, r.dst) for r in own} >= {(5, 7), (7, 5)} and all(r.src != r.dst for r in own)
    # Of all pairs of a row and a cell, few are left with the k-th distance as the limit.
    rows = df.where("sample_id = 's'").select("sample_id", F.col("spot_id").alias("id"), columns.normalised(F.col("vector")).alias("v"))
    celled, cells = matching.vector_cells(rows, "sample_id", block=64)
    n = cells.count()
    assert n > 15 and cells.agg(F.sum("n")).head()[0] == 2000
    limit = out[out["rank"] == 4]["dist"].max()
    more = matching.further_cells(celled.withColumn("tau", F.lit(float(limit))), cells, "sample_id").count()
    assert more < 0.25 * 2000 * n


def test_vectors_without_partners(spark):
    kind = "sample_id string, spot_id int, vector array<double>"
    df = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, None), (None, 3, [1.0, 0.0]), ("t", 4, [0.0, 1.0])], kind)
    none = spark.createDataFrame([], kind)
    assert matching.nearest_vectors(df, none, 3).count() == 0 and matching.nearest_vectors(none, df, 3).count() == 0
    assert [(r.src, r.dst) for r in matching.nearest_vectors(df, df.where("sample_id = 's'"), 3).collect()] == [(1, 1)]


def test_ks_over_ranges(spark):
    rng = np.random.default_rng(16)
    own = {s: rng.integers(0, 50, n).astype(float) + shift for s, n, shift in (("a", 400, 0), ("b", 300, 3), ("c", 5, 60), ("d", 200, 0))}
    df = spark.createDataFrame([(s, float(v)) for s, values in own.items() for v in values] + [("a", None)], "s string, v double")
    pairs = spark.createDataFrame([(a, b) for a in "abcde" for b in "abcde" if a < b], "a string, b string")
    out = {(r.a, r.b): r for r in agreement.ks_pairs(df, "s", "v", pairs, range_rows=20).collect()}
    assert set(out) == {(a, b) for a in "abcd" for b in "abcd" if a < b}
    for (a, b), r in out.items():
        far = max(abs((own[a] <= t).mean() - (own[b] <= t).mean()) for t in np.unique(np.concatenate([own[a], own[b]])))
        assert r.d == pytest.approx(far, abs=1e-12) and (r.n_a, r.n_b) == (len(own[a]), len(own[b]))


def test_ks_reads_values_once(spark):
    """Values go through the shuffle by section and value, and by range; pairs meet counts of ranges alone."""
    df = spark.createDataFrame([(s, float(i)) for s in "abcdefgh" for i in range(200)], "s string, v double")
    pairs = spark.createDataFrame([(a, b) for a in "abcdefgh" for b in "abcdefgh" if a < b], "a string, b string")
    out = agreement.ks_pairs(df, "s", "v", pairs, range_rows=100).collect()
    assert len(out) == 28 and all(r.d == 0 and r.n_a == 200 for r in out)


def test_density_overlap(spark):
    rng = np.random.default_rng(17)
    own = {"a": rng.normal(0, 1, 900), "b": rng.normal(1, 2, 500), "c": np.append(rng.exponential(1, 300), [40.0])}
    df = spark.createDataFrame([(s, float(v)) for s, values in own.items() for v in values] + [("flat", 1.0), ("flat", 1.0), ("a", None)], "s string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "flat")], "a string, b string")
    out = {(r.a, r.b): r.overlap for r in agreement.kde_overlap(df, "s", "v", pairs).collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), found in out.items():
        low, high = min(own[a].min(), own[b].min()), max(own[a].max(), own[b].max())
        at = np.linspace(low - 0.05 * (high - low), high + 0.05 * (high - low), 1000)
        f = []
        for v in (own[a], own[b]):
            h = v.std(ddof=1) * len(v) ** -0.2
            f.append(np.exp(-0.5 * ((at[:, None] - v[None]) / h) ** 2).sum(axis=1) / (h * np.sqrt(2 * np.pi) * len(v)))
        m = np.minimum(*f)
        assert found == pytest.approx(((m[1:] + m[:-1]) / 2 * np.diff(at)).sum(), abs=1e-10)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_send_small_sides_only(spark):
    """Estimates take a compressed file for a small table, so the sides to send are named: cells and arrays of shuffles are none."""
    from gridloom.operators import spatial
    from gridloom.plans import views

    d = "/root/testdata/sf0.001"
    model = optimized(views.predictions(spark, d))
    assert "rightHint=(strategy=broadcast)" in model.split("Join")[1]
    p = views.points(spark, d)
    null = optimized(spatial.permuted_morans(spatial.knn(p, 3), p, "z", 5))
    assert null.count("rightHint=(strategy=merge)") == 2
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0)], "i int, gene string, v double")
    sets = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "pathway string, gene string")
    out = scores.set_scores(df, sets, ["i"], "v", least=2, panel=df.select("gene"))
    assert "rightHint=(strategy=broadcast)" in optimized(out) and out.collect() == scores.set_scores(df, sets, ["i"], "v", least=2).collect()


def test_dense_cells_of_a_spot_stay_together(spark):
    """Spots are shuffled and not cells: genes are laid out above the join, and no exchange lies above that."""
    spots = spark.createDataFrame([(i, i % 2) for i in range(50)], "spot_id int, side int").repartition(3)
    expression = spark.createDataFrame([(i, g, float(i)) for i in range(0, 50, 3) for g in "abx"], "spot_id int, gene string, value double")
    panel = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "gene string")
    out = tables.densified(spots, expression, panel, ["spot_id"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode(") < plan.index("Join")
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("spot_id").agg(F.countDistinct("p").alias("n"), F.count("*").alias("c"))
    assert [tuple(r) for r in parts.select("n", "c").distinct().collect()] == [(1, 3)]
    want = [(i, g, i % 2, float(i) if i % 3 == 0 and g != "c" else 0.0) for i in range(50) for g in "abc"]
    assert sorted(map(tuple, out.collect())) == want


def test_subsampled_halves(spark):
    """Every split by hand; a spot is never copied for a split, so no window ranks rows of spots and splits."""
    rng = np.random.default_rng(21)
    genes = [f"g{i}" for i in range(7)]
    cells = [(None if s < 3 else "pq"[s % 2], s, g, float(np.round(rng.normal(), 1 if s % 5 else 9))) for s in range(63) for g in genes if (s + int(g[1])) % 11]
    df = spark.createDataFrame(cells, "patient string, spot_id int, gene string, residual double").repartition(3)
    panel = spark.createDataFrame([(g,) for g in genes], "gene string")
    out = agreement.subsampled(df, panel, [1, 3], 4, ["patient"], seed=2, least=4)
    assert "Window" not in optimized(out) and out.columns == ["patient", "n_genes", "split", "rho", "n"]
    plan = {}
    for split in range(4):
        order = sorted(genes, key=lambda g: hashlib.md5(f"2|{split}|{g}".encode()).hexdigest())
        plan |= {(n, split): (order[:n], order[n : 2 * n]) for n in (1, 3)}
    want = {}
    for p in "pq":
        own = {s: {g: abs(v) for q, t, g, v in cells if t == s} for q, s, _, _ in cells if q == p}
        for key, sides in plan.items():
            there = [v for v in own.values() if any(g in v for side in sides for g in side)]
            means = [[round(sum(v[g] for g in side if g in v) / len([g for g in side if g in v]), 9) if any(g in v for g in side) else -1.0 for v in there] for side in sides]
            ranks = [pd.Series(m).rank() for m in means]
            want[p, *key] = (np.corrcoef(*ranks)[0, 1], len(there))
    got = {(r.patient, r.n_genes, r.split): (r.rho, r.n) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)
    assert agreement.subsampled(df, panel, [1, 3], 4, ["patient"], seed=2, least=3).where("patient is null").count() <= 8
    assert agreement.subsampled(df, panel.limit(0), [1], 2, ["patient"]).count() == 0


def test_profiles_without_spread(spark):
    df = spark.createDataFrame([(s, p, v) for s, v in (("a", 1.0), ("b", 2.0)) for p in "xyz"], "s string, gene string, mar double")
    assert agreement.profile_pairs(df, "s").head()["r"] == 0
    assert np.isnan(agreement.profile_pairs(df, "s", without=float("nan")).head()["r"])


def test_blocks_are_compared_in_slices():
    """Two blocks of 2,000 vectors by hand; all distances at once would be 32 MB, and their order as much again."""
    rng = np.random.default_rng(22)
    x, y = (pd.DataFrame({"id": rng.permutation(2000), "v": list(rng.normal(size=(2000, 16)))}) for _ in "xy")
    for df in (x, y):
        df["v"] = [v / np.sqrt(v @ v) for v in df["v"]]
    tracemalloc.start()
    src, dst, dist = matching.nearest_in_block(x, y, 3, same=True)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    u, w = np.stack(x["v"]), np.stack(y["v"])
    gap = np.round(np.sqrt(np.maximum(0, 2 - 2 * u @ w.T)), 9)
    gap[x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None]] = np.inf
    want = [(i, j, g) for i, row in zip(x["id"], gap, strict=True) for g, j in sorted(zip(row, y["id"], strict=True))[:3]]
    assert [v[:2] for v in want] == list(zip(src, dst, strict=True)) and np.allclose(dist, [v[2] for v in want], atol=1e-8)


SMALL = "/root/testdata/sf0.001"


def test_counted_rank_sums_equal_spread_ones(spark):
    """values are counted before they are ranked; nulls, ties and a side without spread give what rows give."""
    rng = np.random.default_rng(5)
    rows = [(k, int(s), float(v)) for k in "ab" for s, v in zip(rng.integers(0, 2, 60), rng.integers(-3, 9, 60), strict=True)] + [("c", s, v) for s in (0, 1) for v in (0.1, 0.1, 0.1)] + [("a", 1, None), ("a", 0, None)]
    df = spark.createDataFrame(rows, "k string, side int, v double")
    got, want = (expression_tests.rank_sums(df, "v", ["k"], spread).orderBy("k").toPandas() for spread in (False, True))
    for c in want.columns:
        assert got[c].tolist() == pytest.approx(want[c].tolist(), rel=1e-12, abs=1e-15, nan_ok=True) if c != "k" else got[c].tolist() == want[c].tolist()
    assert got.set_index("k").loc["c", "var_disc"] == 0
    plan = expression_tests.rank_sums(df, "v", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.rindex("Aggregate [k")  # what is sorted comes out of the counts


def test_differential_tests_work_out_cells_once(spark, monkeypatch):
    """scores and tests read the same cells."""
    from gridloom.plans import differential, views

    calls, own = [], views.cells
    monkeypatch.setattr(views, "cells", lambda *a, **k: calls.append(1) or own(*a, **k))
    differential.de(spark, SMALL)
    assert len(calls) == 1


def test_averaged_residuals_are_not_shuffled(spark):
    """a cell holds the predictions of all encoders, so their mean needs no shuffle."""
    import re

    from gridloom.plans import views

    got = views.averaged_residuals(spark, SMALL)
    assert not re.search(r"hashpartitioning\([^)]*spot_id", got._jdf.queryExecution().executedPlan().toString())
    want = scores.averaged_residuals(views.predictions(spark, SMALL)).select(*got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_expression_is_dealt_by_spot_alone(spark):
    """F55 and all that reads cells: no shuffle by spot and gene before the one by spot."""
    import re

    from gridloom.plans import views

    plan = views.cells(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(spot_id#\d+L, gene", plan)


def test_vectors_take_their_own_cells(spark):
    """only lines of spots with a vector are joined and added, with the same rows."""
    from gridloom.plans import views

    only = views.points(spark, SMALL).select("spot_id").where("spot_id % 3 = 0")
    got, want = views.cells(spark, SMALL, only), views.cells(spark, SMALL).join(only, "spot_id", "left_semi")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 3


def test_exact_laws_are_dealt_to_tasks(spark):
    """each pair's law takes n_a * n_b steps, so pairs do not share one task."""
    from gridloom.plans import spatial

    assert spatial.a58_ks_p(spark, SMALL).rdd.getNumPartitions() > 8


def lone_segment(spark):
    """Cells where a patient alone has a segment and another alone a side, so that encoders m2 and m3 lack predictions."""
    rng = np.random.default_rng(48)
    rows = []
    for i in range(40):
        patient = "pqr"[i % 3]
        segment = "lone" if patient == "p" and i % 2 else "shared"
        side = "neg" if patient == "q" and i % 4 == 0 else "pos"
        rows += [("c" if patient != "r" else "d", patient, f"{patient}{i % 2}", i, segment, side, g, round(float(rng.exponential()), 9)) for g in "abc"]
    return spark.createDataFrame(rows, "cohort string, patient string, sample_id string, spot_id long, segment string, side string, gene string, y double")


def test_mean_residuals_add_encoders_in_rows(spark, monkeypatch):
    """profiles are those of the predictions, also where encoders lack some."""
    from gridloom.operators import agreement
    from gridloom.plans import views

    dense = views.written(lone_segment(spark))
    monkeypatch.setattr(views, "written_cells", lambda *a: dense)
    rows = views.predictions(spark, SMALL)
    per = {r["encoder"]: r["count"] for r in rows.groupBy("encoder").count().collect()}
    assert 0 < per["m2"] < per["m1"] and 0 < per["m3"] < per["m1"]
    for keys in (["patient", "sample_id"], ["cohort"]):
        got, want = views.mean_residuals(spark, SMALL, keys), agreement.profiles(rows, keys)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_reproducibility_works_out_cells_once(spark, monkeypatch):
    """comparison and nearest sections share one profile, and what several metrics read is no plan over cells."""
    from gridloom.plans import composed, views

    calls, own = [], views.cells
    monkeypatch.setattr(views, "cells", lambda *a, **k: calls.append(1) or own(*a, **k))
    out = composed.q7_reproducibility(spark, SMALL)
    assert len(calls) == 1 and "yhat" not in optimized(out) and out.count() == 6


def test_scores_shuffle_a_row_for_each_spot(spark, monkeypatch):
    """encoders share a spot's row on the way, with the rows that one row for each encoder gives."""
    import re

    from gridloom.plans import spatial, views

    dense = views.written(lone_segment(spark))
    want = scores.raw_scores(views.predictions(spark, SMALL, dense=dense), ["cohort", "patient", "sample_id", "spot_id", "encoder"])
    monkeypatch.setattr(views, "written_cells", lambda *a: dense)
    got = views.spot_scores(spark, SMALL).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()
    own, _ = spatial.section_values(spark, SMALL)
    means = want.groupBy("sample_id", "spot_id").agg(F.round(F.avg("d_raw"), 9).alias("v")).select("sample_id", "v")
    assert own.exceptAll(means).count() == means.exceptAll(own).count() == 0 < means.count()
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\([^)]*spot_id", plan)) == 1 and "d_raw" not in plan  # nor are scores written on the way


def test_density_overlap_reads_values_once(spark):
    """the values are written before their bandwidths and histograms are taken."""
    from gridloom.operators import agreement

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame([("s" if i % 2 else "t", float(i % 7)) for i in range(200)], "s string, v double").mapInPandas(seen, "s string, v double")
    pairs = spark.createDataFrame([("s", "t")], "a string, b string")
    assert agreement.kde_overlap(df, "s", "v", pairs, 100).count() == 1 and read.value == 200
