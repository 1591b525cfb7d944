"""Ridge, components and boosted trees against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import linear, trees
from gridloom.operators.moments import moments


def frame(spark, u, x, y):
    rows = [(i, str(k), a.tolist(), b.tolist()) for i, (k, a, b) in enumerate(zip(u, x, y, strict=True))]
    return spark.createDataFrame(rows, "i int, u string, x array<double>, y array<double>")


def test_moments_of_wide_vectors(spark):
    from pyspark.sql import functions as F

    own = spark.range(0, 240, 1, 6).select((F.col("id") % 2).alias("u"), F.transform(F.sequence(F.lit(0), F.lit(1535)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(17)).cast("double")).alias("v"))
    got = moments(own, "v", "u")
    assert got.table.count() == 2 * 49 * 50 // 2  # blocks of the upper triangle, once for each unit
    both = got.collected()
    for r in (0, 1):
        x = np.array([v.v for v in own.where(F.col("u") == r).collect()])
        assert both[str(r)].n == 120 and (both[str(r)].s == x.sum(axis=0)).all() and (both[str(r)].p == x.T @ x).all()
    total = got.total()
    assert total.n == 240 and (total.p == both["0"].p + both["1"].p).all()
    assert moments(own.limit(0), "v", "u").total() is None


@pytest.mark.parametrize(("components", "intercept"), [(None, False), (4, False), (None, True), (4, True)])
def test_ridge_grid(spark, components, intercept):
    rng = np.random.default_rng(3)
    x, u = rng.normal(1, 2, (80, 6)), np.arange(80) % 4
    y = x[:, :2] @ rng.normal(size=(2, 3)) + rng.normal(3, 1, (80, 3))
    df = frame(spark, u, x, y)
    got = linear.ridge_grid(df.unionByName(df.limit(1).selectExpr("i", "u", "cast(null as array<double>) x", "y")), "x", "y", "u", components=components, intercept=intercept)
    assert list(got) == pytest.approx(np.logspace(-3, 3, 20))
    for a in (linear.ALPHAS[0], linear.ALPHAS[13]):
        error = 0.0
        for k in range(4):
            t = u != k
            z, zt = ((v - x[t].mean(axis=0)) / x[t].std(axis=0) for v in (x[t], x[~t]))
            if components:
                axes = np.linalg.svd(z, full_matrices=False)[2][:components].T
                z, zt = z @ axes, zt @ axes
            start = y[t].mean(axis=0) if intercept else 0
            b = np.linalg.solve(z.T @ z + a * np.eye(z.shape[1]), z.T @ (y[t] - y[t].mean(axis=0)))
            error += ((y[~t] - start - zt @ b) ** 2).sum()
        assert got[a] == pytest.approx(error / y.size)
    assert linear.ridge_grid(df.where("u = '1'"), "x", "y", "u") == {} and linear.ridge_grid(df.limit(0), "x", "y", "u") == {}


def test_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 7))
    pc, shares = linear.components(frame(spark, np.zeros(50), x, x), "x", ["i"], 3)
    z = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    v = v[:3] * np.sign(v[np.arange(3), np.abs(v[:3]).argmax(axis=1)])[:, None]
    assert shares == pytest.approx((s**2 / (s**2).sum())[:3])
    for r in pc.collect():
        assert r.pc == pytest.approx((z @ v.T)[r.i])


def plain_trees(x, y, cuts, o):
    """One output's trees, one row after the other; gives a function of new rows."""
    start, rest, made = y.mean(), y - y.mean(), []

    def grow(at, depth):
        s, n, best = rest[at].sum(), len(at), (1e-9, None)
        for f in range(x.shape[1] if depth else 0):
            for c in cuts[f]:
                left = at[x[at, f] <= c]
                if 0 < len(left) < n:
                    a = rest[left].sum()
                    gain = a * a / (len(left) + o.l2) + (s - a) ** 2 / (n - len(left) + o.l2) - s * s / (n + o.l2)
                    best = max(best, (gain, (f, c)), key=lambda b: b[0])
        if best[1] is None:
            return o.rate * s / (n + o.l2)
        f, c = best[1]
        return f, c, grow(at[x[at, f] <= c], depth - 1), grow(at[x[at, f] > c], depth - 1)

    def value(tree, v):
        while isinstance(tree, tuple):
            tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(o.rounds):
        made.append(grow(np.arange(len(x)), o.depth))
        rest = rest - np.array([value(made[-1], v) for v in x])
    return lambda v: start + sum(value(t, v) for t in made)


def test_boosted_trees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, u = rng.normal(size=(120, 4)), np.arange(120) % 3
    y = np.c_[np.where(x[:, 0] > 0, 2, -1) + x[:, 1] ** 2, x[:, 2] * x[:, 3], np.ones(120)] + np.array([0.1, 0.1, 0]) * rng.normal(size=(120, 3))
    o = trees.Boosting(rounds=5, depth=2, bins=8, written_every=2)
    df = frame(spark, u, x, y).repartition(5)
    cuts = [np.unique(np.quantile(x[:, k], [(i + 1) / 8 for i in range(7)], method="inverted_cdf")) for k in range(4)]
    odd = spark.createDataFrame([(500, None, [0.0] * 4, [0.0] * 3), (501, "0", None, [0.0] * 3), (502, "1", [0.0, float("nan"), 0.0, 0.0], [0.0] * 3)], df.schema)
    monkeypatch.setattr(trees, "HELD", 1)  # an output a job
    got = {r.i: r.yhat for r in trees.boosted(df.unionByName(odd), "x", "y", "u", ["i"], o).collect()}
    assert len(got) == 120
    for k in range(3):
        fits = [plain_trees(x[u != k], y[u != k, g], cuts, o) for g in range(3)]
        for i in np.flatnonzero(u == k):
            assert got[i] == pytest.approx([f(x[i]) for f in fits])
    assert trees.boosted(df.where("u = '1'"), "x", "y", "u", ["i"], o).count() == 0
    assert trees.boosted(df.limit(0), "x", "y", "u", ["i"], o).count() == 0


def test_boosted_trees_learn_held_out_rows(spark):
    rng = np.random.default_rng(6)
    x, u = rng.normal(size=(600, 3)), np.arange(600) % 3
    y = np.c_[np.where(x[:, 0] > 0, 2.0, -1.0), 3 * x[:, 1]]
    o = trees.Boosting(rounds=20, depth=2, rate=0.3, rows=0.8, features=0.7)
    out = trees.boosted(frame(spark, u, x, y), "x", "y", "u", ["i"], o)
    got = sorted(out.collect(), key=lambda r: r.i)
    error = ((np.array([r.yhat for r in got]) - y) ** 2).mean(axis=0) / y.var(axis=0)
    assert (error < [0.02, 0.1]).all(), error
