"""Linear models from sums over rows: scaling, principal components, ridge, least squares and their cross-validation.

One scan sums outer products for each fold unit. The sums of a training set are those of
all units less the held-out one, so that no fold reads the rows again. The sums are d x d
numbers for each unit (``moments``) and are bounded by the width of the vectors, not by the
rows; models are fitted in tasks, one for each unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import incomplete_beta

from .moments import Sums, moments


def unit_sums(df: DataFrame, vector: str, unit: str) -> dict[str, Sums]:
    """Sums of a narrow vector column for each of few units."""
    return moments(df, vector, unit).collected()


@dataclass
class Ridge:
    """Coefficients of x as it is, and what is added: scaling and components are folded in."""

    beta: np.ndarray
    start: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.beta + self.start

    def error(self, s: Sums) -> float:
        """Sum of squared errors over the rows behind sums of [x, y]."""
        d, b, c = len(self.beta), self.beta, self.start
        yy, xy, xx, sy, sx = np.diag(s.p)[d:], s.p[:d, d:], s.p[:d, :d], s.s[d:], s.s[:d]
        return float(yy.sum() - 2 * (xy * b).sum() - 2 * c @ sy + ((xx @ b) * b).sum() + 2 * (sx @ b) @ c + s.n * c @ c)


def principal_axes(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes of a covariance matrix by falling variance, each with its largest loading positive, and the variances."""
    w, v = np.linalg.eigh(c)
    v, w = v[:, ::-1][:, :k], w[::-1][:k]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]), w


def ridges(sums: Sums, d: int, alphas: Sequence[float | None], components: int | None = None, intercept: bool = False) -> list[Ridge]:
    """Fit y (columns from d on) on x (the first d) for each alpha, from one decomposition.

    x is scaled by population deviations; an alpha of None is 100 / (components * outputs).
    """
    mean, c = sums.s / sums.n, sums.centred()
    sd = np.sqrt(np.maximum(np.diag(c)[:d], 0) / sums.n)
    sd = np.where(sd > 0, sd, 1.0)
    cx = c[:d, :d] / np.outer(sd, sd)
    k, outputs = min(components or d, d), sums.p.shape[0] - d
    axes, w = principal_axes(cx, k)
    # Scaled x is centred, so its products with y are those with centred y.
    xy = axes.T @ (c[:d, d:] / sd[:, None])
    out = []
    for a in alphas:
        a = 100.0 / (k * outputs) if a is None else a
        beta = axes @ (xy / (np.maximum(w, 0) + a)[:, None]) / sd[:, None]
        out.append(Ridge(beta, (mean[d:] if intercept else 0.0) - mean[:d] @ beta))
    return out


def width(df: DataFrame, vector: str) -> int | None:
    """The length of the first vector that is not empty."""
    head = df.select(F.size(vector).alias("d")).where("d > 0").head()
    return head["d"] if head else None


def leave_out(df: DataFrame, x: str, y: str, unit: str, keys: Sequence[str], components: int | None = None, alpha: float | None = None) -> DataFrame:
    """Predictions of every row by the model of all other units: (keys, unit, y, yhat, residual), arrays over outputs.

    Models are fitted in tasks; x times outputs numbers for each unit are broadcast to the
    rows. A null x, y or unit leaves the row out. Less than two units give no rows.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(unit).isNotNull())
    own = moments(df.withColumn("__v", F.concat(F.col(x), F.col(y))), "__v", unit)
    d, total = width(df, x), own.total()

    def fit(u: str, s: Sums) -> list[tuple]:
        m = ridges(total - s, d, [alpha], components)[0]
        return [(u, m.beta.tobytes(), m.start.tobytes())]

    models = {r["u"]: (r["beta"], r["start"]) for r in own.by_unit(fit, "u string, beta binary, start binary").collect()} if total and own.table.select("u").distinct().count() > 1 else {}
    if not models:
        return df.select(*keys, unit, y, F.col(y).alias("yhat"), F.col(y).alias("residual")).limit(0)
    shared = df.sparkSession.sparkContext.broadcast(models)  # units x width x outputs numbers

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for u, g in b.groupby(unit):
                beta, start = (np.frombuffer(t) for t in shared.value[str(u)])
                yhat = np.stack([np.asarray(v, float) for v in g[x]]) @ beta.reshape(d, -1) + start
                own = np.stack([np.asarray(v, float) for v in g[y]])
                yield g[[*keys, unit]].assign(y=list(own), yhat=list(yhat), residual=list(own - yhat))

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, unit])
    return df.select(*keys, unit, x, y).mapInPandas(score, f"{fields}, y array<double>, yhat array<double>, residual array<double>")


#: Twenty alphas from 0.001 to 1000, evenly spaced on a log scale.
ALPHAS = tuple(10.0 ** (-3 + 6 * i / 19) for i in range(20))


def ridge_grid(df: DataFrame, x: str, y: str, fold: str, alphas: Sequence[float] = ALPHAS, components: int | None = None, intercept: bool = False) -> dict[float, float]:
    """Mean squared error of each alpha over folds, from the folds' sums alone; a task takes a fold and decomposes once for all alphas.

    A null x, y or fold leaves the row out. Less than two folds give no errors.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(fold).isNotNull())
    own = moments(df.withColumn("__v", F.concat(F.col(x), F.col(y))), "__v", fold)
    d, total = width(df, x), own.total()

    def errors(u: str, s: Sums) -> list[tuple]:
        if s.n == total.n:
            return []
        return [(u, k, m.error(s), s.n * len(m.start)) for k, m in enumerate(ridges(total - s, d, alphas, components, intercept))]

    rows = sorted(own.by_unit(errors, "u string, k int, error double, n double").collect()) if total else []
    return {a: math.fsum(r["error"] for r in rows if r["k"] == k) / math.fsum(r["n"] for r in rows if r["k"] == k) for k, a in enumerate(alphas)} if rows else {}


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> pd.DataFrame:
    """Least squares with an intercept: a row for each coefficient with error, t and p, and the fit's r2 and adjusted r2.

    Rows with a null or NaN are left out. A singular design is solved by the pseudo-inverse,
    without errors.
    """
    own = df.select(*[F.col(c).cast("double").alias(c) for c in (*xs, y)])
    for c in own.columns:
        own = own.where(F.col(c).isNotNull() & ~F.isnan(c))
    s = unit_sums(own.select(F.array(F.lit(1.0), *xs, y).alias("v"), F.lit("all").alias("u")), "v", "u").get("all")
    names = ["intercept", *xs]
    if s is None:
        return pd.DataFrame({"feature": names, **{c: np.nan for c in ("coefficient", "std_error", "t_statistic", "p_value", "r2", "adj_r2", "n")}})
    p = len(names)
    a, b, yy, n = s.p[:p, :p], s.p[:p, p], s.p[p, p], s.n
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    g = a / np.outer(scale, scale)
    singular = np.linalg.matrix_rank(g, tol=1e-10) < p
    inverse = np.linalg.pinv(g, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ b
    rss, tss = max(0.0, float(yy - b @ beta)), float(yy - s.s[p] ** 2 / n)
    r2 = 1 - rss / tss if tss > 0 else 0.0
    df_ = n - p
    se = np.full(p, np.nan) if singular or df_ <= 0 else np.sqrt(np.maximum(0, np.diag(inverse)) * rss / df_)
    t = beta / se
    pv = [np.nan if not np.isfinite(v) else incomplete_beta(df_ / 2, 0.5, df_ / (df_ + v * v)) for v in t]
    return pd.DataFrame({"feature": names, "coefficient": beta, "std_error": se, "t_statistic": t, "p_value": pv, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df_ if df_ > 0 else np.nan, "n": int(n)})


def vif(df: DataFrame, xs: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each predictor, infinite where the others determine it."""
    s = unit_sums(df.select(F.array(*[F.col(c).cast("double") for c in xs]).alias("v"), F.lit("all").alias("u")), "v", "u")["all"]
    c = s.centred()
    sd = np.sqrt(np.diag(c))
    r = c / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
    out = {}
    for i, name in enumerate(xs):
        rest = [j for j in range(len(xs)) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10) @ r[rest, i]) if rest else 0.0
        out[name] = math.inf if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return out


def ols_folds(df: DataFrame, y: str, xs: Sequence[str], fold: str, keys: Sequence[str]) -> DataFrame:
    """Held-out predictions of least squares with an intercept, by subtraction of the fold's sums."""
    own = df.withColumn("__v", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in (*xs, y)]))
    sums = unit_sums(own, "__v", fold)
    total = sum(list(sums.values())[1:], next(iter(sums.values())))
    p = len(xs) + 1
    betas = {}
    for u, s in sums.items():
        t = total - s
        scale = np.sqrt(np.where(np.diag(t.p)[:p] > 0, np.diag(t.p)[:p], 1.0))
        betas[u] = np.linalg.pinv(t.p[:p, :p] / np.outer(scale, scale), rcond=1e-10) / np.outer(scale, scale) @ t.p[:p, p]
    # A handful of coefficients for each fold go into the plan as a map.
    table = F.create_map(*[v for u, b in betas.items() for v in (F.lit(u), F.array(*[F.lit(float(x)) for x in b]))])
    b = F.element_at(table, F.col(fold).cast("string"))
    yhat = sum((F.col(c).cast("double") * b[i + 1] for i, c in enumerate(xs)), b[0])
    return own.select(*keys, fold, F.col(y).cast("double").alias("actual"), yhat.alias("predicted"))


def fold_numbers(df: DataFrame, key: str, folds: int, seed: int, out: str = "fold") -> DataFrame:
    """Folds of equal size by a seeded order of the key.

    Rows are counted by the first three digits of their hash; a row's number is its place
    among those that share them, behind all that come before.
    """
    from pyspark.sql import Window as W

    from gridloom.functions.stats import seeded

    rows = df.withColumn("__h", seeded(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    before = F.sum("n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    ahead = rows.groupBy("__b").agg(F.count("*").alias("n")).select(F.col("__b").alias("__a"), F.coalesce(before, F.lit(0)).alias("__ahead"))
    place = F.row_number().over(W.partitionBy("__b").orderBy("__h")) - 1 + F.col("__ahead")
    both = rows.join(F.broadcast(ahead), F.col("__b") == F.col("__a"))  # 4096 rows at most
    return both.withColumn(out, F.pmod(place, F.lit(folds)).cast("int")).drop("__h", "__b", "__a", "__ahead")


def components(df: DataFrame, vector: str, keys: Sequence[str], k: int = 5) -> tuple[DataFrame, list[float]]:
    """Scores on the first k principal components (``pc``, an array) and the shares of variance that they explain."""
    s = unit_sums(df.withColumn("__u", F.lit("all")), vector, "__u")["all"]
    c = s.centred() / s.n
    axes, w = principal_axes(c, k)
    mean = s.s / s.n

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[list(keys)].assign(pc=list((np.stack([np.asarray(v, float) for v in b[vector]]) - mean) @ axes)) if len(b) else b[list(keys)].assign(pc=[])

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c_}` {kinds[c_]}" for c_ in keys)
    return df.select(*keys, vector).mapInPandas(score, f"{fields}, pc array<double>"), (w / np.trace(c)).tolist()


def silhouette(df: DataFrame, vector: str, label: str, item: str) -> DataFrame:
    """Mean silhouette over items (sections): pairs of few rows by definition."""
    a, b = (df.select(F.col(item).alias(f"i{x}"), F.col(label).alias(f"l{x}"), F.col(vector).alias(f"v{x}")) for x in "ab")
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = a.join(b, F.col("ia") != F.col("ib")).withColumn("gap", gap)
    means = pairs.groupBy("ia", "la", "lb").agg(F.avg("gap").alias("m"))
    own = means.groupBy("ia").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("a"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return own.agg(F.avg(s).alias("silhouette"))
