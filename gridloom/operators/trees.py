"""Gradient-boosted trees for many outputs and folds at once.

Features become bins of their quantiles. For each level of a round, one job adds the
residuals and rows of all models by (model, output, feature, node, bin): tasks add their own
rows, Spark adds the tasks' arrays and finds the best split of each node. The driver
gets one row for each model, output and node. Model f is fitted without the rows of fold f,
and its predictions are those of that fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import written

#: Bytes of histograms that a task holds; more outputs than fit take further jobs.
HELD = 256 << 20


@dataclass(frozen=True)
class Boosting:
    """``rows`` and ``features`` are the shares that a round's trees see; ``written_every`` rounds the predictions are written anew."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    l2: float = 1.0
    rows: float = 1.0
    features: float = 1.0
    seed: int = 1
    written_every: int = 8


@dataclass
class Trees:
    """A round's trees of all models and outputs as heaps: feature (-1: no split, all go left), last bin of the left side, value of each leaf."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, model: int, outputs: slice, levels: int) -> np.ndarray:
        """The place of each row on a level, from 0, by row and output."""
        feature, last = self.feature[model, outputs], self.last[model, outputs]
        each, at = np.arange(len(feature))[None], np.zeros((len(x), len(feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for level in range(levels):
            heap = at + 2**level - 1
            f = feature[each, heap]
            at = 2 * at + ((f >= 0) & (x[rows, np.maximum(f, 0)] > last[each, heap]))
        return at

    def predict(self, x: np.ndarray, model: int, outputs: slice = slice(None)) -> np.ndarray:
        depth = self.value.shape[2].bit_length() - 1
        at = self.nodes(x, model, outputs, depth)
        own = self.value[model, outputs]
        return own[np.arange(len(own))[None], at]


def cut_points(df: DataFrame, x: str, bins: int) -> list[list[float]]:
    """Distinct quantiles of each component: a value falls in the bin whose number is how many of them lie below it."""
    at = [(i + 1) / bins for i in range(bins - 1)]
    rows = df.select(F.posexplode(x).alias("k", "v")).groupBy("k").agg(F.percentile_approx("v", at, 10000).alias("q")).orderBy("k").collect()
    return [sorted(set(r["q"])) for r in rows]


def _best(part: np.ndarray, nodes: int, l2: float) -> Iterator[tuple[int, float, int, float, float, float, float]]:
    """For each node the best split of one feature: (node, gain, last bin on the left, residuals and rows on the left, and of all)."""
    own = part.reshape(2, nodes, -1)
    left = own.cumsum(axis=2)[:, :, :-1]
    every = own.sum(axis=2)
    right = every[:, :, None] - left
    score = lambda s, n: s * s / (n + l2)
    gain = score(*left) + score(*right) - score(*every)[:, None]
    gain = np.where((left[1] > 0) & (right[1] > 0), gain, -np.inf)
    for node in range(nodes):
        b = int(gain[node].argmax())
        yield node, float(gain[node, b]), b, float(left[0, node, b]), float(left[1, node, b]), float(every[0, node]), float(every[1, node])


def boosted(df: DataFrame, x: str, y: str, fold: str, keys: Sequence[str], settings: Boosting = Boosting()) -> DataFrame:
    """Held-out predictions of every row: (keys, fold, y, yhat), arrays over outputs.

    ``x`` and ``y`` are arrays of one length each. The loss is half the squared error; a tree
    starts from the mean of the training rows, a split needs a gain above 1e-9 and rows on
    both sides, ties go to the smaller feature and bin, and a leaf's value is
    ``rate * residuals / (rows + l2)``. With ``rows`` below 1 a round takes rows by a seeded hash of
    their keys, with ``features`` below 1 it takes features by a seeded draw.

    * Rows with a null fold, a null array or a null or non-finite number take no part.
    * Repeated rows count as often as they stand there. Less than two folds give no rows.
    * Folds and outputs are few: the driver holds one tree for each and round.
    """
    spark, o = df.sparkSession, settings
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = df.select(*keys, F.col(fold).alias("__fold"), F.col(x).cast("array<double>").alias("__x"), F.col(y).cast("array<double>").alias("__y"))
    sound = sound.where(F.col("__fold").isNotNull() & F.col("__x").isNotNull() & F.col("__y").isNotNull() & ~F.exists("__x", bad) & ~F.exists("__y", bad) & (F.size("__x") > 0))
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    schema = f"{fields}, `{fold}` {kinds[fold]}, y array<double>, yhat array<double>"
    sums = sound.groupBy("__fold").agg(F.count("*").alias("n"), F.first(F.size("__y")).alias("g"))
    folds = sorted(sums.collect(), key=lambda r: r["__fold"])
    if len(folds) < 2:
        return spark.createDataFrame([], schema)
    models, outputs = len(folds), folds[0]["g"]
    number = F.create_map(*[v for i, r in enumerate(folds) for v in (F.lit(r["__fold"]), F.lit(i))])
    own = np.zeros((models, outputs))
    for r in sound.select(number[F.col("__fold")].alias("f"), F.posexplode("__y").alias("k", "v")).groupBy("f", "k").agg(F.sum("v").alias("s")).collect():
        own[r["f"], r["k"]] = r["s"]
    count = np.array([r["n"] for r in folds], float)
    base = (own.sum(axis=0) - own) / (count.sum() - count)[:, None]
    cuts = [np.array(q) for q in cut_points(sound, "__x", o.bins)]
    width, bins = len(cuts), max(2, max(len(q) for q in cuts) + 1)
    table_schema = f"{fields}, __fold {kinds[fold]}, __f int, __h long, __b binary, __y array<double>, __p binary"

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.uint8 if bins <= 256 else np.uint16
        for b in batches:
            v = np.stack(b["__x"].tolist()) if len(b) else np.zeros((0, width))
            code = np.stack([np.searchsorted(q, v[:, k]) for k, q in enumerate(cuts)], axis=1).astype(kind)
            yield b.drop(columns="__x").assign(__b=[r.tobytes() for r in code], __p=[base.tobytes()] * len(b))

    marked = sound.withColumn("__f", number[F.col("__fold")]).withColumn("__h", F.xxhash64(F.lit(o.seed), *keys))
    table = written(marked.mapInPandas(binned, table_schema))

    def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins (row, feature), outputs (row, output), predictions (row, model, output)."""
        code = np.frombuffer(b"".join(b["__b"]), np.uint8 if bins <= 256 else np.uint16).reshape(len(b), width).astype(np.int64)
        return code, np.stack([np.asarray(v, float) for v in b["__y"]]), np.frombuffer(b"".join(b["__p"])).reshape(len(b), models, outputs)

    def level_splits(table: DataFrame, since: list[Trees], tree: Trees, level: int, round_: int) -> Iterator[list]:
        """The best split of every model, output and node of a level."""
        nodes = 2**level
        half, size = nodes * bins, 2 * nodes * bins
        at_once = max(1, HELD // (8 * models * width * size))
        seen = np.sort(np.random.default_rng([o.seed, round_]).permutation(width)[: max(1, round(o.features * width))])
        shared = spark.sparkContext.broadcast((since, tree))
        for first in range(0, outputs, at_once):
            span = slice(first, min(outputs, first + at_once))

            def add(batches: Iterator[pd.DataFrame], span: slice = span) -> Iterator[pd.DataFrame]:
                since, tree = shared.value
                held = np.zeros((models, span.stop - span.start, len(seen), size))
                for b in batches:
                    if o.rows < 1:
                        b = b[_mixed(b["__h"].to_numpy(), round_) < o.rows]
                    if not len(b):
                        continue
                    code, y, p = arrays(b)
                    for m in range(models):
                        use = b["__f"].to_numpy() != m
                        if not use.any():
                            continue
                        c = code[use]
                        rest = y[use, span] - p[use, m, span] - sum((t.predict(c, m, span) for t in since), np.zeros(1))
                        node = tree.nodes(c, m, span, level)
                        places = np.arange(len(seen)) * half + c[:, seen]
                        for g in range(rest.shape[1]):
                            at = (places + node[:, g, None] * bins).ravel()
                            held[m, g, :, :half] += np.bincount(at, rest[:, g].repeat(len(seen)), len(seen) * half).reshape(-1, half)
                            held[m, g, :, half:] += np.bincount(at, minlength=len(seen) * half).reshape(-1, half)
                for m in range(models):
                    for g in range(held.shape[1]):
                        yield pd.DataFrame({"m": m, "g": g + span.start, "f": seen, "t": [h.tobytes() for h in held[m, g]]})

            def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                key, sum_ = None, None
                names = ["m", "g", "node", "f", "gain", "last", "left_s", "left_n", "s", "n"]
                out: list[tuple] = []

                def close() -> None:
                    if key is not None:
                        out.extend((key[0], key[1], node, key[2], *rest) for node, *rest in _best(sum_, nodes, o.l2))

                for b in batches:
                    for m, g, f, t in b[["m", "g", "f", "t"]].itertuples(index=False):
                        if (m, g, f) == key:
                            sum_ += np.frombuffer(t)
                        else:
                            close()
                            key, sum_ = (m, g, f), np.frombuffer(t).copy()
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
                close()
                yield pd.DataFrame(out, columns=names)

            parts = table.mapInPandas(add, "m int, g int, f int, t binary")
            each = parts.repartition("m", "g", "f").sortWithinPartitions("m", "g", "f").mapInPandas(split, "m int, g int, node int, f int, gain double, last int, left_s double, left_n double, s double, n double")
            best = each.groupBy("m", "g", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("last")).alias("last"), "left_s", "left_n", "s", "n")).alias("b"))
            yield best.select("m", "g", "node", "b.*").collect()
        shared.unpersist()

    since: list[Trees] = []
    for round_ in range(o.rounds):
        tree = Trees(np.full((models, outputs, 2**o.depth - 1), -1), np.zeros((models, outputs, 2**o.depth - 1), np.int64), np.zeros((models, outputs, 2**o.depth)))
        for level in range(o.depth):
            for rows in level_splits(table, since, tree, level, round_):
                for r in rows:
                    m, g, node, heap = r["m"], r["g"], r["node"], r["node"] + 2**level - 1
                    sides = [(r["s"], r["n"]), (0.0, 0.0)]
                    if r["gain"] > 1e-9:
                        tree.feature[m, g, heap], tree.last[m, g, heap] = -r["f"], -r["last"]
                        sides = [(r["left_s"], r["left_n"]), (r["s"] - r["left_s"], r["n"] - r["left_n"])]
                    if level == o.depth - 1:
                        tree.value[m, g, 2 * node : 2 * node + 2] = [o.rate * s / (n + o.l2) if n > 0 else 0.0 for s, n in sides]
        since.append(tree)
        if len(since) == o.written_every and round_ + 1 < o.rounds:
            trees = spark.sparkContext.broadcast(since)

            def moved(batches: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:  # noqa: ANN001
                for b in batches:
                    if len(b):
                        code, _, p = arrays(b)
                        p = p + np.stack([sum(t.predict(code, m) for t in trees.value) for m in range(models)], axis=1)
                        yield b.assign(__p=[r.tobytes() for r in p])

            table, since = written(table.mapInPandas(moved, table_schema)), []
    last = spark.sparkContext.broadcast(since)

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                code, y, p = arrays(b)
                f = b["__f"].to_numpy()
                yhat = p[np.arange(len(b)), f].copy()
                for m in np.unique(f):
                    yhat[f == m] += sum((t.predict(code[f == m], m) for t in last.value), np.zeros(1))
                yield b[[*keys, "__fold"]].rename(columns={"__fold": fold}).assign(y=list(y), yhat=list(yhat))

    return table.mapInPandas(held_out, schema)


def _mixed(h: np.ndarray, round_: int) -> np.ndarray:
    """A number from 0 to 1 for each hash and round."""
    z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(round_ + 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
