"""Matching of spots of one group to similar ones of another, within samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.columns import normalised
from gridloom.functions.stats import seeded
from gridloom.sources.tables import written


#: Distances of unit vectors come from inner products, so that small ones are off by some 1e-8.
SLACK = 1e-6
#: Rows that a task compares with a block at once, so that its distances take some megabytes.
AT_ONCE = 256


def nearest_in_block(x: pd.DataFrame, y: pd.DataFrame, k: int, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of x, id of y, distance) of the k nearest rows of y for each row of x, ``AT_ONCE`` rows of x at a time; with ``same`` a row is not its own neighbour."""
    y = y.sort_values("id")
    ids, n, found = y["id"].to_numpy(), min(k, len(y)), []
    for first in range(0, len(x), AT_ONCE):
        some = x.iloc[first : first + AT_ONCE]
        src = some["id"].to_numpy()
        gap = np.round(_gaps(some["v"], y["v"]), 9)  # so that equal distances tie whatever the order of sums
        if same:
            gap[src[:, None] == ids[None]] = np.inf
        by = np.argsort(gap, axis=1, kind="stable")[:, :n]
        dist = np.take_along_axis(gap, by, 1).ravel()
        there = np.isfinite(dist)
        found.append((np.repeat(src, n)[there], ids[by].ravel()[there], dist[there]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _gaps(x: pd.Series, y: pd.Series) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (np.stack(x.to_numpy()) @ np.stack(y.to_numpy()).T)))


def _by_chunks(rows: DataFrame, pivots: DataFrame, sample: str, run: Callable, schema: str, chunk: int = 4096) -> DataFrame:
    """``run`` on chunks of a sample's rows, each with a copy of the sample's pivots."""
    n = rows.groupBy(sample).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    x = rows.join(n, sample).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    p = pivots.join(n, sample).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return x.groupBy(sample, "chunk").cogroup(p.groupBy(sample, "chunk")).applyInPandas(run, schema)


def _homes(rows: DataFrame, pivots: DataFrame, sample: str) -> DataFrame:
    """Rows with the cell of their nearest pivot and their distance ``far`` from it."""
    cols = [sample, "id", "v"]

    def run(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(p):
            return x[cols].head(0).assign(cell=np.zeros(0, np.int32), far=np.zeros(0))
        p = p.sort_values("cell")
        gap = _gaps(x["v"], p["v"])
        at = gap.argmin(axis=1)
        return x[cols].assign(cell=p["cell"].to_numpy()[at], far=gap[np.arange(len(x)), at])

    kinds = dict(rows.dtypes)
    return _by_chunks(rows, pivots, sample, run, f"`{sample}` {kinds[sample]}, id {kinds['id']}, v array<double>, cell int, far double")


def vector_cells(rows: DataFrame, sample: str, block: int = 4096, most_cells: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows (sample, id, v) dealt to cells around pivots, one for ``block`` rows and at most ``most_cells`` a sample.

    Returns the rows with ``cell`` and ``far``, and the cells: pivot ``v``, rows ``n``, and
    the least and largest distance, ``low`` and ``high``, of their rows from it. A pivot is the row of least
    hash in its share of the ids.
    """
    size = rows.groupBy(sample).agg(F.least(F.lit(most_cells), F.ceil(F.count("*") / block)).cast("int").alias("cells"))
    share = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell")
    pivots = rows.join(size, sample).groupBy(sample, share).agg(F.min(F.struct(F.xxhash64(F.lit(3), "id").alias("h"), "id", "v")).alias("p")).select(sample, "cell", "p.v")
    pivots = written(pivots)
    celled = written(_homes(rows, pivots, sample))
    about = celled.groupBy(sample, "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    return celled, written(pivots.join(about, [sample, "cell"]))


def further_cells(asked: DataFrame, cells: DataFrame, sample: str) -> DataFrame:
    """(sample, id, cell): the cells apart from their own that may hold a row within ``tau`` of rows (sample, id, v, cell, tau).

    A row of a cell is no nearer than what the triangle inequality leaves of the distance
    from its pivot, nor than half of what that distance exceeds the one from the nearest pivot by.
    """

    def run(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(p):
            return pd.DataFrame({sample: x[sample].head(0), "id": x["id"].head(0), "cell": np.zeros(0, np.int32)})
        gap, low, high = _gaps(x["v"], p["v"]), p["low"].to_numpy(), p["high"].to_numpy()
        least = np.maximum(np.maximum(gap - high, low - gap), (gap - gap.min(axis=1, keepdims=True)) / 2)
        may = (least <= x["tau"].to_numpy()[:, None] + SLACK) & (p["cell"].to_numpy()[None] != x["cell"].to_numpy()[:, None])
        at, to = np.nonzero(may)
        return pd.DataFrame({sample: x[sample].to_numpy()[at], "id": x["id"].to_numpy()[at], "cell": p["cell"].to_numpy()[to]})

    kinds = dict(asked.dtypes)
    return _by_chunks(asked, cells, sample, run, f"`{sample}` {kinds[sample]}, id {kinds['id']}, cell int", AT_ONCE)


def nearest_vectors(left: DataFrame, right: DataFrame, k: int, sample: str = "sample_id", spot: str = "spot_id", vector: str = "vector", block: int = 4096, same: bool = False) -> DataFrame:
    """For each left row its k nearest right rows of the same sample, by Euclidean distance of unit vectors, ties to the smaller id.

    Right rows lie in cells around pivots. A left row searches the cell of its nearest pivot;
    the k-th distance found there tells which other cells can hold a nearer row, and it goes to these alone,
    so no row is lost. A task multiplies a block of left rows and a block of one cell. With
    ``same`` a row is not its own neighbour.

    Ids are unique within a sample. A left row gets fewer rows where its sample has fewer, and
    none where it has none. Rows without a sample, id or vector take no part.
    """
    sound = lambda d: d.select(sample, F.col(spot).alias("id"), normalised(F.col(vector)).alias("v")).dropna()
    asked = written(sound(left))
    celled, cells = vector_cells(written(sound(right)), sample, block)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return x[[sample]].head(0).assign(src=x["id"].head(0), dst=y["id"].head(0), dist=np.zeros(0))
        src, dst, dist = nearest_in_block(x, y, k, same)
        return pd.DataFrame({sample: x[sample].iloc[0], "src": src, "dst": dst, "dist": dist})

    kinds = dict(left.dtypes)
    rank = F.row_number().over(W.partitionBy(sample, "src").orderBy("dist", "dst"))

    def searched(rows: DataFrame) -> DataFrame:
        """The k nearest rows in the cells that rows (sample, id, v, cell) ask for."""
        by = [sample, "cell", "i", "j"]
        load = rows.groupBy(sample, "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("left")).join(cells.select(sample, "cell", F.ceil(F.col("n") / block).cast("int").alias("right")), [sample, "cell"])
        load = written(load)
        x = rows.join(load, [sample, "cell"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("left")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("right") - 1)))
        y = celled.join(load, [sample, "cell"]).withColumn("j", F.pmod(F.xxhash64("id"), F.col("right")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left") - 1)))
        pairs = x.select(*by, "id", "v").groupBy(*by).cogroup(y.select(*by, "id", "v").groupBy(*by)).applyInPandas(run, f"`{sample}` {kinds[sample]}, src {kinds[spot]}, dst {kinds[spot]}, dist double")
        return written(pairs.withColumn("rank", rank).where(F.col("rank") <= k))

    home = written(_homes(asked, cells, sample))
    first = searched(home)
    tau = first.where(F.col("rank") == k).select(sample, F.col("src").alias("id"), F.col("dist").alias("tau"))
    open_ = home.join(tau, [sample, "id"], "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    more = further_cells(open_, cells, sample).join(asked, [sample, "id"])
    both = first.union(searched(written(more.select(sample, "id", "v", "cell"))))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def caliper(right: DataFrame, k: int = 5, share: float = 0.9, limit: int = 1000, seed: int = 42, sample: str = "sample_id", spot: str = "spot_id", vector: str = "vector") -> DataFrame:
    """(sample, tau): a quantile of distances to the k nearest others within a seeded subset of at most ``limit`` rows of each sample."""
    place = F.row_number().over(W.partitionBy(sample).orderBy(seeded(seed, spot)))
    some = right.withColumn("__p", place).where(F.col("__p") <= limit).drop("__p")
    near = nearest_vectors(some, some, k, sample, spot, vector, same=True)
    return near.groupBy(sample).agg(F.percentile("dist", F.lit(share)).alias("tau"))


def matched(disc: DataFrame, conc: DataFrame, tau: DataFrame, k: int = 5, sample: str = "sample_id", **names: str) -> DataFrame:
    """The k nearest controls of each row, with ``is_matched``: whether its nearest is within the caliper."""
    near = nearest_vectors(disc, conc, k, sample, **names)
    first = F.min("dist").over(W.partitionBy(sample, "src"))
    return near.join(tau, sample, "left").withColumn("nn1", first).withColumn("is_matched", F.coalesce(first <= F.col("tau"), F.lit(True)))


def matched_deltas(matches: DataFrame, values: DataFrame, keys: Sequence[str] = ("sample_id",), feature: str = "gene", value: str = "y", spot: str = "spot_id") -> DataFrame:
    """A row's value less the mean of its matched controls, for each feature; unmatched rows are left out."""
    own = matches.where("is_matched")
    v = values.select(*keys, F.col(spot).alias("dst"), feature, F.col(value).alias("__c"))
    mean = own.join(v, [*keys, "dst"]).groupBy(*keys, "src", feature).agg(F.avg("__c").alias("__c"))
    x = values.select(*keys, F.col(spot).alias("src"), feature, F.col(value).alias("__x"))
    return x.join(mean, [*keys, "src", feature]).select(*keys, F.col("src").alias(spot), feature, F.round(F.col("__x") - F.col("__c"), 9).alias("delta"))


def match_quality(matches: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """n, matched, share, caliper, and median, mean and 90th percentile of nearest distances."""
    own = matches.where("rank = 1")
    q = F.percentile("nn1", F.array(F.lit(0.5), F.lit(0.9)))
    out = own.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if("is_matched").alias("n_matched"), F.max("tau").alias("tau"), F.avg("nn1").alias("mean_nn1"), q.alias("__q"))
    return out.select(*keys, "n_total", "n_matched", (F.col("n_matched") / F.col("n_total")).alias("match_fraction"), "tau", F.col("__q")[0].alias("median_nn1"), "mean_nn1", F.col("__q")[1].alias("p90_nn1"))
