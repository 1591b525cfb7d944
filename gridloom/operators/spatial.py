"""Neighbours, spatial autocorrelation, boundary rings and grids, within samples."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.columns import grid_cell, min_max
from gridloom.functions.stats import corr, mid_rank
from gridloom.sources.tables import written


def _near_cells(side: Column, reach: Column) -> Column:
    return F.sequence(F.floor(side).cast("long") - reach, F.floor(side).cast("long") + reach)


#: Halvings of the first cell side that a dense place may have.
LEVELS = 12


def knn(df: DataFrame, k: int = 6, sample: str = "sample_id", spot: str = "spot_id", x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest other spots of each spot of a sample, by Euclidean distance, ties to the smaller id: (sample, src, dst, dist, rank).

    Spots meet those in square cells around. The side is that of cells which hold about k
    spots at the sample's mean density, halved as often as a dense place asks for. Of spots
    in one place only the k + 1 with the smallest ids can be neighbours. A spot is done when
    its k-th distance does not exceed the border of what it has seen; the others go round
    again with twice the side, until that covers the sample. Each round is written to the
    shared folder.
    """
    own = df.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y)).select(F.col(sample).alias("s"), F.col(spot).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    box = own.groupBy("s").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    span = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))
    area = F.greatest((F.col("hi_x") - F.col("lo_x")) * (F.col("hi_y") - F.col("lo_y")), span * span * 1e-6)
    # Points on a line lie as far apart as the span allows; cells are no smaller than that asks for.
    share = F.least(F.lit(1.0), k / F.col("n"))
    box = box.select("s", "n", "lo_x", "lo_y", span.alias("span"), F.when(span > 0, F.greatest(F.sqrt(area * share), span * share)).otherwise(1.0).alias("side"))
    placed = own.join(box, "s").withColumn("px", (F.col("x") - F.col("lo_x")) / F.col("side")).withColumn("py", (F.col("y") - F.col("lo_y")) / F.col("side"))
    placed = written(placed.select("s", "id", "x", "y", "n", "span", "side", "px", "py"))
    first = placed.withColumn("__n", F.row_number().over(W.partitionBy("s", "x", "y").orderBy("id"))).where(F.col("__n") <= k + 1)
    first = written(first.select("s", F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "px", "py"))

    def gridded_at(points: DataFrame, levels: Column) -> DataFrame:
        """Points with their cell at each level: a level's cells have half the side of those at the level before."""
        out = points.withColumn("level", F.explode(levels))
        return out.withColumns({f"g{c}": F.floor(F.col(f"p{c}") * F.pow(F.lit(2.0), F.col("level"))).cast("long") for c in "xy"})

    every = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    held = gridded_at(first, every).groupBy("s", "level", "gx", "gy").agg(F.count("*").alias("held"))
    at = gridded_at(placed, every).join(held, ["s", "level", "gx", "gy"], "left")
    at = at.groupBy("s", "id").agg(F.coalesce(F.min(F.when(F.coalesce("held", F.lit(0)) <= 4 * k, F.col("level"))), F.lit(LEVELS - 1)).alias("level"))
    todo, out = written(placed.join(at, ["s", "id"])), None
    while True:
        low, high = todo.agg(F.min("level"), F.max("level")).head()
        if low is None:
            return out if out is not None else placed.select(F.col("s").alias(sample), F.col("id").alias("src"), F.col("id").alias("dst"), F.col("x").alias("dist"), F.lit(1).alias("rank")).limit(0)
        scale = F.pow(F.lit(2.0), F.col("level"))
        now = todo.withColumn("px", F.col("px") * scale).withColumn("py", F.col("py") * scale).withColumn("side", F.col("side") / scale)
        one = F.lit(1).cast("long")
        wide = now.withColumn("gx", F.explode(_near_cells(F.col("px"), one))).withColumn("gy", F.explode(_near_cells(F.col("py"), one)))
        other = gridded_at(first, F.sequence(F.lit(low), F.lit(high))).drop("px", "py")
        near = wide.join(other, ["s", "level", "gx", "gy"]).where("id <> dst").withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)))
        rank = F.row_number().over(W.partitionBy("s", "id").orderBy("dist", "dst"))
        near = written(near.withColumn("rank", rank).where(F.col("rank") <= k).select("s", "id", "dst", "dist", "rank"))
        border = (1 + F.least(*[F.least(F.col(p) - F.floor(p), F.floor(p) + 1 - F.col(p)) for p in ("px", "py")])) * F.col("side")
        seen = near.groupBy("s", "id").agg(F.count("*").alias("have"), F.max("dist").alias("kth"))
        state = now.select("s", "id", "n", "span", "side", border.alias("border")).join(seen, ["s", "id"], "left")
        whole = F.col("side") >= F.col("span")
        done = state.where(whole | ((F.coalesce("have", F.lit(0)) >= F.least(F.lit(k), F.col("n") - 1)) & (F.coalesce("kth", F.lit(0.0)) <= F.col("border")))).select("s", "id")
        found = near.join(done, ["s", "id"], "left_semi").select(F.col("s").alias(sample), F.col("id").alias("src"), "dst", "dist", "rank")
        out = found if out is None else out.unionByName(found)
        todo = written(todo.join(done, ["s", "id"], "left_anti").withColumn("level", F.col("level") - 1))


def radius_pairs(left: DataFrame, right: DataFrame, r: float, keys: Sequence[str] = (), left_id: str = "spot_id", right_id: str = "nucleus_id") -> DataFrame:
    """Pairs of rows within distance r: cells of side r, each left row meets the nine around it."""
    a = left.withColumn("gx", F.explode(_near_cells(F.col("x") / r, F.lit(1)))).withColumn("gy", F.explode(_near_cells(F.col("y") / r, F.lit(1))))
    b = right.select(*keys, F.col(right_id), F.col("x").alias("x2"), F.col("y").alias("y2"), *[c for c in right.columns if c not in {*keys, right_id, "x", "y"}])
    b = b.withColumn("gx", F.floor(F.col("x2") / r).cast("long")).withColumn("gy", F.floor(F.col("y2") / r).cast("long"))
    gap = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
    return a.join(b, [*keys, "gx", "gy"]).where(gap <= r * r).drop("gx", "gy")


def morphometry(spots: DataFrame, nuclei: DataFrame, r: float, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Nuclei within r of each spot: count, mean and variance of areas, shares of classes, density. Spots without nuclei have 0 and nulls."""
    pairs = radius_pairs(spots, nuclei, r, keys)
    area = F.when(F.col("area") > 0, F.col("area"))
    seen = pairs.groupBy(*keys, "spot_id").agg(F.count("*").alias("n"), F.avg(area).alias("mean_area"), F.var_pop(area).alias("var_area"), *[F.avg((F.col("class_label") == c).cast("double")).alias(f"frac_{c}") for c in classes])
    out = spots.select(*keys, "spot_id").join(seen, [*keys, "spot_id"], "left").withColumn("nuclear_count", F.coalesce("n", F.lit(0)))
    return out.withColumn("nuclear_density", F.col("nuclear_count") / (3.141592653589793 * r * r)).drop("n")


def lagged(edges: DataFrame, values: DataFrame, value: str, keys: Sequence[str] = (), sample: str = "sample_id", spot: str = "spot_id") -> DataFrame:
    """Mean of the neighbours' values for each source spot."""
    v = values.select(*keys, sample, F.col(spot).alias("dst"), F.col(value).alias("__v"))
    return edges.join(v, [sample, "dst"]).groupBy(*keys, sample, "src").agg(F.avg("__v").alias("lag"))


def morans_i(edges: DataFrame, values: DataFrame, value: str, keys: Sequence[str] = (), sample: str = "sample_id", spot: str = "spot_id") -> DataFrame:
    """Moran's I with row-standardised weights for each sample (and key); 0 without variance."""
    w = W.partitionBy(*keys, sample)
    z = values.select(*keys, sample, spot, (F.col(value) - F.avg(value).over(w)).alias("z"))
    lag = lagged(edges, z, "z", keys, sample, spot).withColumnRenamed("src", spot)
    both = z.join(lag, [*keys, sample, spot], "left")
    out = both.groupBy(*keys, sample).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))).alias("top"), F.sum(F.col("z") * F.col("z")).alias("below"), F.count("lag").alias("w_sum"))
    return out.select(*keys, sample, "n", F.when(F.col("below") > 0, F.col("n") / F.col("w_sum") * F.col("top") / F.col("below")).otherwise(0.0).alias("morans_i"))


#: Shuffles of samples up to this many spots are drawn within tasks that hold the sample; those of larger ones are sorted as rows.
HELD = 1 << 19
#: Tasks that share the shuffles of a sample.
SHARES = 32


def permuted_morans(edges: DataFrame, values: DataFrame, value: str, permutations: int = 999, seed: int = 0, group: str | None = None, sample: str = "sample_id", spot: str = "spot_id", held: int = HELD) -> DataFrame:
    """Moran's I of each sample under each of P seeded shuffles (0 is as observed), freely or within groups: (sample, perm, morans_i).

    In shuffle p the spot at a place by id gets the value of the spot at that place by
    md5(seed|p|id), so any engine draws the same shuffles. The variance of a sample is the
    same under every shuffle. A sample without variance or without edges has 0 throughout.
    Samples of up to ``held`` spots go to tasks that draw their share of the shuffles, so only
    spots are shuffled; larger ones are sorted as rows (``sorted_numerators``).
    """
    w = W.partitionBy(sample)
    own = values.select(F.col(sample).alias("s"), F.col(spot).alias("id"), F.struct(F.col(group) if group else F.lit(0)).alias("g"), (F.col(value) - F.avg(value).over(w)).alias("z"), F.count("*").over(w).alias("n"))
    # Groups lie behind each other: ``i`` is a spot's place in its sample, ``start`` that of the first spot of its group.
    place = {"i": F.row_number().over(W.partitionBy("s").orderBy("g", "id")) - 1, "start": F.rank().over(W.partitionBy("s").orderBy("g")) - 1}
    own = written(own.withColumns(place).drop("g"))
    near = written(edges.select(F.col(sample).alias("s"), "src", "dst", F.count("*").over(W.partitionBy(sample, "src")).alias("k")))
    tops = held_numerators(near, own.where(F.col("n") <= held), permutations, seed)
    large = own.where(F.col("n") > held)
    if not large.isEmpty():
        tops = tops.unionByName(sorted_numerators(near, large, permutations, seed))
    base = own.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("below"))
    base = base.join(near.groupBy("s").agg(F.countDistinct("src").alias("w_sum")), "s", "left").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    out = base.join(tops, ["s", "perm"], "left")
    moran = F.when((F.col("below") > 0) & F.col("top").isNotNull(), F.col("n") / F.col("w_sum") * F.col("top") / F.col("below")).otherwise(0.0)
    return out.select(F.col("s").alias(sample), "perm", moran.alias("morans_i"))


def held_numerators(near: DataFrame, own: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Numerators (s, perm, top) of samples that a task may hold, each task with its share of their shuffles.

    A spot comes once for each share, with the places of its neighbours; a task holds some
    600 bytes for each spot of one sample.
    """
    shares = min(SHARES, permutations + 1)
    to = own.select("s", F.col("id").alias("dst"), F.col("i").alias("to"))
    # A small file of spots may be many rows in memory: neither side is broadcast.
    around = near.join(to.hint("merge"), ["s", "dst"]).groupBy("s", F.col("src").alias("id")).agg(F.collect_list("to").alias("to"), F.max("k").alias("k"))
    text = F.coalesce(F.concat(F.lit("|"), F.col("id").cast("string")), F.lit("")).cast("binary")
    rows = own.join(around.hint("merge"), ["s", "id"], "left").select("s", "i", "start", "z", "k", "to", text.alias("text"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    kind = dict(own.dtypes)["s"]

    def numerators(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t["i"].to_numpy())).combine_chunks()
        z, start, k = (t[c].to_numpy() for c in ("z", "start", "k"))
        texts, share, at = t["text"].to_pylist(), t["share"][0].as_py(), t["to"].combine_chunks()
        many = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        to, here = at.flatten().to_numpy().astype(np.int64), np.flatnonzero(many)
        first, weight = np.cumsum(many[here]) - many[here], 1 / k[here]
        cuts = [*np.flatnonzero(np.r_[True, start[1:] != start[:-1]]).tolist(), len(z)]
        perms = range(share, permutations + 1, shares) if len(here) else range(0)

        def shuffled(perm: int) -> np.ndarray:
            front = f"{seed}|{perm}".encode()
            drawn = np.frombuffer(b"".join([md5(front + x).digest() for x in texts]), ">u8").reshape(-1, 2).astype(np.uint64)
            out = np.empty_like(z)
            for a, b in zip(cuts, cuts[1:], strict=False):
                order = np.argsort(drawn[a:b, 0])
                high = drawn[a:b, 0][order]
                if (high[1:] == high[:-1]).any():
                    order = np.lexsort((drawn[a:b, 1], drawn[a:b, 0]))  # the order of ids where all digits tie
                out[a:b] = z[a:b][order]
            return out

        tops = []
        for perm in perms:
            v = shuffled(perm) if perm else z
            tops.append(float(v[here] * weight @ np.add.reduceat(v[to], first)))
        return pa.table({"s": pa.array([t["s"][0].as_py()] * len(tops), t.schema.field("s").type), "perm": pa.array(perms, pa.int32()), "top": pa.array(tops, pa.float64())})

    # As many partitions as are asked for: a task's work is its hashes, not the bytes that it reads.
    return rows.repartition(4 * shares, "s", "share").groupBy("s", "share").applyInArrow(numerators, f"s {kind}, perm int, top double")


def sorted_numerators(near: DataFrame, own: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Numerators (s, perm, top) of samples of any size.

    A window holds one sample's (or group's) spots for one shuffle, as (place, value) alone.
    Each spot then has one array of its values under all shuffles, and an edge meets the arrays
    of its two ends: the products of the arrays, divided by the source's number of neighbours,
    add up to all shuffles' numerators in one pass. Tasks add their own edges; a row for each
    task, sample and shuffle is added by Spark.
    """
    own = own.withColumn("p", F.col("i") - F.col("start"))
    each = own.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))) if permutations else own.withColumn("perm", F.lit(1)).limit(0)
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("id").cast("string")))
    placed = each.select("s", "start", "perm", "z", (F.row_number().over(W.partitionBy("s", "perm", "start").orderBy(drawn, "id")) - 1).alias("p"))
    arrays = placed.groupBy("s", "start", "p").agg(F.array_sort(F.collect_list(F.struct("perm", "z")))["z"].alias("zs"))
    whole = F.concat(F.array("z"), F.coalesce("zs", F.array().cast("array<double>")))
    spots = written(own.join(arrays.hint("merge"), ["s", "start", "p"], "left").select("s", "id", whole.alias("zs")))
    # Arrays of few distinct values are a small file and still all spots x shuffles: they are never broadcast.
    met = near.join(spots.select("s", F.col("id").alias("dst"), F.col("zs").alias("there")).hint("merge"), ["s", "dst"])
    met = met.join(spots.select("s", F.col("id").alias("src"), F.col("zs").alias("here")).hint("merge"), ["s", "src"]).select("s", "k", "here", "there")
    kind = dict(own.dtypes)["s"]

    def numerators(batches):  # noqa: ANN001, ANN202
        sums: dict = {}
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                here, there = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in (2, 3))
                each_ = here * there / part.column(1).to_numpy()[:, None]
                names = np.array(part.column(0).to_pylist(), object)
                for name in set(names.tolist()):
                    sums[name] = sums.get(name, 0.0) + each_[names == name].sum(axis=0)
        for name, top in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(top), part.schema.field(0).type), pa.array(np.arange(len(top), dtype=np.int32)), pa.array(top)], names=["s", "perm", "top"])

    return met.mapInArrow(numerators, f"s {kind}, perm int, top double").groupBy("s", "perm").agg(F.sum("top").alias("top"))


def permutation_p(null: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(1 + permutations at least as high as the observed) / (1 + permutations)."""
    seen = null.where("perm = 0").select(*keys, F.col(value).alias("observed"))
    rest = null.where("perm > 0").join(seen, list(keys))
    return rest.groupBy(*keys).agg(F.max("observed").alias("observed"), F.avg(value).alias("null_mean"), ((1 + F.count_if(F.col(value) >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull in order, by the monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hulls(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Convex hull edges of each sample: (sample, ax, ay, bx, by). Each task keeps the hulls of its own rows; the final one is over those."""
    own = df.select(F.col(sample).cast("string").alias("s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def part(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(s, x, y) for s, g in b.groupby("s") for x, y in _hull(g[["x", "y"]].to_numpy()).tolist()]
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("s", "x", "y"))})

    def final(g: pd.DataFrame) -> pd.DataFrame:
        h = _hull(g[["x", "y"]].to_numpy())
        n = np.roll(h, -1, axis=0)
        out = pd.DataFrame({sample: [g["s"].iloc[0]] * len(h), "ax": h[:, 0], "ay": h[:, 1], "bx": n[:, 0], "by": n[:, 1]})
        return out if len(h) > 2 else out.head(0)  # points on a line have no hull

    return own.mapInPandas(part, "s string, x double, y double").groupBy("s").applyInPandas(final, f"`{sample}` string, ax double, ay double, bx double, by double")


def edge_distance(df: DataFrame, edges: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Add ``edge_dist``, the least distance to the sample's hull edges (a hull has few edges; they come as an array)."""
    arrays = edges.groupBy(sample).agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("__e"))
    dx, dy = (lambda e: e["bx"] - e["ax"]), (lambda e: e["by"] - e["ay"])

    def one(e: Column) -> Column:
        t = ((F.col("x") - e["ax"]) * dx(e) + (F.col("y") - e["ay"]) * dy(e)) / (dx(e) * dx(e) + dy(e) * dy(e))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.sqrt(F.pow(F.col("x") - e["ax"] - t * dx(e), 2) + F.pow(F.col("y") - e["ay"] - t * dy(e), 2))

    return df.join(arrays, sample, "left").withColumn("edge_dist", F.array_min(F.transform("__e", one))).drop("__e")


def rings(df: DataFrame, n_rings: int = 10, least: int = 10, sample: str = "sample_id") -> DataFrame:
    """Boundary rings: quantile bins of the distance to the hull, small ones merged to the left; ring 0 where there is no hull."""
    from gridloom.operators.scores import merge_bins, quantile_bins

    far = edge_distance(df, hulls(df, sample), sample)
    whole = far.where("edge_dist is not null")
    flat = far.where("edge_dist is null").withColumn("ring", F.lit(0))
    out = merge_bins(quantile_bins(whole.withColumn("edge_dist", F.round("edge_dist", 9)), "edge_dist", [sample], n_rings, 0), [sample], least, left_always=True)
    return out.withColumnRenamed("bin", "ring").unionByName(flat)


def gridded(df: DataFrame, value: str, n: int = 20, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean and count of ``value`` in each cell of an n x n grid over the sample's extent."""
    own = df.withColumn("__x", min_max(F.col("x"), keys)).withColumn("__y", min_max(F.col("y"), keys))
    own = own.withColumn("cx", grid_cell(F.col("__x"), n)).withColumn("cy", grid_cell(F.col("__y"), n))
    return own.groupBy(*keys, "cx", "cy").agg(F.round(F.avg(value), 9).alias("mean"), F.count("*").alias("n"))


def grid_rho(grid: DataFrame, section: str = "sample_id", least: int = 10) -> DataFrame:
    """Spearman's rho of each two sections' grids over common cells; 0 with p 1 under ``least`` cells."""
    a, b = (grid.select(F.col(section).alias(x), "cx", "cy", F.col("mean").alias(f"v{x}")) for x in "ab")
    both = a.join(b, ["cx", "cy"]).where("a < b")
    ranked = both.withColumn("ra", mid_rank("va", ["a", "b"])).withColumn("rb", mid_rank("vb", ["a", "b"]))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), corr("ra", "rb").alias("r")).withColumn("rho", F.when(F.col("n") >= least, F.col("r")).otherwise(0.0)).drop("r")


def grid_dice(grid: DataFrame, section: str = "sample_id", least: int = 5) -> DataFrame:
    """Dice similarity of the cells in each two sections' top quartile; 0 where a side has under ``least``."""
    q = grid.groupBy(section).agg(F.percentile("mean", F.lit(0.75)).alias("__q"))
    top = grid.join(q, section).where("mean >= __q").select(section, "cx", "cy")
    size = top.groupBy(section).agg(F.count("*").alias("n"))
    a, b = (size.select(F.col(section).alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))  # one row a section
    x, y = top.withColumnRenamed(section, "a"), top.withColumnRenamed(section, "b")
    both = x.join(y, ["cx", "cy"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    out = pairs.join(both, ["a", "b"], "left")
    small = (F.col("n_a") < least) | (F.col("n_b") < least)
    return out.select("a", "b", F.when(small, 0.0).otherwise(2 * F.coalesce("n_both", F.lit(0)) / (F.col("n_a") + F.col("n_b"))).alias("dice"))


def interior(edges: DataFrame, df: DataFrame, vector: str = "vector", sample: str = "sample_id", spot: str = "spot_id") -> DataFrame:
    """Spots whose least cosine to their neighbours is above the sample's median: (sample, spot, min_cosine, interior)."""
    from gridloom.functions.columns import cosine

    a = df.select(sample, F.col(spot).alias("src"), F.col(vector).alias("va"))
    b = df.select(sample, F.col(spot).alias("dst"), F.col(vector).alias("vb"))
    low = edges.join(a, [sample, "src"]).join(b, [sample, "dst"]).groupBy(sample, "src").agg(F.round(F.min(cosine(F.col("va"), F.col("vb"))), 9).alias("min_cosine"))
    mid = low.groupBy(sample).agg(F.percentile("min_cosine", F.lit(0.5)).alias("__m"))
    return low.join(mid, sample).select(sample, F.col("src").alias(spot), "min_cosine", (F.col("min_cosine") > F.col("__m")).alias("interior"))
