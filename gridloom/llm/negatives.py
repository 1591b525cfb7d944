"""Hard negatives by best-first search in cover trees over norm-augmented candidates.

Every row belongs to a block of its label, dealt by pivots. A task builds the cover tree of a
block, whose points have one more component that gives them all one norm, and searches it
for a pack of anchors. Positives are an anchor's best rows of its own label. Each positive
opens a window of scores below its own; nodes that the covering radii put outside all
windows of an anchor are skipped, and so are whole blocks, before they are sent anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled
from .covertree import CoverTree, augmented, best_in_windows
from .topk import _dealt, _vectors, quantised

KEYS = ["dim", "label", "top", "cell", "part"]
GROUP = ["dim", "label", "top", "chunk"]
FOUND = "anchor_id long, h long, window int, vec_id long, score long"


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    block_rows: int = 8192,
    pack_rows: int = 8192,
    most_pivots: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    seed: int = 5,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within the positive's window.

    Anchors are the rows whose id is divisible by ``every``. Scores are integer inner products
    of floor(scale * x). An anchor's positives are its ``positives`` best other rows of its
    label; a positive's negatives are the ``negatives`` best rows of other labels with
    low[0] * positive_score <= low[1] * score <= low[1] * positive_score. Returns ``anchor_id``,
    ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``; ties go
    to the smaller id, and there are fewer rows where there are fewer candidates.

    * Rows with a null id or label, or a vector that is null, empty or holds a null or non-finite
      component take no part. Vectors are compared with those of their own length.
    * A positive with a negative score has an empty window and no rows, one with 0 has rows of
      score 0. An anchor alone with its label has no positives and no rows.
    * Rows that share an id are rows of their own, and anchors of their own where vector or
      label differ; equal rows are one anchor. No row of an anchor's id is its candidate.
    * An empty table gives no rows. Other columns are left out, so their names cannot clash.
    * Scores are exact while sums stay below 2**53. Blocks and pivots decide nothing about
      results. A task holds one block and one pack of anchors (``block_rows`` and about
      ``pack_rows`` rows, fewer where vectors are long).
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(f"`{label_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").cast("long").alias("label")
    )
    data = quantised(own, "id", "v", scale, "label").withColumn("dim", F.size("v")).withColumn("h", F.xxhash64(F.lit(seed), "vec_id", "label", "v"))
    data = settled(data.select("dim", "label", "vec_id", "h", "v"), "vectors")
    widest, square = data.agg(F.max("dim"), F.max(_dot("v", "v"))).head()
    if widest is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    square = float(square) * (1 + 1e-12)
    block_rows = max(16, min(block_rows, (1 << 23) // (8 * widest)))
    pack_rows = max(16, min(pack_rows, (1 << 23) // (8 * widest)))

    top = settled(_dealt(data, ["dim", "label"], block_rows, most_pivots, "top"), "top")
    celled = settled(_dealt(top, ["dim", "label", "top"], block_rows, most_pivots, "cell"), "cells")
    counts = settled(celled.groupBy(*KEYS[:-1]).agg(F.ceil(F.count("*") / F.lit(2 * block_rows)).cast("int").alias("parts")), "counts")
    blocks = settled(celled.join(counts, KEYS[:-1]).withColumn("part", F.pmod("h", F.col("parts")).cast("int")).select(*KEYS, "vec_id", "h", "v"), "blocks")

    # Anchors in groups of one label and region, groups in packs; a pack meets a block in one task.
    asked = blocks.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates([*KEYS, "vec_id", "h"])
    asked = asked.select(*KEYS, F.col("vec_id").alias("anchor_id"), "h", "v")
    sizes = asked.groupBy(*GROUP[:-1]).agg(F.ceil(F.count("*") / F.lit(pack_rows)).cast("int").alias("chunks"))
    packs = max(1, -(-asked.count() // pack_rows))
    asked = asked.join(sizes, GROUP[:-1]).withColumn("chunk", F.pmod(F.shiftright("h", 7), F.col("chunks")).cast("int")).drop("chunks")
    asked = settled(asked.withColumn("pack", F.pmod(F.xxhash64(*GROUP), F.lit(packs)).cast("int")), "asked")

    def ball(keys: list[str], level: float):  # noqa: ANN202
        def run(group: pa.Table) -> pa.Table:
            x = augmented(_vectors(group.column("v")), level) if level else np.pad(_vectors(group.column("v")), ((0, 0), (0, 1)))
            c = x.mean(axis=0)
            out = {n: group.column(n).slice(0, 1) for n in keys}
            return pa.table(out | {"centre": [c.tolist()], "radius": [float(np.sqrt(((x - c) ** 2).sum(axis=1)).max()) * (1 + 1e-9)]})

        return run

    kinds = "dim int, label long, top int, cell int, part int"
    regions = settled(blocks.groupBy(*KEYS).applyInArrow(ball(KEYS, square), f"{kinds}, centre array<double>, radius double"), "regions")
    group_of = [*GROUP, "pack"]
    groups = asked.groupBy(*group_of).applyInArrow(ball(group_of, 0.0), "dim int, label long, top int, chunk int, pack int, centre array<double>, radius double")
    groups = settled(groups.select(*[F.col(c).alias(f"q_{c}") if c != "dim" else "dim" for c in group_of], F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius")), "groups")
    salts = max(1, regions.count() // 256)
    salted = regions.withColumn("salt", F.pmod(F.xxhash64(*KEYS), F.lit(salts)))
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

    def search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("anchor_id", "h", "window", "vec_id", "score")}
        if len(left) and len(right):
            tree, ids = CoverTree(augmented(_vectors(right.column("v")), square)), right.column("vec_id").to_numpy()
            low_, high_, windows = (left.column(c).to_pylist() for c in ("low", "high", "windows"))
            names, marks = left.column("anchor_id").to_pylist(), left.column("h").to_pylist()
            for i, q in enumerate(_vectors(left.column("v"))):
                got, _ = best_in_windows(tree, ids, square, q, names[i], np.array(low_[i]), np.array(high_[i]), k)
                for w, (rows, scores) in zip(windows[i], got, strict=True):
                    for c, v in zip(out, (np.full(len(rows), names[i]), np.full(len(rows), marks[i]), np.full(len(rows), w), rows, scores.astype(np.int64)), strict=True):
                        out[c].append(v)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), t) for (c, v), t in zip(out.items(), types, strict=True)})

    high_bound = _dot("q_centre", "centre") + F.col("q_radius") * F.sqrt(F.lit(square)) + F.col("radius") * F.sqrt(_dot("q_centre", "q_centre")) + F.col("q_radius") * F.col("radius")
    low_bound = 2 * _dot("q_centre", "centre") - high_bound
    slack = F.lit(1e-6 * (1 + square))
    window = ["anchor_id", "h", "v", "low", "high", "windows"]

    def met(want: DataFrame, labels: Column, k: int) -> DataFrame:
        """The k best rows of each window of the anchors in all blocks that may hold one."""
        need = want.groupBy(*GROUP).agg(F.min(F.array_min("low")).alias("floor"), F.max(F.array_max("high")).alias("ceiling"))
        need = need.select(*[F.col(c).alias(f"q_{c}") if c != "dim" else "dim" for c in GROUP], "floor", "ceiling")
        may = labels & (high_bound + slack >= F.col("floor")) & (low_bound - slack <= F.col("ceiling"))
        open_ = copies.join(need, ["dim", *[f"q_{c}" for c in GROUP[1:]]]).join(salted, ["dim", "salt"]).where(may)
        open_ = settled(open_.select(*KEYS, *[f"q_{c}" for c in (*GROUP[1:], "pack")]), "open")
        sent = want.select("dim", *[F.col(c).alias(f"q_{c}") for c in (*GROUP[1:], "pack")], *window).join(open_, ["dim", *[f"q_{c}" for c in (*GROUP[1:], "pack")]])
        held = blocks.join(settled(open_.select(*KEYS, "q_pack").distinct(), "meetings"), KEYS)
        by = [*KEYS, "q_pack"]
        left, right = sent.select(*by, *window), held.select(*by, "vec_id", "h", "v")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: search(a, b, k), FOUND)

    def best(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("anchor_id", "h", "window").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    # Positives: the anchor's own block gives a floor, with which all blocks of its label that may reach it are searched.
    one = {"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf"))), "windows": F.array(F.lit(0))}
    at_home = asked.withColumns(one).select(*KEYS, *window)
    home = settled(at_home.groupBy(*KEYS).cogroup(blocks.groupBy(*KEYS)).applyInArrow(lambda a, b: search(a, b, positives), FOUND), "home")
    floor = best(home, positives).where(F.col("rank") == positives).select("anchor_id", "h", F.col("score").cast("double").alias("floor"))
    seek = asked.join(floor, ["anchor_id", "h"], "left").withColumns(one | {"low": F.array(F.coalesce("floor", F.lit(float("-inf"))))})
    same = F.col("label") == F.col("q_label")
    more = met(settled(seek, "seek"), same, positives)
    near = best(more, positives).select("anchor_id", "h", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = settled(near, "positives")

    # The least integer that low[0] / low[1] of the positive's score does not exceed.
    bounds = near.withColumn("low", (F.lit(low[0]) * F.col("positive_score") + F.pmod(-F.lit(low[0]) * F.col("positive_score"), F.lit(low[1]))) / F.lit(low[1])).where(F.col("low") <= F.col("positive_score"))
    spans = bounds.groupBy("anchor_id", "h").agg(F.collect_list(F.struct("window", F.col("low").cast("double").alias("low"), F.col("positive_score").cast("double").alias("high"))).alias("w"))
    look = asked.join(spans, ["anchor_id", "h"]).select(*asked.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.window").alias("windows"))
    far = best(met(settled(look, "look"), F.col("label") != F.col("q_label"), negatives), negatives)
    out = far.join(near, ["anchor_id", "h", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
