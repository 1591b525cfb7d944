"""Mixing sources to target weights by subset-sum budget fitting.

Whole passes over a source come first. For the budget that is left, documents are
counted by exact length, every length gives its rounded share, and a bounded-knapsack
dynamic programme over the counts closes the gap that rounding leaves. Which documents of
a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_key, staged

#: Words on each side of the share, besides four times the longest length, that sums on the way to a budget may reach.
WINDOW = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets for sources (``source``, ``source_size``): ``share`` of all words by weight, none above ``most`` sizes.

    The excess of capped sources is reshared until none is above: in order of size by
    weight, a source is capped as long as its even share of what is left exceeds its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__mix_at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__mix_at") % len(weights) + 1).cast("int"))
    all_rows = W.partitionBy()
    before = W.orderBy("__mix_ratio", "__mix_at").rowsBetween(W.unboundedPreceding, -1)
    out = (
        ranked.withColumn("__mix_w", weight)
        .withColumn("__mix_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__mix_ratio", F.col("__mix_cap") / F.col("__mix_w"))
        .withColumn("__mix_budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("__mix_left", F.col("__mix_budget") - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0)))
        .withColumn("__mix_rest", F.sum("__mix_w").over(all_rows) - F.coalesce(F.sum("__mix_w").over(before), F.lit(0.0)))
        .withColumn("__mix_level", F.col("__mix_left") / F.col("__mix_rest"))
        .withColumn("__mix_capped", F.col("__mix_level") >= F.col("__mix_ratio"))
        .withColumn("__mix_water", F.min(F.when(~F.col("__mix_capped"), F.struct("__mix_ratio", "__mix_at", "__mix_level"))).over(all_rows)["__mix_level"])
    )
    target = F.when(F.col("__mix_capped"), F.col("__mix_cap")).otherwise(F.least("__mix_cap", F.col("__mix_water") * F.col("__mix_w")))
    return out.select("source", "source_size", target.cast("double").alias("target"))


def spread(counts: Sequence[int], share: float) -> list[int]:
    """``share`` of each count, rounded so that no count and no run of counts is off by one or more."""
    out, seen, before = [], 0, 0
    for c in counts:
        seen += c
        now = math.floor(seen * share + 0.5)
        out.append(now - before)
        before = now
    return out


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come as near to the budget as they can from below.

    Every length gives its share, rounded, which misses the budget by less than the longest
    length. A bounded-knapsack programme over single documents, then pairs, then fours and so
    on, taken or given back, as far as the counts allow, finds the sum that is wanted. Sums
    on the way stay within a window around the share that is several lengths wide. What is
    left then is closed by swaps between neighbouring lengths. Lengths of 0 are never taken.
    """
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0), key=lambda i: lengths[i])
    total = sum(lengths[i] * counts[i] for i in order)
    taken = [0] * len(lengths)
    if budget >= total:
        return [c if n > 0 else 0 for c, n in zip(counts, lengths, strict=True)]
    if budget <= 0 or not order:
        return taken
    share = budget / total
    for i, n in zip(order, spread([counts[i] for i in order], share), strict=True):
        taken[i] = min(n, counts[i])
    left = _closed(lengths, counts, taken, order, share, budget)
    while left > 0:
        # Swaps of neighbouring lengths, which move little for each document, and the programme again.
        moved = 0
        for a, b in sorted(zip(order, order[1:], strict=False), key=lambda p: lengths[p[0]] - lengths[p[1]]):
            step = lengths[b] - lengths[a]
            n = min((left - moved) // step, taken[a], counts[b] - taken[b]) if step else 0
            taken[a], taken[b], moved = taken[a] - n, taken[b] + n, moved + n * step
        if not moved:
            break
        left = _closed(lengths, counts, taken, order, share, budget)
    return taken


def _closed(lengths: Sequence[int], counts: Sequence[int], taken: list[int], order: list[int], share: float, budget: int) -> int:
    """Change ``taken`` so that its words come as near to the budget as the programme can; the words that are left."""
    unit = math.gcd(*[lengths[i] for i in order])
    left = budget - sum(lengths[i] * taken[i] for i in order)
    gap = left // unit
    width = 4 * lengths[order[-1]] // unit + WINDOW
    zero, mask = width, (1 << (2 * width + 1)) - 1
    # Sums that can be reached, as the bits of an integer around ``zero``; a layer for each change that reaches more.
    reach, layers, part = 1 << zero, [], 1
    room = {(i, sign): counts[i] - taken[i] if sign > 0 else taken[i] for i in order for sign in (1, -1)}
    # First what brings a length nearer to its share.
    error = {i: counts[i] * share - taken[i] for i in order}
    moves = sorted((m for m in room if room[m] > 0), key=lambda m: abs(error[m[0]] - m[1]))
    while moves and not reach >> (zero + gap) & 1:
        for i, sign in moves:
            n = min(part, room[i, sign])
            step = n * lengths[i] // unit
            more = reach if step > 2 * width else reach | (reach << step & mask if sign > 0 else reach >> step)
            if more != reach:
                layers.append((i, sign * n, reach))
                reach = more
            room[i, sign] -= n
            if reach >> (zero + gap) & 1:
                break
        part *= 2
        moves = [m for m in moves if room[m] > 0]
    best = (reach & ((1 << (zero + gap + 1)) - 1)).bit_length() - 1
    left -= (best - zero) * unit
    for i, n, before in reversed(layers):
        if not before >> best & 1:
            taken[i] += n
            best -= n * lengths[i] // unit
    return left


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decide how often the mix takes each document.

    Returns for each row ``doc_id``, ``text_hash`` (of a row's text, to tell rows with one
    id apart), ``source``, ``size`` in words, ``source_size``, ``target`` of its source,
    ``copies`` from 0 to ``most`` and ``taken`` = copies * size.

    * Sources are weighted in code-point order, null last; an empty table gives no rows.
    * A null text has size 0. A document of size 0 is taken as often as there are whole
      passes over its source; a source without words has no passes.
    * Texts of any length count as a whole. Other columns are left out, so their names
      cannot clash.
    * Rows that agree in id, source and text are told apart by no one: ties in the hash
      are broken by the text's hash and then by any order of equal rows.
    * A source whose words are all in one length is split by hash before it is ranked.
    """
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = staged(read.withColumn("hash", F.xxhash64(F.lit(seed), id_key(F.col("doc_id")), "text_hash")).withColumn("cell", F.shiftrightunsigned("hash", 52)), "mix_rows")
    cells = staged(rows.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), "mix_cells")
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = staged(targets(sizes, weights, share, most), "mix_targets")

    def plan(g: pd.DataFrame) -> pd.DataFrame:
        size, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        passes = min(most, int(target // size)) if size else 0
        left = round(target) - passes * size if passes < most else 0
        lengths, counts = g["size"].tolist(), g["n"].tolist()
        extra = fit_budget(lengths, counts, left)
        return pd.DataFrame({"source": g["source"], "size": lengths, "source_size": size, "target": target, "passes": passes, "extra": extra})

    # A group has a row for each length that occurs in a source, so it is bounded by the longest text, not by the rows.
    plans = lengths.join(aims, lengths["source"].eqNullSafe(aims["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    plans = plans.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, passes int, extra long")
    plans = staged(plans, "mix_plans")
    # How many documents of the length stand in cells before: whole cells are taken or left, one cell is ranked.
    ahead = W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    c = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("c")
    p = plans.alias("p")
    c = c.join(p, F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))).select("c.*", "source_size", "target", "passes", "extra")
    place = W.partitionBy("source", "size", "cell").orderBy("hash", "text_hash", "doc_id")
    r = rows.withColumn("place", F.row_number().over(place)).alias("r")
    c = c.alias("c")
    both = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")) & (F.col("r.cell") == F.col("c.cell")))
    copies = F.col("passes") + (F.col("ahead") + F.col("place") <= F.col("extra")).cast("int")
    return both.select("doc_id", "text_hash", "r.source", "r.size", "source_size", "target", copies.alias("copies")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the input's columns.

    Rows that agree in id, text and source share their copies in any order. Names that begin
    with ``__mix_`` are reserved. See ``mix`` for nulls, empty texts and empty tables.
    """
    source = F.col(str(options.get("source_col", "source"))).cast("string")
    keys = ["__mix_id", "__mix_text", "__mix_null", "__mix_source"]
    marks = lambda id_, text, src: dict(zip(keys, (id_key(id_), text, src.isNull(), F.coalesce(src, F.lit(""))), strict=True))
    plan = mix(docs, id_col=id_col, text_col=text_col, **options)
    # Rows with equal keys share the copies that they were given together.
    plan = plan.select(*[c.alias(n) for n, c in marks(F.col("doc_id"), F.col("text_hash"), F.col("source")).items()], "copies")
    plan = plan.groupBy(*keys).agg(F.sum("copies").alias("__mix_sum"), F.count("*").alias("__mix_rows"))
    own = docs.withColumns(marks(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), source))
    # The window has the join's keys, so it needs no shuffle of its own.
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    both = own.join(plan.where("__mix_sum > 0"), keys).withColumn("__mix_turn", turn)
    times = F.floor(F.col("__mix_sum") / F.col("__mix_rows")) + (F.col("__mix_turn") <= F.col("__mix_sum") % F.col("__mix_rows")).cast("long")
    both = both.withColumn("__mix_times", times).where("__mix_times > 0")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times"))).alias("__mix_copy")).drop("__mix_copy")
