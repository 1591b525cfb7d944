"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to blocks by nearest pivot, so that a block covers a small region. Each
task builds a cover tree over its block and one over a group of queries, and walks both
trees at once: a pair of nodes is left out if no inner product of their points, bounded
by centres and covering radii, reaches the worst k-th score of the query node. The first
walk is over each query group's own region; the scores it finds prune the other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged
from .covertree import CoverTree

#: Queries of a query leaf, and of a pack of leaves.
QUERY_LEAF, PACK = 8, 32


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer each row its scores with the ids of the columns, which ascend."""
        n, k = scores.shape[1], self.k
        least = self.scores[rows, -1]
        if n > k:
            least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
        for r, own, low in zip(rows, scores, least, strict=True):
            # What is above the least, and of what equals it the smallest ids.
            at = np.flatnonzero(own >= low)
            if len(at) > 2 * k:
                at = np.concatenate([at[own[at] > low], at[own[at] == low][:k]])
            if len(at):
                s, i = np.concatenate([self.scores[r], own[at]]), np.concatenate([self.ids[r], ids[at]])
                by = np.lexsort((i, -s))[:k]
                self.scores[r], self.ids[r] = s[by], i[by]

    def worst(self, rows: np.ndarray) -> float:
        return float(self.scores[rows, -1].min())


def product_bounds(q: CoverTree, at: np.ndarray, x: CoverTree, to: np.ndarray) -> np.ndarray:
    """For each pair of nodes a number that no inner product of their points exceeds."""
    length = lambda c: np.sqrt(np.einsum("ij,ij->i", c, c))
    rq, rx, lq, lx = q.radius[at][:, None], x.radius[to][None], length(q.centres[at])[:, None], length(x.centres[to])[None]
    v = q.centres[at] @ x.centres[to].T + rq * lx + rx * lq + rq * rx
    return v + 1e-9 * (1 + np.abs(v))


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Walk both trees at once, the most promising pairs of nodes first; how many pairs of points were scored.

    A query node is split before a data node unless it is less than half as wide; its leaves go on
    in packs. In a pack each query has a bound of its own for every child of a data node, by
    the child's covering radius and the query's norm, and goes on only to children that reach
    its own k-th score. The product with the centre of a child of one point is that point's
    score, and is taken as such.
    """
    scored = 0
    if not len(query_ids) or not len(ids):
        return scored
    norms = np.sqrt(np.einsum("ij,ij->i", queries.points, queries.points))
    alone = data.end - data.first == 1
    root = np.zeros(1, np.int64)
    everyone = queries.members(root)
    # A query node or, from its leaves on, rows of queries; a data node; the bound or the rows' bounds.
    stack: list[tuple] = [(0, everyone, 0, np.full(len(everyone), np.inf))]
    while stack:
        a, rows, b, bound = stack.pop()
        open_ = bound >= best.scores[rows, -1]
        if not open_.any():
            continue
        if a is not None and queries.kid_count[a]:
            if 2 * queries.radius[a] >= data.radius[b] or not data.kid_count[b]:
                kids = queries.children(root + a)
                bounds = product_bounds(queries, kids, data, root + b)[:, 0]
                size, leaf = queries.end[kids] - queries.first[kids], queries.kid_count[kids] == 0
                parts = [kids[x : x + 1] for x in np.flatnonzero(~leaf)]
                parts += [p for p in np.array_split(kids[leaf], max(1, -(-int(size[leaf].sum()) // PACK))) if len(p)]
                fresh = [(int(p[0]) if queries.kid_count[p[0]] else None, queries.members(p), b, np.repeat(bounds[p - kids[0]], size[p - kids[0]])) for p in parts]
            else:
                kids = data.children(root + b)
                bounds = product_bounds(queries, root + a, data, kids)[0]
                fresh = [(a, rows, int(kid), np.full(len(rows), x)) for kid, x in zip(kids, bounds, strict=True) if x >= best.worst(rows)]
            stack += sorted(fresh, key=lambda f: f[3].max())
            continue
        rows = rows[open_]
        kids = data.children(root + b) if data.kid_count[b] else root + b
        side = slice(int(kids[0]), int(kids[-1]) + 1)  # children stand next to each other: no copy
        dots = queries.points[rows] @ data.centres[side].T
        single = np.flatnonzero(alone[side])
        if len(single):
            single = single[np.argsort(ids[data.centre[kids[single]]], kind="stable")]
            own = ids[data.centre[kids[single]]]
            scores = dots[:, single]
            scored += scores.size
            scores[query_ids[rows][:, None] == own[None, :]] = -np.inf
            best.add(rows, scores, own)
        more = np.flatnonzero(~alone[side])
        if not len(more):
            continue
        high = dots[:, more] + norms[rows][:, None] * data.radius[side][more][None]
        high += 1e-9 * (1 + np.abs(high))
        leaf = data.kid_count[kids[more]] == 0
        last = np.flatnonzero(leaf)
        for at in last[np.argsort(-high[:, last].max(axis=0), kind="stable")] if len(last) else last:
            need = np.flatnonzero(high[:, at] >= best.scores[rows, -1])
            if len(need):
                some, cols = rows[need], data.members(kids[more[at : at + 1]])
                cols = cols[np.argsort(ids[cols], kind="stable")]
                scores = queries.points[some] @ data.points[cols].T
                scored += scores.size
                scores[query_ids[some][:, None] == ids[cols][None, :]] = -np.inf
                best.add(some, scores, ids[cols])
        may = high >= best.scores[rows, -1][:, None]
        inner = np.flatnonzero(~leaf & may.any(axis=0))
        inner = inner[np.argsort(high[:, inner].max(axis=0), kind="stable")] if len(inner) else inner
        stack += [(None, rows[may[:, i]], int(kids[more[i]]), high[may[:, i], i]) for i in inner]
    return scored


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float, *more: str) -> DataFrame:
    """(``more``, ``vec_id``, ``v``): floor(scale * x) of each component, for vectors without null or non-finite components."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & sound).select(*more, F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dealt(rows: DataFrame, keys: list[str], block_rows: int, most: int, name: str) -> DataFrame:
    """Add a number ``name`` to rows (with ``dim``, ``h``, ``v``): that of the nearest of their group's pivots.

    Pivots are rows of a bounded sample of the group, about one for ``block_rows`` rows and
    at most ``most``. A large group is dealt out by hash with a copy of its pivots for each
    part, so no task holds a whole group.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / F.lit(block_rows))).cast("int")
    counts = staged(counts.withColumn("pivots", wanted).withColumn("parts", F.ceil(F.col("n") / F.lit(8 * block_rows)).cast("int")), "counts")
    # By hash, some sixteen candidates for a pivot, and at least two of every group.
    few = F.col("h") / F.lit(2.0**64) + 0.5 <= 16 * F.col("pivots") / F.col("n")
    own = rows.join(counts, keys)
    sample = own.where((F.col("pivots") > 1) & few).select(*keys, "pivots", "parts", "h", "v")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def spread(group: pa.Table) -> pa.Table:
        x = _vectors(group.sort_by("h").column("v"))
        picked = _spread(x, group.column("pivots")[0].as_py())
        head = {c: pa.repeat(group.column(c)[0], len(picked)) for c in (*keys, "parts")}
        return pa.table({**head, "number": pa.array(np.arange(len(picked), dtype=np.int32)), "v": pa.array(list(picked), pa.list_(pa.float64()))})

    pivots = staged(sample.groupBy(*keys).applyInArrow(spread, f"{fields}, parts int, number int, v array<double>"), "pivots")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} int"

    columns, empty = rows.columns, to_arrow_schema(rows.schema).append(pa.field(name, pa.int32()))

    def nearest(group: pa.Table, near: pa.Table) -> pa.Table:
        if not len(group):
            return empty.empty_table()
        at = np.zeros(len(group), np.int32)
        if len(near):
            p = _vectors(near.sort_by("number").column("v"))
            half = (p * p).sum(axis=1)[None] / 2
            for i in range(0, len(group), 2048):
                x = _vectors(group.column("v").slice(i, 2048))
                at[i : i + 2048] = (half - x @ p.T).argmin(axis=1)
        return group.select(columns).append_column(name, pa.array(at))

    left = own.withColumn("part", F.pmod(F.shiftright("h", 8), F.col("parts")).cast("int")).select(*rows.columns, "part")
    right = pivots.select(*keys, "part", "number", "v")
    by = [*keys, "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest, schema)


def top_inner_products(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: float = 256.0,
    block_rows: int = 8192,
    most_pivots: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 3,
) -> DataFrame:
    """For each row whose id is divisible by ``every``, its k best other rows by integer inner product.

    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; all other rows if there are
    fewer than k; ties go to the smaller id. An empty table gives no rows; other columns are
    left out, so their names cannot clash.

    * Vectors that are null, empty or hold a null or non-finite component take no part;
      nor do rows with a null id. Vectors are compared with those of their own length.
    * Scores are exact while sums stay below 2**53. Rows that share an id are candidates of
      their own, and queries of their own where their vectors differ: each vector gets its
      ranks. A query does not find rows of its own id.
    * Rows are dealt to cells by pivots and each cell to smaller ones by its own pivots, so
      that regions shrink as rows grow. Pivots decide nothing about results. Equal vectors
      are split by hash.
    """
    spark = vectors.sparkSession
    data = quantised(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")).withColumn("h", F.xxhash64(F.lit(seed), "vec_id", "v"))
    data = staged(data.select("dim", "vec_id", "h", "v"), "vectors")
    # A task holds a block of bounded bytes: fewer rows where vectors are long.
    widest = data.agg(F.max("dim")).head()[0]
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block_rows = max(16, min(block_rows, (1 << 23) // (8 * widest)))
    top = staged(_dealt(data, ["dim"], block_rows, most_pivots, "top"), "top")
    celled = staged(_dealt(top, ["dim", "top"], block_rows, most_pivots, "cell"), "cells")
    parts = F.ceil(F.col("n") / F.lit(2 * block_rows)).cast("int")
    counts = staged(celled.groupBy("dim", "top", "cell").agg(F.count("*").alias("n")), "counts")
    keys = ["dim", "top", "cell", "part"]
    blocks = celled.join(counts, ["dim", "top", "cell"]).withColumn("part", F.pmod("h", parts).cast("int")).select(*keys, "vec_id", "h", "v")
    blocks = staged(blocks, "blocks")
    queries = blocks.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates([*keys, "vec_id", "h"])

    # What a block and its queries cover: centres and covering radii.
    def ball(x: np.ndarray) -> tuple[list[float], float]:
        c = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return c.tolist(), float(np.sqrt(((x - c) ** 2).sum(axis=1)).max(initial=0.0))

    def covers(group: pa.Table) -> pa.Table:
        x = _vectors(group.column("v"))
        asked = group.column("vec_id").to_numpy() % every == 0
        (c, r), (qc, qr) = ball(x), ball(x[asked])
        head = {n: [group.column(n)[0].as_py()] for n in keys}
        row = head | {"centre": [c], "radius": [r], "asked": [int(asked.sum())], "q_centre": [qc], "q_radius": [qr]}
        return pa.table({n: pa.array(v, pa.int32()) if n in keys else v for n, v in row.items()})

    fields = "dim int, top int, cell int, part int"
    regions = staged(blocks.groupBy(*keys).applyInArrow(covers, f"{fields}, centre array<double>, radius double, asked long, q_centre array<double>, q_radius double"), "regions")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (with the k-th score that they have so far) against one block."""
        out = {n: pa.array([], pa.int64()) for n in ("query_id", "query_h", "vec_id", "score")}
        if not len(left) or not len(right):
            return pa.table(out)
        ids, marks = left.column("vec_id").to_numpy(), left.column("h").to_numpy()
        q, x = CoverTree(_vectors(left.column("v")), QUERY_LEAF), CoverTree(_vectors(right.column("v")))
        best = Best(len(left), k)
        floor = left.column("floor").to_numpy(zero_copy_only=False).astype(float)
        # What is known to be reached elsewhere prunes here; candidates at the floor itself still count.
        best.scores[:, :] = np.where(np.isnan(floor), -np.inf, floor - 0.5)[:, None]
        dual_search(q, ids, x, right.column("vec_id").to_numpy(), best)
        got = np.isfinite(best.scores) & (best.ids != np.iinfo(np.int64).max)
        rows, _ = np.nonzero(got)
        return pa.table({"query_id": ids[rows], "query_h": marks[rows], "vec_id": best.ids[got], "score": best.scores[got].astype(np.int64)})

    out = "query_id long, query_h long, vec_id long, score long"
    # First the queries of each block against their own block.
    own = queries.select(*keys, "vec_id", "h", "v", F.lit(None).cast("double").alias("floor"))
    first = staged(own.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(search, out), "first")
    ranked = W.partitionBy("query_id", "query_h").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("query_h").alias("h"), F.col("score").cast("double").alias("floor"))
    asked = staged(queries.join(kth, ["vec_id", "h"], "left"), "asked")
    # The worst k-th score of each group of queries, against the bound of its region and a block's.
    worst = asked.groupBy(*keys).agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst"))
    groups = regions.where("asked > 0").join(worst, keys).select("dim", *[F.col(c).alias(f"q_{c}") for c in keys[1:]], "q_centre", "q_radius", "worst")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("q_radius") * length("centre") + F.col("radius") * length("q_centre") + F.col("q_radius") * F.col("radius")
    may = F.col("worst").isNull() | (bound + F.lit(1e-6) * (1 + F.abs(bound)) >= F.col("worst"))
    # Whole cells of the first pivots against each other, a bounded number of pairs; then blocks within the pairs that are left.
    mean = regions.join(counts.groupBy("dim", "top").agg(F.first("cell").alias("cell")), ["dim", "top", "cell"]).where("part = 0").select("dim", "top", F.col("centre").alias("c"))
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    wide = regions.join(mean, ["dim", "top"]).groupBy("dim", "top").agg(F.first("c").alias("centre"), F.max(gap + F.col("radius")).alias("radius"))
    gap_q = F.sqrt(F.aggregate(F.zip_with("q_centre", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    q_wide = groups.join(mean.withColumnRenamed("top", "q_top"), ["dim", "q_top"]).groupBy("dim", "q_top").agg(F.first("c").alias("q_centre"), F.max(gap_q + F.col("q_radius")).alias("q_radius"), F.when(F.count("worst") == F.count("*"), F.min("worst")).alias("worst"))
    near = staged(q_wide.join(wide, "dim").where(may).select("dim", "q_top", "top"), "near")
    open_ = groups.join(near, ["dim", "q_top"]).join(regions.select(*keys, "centre", "radius"), ["dim", "top"])
    open_ = open_.where("top <> q_top or cell <> q_cell or part <> q_part").where(may).select(*keys, "q_top", "q_cell", "q_part")
    # A task gets one block and one chunk of the queries that are open for it.
    n_queries = F.ceil(F.sum("asked") / F.lit(block_rows)).cast("int")
    open_ = staged(open_, "open")
    load = open_.join(regions.select("dim", *[F.col(c).alias(f"q_{c}") for c in keys[1:]], "asked"), ["dim", "q_top", "q_cell", "q_part"]).groupBy(*keys).agg(n_queries.alias("chunks"))
    ask = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in keys[1:]], "vec_id", "h", "v", "floor").join(open_, ["dim", "q_top", "q_cell", "q_part"])
    load = staged(load, "load")
    ask = ask.join(load, keys).withColumn("chunk", F.pmod(F.xxhash64("q_top", "q_cell", "q_part"), F.col("chunks")).cast("int"))
    held = blocks.join(load, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = [*keys, "chunk"]
    second = ask.select(*by, "vec_id", "h", "v", "floor").groupBy(*by).cogroup(held.select(*by, "vec_id", "h", "v").groupBy(*by)).applyInArrow(search, out)
    all_ = first.union(staged(second, "second")).withColumn("rank", F.row_number().over(ranked))
    return all_.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots among the points, each the farthest from those before."""
    out, near, pick = [], np.full(len(points), np.inf), 0
    for _ in range(min(count, len(points))):
        out.append(points[pick])
        near = np.minimum(near, ((points - points[pick]) ** 2).sum(axis=1))
        pick = int(near.argmax())
        if near[pick] == 0:
            break
    return np.stack(out)
