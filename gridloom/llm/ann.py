"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Rows are dealt to cells by their nearest centre. A query searches as many of its nearest cells
and ranks as many rows of a block exactly as a trial with other queries asks for. The nearest row has the largest <q, x> - |x|^2 / 2.
Half the squared norm is kept exactly and the inner product is approximated: x is cut into pairs of components, each coded by
one of 16 codewords, and both codes and codewords minimise a loss in which the residual
parallel to x weighs more than the rest. A query scans the codes with tables of 16 sums
for each pair, two codes a byte; the best are ranked by exact distance.

The trial, and a search that may lose nothing, go on from there. Each row also
keeps how far it is from what its code stands for. By the triangle inequality no row is nearer
than its code less that gap, so every row whose bound does not exceed the k-th exact distance
is ranked exactly too, and none that is nearer is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

WORDS = 16


@dataclass
class Codebook:
    """words: pair, codeword, component; parallel: how much more a parallel residual weighs."""

    words: np.ndarray
    parallel: float

    @staticmethod
    def pairs(x: np.ndarray) -> np.ndarray:
        """Rows as pairs of components, an odd number filled with 0; pairs to a multiple of two."""
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
        return x.reshape(len(x), -1, 2)

    @classmethod
    def train(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 1) -> Codebook:
        """Fit to rows of one length: k-means for each pair, then rounds of coding and least squares under the anisotropic loss."""
        parallel = 1 + max(0.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2) - 1)
        p = cls.pairs(x)
        rng = np.random.default_rng(seed)
        words = p[rng.choice(len(p), WORDS, replace=len(p) < WORDS)].transpose(1, 0, 2) + rng.normal(0, 1e-9, (p.shape[1], WORDS, 2))
        for s in range(p.shape[1]):
            for _ in range(12):
                at = ((p[:, s, None] - words[s][None]) ** 2).sum(axis=2).argmin(axis=1)
                for k in np.unique(at):
                    words[s, k] = p[at == k, s].mean(axis=0)
        book = cls(words, parallel)
        n, m, _ = p.shape
        unit = p / np.sqrt((p * p).sum(axis=(1, 2), keepdims=True))
        rows = np.arange(n)
        for _ in range(rounds):
            code = book.encode(x)
            # Normal equations over all codewords: |x - Bc|^2 + (parallel - 1) (u . (x - Bc))^2, summed over the rows.
            along = np.zeros((n, m, WORDS, 2))
            along[rows[:, None], np.arange(m)[None], code] = unit
            along = along.reshape(n, -1)
            a = (parallel - 1) * (along.T @ along)
            count, sums = np.zeros((m, WORDS)), np.zeros((m, WORDS, 2))
            np.add.at(count, (np.arange(m)[None].repeat(n, 0), code), 1)
            np.add.at(sums, (np.arange(m)[None].repeat(n, 0), code), p)
            a[np.diag_indices_from(a)] += np.repeat(count, 2) + 1e-6
            b = sums.reshape(-1) + (parallel - 1) * (along.T @ (unit * p).sum(axis=(1, 2))) + 1e-6 * book.words.reshape(-1)
            book = cls(np.linalg.solve(a, b).reshape(m, WORDS, 2), parallel)
        return book

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest codewords."""
        p = self.pairs(x)
        size = np.sqrt((p * p).sum(axis=(1, 2), keepdims=True))
        unit = p / np.where(size > 0, size, 1)
        code = np.stack([((p[:, s, None] - self.words[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(p.shape[1])], axis=1)
        rest = p - self.words[np.arange(p.shape[1])[None], code]
        along = (unit * rest).sum(axis=(1, 2))
        for _ in range(sweeps):
            for s in range(p.shape[1]):
                r = p[:, s, None] - self.words[s][None]
                a = (unit[:, s, None] * r).sum(axis=2)
                others = along - np.take_along_axis(a, code[:, s : s + 1], 1)[:, 0]
                total = others[:, None] + a
                code[:, s] = ((r * r).sum(axis=2) + (self.parallel - 1) * total * total).argmin(axis=1)
                along = np.take_along_axis(total, code[:, s : s + 1], 1)[:, 0]
        return code

    def packed(self, x: np.ndarray) -> np.ndarray:
        code = self.encode(x).astype(np.uint8)
        return code[:, ::2] | code[:, 1::2] << 4

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that packed codes stand for."""
        code = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
        return self.words[np.arange(code.shape[1])[None], code].reshape(len(code), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For a query, the inner products behind each byte of two codes."""
        t = np.einsum("sd,skd->sk", self.pairs(q[None])[0], self.words)
        return (t[1::2, :, None] + t[::2, None, :]).reshape(len(t) // 2, 256)


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``vec_id``, ``v`` in double precision, ``dim``) of rows with an id whose vector is finite, without nulls and not zero."""
    v = F.col(vector_col)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    apart = x - v
    return np.sqrt((apart * apart).sum(axis=1))


def centres(x: np.ndarray, count: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    """At most ``count`` centres of rows by k-means; one that loses all its rows stays where it was."""
    out = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:count]], axis=0)
    for _ in range(rounds if len(out) > 1 else 0):
        at = by_nearness(x, out, 1)[:, 0]
        n = np.bincount(at, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, at, x)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def by_nearness(x: np.ndarray, centres_: np.ndarray, most: int) -> np.ndarray:
    """For each row the numbers of its ``most`` nearest centres, the nearest first."""
    half, out = (centres_ * centres_).sum(axis=1) / 2, []
    for i in range(0, len(x), 1024):
        far = half - x[i : i + 1024] @ centres_.T
        out.append(far.argmin(axis=1)[:, None] if most == 1 else far.argsort(axis=1, kind="stable")[:, :most])
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    recall: float = 0.98,
    trial: int = 256,
    candidates: int = 200,
    sample: int = 4096,
    cell_rows: int = 4096,
    most_cells: int = 4096,
    block_rows: int = 1 << 12,
    query_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 9,
) -> DataFrame:
    """For each row whose id is divisible by ``every``, the k nearest other rows, by Euclidean distance.

    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (the distance between the
    original vectors in double precision), ``ranked`` (how many rows the query's last search ranked exactly). All rows are indexed: each belongs to the cell of
    its nearest centre and has its codes. Centres, one for ``cell_rows`` rows and at most
    ``most_cells``, and codewords are fitted on a bounded sample by a seeded hash (``sample``
    rows, or 16 for each centre).

    About ``trial`` rows, by hash, are searched for in all cells in the exact way: the
    ``candidates`` best rows of a block by the code tables are ranked, and then all that can
    be as near as the k-th of them. They are not among the queries (unless every row is one). As
    queries may lie where other rows do not, a tenth of them, ``trial`` / 2 at most, is tried too;
    these are answered like all others. Whichever of the two sets asks for more shows how many of the nearest cells, and how many of the best rows of a block by code,
    hold ``recall`` of the neighbours. The queries search as many cells and rank as many
    rows of each block. A query that finds less than k rows, and every query where ``recall`` is 1
    or no row is left for a trial, takes the exact way. Equal distances go to the smaller id.

    * Vectors that are null, zero or hold a null or non-finite component take no part, nor
      do rows with a null id. Vectors are compared with those of their own length.
    * A query does not find rows of its own id. Rows that share an id are rows of their own,
      and queries of their own where their vectors differ; equal rows are one query.
    * An empty table gives no rows. Other columns are left out, so their names cannot clash.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vector_col)
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"))
    n, kinds = lengths.agg(F.sum("n"), F.count("*")).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, ranked long")
    cells = F.greatest(F.lit(1), F.least(F.lit(max(1, most_cells // kinds)), F.ceil(F.col("n") / F.lit(cell_rows)))).cast("int")
    wanted = lengths.withColumn("cells", cells)
    wanted = wanted.withColumn("share", F.greatest(F.lit(max(sample // kinds, 4 * WORDS)), 16 * F.col("cells")) / F.col("n"))
    mark = F.xxhash64(F.lit(seed), "vec_id", "v").alias("h")
    some = rows.join(wanted, "dim").where(mark / F.lit(2.0**64) + 0.5 <= F.col("share")).select("dim", "cells", "v").toPandas()
    books, grid = {}, {}
    for d, g in some.groupby("dim"):
        x = np.stack([np.asarray(v, float) for v in g["v"]])
        books[int(d)], grid[int(d)] = Codebook.train(x[:sample]), centres(x, int(g["cells"].iloc[0]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                x = matrix(own.column("v"))
                # A length that the sample lacks has one code, that of 0, and one cell.
                code = books[int(d)].packed(x) if int(d) in books else np.zeros((len(x), 1), np.uint8)
                like = books[int(d)].decode(code) if int(d) in books else np.zeros_like(x)
                cell = by_nearness(x, grid[int(d)], 1)[:, 0] if int(d) in grid else np.zeros(len(x), np.int64)
                rest = np.pad(x, ((0, 0), (0, like.shape[1] - x.shape[1]))) - like
                with np.errstate(over="ignore"):
                    single = x.astype(np.float32)
                raw = single if (single == x).all() else x
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                sums = [pa.array(z) for z in ((x * x).sum(axis=1) / 2, (like * like).sum(axis=1) / 2, np.sqrt((rest * rest).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("h"), own.column("dim"), pa.array(cell.astype(np.int32)), binary(code), *sums, binary(raw)], names=["vec_id", "h", "dim", "cell", "code", "half", "code_half", "gap", "x"])

    marked = rows.select("vec_id", mark, "dim", "v")
    coded = staged(marked.mapInArrow(index, "vec_id long, h long, dim int, cell int, code binary, half double, code_half double, gap double, x binary"), "codes")
    sizes = staged(coded.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")), "sizes")
    queries = staged(marked.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "h"]), "queries")
    apart = marked.where(F.pmod("vec_id", F.lit(every)) != 0) if every > 1 else marked
    tried = apart.where(F.xxhash64(F.lit(seed + 1), "h") / F.lit(2.0**64) + 0.5 <= trial / n).dropDuplicates(["vec_id", "h"])

    def cells_of(most: int | None):  # noqa: ANN202
        """Each query with each of its nearest cells, all or as many."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims):
                    own = b.take(pa.array(np.flatnonzero(dims == d)))
                    count = len(grid[int(d)]) if int(d) in grid else 1
                    for i in range(0, own.num_rows, max(1, 16384 // count)):
                        part = own.slice(i, max(1, 16384 // count))
                        near = by_nearness(matrix(part.column("v")), grid[int(d)], min(most or count, count)) if int(d) in grid else np.zeros((part.num_rows, 1), np.int64)
                        at = np.repeat(np.arange(part.num_rows), near.shape[1])
                        place = np.tile(np.arange(near.shape[1], dtype=np.int32), part.num_rows)
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(near.ravel().astype(np.int32)), pa.array(place)], names=["vec_id", "h", "dim", "v", "cell", "place"])

        return run

    def scan(asked: pa.Table, codes: pa.Table, most_ranked: int | None) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "query_h", "place", "vec_id", "score", "depth", "ranked")}
        if len(asked) and len(codes):
            d = int(codes.column("dim")[0].as_py())
            own, asked = codes.sort_by("vec_id").combine_chunks(), asked.combine_chunks()
            raw = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(own), -1).T.copy()
            x = np.stack([np.frombuffer(r, np.float64 if len(r) == 8 * d else np.float32) for r in own.column("x").to_pylist()]).astype(np.float64)
            ids, half, code_half, gap = (own.column(c).to_numpy() for c in ("vec_id", "half", "code_half", "gap"))
            marks = zip(*(asked.column(c).to_pylist() for c in ("vec_id", "h", "place")), strict=True)
            for (q, h, place), v in zip(marks, matrix(asked.column("v").combine_chunks()), strict=True):
                vv, others = v @ v, ids != q
                inner = np.zeros(len(ids))
                if d in books:
                    for table, byte in zip(books[d].tables(v), raw, strict=True):
                        inner += table[byte]
                score = np.where(others, inner - half, -np.inf)
                order = np.argsort(-score, kind="stable")  # ties go to the smaller id
                if most_ranked is None or d not in books:
                    best = order[:candidates]
                    best = np.sort(distances(x[best[others[best]]], v))
                    limit = best[k - 1] if len(best) >= k else np.inf
                    # Rounding is allowed for: a bound that is too low costs a comparison only.
                    least = np.sqrt(np.maximum(vv + 2 * (code_half - inner) - 1e-12 * (vv + 2 * code_half), 0)) - gap * (1 + 1e-12)
                    may = np.flatnonzero(others & ~(least > limit * (1 + 1e-12)))
                    ranked = len(may)
                    dots = (x @ v)[may] if 2 * len(may) > len(x) else x[may] @ v
                    square = vv + 2 * (half[may] - dots)
                    may = may[~(square > limit * limit * (1 + 1e-12) + 1e-12 * (vv + 2 * half[may]))]
                else:
                    may = order[:most_ranked]
                    may = may[others[may]]
                    ranked = len(may)
                far = distances(x[may], v)
                may, far = may[np.isfinite(far)], far[np.isfinite(far)]
                best = np.lexsort((ids[may], far))[:k]
                depth = np.empty(len(order), np.int32)
                depth[order] = np.arange(len(order), dtype=np.int32)
                # What a block ranks stands on its first row.
                ranks = np.where(np.arange(len(best)) == 0, ranked, 0)
                for c, value in zip(out, (np.full(len(best), q), np.full(len(best), h), np.full(len(best), place), ids[may[best]], far[best], depth[may[best]], ranks), strict=True):
                    out[c].append(value)
        kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0), kind) for (c, v), kind in zip(out.items(), kinds_, strict=True)})

    def searched(asked: DataFrame, most: int | None, most_ranked: int | None) -> DataFrame:
        """The k nearest rows of each query in its cells, with the place of the row's cell among the query's and of the row in its block."""
        asked = staged(asked.mapInArrow(cells_of(most), "vec_id long, h long, dim int, v array<double>, cell int, place int"), "asked")
        # A task gets one block of a cell and a chunk of the queries that ask for the cell.
        load = staged(asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("chunks")).join(sizes, ["dim", "cell"]), "load")
        by = ["dim", "cell", "block", "chunk"]
        left = asked.join(load, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = coded.join(load, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "h"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        found = left.select(*by, "vec_id", "h", "place", "v").groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, c: scan(a, c, most_ranked), "query_id long, query_h long, place int, vec_id long, score double, depth int, ranked long")
        query = W.partitionBy("query_id", "query_h")
        rank = F.row_number().over(query.orderBy("score", "vec_id")).cast("int")
        return staged(found.withColumn("ranked", F.sum("ranked").over(query)).withColumn("rank", rank).where(F.col("rank") <= k), "found")

    def reaching(counts: DataFrame, share: float) -> int | None:
        """How many of the first places hold a share of the rows counted; None without rows."""
        each = sorted(map(tuple, counts.collect()))  # a row for each cell, or place in a block, at most
        seen, every_ = 0, sum(c for _, c in each)
        for at, c in each:
            seen += c
            if seen >= share * every_:
                return at + 1
        return None

    def asks(exact: DataFrame) -> tuple[int, int] | None:
        """How many cells, and rows of a block, hold ``recall`` of rows found exactly: half of what may be lost goes to cells, the rest to codes."""
        cells_ = reaching(exact.groupBy("place").agg(F.count("*")), 1 - (1 - recall) / 2)
        if cells_ is None:
            return None
        return cells_, max(k + 1, reaching(exact.where(F.col("place") < cells_).groupBy("depth").agg(F.count("*")), recall / (1 - (1 - recall) / 2)))

    most = most_ranked = None
    if recall < 1:
        some = min(trial // 2, -(-queries.count() // 10))
        own = staged(queries.orderBy(F.xxhash64(F.lit(seed + 2), "h"), "vec_id", "h").limit(some), "own")
        wanted_ = [a for a in (asks(searched(tried, None, None)), asks(searched(own, None, None))) if a]
        if wanted_:
            most, most_ranked = (max(a) for a in zip(*wanted_, strict=True))
    out = searched(queries, most, most_ranked)
    if most is not None:
        full = out.groupBy("query_id", "query_h").agg(F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), F.col("query_h").alias("h"))
        short = staged(queries.join(full, ["vec_id", "h"], "left_anti"), "short")
        again = searched(short, None, None)
        rest = short.select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_h"))
        out = out.join(rest, ["query_id", "query_h"], "left_anti").select(again.columns).unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score", "ranked")
