"""Counts, sums and products of wide vectors for each unit, as square blocks that tasks add in a tree.

A vector of d numbers gets a leading 1, so that its products hold the count and the sums too.
A task multiplies its rows once for each unit and hands on the blocks of the upper triangle;
64 tasks' worth of them is added for each block, and then these sums. No row of the tables is
larger than a block, and the driver sees the total alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import written

#: Rows and columns of a block, and the bytes of products that a task holds before it hands them on.
BLOCK = 32
HELD = 256 << 20

_SCHEMA = "u string, i int, j int, d int, task int, t binary"


@dataclass
class Sums:
    """n, sums and products of columns."""

    n: float
    s: np.ndarray
    p: np.ndarray

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.n + o.n, self.s + o.s, self.p + o.p)

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.n - o.n, self.s - o.s, self.p - o.p)

    def centred(self) -> np.ndarray:
        return self.p - np.outer(self.s, self.s) / self.n


def blocks_of(u: str, m: np.ndarray, task: int) -> pd.DataFrame:
    """The upper triangle of a symmetric matrix as rows, the last blocks filled with 0."""
    d = len(m)
    full = np.pad(m, (0, -d % BLOCK))
    spans = range(0, len(full), BLOCK)
    rows = [(u, i // BLOCK, j // BLOCK, d, task, full[i : i + BLOCK, j : j + BLOCK].tobytes()) for i in spans for j in spans if i <= j]
    return pd.DataFrame(rows, columns=["u", "i", "j", "d", "task", "t"])


def from_blocks(g: pd.DataFrame) -> Sums:
    d = int(g["d"].iloc[0])
    full = np.zeros((d + -d % BLOCK,) * 2)
    for i, j, t in zip(g["i"], g["j"], g["t"], strict=True):
        block = np.frombuffer(t).reshape(BLOCK, BLOCK)
        full[i * BLOCK : (i + 1) * BLOCK, j * BLOCK : (j + 1) * BLOCK] = block
        full[j * BLOCK : (j + 1) * BLOCK, i * BLOCK : (i + 1) * BLOCK] = block.T
    return Sums(full[0, 0], full[0, 1:d].copy(), full[1:d, 1:d].copy())


def _added(rows: DataFrame, group: str) -> DataFrame:
    """Blocks of one unit, place and ``group`` become one, added in the order of their tasks; a task holds one sum at a time."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sum_, d = None, None, 0
        done: list[tuple] = []
        for b in batches:
            for u, i, j, own, task, part, t in b[["u", "i", "j", "d", "task", "part", "t"]].itertuples(index=False):
                if (u, i, j, part) == key:
                    sum_ += np.frombuffer(t)
                    continue
                if key is not None:
                    done.append((*key[:3], d, key[3], sum_.tobytes()))
                key, sum_, d = (u, i, j, part), np.frombuffer(t).copy(), own
                if len(done) >= 1024:
                    yield pd.DataFrame(done, columns=["u", "i", "j", "d", "task", "t"])
                    done = []
        if key is not None:
            done.append((*key[:3], d, key[3], sum_.tobytes()))
        yield pd.DataFrame(done, columns=["u", "i", "j", "d", "task", "t"])

    own = rows.withColumn("part", F.expr(group).cast("int"))
    return own.repartition("u", "i", "j", "part").sortWithinPartitions("u", "i", "j", "part", "task").mapInPandas(add, _SCHEMA)


@dataclass
class Moments:
    """A written table of blocks for each unit."""

    table: DataFrame

    def total(self) -> Sums | None:
        """The sums of all units: width squared numbers, on the driver."""
        g = _added(self.table.withColumn("task", F.hash("u")).withColumn("u", F.lit("")), "0").toPandas()
        return from_blocks(g) if len(g) else None

    def by_unit(self, fit: Callable[[str, Sums], list[tuple]], schema: str) -> DataFrame:
        """Rows that ``fit`` makes of a unit's sums, each unit in a task of its own; its group is its own blocks."""
        names = [c.split()[0] for c in schema.split(", ")]
        return self.table.groupBy("u").applyInPandas(lambda g: pd.DataFrame(fit(g["u"].iloc[0], from_blocks(g)), columns=names), schema)

    def collected(self) -> dict[str, Sums]:
        """The sums of every unit, for narrow vectors and few units."""
        g = self.table.toPandas()
        return {u: from_blocks(own) for u, own in g.groupby("u")}


def moments(df: DataFrame, vector: str, unit: str) -> Moments:
    """Sums of a vector column (all of one length) for each unit, read as text; null vectors and units take no part.

    No rows give a table without units.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        task = TaskContext.get().partitionId()
        for b in batches:
            for u, g in b.groupby("u"):
                for k in range(0, len(g), 1024):
                    x = np.stack([np.asarray(v, float) for v in g["v"].iloc[k : k + 1024]])
                    x = np.hstack([np.ones((len(x), 1)), x])
                    held[u] = held[u] + x.T @ x if u in held else x.T @ x
                if sum(m.nbytes for m in held.values()) > HELD:
                    for own, m in held.items():
                        yield blocks_of(own, m, task)
                    held = {}
        for u, m in held.items():
            yield blocks_of(u, m, task)

    rows = df.select(F.col(unit).cast("string").alias("u"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("u").isNotNull())
    return Moments(written(_added(_added(rows.mapInPandas(part, _SCHEMA), "task % 64"), "0")))
