"""Importance resampling towards a target distribution, over hashed word n-grams.

A tokenizers ``Split`` over a regular expression, which needs no training, cuts the ASCII
lower-cased text to words with their offsets. Windows over consecutive offset pairs are the
features; each falls in the bucket of its CRC-32. Histograms of all documents and of the
target give every bucket a gain, a document weighs the sum of its features' gains, and
seeded Gumbel noise on the weights draws documents without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import staged

#: Fixed value: what a word is made of, after A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Runs between blanks that a task keeps with their words; beyond that it starts again.
KEPT = 1 << 17
#: Bytes of text that are worked on together, and rows of a batch.
SLICE, ROWS = 1 << 20, 256


def _shift_tables(length: int) -> np.ndarray:
    """Four tables of 256: what ``length`` zero bytes make of each byte of a CRC-32, to be xor-ed."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit, as columns of a matrix over bits
    out, bits = [1 << i for i in range(32)], 8 * length

    def times(m: list[int], v: int) -> int:
        x = 0
        while v:
            x ^= m[(v & -v).bit_length() - 1]
            v &= v - 1
        return x

    while bits:
        if bits & 1:
            out = [times(step, v) for v in out]
        step, bits = [times(step, v) for v in step], bits >> 1
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            half = 1 << i
            tables[k, half : 2 * half] = tables[k, :half] ^ np.uint32(out[8 * k + i])
    return tables


class Features:
    """The buckets of all runs of 1 to ``n`` consecutive words of texts."""

    def __init__(self, n: int = 3, buckets: int = 10_000) -> None:
        self.n, self.buckets = n, buckets
        self.split = Split(Regex(WORD), "removed", invert=True)
        self.row_of: dict[int, int] = {0: 0}
        self.tables = _shift_tables(0)[None]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.crc, self.spaced, self.length = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _make_room(self, fresh: int) -> None:
        """Forget the runs that are used least, where the fresh ones would be too many."""
        if not self.known or len(self.known) + fresh <= KEPT:
            return
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: max(0, min(KEPT // 2, KEPT - fresh))])
        runs = list(self.known)
        self.known = {runs[i]: k for k, i in enumerate(stay.tolist())}
        counts, starts = self.counts[stay], self.starts[stay]
        ends = np.cumsum(counts)
        word = np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())
        self.starts, self.counts, self.uses = ends - counts, counts, self.uses[stay] // 2
        self.crc, self.spaced, self.length = self.crc[word], self.spaced[word], self.length[word]

    def _learn(self, runs: list[bytes]) -> None:
        """Cut runs between blanks to words. A blank is in no word, so a run's words do not depend on what is around it."""
        counts, raw = [], []
        for i in range(0, len(runs), 128):  # the splitter is fastest on short strings
            text = b" ".join(runs[i : i + 128]).decode()
            ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            words = self.split.pre_tokenize_str(text)
            counts.append(np.bincount(np.searchsorted(ends, [start for _, (start, _) in words], side="right"), minlength=len(runs[i : i + 128])))
            raw += [w.encode() for w, _ in words]
        counts = np.concatenate(counts)
        at, first = len(self.counts), len(self.crc)
        self.known |= zip(runs, range(at, at + len(runs)), strict=True)
        self.starts = np.r_[self.starts, first + np.cumsum(counts) - counts]
        self.counts, self.uses = np.r_[self.counts, counts], np.r_[self.uses, np.zeros_like(counts)]
        self.crc = np.r_[self.crc, np.array(list(map(zlib.crc32, raw)), np.uint32)]
        self.spaced = np.r_[self.spaced, np.array([zlib.crc32(w + b" ") for w in raw], np.uint32)]
        self.length = np.r_[self.length, np.array(list(map(len, raw)), np.int64)]

    def _joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of strings put together: that of the left ones moved by the right ones' lengths, and that of the right ones."""
        rows = np.zeros(int(length.max(initial=0)) + 1, np.int64) if length.max(initial=0) < 1 << 16 else None
        for n in np.unique(length).tolist():
            if n not in self.row_of:
                if len(self.row_of) > 1 << 12:
                    self.row_of, self.tables = {0: 0}, self.tables[:1]
                    return self._joined(left, right, length) if len(np.unique(length)) < 1 << 12 else np.array([_one(a, b, m) for a, b, m in zip(left, right, length, strict=True)], np.uint32)
                self.row_of[n] = len(self.tables)
                self.tables = np.concatenate([self.tables, _shift_tables(n)[None]])
            if rows is not None:
                rows[n] = self.row_of[n]
        row = rows[length] if rows is not None else np.array([self.row_of[n] for n in length.tolist()], np.int64)
        flat, base = self.tables.reshape(-1), row * 1024
        out = right.copy()
        for k in range(4):
            out ^= flat[base + (256 * k) + ((left >> np.uint32(8 * k)) & np.uint32(255))]
        return out

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of the texts, in order: (words of each text, the text of each feature, the bucket of each feature)."""
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append((t or "").encode().translate(_LOWER))
            size += len(part[-1])
            if size >= SLICE:
                yield self._of(part)
                part, size = [], 0
        if part:
            yield self._of(part)

    def _of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [t.split() for t in texts]
        runs = list(chain.from_iterable(own))
        fresh = set(runs).difference(self.known)
        if len(self.known) + len(fresh) > KEPT:
            self._make_room(len(fresh))
            fresh = set(runs).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        at = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        self.uses += np.bincount(at, minlength=len(self.uses))
        owner = np.repeat(np.arange(len(texts)), list(map(len, own)))
        many = self.counts[at]
        owner = np.repeat(owner, many)
        ends = np.cumsum(many)
        word = np.repeat(self.starts[at] - (ends - many), many) + np.arange(len(owner))
        crc, spaced, length = self.crc[word], self.spaced[word], self.length[word]
        owners, found, ahead = [owner], [crc], spaced
        for j in range(1, self.n):
            if len(word) <= j:
                break
            ahead = ahead[:-1]  # CRC of the j words in front and a space
            same = owner[j:] == owner[: len(owner) - j]
            found.append(self._joined(ahead, crc[j:], length[j:])[same])
            owners.append(owner[j:][same])
            if j + 1 < self.n:
                ahead = self._joined(ahead, spaced[j:], length[j:] + 1)
        return np.bincount(owner, minlength=len(texts)), np.concatenate(owners), (np.concatenate(found) % np.uint32(self.buckets)).astype(np.int64)


def _one(left: int, right: int, length: int) -> int:
    t = _shift_tables(int(length))
    return int(right) ^ int(t[0, left & 255] ^ t[1, (left >> 8) & 255] ^ t[2, (left >> 16) & 255] ^ t[3, left >> 24])


def featured(texts: DataFrame, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """Columns in front of the last, ``n_words``, ``n_features`` and ``found`` (the buckets of a text's features, unsigned little-endian integers) for rows whose last column is the text."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    keys = texts.schema[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(n, buckets)
        for b in _small(batches):
            at = 0
            for words, owner, found in features.of(b.column(len(keys)).to_pylist()):
                many = np.bincount(owner, minlength=len(words))
                rows = found[np.argsort(owner, kind="stable")].astype(kind)
                ends = np.cumsum(many)
                raw = pa.array([rows[e - m : e].tobytes() for e, m in zip(ends, many, strict=True)], pa.binary())
                part = b.slice(at, len(words))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(words.astype(np.int64)), pa.array(many.astype(np.int64)), raw], names=[*part.schema.names[:-1], "n_words", "n_features", "found"])
                at += len(words)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return texts.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n_words long, n_features long, found binary")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows, as a batch is held several times over while it is worked on."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def _found(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, bucket) of all features of a column."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    raw = column.to_pylist()
    return np.repeat(np.arange(len(raw)), [len(r) // kind.itemsize for r in raw]), np.frombuffer(b"".join(raw), kind).astype(np.int64)


def histogram(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """All features of ``featured`` rows by bucket. Each task counts its own; at most ``buckets`` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for b in _small(batches):
            out += np.bincount(_found(b.column(0), buckets)[1], minlength=buckets)
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], names=["bucket", "n"])

    rows = features.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, many in rows.collect():  # one row for each bucket at most
        total[bucket] = many
    return total


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the pool)) of each bucket, both smoothed by one feature a bucket."""
    s, t, width = int(pool.sum()), int(target.sum()), len(pool)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + width) / ((int(a) + 1) * (t + width)))) for a, b in zip(pool, target, strict=True)], np.int64)


def noise(id_col: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)) with u from the id's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def places(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows in an order, with ``rank`` from 1, without a task that holds them all.

    Rows are dealt to ranges of the order and written; counts of the ranges, a row for each
    partition, give every range its first rank, and ranges behind the last wanted one are not read.
    """
    spark = rows.sparkSession
    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    keyed = staged(keyed, "ranges")
    sizes = keyed.groupBy("__range").agg(F.count("*").alias("__n")).orderBy("__range").collect()  # one row for each partition
    ahead, firsts = 0, []
    for r in sizes:
        if ahead < count:
            firsts.append((r[0], ahead))
        ahead += r[1]
    firsts_df = F.broadcast(spark.createDataFrame(firsts or [(-1, 0)], "__range int, __ahead long"))
    ranked = keyed.join(firsts_df, "__range").withColumn("rank", F.col("__ahead") + F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return ranked.where(F.col("rank") <= count).drop("__range", "__ahead")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: float | tuple[int, int] = (5, 100),
    min_words: int = 20,
    n: int = 3,
    buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """All documents with their weight towards the target, and the rank of those that are drawn.

    Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``. Of the
    documents with at least ``min_words`` words, the given share (numerator, denominator) with
    the highest scores is drawn, ties to the smaller id; the others have a null rank.

    * A null or empty text has no words, no features and weight 0. Texts are read as a whole.
    * A row with a null id has its weight, but no score, and is never drawn nor counted among
      the documents to draw from. Its text counts in the histogram, as every text does.
    * Rows that share an id are documents of their own with one noise; equal ones are drawn in
      any order, which changes no row of the result but by its rank among equals.
    * An empty table gives no rows; an empty target leaves each bucket the smoothed share.
      Other columns are left out, so their names cannot clash.
    """
    text = lambda col: F.col(f"`{col}`").cast("string").alias("text")
    own = staged(featured(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text(text_col)), n, buckets), "features")
    gain = gains(histogram(own, buckets), histogram(featured(target.select(text(target_col)), n, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            row, found = _found(b.column(3), buckets)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, row, gain[found])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    rated = own.select("doc_id", "n_words", "n_features", "found").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    rated = staged(rated.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "rated")
    fit = rated.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    up, down = share if isinstance(share, tuple) else share.as_integer_ratio()
    drawn = fit.count() * up // down
    first = places(fit.select("score", "doc_id", "row"), [F.desc("score"), F.asc("doc_id"), F.asc("row")], drawn)
    out = rated.join(first.select("row", F.col("rank").cast("long").alias("rank")), "row", "left")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


