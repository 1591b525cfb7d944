"""Token ids in binary shards with a minimal-perfect-hash index.

A shard is a file of raw ids in ascending document order:

    magic "GLTB", version u32, bytes per id u32, 0 u32
    payload: the ids, little-endian
    places: for each document the ids of the shard before it, u64, and the total at the end
    documents u64, first byte of the places u64, magic "BTLG"

The index has one file for each bucket of keys:

    magic "GLIX", version u32, keys u64, levels u32, 0 u32, for each level its 64-bit words u64
    the levels' bits, u64 words
    for each word the bits before it, u32
    slots, one for each key: fingerprint u32, shard u32, first document u64, documents u32

A key's slot is the rank of its first free bit. ``get`` reads one word for each level down
to that bit, less than two on average, then its rank, the slot and the ids; ``lookup``, for
many keys, reads the files of the buckets it needs as a whole. The stored fingerprint
rejects keys that were never written. Rows of one key may go on in the next shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_rows, work_dir
from .encoding import Encoder, vocabulary_size

SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("copies", "<u4")])
#: Bits of a level for each key that reaches it.
GAMMA = 2
U = np.uint64


def scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    x = (x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)).astype(np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def place(h: np.ndarray, bits: int) -> np.ndarray:
    """Places below ``bits``, from the upper half of a hash."""
    return ((h >> U(32)) * U(bits)) >> U(32)


class HashIndex:
    """A minimal perfect hash over distinct 64-bit keys: levels of bits, a key rests at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray], slots: np.ndarray) -> None:
        self.levels, self.slots = levels, slots
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.uint64)
        self.before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones)])[:-1] if len(words) else ones
        self.base = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> HashIndex:
        left, levels = keys, []
        while len(left):
            n = max(1, -(-len(left) * GAMMA // 64))
            at = place(scrambled(left, len(levels)), 64 * n)
            _, back, count = np.unique(at, return_inverse=True, return_counts=True)
            alone = count[back] == 1
            words = np.zeros(n, np.uint64)
            np.bitwise_or.at(words, at[alone] >> U(6), U(1) << (at[alone] & U(63)))
            levels.append(words)
            left = left[~alone]
        out = cls(levels, np.zeros(len(keys), SLOT))
        rank = out.rank(keys)
        values = values.copy()
        values["mark"] = scrambled(keys, 1 << 20) & U(0xFFFFFFFF)
        out.slots[rank] = values
        return out

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 if it rests at no level."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, words in enumerate(self.levels):
            at = place(scrambled(keys[open_], i), 64 * len(words))
            word, bit = at >> U(6), at & U(63)
            hit = (words[word] >> bit & U(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((U(1) << bit) - U(1))).astype(np.uint64)
            out[open_[hit]] = (self.before[self.base[i] + word.astype(np.int64)] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slots): whether each key's fingerprint is stored at its rank, and the slots there."""
        rank = self.rank(keys)
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), SLOT)
        slots = self.slots[np.maximum(rank, 0)]
        return (rank >= 0) & (slots["mark"] == (scrambled(keys, 1 << 20) & U(0xFFFFFFFF))), slots

    def to_bytes(self) -> bytes:
        head = b"GLIX" + np.array([2], "<u4").tobytes() + np.array([len(self.slots)], "<u8").tobytes() + np.array([len(self.levels), 0], "<u4").tobytes()
        return b"".join([head, np.array([len(x) for x in self.levels], "<u8").tobytes(), *[x.astype("<u8").tobytes() for x in self.levels], self.before.astype("<u4").tobytes(), self.slots.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> HashIndex:
        if raw[:4] != b"GLIX":
            raise ValueError("not an index file")
        n, (count, _) = int(np.frombuffer(raw, "<u8", 1, 8)[0]), np.frombuffer(raw, "<u4", 2, 16)
        sizes, at, levels = np.frombuffer(raw, "<u8", count, 24), 24 + 8 * int(count), []
        for size in sizes.tolist():
            levels.append(np.frombuffer(raw, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        return cls(levels, np.frombuffer(raw, SLOT, n, at + 4 * sum(sizes.tolist())))


class IndexFile:
    """One index file, open for looking up single keys."""

    def __init__(self, path: str) -> None:
        system, name = opened(path)
        self.file = system.open_input_file(name)
        head = self.file.read_at(24, 0)
        if head[:4] != b"GLIX":
            raise ValueError(f"not an index file: {path}")
        levels = int(np.frombuffer(head, "<u4", 1, 16)[0])
        self.sizes = np.frombuffer(self.file.read_at(8 * levels, 24), "<u8").tolist()
        self.words = 24 + 8 * levels

    def find(self, key: int) -> np.void | None:
        """The slot of a key, or None if it was never written."""
        one, before = np.array([key], np.int64).view(np.uint64), 0
        for i, size in enumerate(self.sizes):
            at = int(place(scrambled(one, i), 64 * size)[0])
            word, bit = before + (at >> 6), at & 63
            held = int(np.frombuffer(self.file.read_at(8, self.words + 8 * word), "<u8")[0])
            if held >> bit & 1:
                ranks = self.words + 8 * sum(self.sizes)
                rank = int(np.frombuffer(self.file.read_at(4, ranks + 4 * word), "<u4")[0]) + (held & ((1 << bit) - 1)).bit_count()
                (slot,) = np.frombuffer(self.file.read_at(SLOT.itemsize, ranks + 4 * sum(self.sizes) + SLOT.itemsize * rank), SLOT)
                return slot if slot["mark"] == (scrambled(one, 1 << 20) & U(0xFFFFFFFF))[0] else None
            before += size
        return None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Shard:
    """One shard, open for reading by document number."""

    def __init__(self, path: str) -> None:
        system, name = opened(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(20, size - 20)
        head = self.file.read_at(16, 0)
        if tail[16:] != b"BTLG" or head[:4] != b"GLTB":
            raise ValueError(f"not a shard: {path}")
        self.n, self.places = (int(x) for x in np.frombuffer(tail, "<u8", 2))
        self.width = int(np.frombuffer(head, "<u4", 3, 4)[1])

    def spans(self, first: int, count: int) -> np.ndarray:
        """The places of ``count`` documents and the end of the last."""
        return np.frombuffer(self.file.read_at(8 * (count + 1), self.places + 8 * first), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, 16 + start * self.width), f"<u{self.width}")


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.ids"


def index_name(folder: str, bucket: int) -> str:
    return f"{folder}/index-{bucket:08d}.mph"


def put(path: str, parts: Iterator[bytes]) -> None:
    """Write a file under another name first, so that a lost or doubled task leaves none half written."""
    system, name = opened(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    with system.open_output_stream(own := f"{name}.{task.taskAttemptId() if task else 0}") as f:
        for part in parts:
            f.write(part)
    system.move(own, name)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (scrambled(key.view(np.uint64), 1 << 21) % U(buckets)).astype(np.int32)


#: A null id in an index: the smallest long, so that it also comes first in the files.
NULL_KEY = -(2**63)


class TokenStore:
    """Shards and index of one corpus in a folder that all executors reach."""

    def __init__(self, spark, folder: str) -> None:  # noqa: ANN001
        self.spark, self.folder = spark, folder
        info = spark.read.json(f"{folder}/info").head()
        self.buckets = int(info["buckets"])

    @classmethod
    def write(
        cls,
        docs: DataFrame,
        tokenizer: str,
        end_id: int = 2,
        folder: str | None = None,
        id_col: str = "doc_id",
        text_col: str = "text",
        keys_per_bucket: int = 1 << 14,
        shards: int | None = None,
    ) -> TokenStore:
        """Encode all documents and write them in ascending id order, rows with a null id first.

        Rows that share an id stand together; equal ids are ordered by text. The smallest
        long is reserved for null ids. An empty table makes a store without shards. Texts of
        any length are encoded as a whole; other columns are left out, so their names cannot
        clash. The rows of an id that very many share are dealt out by the beginnings of
        their texts, so that they need not stand in one shard.
        """
        few_rows(docs.sparkSession)
        spark, folder = docs.sparkSession, folder or f"{work_dir(docs.sparkSession)}/ids"
        width = 2 if vocabulary_size(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))
        rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        by = ["key", F.substring("text", 1, 16)]  # in the order of the texts
        rows = (rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)).sortWithinPartitions("key", "text")
        end = np.array([end_id], f"<u{width}").tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, encoder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
            keys: list[int] = []
            places = [0]

            def parts() -> Iterator[bytes]:
                yield b"GLTB" + np.array([1, width, 0], "<u4").tobytes()
                for batch in batches:
                    texts = batch.column(1)
                    keys.extend(batch.column(0).to_pylist())
                    for i in range(0, len(texts), 100):
                        for raw in encoder.ids(texts.slice(i, 100).to_pylist()):
                            own = np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes() + end
                            places.append(places[-1] + len(own) // width)
                            yield own
                yield np.array(places, "<u8").tobytes()
                yield np.array([len(places) - 1, 16 + width * places[-1]], "<u8").tobytes() + b"BTLG"

            first = next(batches, None)
            if first is not None:
                batches = (b for part in ([first], batches) for b in part)
                put(shard_name(folder, shard), parts())
            if keys:
                at = np.array(keys, np.int64)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                copies = np.diff(np.r_[starts, len(at)])
                n = len(starts)
                last = np.zeros(n, np.int64)
                last[-1] = places[-1]
                edge = np.zeros(n, bool)
                edge[[0, -1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(np.full(n, shard, np.int32)), pa.array(starts.astype(np.int64)), pa.array(copies.astype(np.int32)), pa.array(last), pa.array(edge)], names=["key", "shard", "first", "copies", "tokens", "edge"])

        rows.mapInArrow(run, "key long, shard int, first long, copies int, tokens long, edge boolean").write.parquet(f"{folder}/entries")
        entries = spark.read.parquet(f"{folder}/entries")
        # A shard's ids before it: one row for each shard, so the running sum is over few rows.
        bases = entries.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
        before = F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
        bases.select("shard", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{folder}/bases")
        # A key that goes on in other shards stands at their edges, of which each shard has two.
        edges = entries.where("edge").groupBy("key").agg(F.min(F.struct("shard", "first")).alias("at"), F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n"))
        entries.where("edge").join(edges.where("n > 1").select("key"), "key").select("key", "shard", "first", "copies").write.parquet(f"{folder}/runs")
        heads = edges.select("key", "at.shard", "at.first", "copies")
        heads = entries.where("not edge").select("key", "shard", "first", "copies").unionByName(heads)
        buckets = max(1, -(-entries.count() // keys_per_bucket))

        def index(group: pd.DataFrame) -> pd.DataFrame:
            b = int(group["bucket"].iloc[0])
            values = np.zeros(len(group), SLOT)
            for name in ("shard", "first", "copies"):
                values[name] = group[name].to_numpy()
            raw = HashIndex.build(group["key"].to_numpy().view(np.uint64), values).to_bytes()
            put(index_name(folder, b), iter([raw]))
            return pd.DataFrame({"bucket": [b], "keys": [len(group)], "bytes": [len(raw)]})

        cls._bucketed(heads, buckets).groupBy("bucket").applyInPandas(index, "bucket int, keys long, bytes long").write.parquet(f"{folder}/buckets")
        spark.createDataFrame([(buckets, width, end_id)], "buckets long, width int, end_id long").write.json(f"{folder}/info")
        return cls(spark, folder)

    @staticmethod
    def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = bucket_of(b.column("key").to_numpy(zero_copy_only=False), buckets)
                yield b.append_column("bucket", pa.array(own))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
        return keys.mapInArrow(add, f"{fields}, bucket int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """For distinct keys (column ``key``, null ids as NULL_KEY) shard, first document and documents; keys not stored are left out."""
        folder = self.folder

        def find(group: pd.DataFrame) -> pd.DataFrame:
            system, name = opened(index_name(folder, int(group["bucket"].iloc[0])))
            if system.get_file_info(name).type == fs.FileType.NotFound:
                return pd.DataFrame({"key": [], "shard": [], "first": [], "copies": []})
            with system.open_input_file(name) as f:
                own = HashIndex.from_bytes(f.read())
            found, slots = own.find(group["key"].to_numpy().view(np.uint64))
            return pd.DataFrame({"key": group["key"].to_numpy()[found], **{k: slots[k][found].astype(np.int64) for k in ("shard", "first", "copies")}})

        return self._bucketed(keys.select("key").distinct(), self.buckets).groupBy("bucket").applyInPandas(find, "key long, shard int, first long, copies int")

    def read(self, keys: DataFrame) -> DataFrame:
        """The documents of distinct keys, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, shard = -1, None
            for batch in batches:
                out: list[tuple] = []
                for key, own, first, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != number:
                        if shard:
                            shard.file.close()
                        number, shard = own, Shard(shard_name(folder, own))
                    spans = shard.spans(first, copies)
                    for a, b in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True):
                        out.append((None if key == NULL_KEY else key, own, a, b - a, shard.ids(a, b).astype("<u4").tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "shard", "place", "n_tokens", "ids"]
                for i in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 2000], strict=True), kinds, strict=True)], names=names)

        runs = self.spark.read.parquet(f"{self.folder}/runs").select("key", *[F.col(c).alias(f"run_{c}") for c in ("shard", "first", "copies")])
        found = self.lookup(keys).join(runs, "key", "left").select("key", *[F.coalesce(f"run_{c}", c).alias(c) for c in ("shard", "first", "copies")])
        found = found.repartition("shard").sortWithinPartitions("shard", "first")
        rows = found.mapInArrow(run, "doc_id long, shard int, place long, n_tokens long, ids binary")
        bases = self.spark.read.parquet(f"{self.folder}/bases")
        return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")

    def get(self, key: int | None) -> list[list[int]]:
        """The ids of the documents with one key, read directly; empty if there are none."""
        at = np.array([NULL_KEY if key is None else key], np.int64)
        path = index_name(self.folder, int(bucket_of(at, self.buckets)[0]))
        exists = lambda p: (lambda system, name: system.get_file_info(name).type != fs.FileType.NotFound)(*opened(p))
        slot = IndexFile(path).find(int(at[0])) if exists(path) else None
        out: list[list[int]] = []
        if slot is None:
            return out
        number, first, left = int(slot["shard"]), int(slot["first"]), int(slot["copies"])
        while left:
            if exists(shard_name(self.folder, number)):  # an empty partition has no shard
                shard = Shard(shard_name(self.folder, number))
                n = min(left, shard.n - first)
                spans = shard.spans(first, n).tolist()
                out += [shard.ids(a, b).tolist() for a, b in zip(spans, spans[1:], strict=False)]
                left, first = left - n, 0
            number += 1
        return out
