"""Near-duplicate groups by circulant MinHash, banding and exact confirmation.

One permutation scatters the shingles of a document on a ring of 2^32 places; a second
one, shifted by k places, gives coordinate k of the signature as the least value. So two
permutations make all coordinates.

Documents with equal sets are one class from the start. In every band's bucket all classes
are held against one leader, the class that shares most bands, by signature and then on
whole sets; this joins a group of near copies in linear work. Only what is still apart
after that is compared further, in pairs of blocks of bounded bytes in which the largest
joined part of a group never meets itself. All steps give a spanning forest of the links
they find, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_rows, staged
from .components import components, extended

U = np.uint64
COORDS = 252
#: Standard deviations that a signature may fall short of the threshold before a pair is given up.
SLACK = 5
#: Bytes of a block of members; pairs of blocks are one task's group. A member counts for MEMBER bytes at least.
BLOCK_BYTES, MEMBER = 1 << 19, 1 << 11
#: Texts that are worked on together.
SLICE = 256
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U(1), np.full(m - 1, U(_P))])
                self.down = np.cumprod(np.r_[U(1), np.full(m - 1, U(pow(_P, -1, 2**64)))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of other bytes than blanks."""
    b = np.frombuffer(raw, np.uint8)
    word = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    sums = np.r_[U(0), np.cumsum((b.astype(np.uint64) + U(1)) * up[:-1])]
    return mixed64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles, A-Z in lower case; of all its words, if they are fewer."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, U(k))
    for j in range(k):
        h = mixed64(h * U(0xA24BAED4963EE407) + words[j : len(words) - k + 1 + j])
    return np.unique(h)


_SHIFTS = np.arange(COORDS, dtype=np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    ring = (mixed64(hashes ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(np.uint32)  # the first permutation
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(ring), 512):
        x = ring[None, i : i + 512] - _SHIFTS  # the ring is turned by one place for each coordinate
        x ^= x >> np.uint32(16)  # the second permutation
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_rows(threshold: float) -> int:
    """The most rows a band may have if a pair at the threshold is to be missed less than once in 100,000."""
    fits = [r for r in (12, 9, 7, 6, 4, 3, 2, 1) if (1 - threshold**r) ** (COORDS // r) < 1e-5]
    return fits[0]


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(bands), dtype=np.uint64) + U(1)
    for j in range(rows):
        h = mixed64(h * U(0xA24BAED4963EE407) + bands[:, j])
    return h.view(np.int64)


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _sketches(k: int, bands_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text hash, text): size, digest, bands and signature of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, digests, bands, sigs = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = shingles(text, k)
                    sig = signature(own) if len(own) else None
                    n.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    bands.append(bands_of(own, sig) if len(own) else None)
                    sigs.append(sig.astype(np.uint8).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sig"],
                )

    return run


def _parted(members: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Members (``key``, node, weight) of the keys that hold several labels, dealt to pairs of blocks ``i`` <= ``j``.

    The label with the most weight in a key is its main part. Blocks of the rest meet all
    blocks; blocks of the main part meet blocks of the rest alone.
    """
    own = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = own.groupBy(key, "label").agg(F.sum("weight").alias("w"))
    mixed = by_label.groupBy(key).agg(F.count("*").alias("parts"), F.sum("w").alias("all"), F.max(F.struct("w", "label")).alias("main")).where("parts > 1")
    blocks = lambda w: F.ceil(w / F.lit(BLOCK_BYTES)).cast("int")
    mixed = staged(mixed.select(key, F.col("main.label").alias("main"), blocks(F.col("all") - F.col("main.w")).alias("rest_blocks"), blocks(F.col("main.w")).alias("main_blocks")), "mixed")
    is_main = F.col("label") == F.col("main")
    place = F.xxhash64(F.lit(3), "node")
    at = F.when(is_main, F.col("rest_blocks") + F.pmod(place, F.col("main_blocks"))).otherwise(F.pmod(place, F.col("rest_blocks"))).cast("int")
    last = F.col("rest_blocks") - 1 + F.when(is_main, 0).otherwise(F.col("main_blocks"))
    rows = own.join(mixed, key).withColumn("own", at).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(key, "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _sides(group: pa.Table) -> tuple[list[int], list[int]]:
    """The places of a group's two blocks; the second is empty if a block meets itself."""
    own, i, j = (group.column(c).to_numpy() for c in ("own", "i", "j"))
    return np.flatnonzero(own == i).tolist(), np.flatnonzero((own == j) & (i != j)).tolist()


def _forest(group: pa.Table, matches: Callable[[int, np.ndarray], np.ndarray]) -> pa.Table:
    """Links between the labels of a group: ``matches(x, ys)`` says which of the rows ``ys`` row x links with."""
    nodes, trees, out = group.column("node").to_pylist(), Forest(group.column("label").to_pylist()), []
    left, right = _sides(group)
    for turn, x in enumerate(left):
        ys = np.array([y for y in (right or left[turn + 1 :]) if trees.root(x) != trees.root(y)], np.int64)
        if len(ys):
            out += [(nodes[x], nodes[y]) for y in ys[matches(x, ys)].tolist() if trees.join(x, y)]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _similar(least: int) -> Callable[[pa.Table], pa.Table]:
    """From a bucket: links between its labels, by signatures that agree in ``least`` places."""

    def run(group: pa.Table) -> pa.Table:
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)
        return _forest(group, lambda x, ys: (sigs[ys] == sigs[x]).sum(axis=1) >= least)

    return run


class Overlaps:
    """Sizes of intersections of a few sets, by a bit for each element that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        held = count[at] > 1
        owner, at = owner[held], place[at[held]]
        width = max(1, -(-int((count > 1).sum()) // 64))
        self.words = np.zeros((len(sets), width), np.uint64)
        np.bitwise_or.at(self.words, (owner, at >> 6), U(1) << (at & 63).astype(np.uint64))

    def sizes(self, x: int, ys: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bitwise_count(self.words[ys[i : i + 64]] & self.words[x]).sum(axis=1, dtype=np.int64) for i in range(0, len(ys), 64)])


def _confirmed(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """From a cluster: links between its labels with den * intersection >= num * union, on whole sets."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        sizes, common = np.array([len(s) for s in sets]), Overlaps(sets)

        def linked(x: int, ys: np.ndarray) -> np.ndarray:
            both = common.sizes(x, ys)
            return den * both >= num * (sizes[x] + sizes[ys] - both)

        return _forest(group, linked)

    return run


def _groups(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, exact: bool) -> DataFrame:
    """For each row its id, its text's hash, the size of its set and ``head``, the least (id, text hash) that links lead to."""
    rows, t = band_rows(num / den), num / den
    least = 0 if exact else math.ceil((t - SLACK * math.sqrt(t * (1 - t) / COORDS)) * COORDS)
    few_rows(docs.sparkSession)

    def bands_of(own: np.ndarray, sig: np.ndarray) -> np.ndarray:
        if exact:  # linked sets share one of so many least elements
            return own[: len(own) + (-num * len(own) // den) + 1].view(np.int64)
        return band_hashes(sig, rows)

    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketches = staged(read.mapInArrow(_sketches(k, bands_of), "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sig binary"), "sketches")
    full = sketches.where("digest is not null and doc_id is not null")
    head = F.min(F.struct("doc_id", "text_hash")).alias("head")
    classes = full.groupBy("digest").agg(head, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # A class's number is fixed as soon as it is written.
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # Buckets that hold more than one class, and the leader of each: the class that meets the most others.
    spots = classes.select("node", F.explode("bands").alias("band"))
    members = staged(spots.join(spots.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"), "members")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = members.join(meets, "node").groupBy("band").agg(F.max(F.struct("meets", "node"))["node"].alias("leader"))
    stars = members.join(leaders, "band").where("node <> leader").select("node", "leader").distinct()
    sigs = classes.select("node", "sig")
    pairs = stars.join(sigs, "node").join(sigs.select(F.col("node").alias("leader"), F.col("sig").alias("sig_b")), "leader")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, COORDS) for c in ("sig", "sig_b"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("leader").filter(keep), b.column("node").filter(keep)], names=["a", "b"])

    near = staged(pairs.select("leader", "node", "sig", "sig_b").mapInArrow(close, "a long, b long"), "stars")
    joined = components(near)
    label = lambda found: found.withColumnRenamed("component", "label")
    # Members of a bucket that the stars left apart, among each other and against the joined part.
    open_ = _parted(members.where("n > 2").select("band", "node", F.lit(MEMBER).alias("weight")), label(joined), "band").join(sigs, "node")
    more = open_.groupBy("band", "i", "j").applyInArrow(_similar(least), "a long, b long")
    clusters = extended(joined, more).withColumnRenamed("component", "cluster")

    # Links within clusters, on whole sets.
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingles(x, k).tobytes() for x in part.column(2).to_pylist()], pa.binary())], names=["node", "cluster", "hashes"])

    wanted = clusters.join(classes.select("node", F.col("head.doc_id").alias("doc_id"), F.col("head.text_hash").alias("text_hash")), "node")
    texts = read.join(wanted, ["doc_id", "text_hash"]).select("node", "cluster", "text")
    # Rows that agree in id and text bring the same set.
    sets = staged(texts.mapInArrow(sets_of, "node long, cluster long, hashes binary").dropDuplicates(["node"]), "sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("hashes").alias(name))
    sure = staged(near.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long"), "sure")
    weight = F.greatest(F.octet_length("hashes"), F.lit(MEMBER)).cast("long").alias("weight")
    joined = components(sure)
    apart = _parted(sets.select("cluster", "node", weight), label(joined), "cluster").join(sets.select("node", "hashes"), "node")
    links = apart.groupBy("cluster", "i", "j").applyInArrow(_confirmed(num, den), "a long, b long")
    found = extended(joined, links)

    heads = found.join(classes.select("node", "head"), "node").groupBy("component").agg(F.min("head").alias("least"))
    by_class = classes.join(found, "node", "left").join(heads, "component", "left").select("digest", F.coalesce("least", "head").alias("head"))
    out = sketches.select("doc_id", "text_hash", "n_shingles", "digest").join(by_class, "digest", "left")
    none = F.struct("doc_id", "text_hash")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", none)).otherwise(none).alias("head"))


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: bool = False,
) -> DataFrame:
    """Groups of documents whose k-word shingle sets have den * intersection >= num * union.

    Returns for each row ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that
    links lead to) and ``kept`` (whether that is the row's own id). Other columns are left
    out, so their names cannot clash. An empty table gives no rows.

    * Words are runs of other characters than [space, 9-13], A-Z in lower case. A text of
      fewer than k words is one shingle; one without words (or null) has none and no links.
    * Texts of any length count as a whole; a task holds two blocks of sets of bounded
      bytes, or two longer sets.
    * Rows that share an id are each grouped by their own text; repeated rows are one class.
    * A row with a null id links with nothing; its component is null and it is kept.
    * A pair of signatures is given up only where it falls short by 5 standard deviations;
      a pair at the threshold shares no band less than once in 100,000. With ``exact``
      buckets are the least elements of each set, of which linked sets always share one, and
      no pair is given up by signature: no link is lost, for more comparisons.
    """
    out = _groups(docs, k, num, den, id_col, text_col, exact).select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """The input's rows without near duplicates: of each group the row with the smallest id, once.

    Where rows of one id differ in text, each text is decided by its own group; of a group
    whose smallest id has several texts in it, the one with the least hash stays. Of rows
    with equal id and text one stays, the least by a hash of all columns. Rows without words
    and rows with a null id all stay. An empty table stays empty. Names that begin with
    ``__near_`` are reserved.
    """
    groups = _groups(docs, k, num, den, id_col, text_col, exact).where("doc_id is not null")
    own_head = (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.text_hash") == F.col("text_hash"))
    kept = groups.where(own_head | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"), (F.col("n_shingles") == 0).alias("__near_empty")).distinct()
    marked = docs.withColumns({"__near_id": F.col(id_col).cast("long"), "__near_hash": F.xxhash64(F.col(text_col).cast("string"))})
    every = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    turn = F.row_number().over(W.partitionBy("__near_id", "__near_hash").orderBy("__near_order"))
    out = marked.join(kept, ["__near_id", "__near_hash"]).withColumn("__near_order", every).withColumn("__near_turn", turn).where("__near_turn = 1 or __near_empty")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns).unionByName(marked.where("__near_id is null").select(*columns))
