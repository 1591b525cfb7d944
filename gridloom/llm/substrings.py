"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A passage counts if at least ``width`` words are equal. Each window of that many words has an
anchor, the run of a few words in it with the least hash, and equal windows have equal
anchors at equal places. So suffixes are needed at anchors alone, about every ninth word.
Suffixes are grouped by prefix: the words of the anchor, and where a group is larger than a
task should hold, longer ones, over the words that all windows of half the offsets share. In
each group a suffix tree of what follows the anchors and one of what precedes them, read
backwards, stand as sorted suffixes with their common lengths; two windows are equal where
they hang below one deep node of either tree. The earliest window of each such pair of nodes
stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, removed, settled

U = np.uint64
#: Bytes of text that are worked on together, and rows of a batch.
SLICE, ROWS = 1 << 21, 512


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def codes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, never 0, which stands for no word."""
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), U(1))


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k codes."""
    h = np.full(max(0, len(codes) - k + 1), U(k))
    for j in range(k):
        h = _mixed(h * U(0xA24BAED4963EE407) + codes[j : len(codes) - k + 1 + j])
    return h


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the place of the least one, the first of equals."""
    low, at, wide = values, np.arange(len(values)), 1

    def pair(gap: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[gap:] < low[:-gap]
        return np.where(right, low[gap:], low[:-gap]), np.where(right, at[gap:], at[:-gap])

    while 2 * wide <= span:
        low, at = pair(wide)
        wide *= 2
    if wide < span:
        low, at = pair(span - wide)
    return at


class Anchored:
    """Texts as words with the anchors of their windows.

    ``anchor``, ``low`` and ``high``: the anchors' places and their first and last window, all as
    places among the words of all texts; ``doc`` is the number of the anchor's text.
    """

    def __init__(self, texts: list[bytes], width: int, k: int) -> None:
        self.words = [t.split() for t in texts]  # bytes are split at the white space of the contracts
        self.ends = np.cumsum([len(w) for w in self.words])
        self.begins = self.ends - np.array([len(w) for w in self.words], np.int64)
        self.codes = codes_of([w for own in self.words for w in own])
        self.grams = run_hashes(self.codes, k)
        empty = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.doc = empty
        if len(self.codes) < width:
            return
        place = least_places(_mixed(self.grams ^ U(0x5851F42D4C957F2D)), width - k + 1)
        start = np.arange(len(place))
        doc = np.searchsorted(self.ends, start, side="right")
        own = start + width <= self.ends[doc]
        start, doc, place = start[own], doc[own], place[own]
        if not len(start):
            return
        turn = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(doc) != 0)])
        self.anchor, self.doc, self.low = place[turn], doc[turn], start[turn]
        self.high = start[np.r_[turn[1:], len(start)] - 1]


def sliced(b: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of bounded rows and bytes of text (one text at least) and their texts; a null is empty."""
    for at in range(0, b.num_rows, ROWS):
        own = b.slice(at, ROWS)
        raw = [(t or "").encode() for t in own.column(text).to_pylist()]
        part = np.cumsum([len(r) for r in raw]) // SLICE
        edge = np.flatnonzero(np.r_[True, np.diff(part) > 0]).tolist()
        for i, j in zip(edge, [*edge[1:], len(raw)], strict=True):
            yield own.slice(i, j - i), raw[i:j]


def equal_windows(key: np.ndarray, off: np.ndarray, n: np.ndarray, codes: list[bytes], order: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that come first among their equals: (row, words from the window's start to its anchor).

    A row is a run of words with n windows, the first ``off`` words in front of its anchor. Rows
    of one key share their anchors' words. ``order`` ranks rows by document and anchor place.
    """
    rows, spans = len(key), width - k + 1
    length = n + width - 1
    flat = np.frombuffer(b"".join(codes), np.uint64)
    at = np.cumsum(length) - length + off  # the anchors
    first, last = at - off, at - off + length

    def gathered(step: np.ndarray) -> np.ndarray:
        place = at[:, None] + step[None]
        good = (place >= first[:, None]) & (place < last[:, None])
        return np.where(good, flat[np.clip(place, 0, len(flat) - 1)], U(0))

    def tree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and how many words (0 for another key) each has in common with the one before."""
        by = np.lexsort((*words.T[::-1], key))
        same = np.logical_and.accumulate(words[by[1:]] == words[by[:-1]], axis=1).sum(axis=1)
        return by, np.where(key[by[1:]] == key[by[:-1]], same, -1)

    def nodes(sorted_: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        """For each row the number of the node of at least this depth above its suffix."""
        out = np.empty(rows, np.int64)
        out[sorted_] = np.r_[0, np.cumsum(common < depth)]
        return out

    after, before = tree(gathered(np.arange(width))), tree(gathered(-1 - np.arange(spans - 1)))
    found = []
    for o in range(spans):
        have = np.flatnonzero((off - n + 1 <= o) & (o <= off))
        if len(have):
            pair = nodes(*after, width - o)[have] * (rows + 1) + nodes(*before, o)[have]
            by = np.lexsort((order[have], pair))
            head = np.r_[True, np.diff(pair[by]) != 0]
            found.append((have[by[head]], np.full(int(head.sum()), o)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


ROW = "key long, off int, n int, codes binary, id long, t long, start int"


def _halves(low: int, high: int, width: int):  # noqa: ANN202
    """Rows of offsets low to high as rows of either half of the offsets, with the words that all windows of the half share in the key."""
    middle = (low + high) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("key", "off", "n", "codes", "id", "t", "start")}
            for r in b.to_pylist():
                for o1, o2 in ((low, middle), (middle + 1, high)):
                    a, z = max(o1, r["off"] - r["n"] + 1), min(o2, r["off"])
                    if a > z:
                        continue
                    skip, many = r["off"] - z, z - a + 1
                    own = r["codes"][8 * skip : 8 * (skip + many - 1 + width)]
                    shared = own[8 * (z - o1) : 8 * (z - o2 + width)]
                    key = xxhash.xxh3_64_intdigest(shared, seed=(r["key"] ^ o1) & (2**64 - 1)) - 2**63
                    for c, v in zip(out, (key, z, many, own, r["id"], r["t"], r["start"] + skip), strict=True):
                        out[c].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _distinct(rows: DataFrame) -> DataFrame:
    """Each run of words of a key once, at its earliest place."""
    first = F.min(F.struct("id", "t", (F.col("start") + F.col("off")).alias("anchor"), "n", "codes")).alias("m")
    own = rows.groupBy("key", "off", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(7), "codes").alias("h2")).agg(first)
    return own.select("key", "off", "m.n", "m.codes", "m.id", "m.t", (F.col("m.anchor") - F.col("off")).alias("start"))


def first_windows(rows: DataFrame, width: int, k: int, most: int, task_rows: int) -> DataFrame:
    """(``id``, ``t``, ``starts``) of the windows that come first among their equals, for rows of ``ROW``."""

    def grow(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("key", "off", "n", "id", "t", "start")}
        off, anchor = col["off"].astype(np.int64), col["start"].astype(np.int64) + col["off"]
        order = np.empty(len(group), np.int64)
        order[np.lexsort((anchor, col["t"], col["id"]))] = np.arange(len(group))
        row, o = equal_windows(col["key"], off, col["n"].astype(np.int64), group.column("codes").to_pylist(), order, width, k)
        by = np.argsort(row, kind="stable")
        row, starts = row[by], (anchor[row] - o)[by]
        head = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        offsets = pa.array(np.r_[head, len(row)].astype(np.int32))
        return pa.table({"id": col["id"][row[head]], "t": col["t"][row[head]], "starts": pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32)))})

    found, ranges = [], [(0, width - k)]
    while True:
        rows = settled(_distinct(rows), "runs")
        sizes = settled(rows.groupBy("key").agg(F.count("*").alias("m")), "sizes")
        single, some, many = sizes.agg(F.count(F.when(F.col("m") == 1, 1)), F.sum(F.when((F.col("m") > 1) & (F.col("m") <= most), F.col("m"))), F.count(F.when(F.col("m") > most, 1))).head()
        last = all(a == b for a, b in ranges)
        sized = rows.join(sizes, "key")
        if single or last:
            # Alone with its key, or, where the key holds the whole window, equal to all rows of the key.
            found.append(sized.where("m = 1").select("id", "t", F.sequence("start", F.col("start") + F.col("n") - 1).alias("starts")))
        if some:
            tasks = -(-some // task_rows)
            dealt = sized.where((F.col("m") > 1) & (F.col("m") <= most)).withColumn("task", F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(tasks)))
            found.append(settled(dealt.select("task", "key", "off", "n", "codes", "id", "t", "start").groupBy("task").applyInArrow(grow, "id long, t long, starts array<int>"), "firsts"))
        if not many:
            break
        large = settled(sized.where(F.col("m") > most).select(rows.columns), "large")
        halves = None
        for low, high in ranges:
            within = large.where((F.col("off") <= high) & (F.col("off") >= low)) if len(ranges) > 1 else large
            part = within.mapInArrow(_halves(low, high, width), ROW)
            halves = part if halves is None else halves.union(part)
        rows, ranges = halves, [x for low, high in ranges for x in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)) if x[0] <= x[1]]
    out = rows.sparkSession.createDataFrame([], "id long, t long, starts array<int>")
    for f in found:
        out = out.unionByName(f)
    return out


def remove_repeats(
    docs: DataFrame,
    width: int = 20,
    k: int = 5,
    most: int = 1 << 15,
    task_rows: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents without the words that lie in a window of ``width`` words which also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; all windows are judged
    on the input. Returns ``doc_id``, ``n_words``, ``n_removed`` and ``text``, the kept words
    joined by single spaces. Words are runs of other characters than ``[\\x20\\x09-\\x0D]``.

    * A null or empty text has no words and comes back as an empty one. Texts of any length are
      read as a whole; a text of fewer than ``width`` words loses nothing.
    * A null id comes before all others and stays null. Of different texts that share an id,
      that with the smaller hash counts as earlier; equal rows are one document, and each
      row has its result.
    * An empty table gives no rows. Other columns are left out, so their names cannot clash.
    * ``k`` words make an anchor. A task holds about ``task_rows`` suffixes, and a prefix is
      made longer where more than ``most`` different suffixes share it. Both decide nothing
      about results. Words are compared by 64-bit hashes.
    """
    if not 1 <= k < width:
        raise ValueError("an anchor has at least one word and fewer than a window")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    own = own.withColumns({"id": id_key(F.col("doc_id")), "t": F.xxhash64(F.coalesce("text", F.lit("")))})

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in sliced(b, 2):
                x = Anchored(texts, width, k)
                head = part.select([0, 1]).take(pa.array(x.doc))  # without the text
                place = (x.anchor - x.begins[x.doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.grams[x.anchor].view(np.int64)), head.column(0), head.column(1), pa.array(place)], names=["key", "id", "t", "place"])

    at = settled(own.select("id", "t", "text").mapInArrow(anchors, "key long, id long, t long, place int"), "anchors")
    repeated = settled(at.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "repeated")
    # Both sides are written, so that Spark can split the join for an anchor that very many documents hold.
    places = settled(at.join(repeated, "key").groupBy("id", "t").agg(F.collect_list("place").alias("places")), "places")
    removed(at, repeated)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in sliced(b, 2):
                x = Anchored(texts, width, k)
                pick = np.flatnonzero(_held(x, part.column(3)))
                doc, low, n = x.doc[pick], x.low[pick], x.high[pick] - x.low[pick] + 1
                raw, ends = x.codes.tobytes(), low + n + width - 1
                codes = pa.array([raw[8 * i : 8 * j] for i, j in zip(low.tolist(), ends.tolist(), strict=True)], pa.binary())
                head = part.select([0, 1]).take(pa.array(doc))
                ints = [pa.array(v.astype(np.int32)) for v in (x.anchor[pick] - low, n, low - x.begins[doc])]
                yield pa.RecordBatch.from_arrays([pa.array(x.grams[x.anchor[pick]].view(np.int64)), ints[0], ints[1], codes, head.column(0), head.column(1), ints[2]], names=["key", "off", "n", "codes", "id", "t", "start"])

    held = own.select("id", "t", "text").join(places, ["id", "t"]).select("id", "t", "text", "places")
    firsts = first_windows(settled(held.mapInArrow(runs, ROW), "runs"), width, k, most, task_rows)
    firsts = firsts.groupBy("id", "t").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    marks = settled(places.join(firsts, ["id", "t"], "left"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in sliced(b, 1):
                x = Anchored(texts, width, k)
                again = np.zeros(len(x.codes) + 1, np.int64)
                windows = _held(x, part.column(2))
                np.add.at(again, x.low[windows], 1)
                np.add.at(again, x.high[windows] + 1, -1)
                again = np.cumsum(again) > 0
                again[_placed(x, part.column(3))] = False
                # A word is covered if one of the last ``width`` windows up to it is repeated.
                run = np.r_[0, np.cumsum(again[: len(x.codes)])]
                covered = run[1:] > run[np.maximum(np.arange(len(x.codes)) + 1 - width, 0)]
                texts_out, gone = [], []
                for words, i, j in zip(x.words, x.begins.tolist(), x.ends.tolist(), strict=True):
                    drop = covered[i:j]
                    gone.append(int(drop.sum()))
                    texts_out.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if gone[-1] else words).decode())
                counts = [pa.array(v, pa.int64()) for v in ((x.ends - x.begins).tolist(), gone)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(texts_out, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    joined = own.join(marks, ["id", "t"], "left").select("doc_id", "text", "places", "starts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


def _placed(x: Anchored, lists: pa.Array) -> np.ndarray:
    """Places in documents as places among all words; a null list has none."""
    doc = np.repeat(np.arange(len(lists)), [len(v) if v is not None else 0 for v in lists.to_pylist()])
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + x.begins[doc]


def _held(x: Anchored, lists: pa.Array) -> np.ndarray:
    """Which anchors stand at the places of the lists."""
    marked = np.zeros(len(x.codes) + 1, bool)
    marked[_placed(x, lists)] = True
    return marked[x.anchor]
