"""Hierarchical multi-length packing.

Each task encodes the documents of its own input split and packs them while they
stream by, so no text is shuffled. Documents are routed to tiers of context sizes, each
tier is packed, the gaps of long windows are filled from shorter tiers, and the finished
windows are dealt to step groups of equal size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows
from .encoding import WORD, Encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Bits for the counters of one task, below the task's number.
TASK_BITS = 36


class Pool:
    """Pieces (length, document, start) of one tier, in order of length."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int]] = []

    def add(self, piece: tuple[int, int, int]) -> None:
        insort(self.pieces, piece)

    def longest(self, most: int | None = None) -> tuple[int, int, int] | None:
        at = len(self.pieces) if most is None else bisect_right(self.pieces, (most, float("inf"), 0))
        return self.pieces.pop(at - 1) if at else None


class Packer:
    """Packs pieces into windows; ``full`` holds finished windows as (tier, pieces)."""

    def __init__(self, tiers: list[int]) -> None:
        self.tiers = tiers
        self.pools = [Pool() for _ in tiers]
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.waiting = 0

    def add(self, doc: int, tokens: int) -> None:
        """Cut a document's full windows of the largest tier off and route the rest by its length."""
        top, start = self.tiers[-1], 0
        while tokens - start >= top:
            self.full.append((top, [(top, doc, start)]))
            start += top
        self.route((tokens - start, doc, start))

    def route(self, piece: tuple[int, int, int]) -> None:
        if piece[0]:
            self.pools[bisect_left(self.tiers, piece[0])].add(piece)
            self.waiting += piece[0]

    def take(self, k: int, most: int) -> tuple[int, int, int] | None:
        """From tier k or a shorter one: the longest piece that fits, else one cut to fit."""
        for pool in reversed(self.pools[: k + 1]):
            if piece := pool.longest(most):
                self.waiting -= piece[0]
                return piece
        for pool in reversed(self.pools[: k + 1]):
            if piece := pool.longest():
                length, doc, start = piece
                self.waiting -= length
                self.route((length - most, doc, start + most))
                return (most, doc, start)
        return None

    def pack(self) -> None:
        """Fill windows of every tier while shorter pieces last; what can fill no window waits."""
        for k in reversed(range(len(self.tiers))):
            short: list[tuple[int, int, int]] = []
            while first := self.pools[k].longest():
                self.waiting -= first[0]
                window, gap = [first], self.tiers[k] - first[0]
                # Pieces of the own tier are over half a window, but in the shortest tier they are of any length.
                while gap and (piece := self.take(k if k == 0 else k - 1, gap)):
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    short += window
                else:
                    self.full.append((self.tiers[k], window))
            for piece in short:
                self.route(piece)

    def flush(self) -> None:
        """Close what waits: windows of the largest tier, of which only the last has a gap."""
        self.pack()
        rest = [p for pool in self.pools for p in pool.pieces]
        top, window, room = self.tiers[-1], [], self.tiers[-1]
        for length, doc, start in sorted(rest, key=lambda p: p[1:]):
            while length:
                n = min(length, room)
                window.append((n, doc, start))
                length, start, room = length - n, start + n, room - n
                if not room:
                    self.full.append((top, window))
                    window, room = [], top
        if window:
            self.full.append((top, window))
        self.pools, self.waiting = [Pool() for _ in self.tiers], 0


def balanced(sizes: list[int], per_step: int) -> list[int]:
    """A step group for each window: largest first, each to the group with the fewest tokens."""
    groups = max(1, -(-sum(sizes) // per_step))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    step_tokens: int = 1 << 17,
    buffer_tokens: int = 1 << 19,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into windows; one row for each piece of a document.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers, ``start`` the
    ids of its document before it, ``doc_tokens`` the document's ids with ``end_id``.
    ``sequence_id`` is the window, ``offset`` the piece's place in it, ``tier`` the
    window's size, and ``step_group`` the training step that it is dealt to. A task holds
    ``buffer_tokens`` ids besides one document; windows are full but for the last one of
    a task, which is padded to the largest tier.

    * A null or empty text has its end id alone. A null id stays null.
    * Each row is a document of its own, also where rows or ids are repeated.
    * A text of any length is cut into windows of the largest tier and a rest; ties in length
      go by the document's place in its input split.
    * Other columns are left out, so their names cannot clash. An empty table gives no rows.
    """
    few_rows(docs.sparkSession)
    path, sizes = tokenizer, sorted(tiers)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << TASK_BITS
        encoder, packer = Encoder.of(path), Packer(sizes)
        held: dict[int, tuple[int | None, bytes]] = {}  # documents that have pieces in the packer
        number = sequence = step = tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step, held
            done, packer.full = packer.full, []
            groups = balanced([tier for tier, _ in done], step_tokens)
            rows: list[tuple] = []
            for (tier, window), group in zip(done, groups, strict=True):
                offset = 0
                for length, doc, start in window:
                    key, raw = held[doc]
                    rows.append((key, start, length, raw[4 * start : 4 * (start + length)], len(raw) // 4, task + sequence, offset, tier, task + step + group))
                    offset += length
                sequence += 1
            step += max(groups, default=-1) + 1
            left = {doc for pool in packer.pools for _, doc, _ in pool.pieces}
            held = {doc: held[doc] for doc in left}
            for i in range(0, len(rows), 1000):
                columns = zip(*rows[i : i + 1000], strict=True)
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(keys), 100):
                for key, raw in zip(keys[i : i + 100], encoder.ids(texts.slice(i, 100).to_pylist()), strict=True):
                    held[number] = (key, raw + end)
                    packer.add(number, len(raw) // 4 + 1)
                    tokens += len(raw) // 4 + 1
                    number += 1
                if tokens >= buffer_tokens:
                    packer.pack()
                    yield from out()
                    tokens = packer.waiting
        packer.flush()
        yield from out()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def words_of(raw: bytes) -> list[int]:
    """The ids of one ``ids`` value."""
    import numpy as np

    return np.frombuffer(raw, WORD).tolist()
