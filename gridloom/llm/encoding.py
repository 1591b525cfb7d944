"""Token ids of whole texts by the tokenizers library.

Neither pre-tokenizer joins what a space or a line break divides, nor a letter and an
ASCII mark behind it. So texts are cut there, and the ids of a piece are remembered: the
library encodes each piece once in a while instead of each time. Cutting, looking up and
putting together work on whole batches. Texts with other white space, or with white space
in a row where that matters, go to the library as they are, and so do texts with the content
of an added token, which the library takes out before it cuts. Tests hold the result against
one call for the whole text.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

WORD = np.dtype("<u4")
U = np.uint64
#: Slots of the memory of pieces, and ids that it holds at most before it is emptied.
SLOTS, POOL = 1 << 20, 1 << 22
#: Bytes of text that are worked on together, besides one longer text.
BATCH = 1 << 19
_OPEN: dict[str, Encoder] = {}
_OTHER_BLANKS = re.compile("[\x85\xa0 ᠎ -     　]")
_ODD = re.compile("[0\x00-\x1f\x7f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_BASE = 0xD1342543DE82EF95

_TABLE = np.zeros(256, np.uint8)  # 1 letter, 2 mark, 3 space or line break, 4 other ASCII blank
_TABLE[[b for b in range(128) if chr(b).isalpha()]] = 1
_TABLE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_TABLE[[32, 10]] = 3
_TABLE[[9, 11, 12, 13]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Kinds of pieces: behind a space, behind a line break, and without white space in front.
SPACE, BREAK, BARE = 0, 1, 2


def vocabulary_size(path: str) -> int:
    return Encoder.of(path).size


class Encoder:
    """ids(texts) gives, for each text, its ids as little-endian unsigned 32-bit integers."""

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _OPEN:
            _OPEN[path] = cls(path, literal=False)
        return _OPEN[path]

    def __init__(self, path: str, literal: bool = True) -> None:
        """literal: whether added tokens in a text are text like any other; else, as is the library's default, each is one id."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        #: Whether white space is dropped and letters are lowered; else a space belongs to the word behind it.
        self.word_ends = bool(said["normalizer"])
        self.added = [] if literal else [t["content"] for t in said["added_tokens"]]
        # Where an added token is looked for in the normalised text, no text is cut.
        self.uncut = not literal and any(t["normalized"] for t in said["added_tokens"])
        # Stands between pieces that are encoded in one call, and always is one id of its own.
        self.bar = " 0 " if self.word_ends else "\n"
        self.bar_id = int(np.frombuffer(self._whole(self.bar), WORD)[0])
        self.lead = {SPACE: "" if self.word_ends else " ", BREAK: "", BARE: ""}
        self.up = self.down = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.tag, self.tag2 = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        self.at, self.n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=WORD).tobytes()

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            m = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[U(1), np.full(m - 1, U(_BASE))])
            self.down = np.cumprod(np.r_[U(1), np.full(m - 1, U(pow(_BASE, -1, 2**64)))])

    def _fresh(self, pieces: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each piece has)."""
        plain, odd = [], {}
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            text = p.decode()
            if not text or (self.word_ends and _ODD.search(text)):
                odd[i] = np.frombuffer(self._whole(self.lead[kind] + text), WORD)
            else:
                plain.append(self.lead[kind] + text)
        ids, sizes = np.zeros(0, WORD), np.zeros(0, np.int64)
        if plain:
            (got,) = self.tokenizer.encode_batch_fast([self.bar.join(plain) + self.bar], add_special_tokens=False)
            ids = np.array(got.ids, WORD)
            ends = np.flatnonzero(ids == self.bar_id)
            if len(ends) == len(plain):
                sizes = np.diff(np.r_[-1, ends]) - 1
                ids = np.delete(ids, ends)
            else:
                each = [np.frombuffer(self._whole(p), WORD) for p in plain]
                ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
        if self.word_ends is False:
            # A line break is the id before its piece.
            kind = np.array([k for i, k in enumerate(kinds) if i not in odd], np.int64)
            starts = np.cumsum(sizes) - sizes
            ids, sizes = np.insert(ids, starts[kind == BREAK], self.bar_id), sizes + (kind == BREAK)
            odd = {i: np.r_[WORD.type(self.bar_id), x] if kinds[i] == BREAK else x for i, x in odd.items()}
        if odd:
            parts, cut = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [], iter(())
            cut = iter(parts)
            each = [odd[i] if i in odd else next(cut) for i in range(len(pieces))]
            ids, sizes = np.concatenate(each).astype(WORD), np.array([len(x) for x in each])
        return ids, sizes

    def _regular(self, text: str) -> bool:
        """Whether the cuts are right whatever stands around them."""
        if not text.isascii() and not self.word_ends and _OTHER_BLANKS.search(text):
            return False
        if self.uncut or any(t in text for t in self.added):
            return False
        return "\u0130" not in text  # it is lowered to a letter and a mark, which would join the marks behind it

    def _batch(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)  # each text ends with a line break that is not its own
        if self.word_ends:
            buf = _LOWER[buf]
        kind = _TABLE[buf]
        ends = np.cumsum([len(r) + 1 for r in raws]) - 1
        begins = np.r_[0, ends[:-1] + 1]
        blank = kind >= 3
        letter = kind == 1
        # Letters of two bytes in Latin-1, but for the signs of multiplication and division.
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        starts = blank.copy()  # of pieces: white space itself, whose piece follows it
        starts[1:] |= letter[:-1] & (kind[1:] == 2)
        starts[begins] = True
        first = np.zeros(len(buf), bool)
        first[begins] = True
        at = np.flatnonzero(starts)
        behind = np.r_[at[1:], len(buf)]
        own = at + (blank[at] & ~first[at])  # a text's first byte is never skipped, even if it is white space
        form = np.where(first[at] | ~blank[at], BARE, np.where(buf[at] == 32, SPACE, BREAK))
        last = np.zeros(len(buf), bool)
        last[ends] = True
        keep = ~last[at]
        at, own, behind, form = at[keep], own[keep], behind[keep], form[keep]
        # The text's own end cuts its last piece.
        doc = np.searchsorted(begins, at, "right") - 1
        behind = np.minimum(behind, ends[doc])
        n = np.maximum(behind - own, 0)
        bad = np.zeros(len(raws), bool)
        if not self.word_ends:
            other = np.flatnonzero(kind == 4)
            bad[np.searchsorted(begins, other, "right") - 1] = True
            row = np.flatnonzero(blank[1:] & blank[:-1])
            row_doc = np.searchsorted(begins, row, "right") - 1
            bad[row_doc[row + 1 < ends[row_doc]]] = True
            bad[[i for i, r in enumerate(raws) if r[:1] in (b" ", b"\n")]] = True
        self._powers(len(buf) + 1)
        sums = np.r_[U(0), np.cumsum((buf.astype(np.uint64) + U(1)) * self.up[: len(buf)])]
        h = (sums[own + n] - sums[own]) * self.down[own] + n.astype(np.uint64) * U(0x9FB21C651E98DF25) + form.astype(np.uint64) * U(0xA24BAED4963EE407)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        check = (n.astype(np.uint32) << np.uint32(2) | form.astype(np.uint32)) + (buf[np.minimum(own, len(buf) - 1)].astype(np.uint32) << np.uint32(24)) + np.uint32(1)
        slot = (h & U(SLOTS - 1)).astype(np.int64)
        hit = (self.tag[slot] == h) & (self.tag2[slot] == check)
        start, size = self.at[slot], self.n[slot].astype(np.int64)
        miss = np.flatnonzero(~hit & ~bad[doc])
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            raw = buf.tobytes()
            ids, sizes = self._fresh([raw[a : a + k] for a, k in zip(own[one].tolist(), n[one].tolist(), strict=True)], form[one].tolist())
            if self.used + len(ids) > len(self.pool):
                # The pieces that were found stay for this batch; all else is learnt anew.
                before = self.pool
                self._forget()
                if len(ids) > len(self.pool) // 2:
                    self.pool = np.zeros(2 * len(ids), np.uint32)
                offset = self.used
                pool = np.concatenate([before, ids])
                start[miss], size[miss] = (len(before) + np.cumsum(sizes) - sizes)[back], sizes[back]
            else:
                offset, pool = self.used, self.pool
                start[miss], size[miss] = (offset + np.cumsum(sizes) - sizes)[back], sizes[back]
            self.pool[offset : offset + len(ids)] = ids
            self.used = offset + len(ids)
            self.tag[slot[one]], self.tag2[slot[one]] = h[one], check[one]
            self.at[slot[one]], self.n[slot[one]] = offset + np.cumsum(sizes) - sizes, sizes
        else:
            pool = self.pool
        size[bad[doc]] = 0
        total = np.cumsum(size)
        flat = pool[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)].astype(WORD)
        bounds = np.r_[0, total][np.searchsorted(doc, np.arange(len(raws) + 1))]
        out = []
        for i, text in enumerate(texts):
            out.append(self._whole(text) if bad[i] else flat[bounds[i] : bounds[i + 1]].tobytes())
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self._regular(t):
                out[i] = self._whole(t)
                continue
            group.append(i)
            size += len(t)
            if size >= BATCH:
                for j, x in zip(group, self._batch([texts[j] for j in group]), strict=True):
                    out[j] = x
                group, size = [], 0
        if group:
            for j, x in zip(group, self._batch([texts[j] for j in group]), strict=True):
                out[j] = x
        return out
