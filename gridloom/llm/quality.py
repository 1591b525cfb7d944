"""Quality classification without labels.

Heuristic labellers vote on every document or abstain. Expectation-maximisation over
the counts of vote patterns estimates how often each is right; the posteriors of a
bounded sample train a linear scorer on hashed features, which rates all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, id_key
from .linear import logistic, ngram_counts, scaled, sigmoid
from .minhash import SLICE, word_hashes

BITS, SIZES = 11, (2, 3, 4)
#: Shares of a text that stand behind the n-grams: repeated neighbours, repeated words, and what is left of each.
EXTRA = 4
WIDTH = (len(SIZES) << BITS) + EXTRA
GOOD, BAD, ABSTAIN = "1", "0", "-"

# Bytes by class: letters by case, digits, blanks; other characters stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if chr(b).islower()] + list(range(128, 256))] = ord("a")
_CLASS[[b for b in range(128) if chr(b).isupper()]] = ord("A")
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = ord("0")
_CLASS[[9, 10, 11, 12, 13]] = ord(" ")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in b"#$%&*+<=>@\\^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[b for b in b".,;:"]] = True


@dataclass
class Shape:
    """What the labellers look at."""

    bytes: int  # that are not blank
    words: int
    upper: float  # of letters
    symbols: float  # of bytes
    runs: float  # places with the same mark twice in a row, a word
    neighbours: float  # words equal to the one before
    variety: float  # distinct words by the root of the words
    short: float  # words of at most three bytes, of those with letters
    bare: float  # words without letters and digits
    stops: float  # words by stops and commas
    length: float  # mean bytes of a word


def shape(raw: bytes) -> tuple[Shape, np.ndarray, np.ndarray]:
    """The shape of a text, its words' hashes and its bytes by class."""
    b = np.frombuffer(raw, np.uint8)
    c = _CLASS[b]
    full = c != 32
    edge = np.flatnonzero(np.diff(np.r_[False, full, False]))
    lengths = edge[1::2] - edge[::2]
    words = word_hashes(raw)
    n, chars = max(1, len(words)), max(1, int(full.sum()))
    upper, lower = int((c == ord("A")).sum()), int((c == ord("a")).sum())
    plain = np.r_[0, np.cumsum((c == ord("a")) | (c == ord("A")))]
    spelt = plain[edge[1::2]] > plain[edge[::2]]
    counted = np.r_[0, np.cumsum(c == ord("0"))]
    bare = ~spelt & (counted[edge[1::2]] == counted[edge[::2]])
    marks = full & (c != ord("a")) & (c != ord("A")) & (c != ord("0"))
    twice = int((marks[1:] & (c[1:] == c[:-1])).sum())
    return (
        Shape(
            chars,
            len(words),
            upper / max(1, upper + lower),
            float(_SYMBOL[b].sum()) / chars,
            twice / n,
            float((words[1:] == words[:-1]).sum()) / n,
            len(np.unique(words)) / n**0.5,
            float((lengths[spelt] <= 3).sum()) / max(1, int(spelt.sum())),
            float(bare.sum()) / n,
            float(_STOP[b].sum()) / n,
            float(lengths.mean()) if len(lengths) else 0.0,
        ),
        words,
        c,
    )


def between(value: float, good: float, bad: float) -> str:
    """Good on one side, bad on the other, and no vote between."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


#: Each sees the shape of a text with words and votes.
LABELLERS: dict[str, Callable[[Shape], str]] = {
    "symbols": lambda s: between(s.symbols, 0.02, 0.06),
    "upper": lambda s: between(s.upper, 0.15, 0.4),
    "runs": lambda s: between(s.runs, 0.02, 0.15),
    "neighbours": lambda s: between(s.neighbours, 0.04, 0.15),
    "variety": lambda s: ABSTAIN if s.words < 30 else between(s.variety, 6.0, 4.0),
    "short": lambda s: ABSTAIN if s.words < 20 else between(s.short, 0.15, 0.04),
    "bare": lambda s: between(s.bare, 0.02, 0.1),
    "stops": lambda s: ABSTAIN if s.words < 20 else GOOD if 0.02 <= s.stops <= 0.5 else ABSTAIN,
    "length": lambda s: GOOD if 2.5 <= s.length <= 9 else BAD if not 1.5 <= s.length <= 14 else ABSTAIN,
}


def votes(s: Shape) -> str:
    return "".join(f(s) for f in LABELLERS.values())


def features(s: Shape, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    n = max(1, len(words))
    grams = scaled(ngram_counts(classes, SIZES, BITS))
    again = 1 - len(np.unique(words)) / min(n, 30 * n**0.5)
    extra = [s.neighbours**0.5, (1 - s.neighbours) ** 0.5, max(0.0, again), 1.0]
    return np.r_[grams, np.array(extra, np.float32)].astype(np.float32)


def estimate(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], list[dict[str, float]]]:
    """(posterior of each pattern being good, accuracies of the labellers) by expectation-maximisation.

    A labeller is right with a probability for good and one for bad documents, whatever the
    others say. It starts from the votes against, as a labeller sees one kind of fault each.
    """
    patterns = list(counts)
    if not patterns:
        return {}, []
    weight = np.array([counts[p] for p in patterns], float)
    vote = np.array([[{GOOD: 1, BAD: 0, ABSTAIN: -1}[v] for v in p] for p in patterns])
    good, bad = vote == 1, vote == 0
    belief = sigmoid(1.5 - 3.0 * bad.sum(axis=1) + 0.25 * good.sum(axis=1))
    for _ in range(rounds):
        w1, w0 = weight * belief, weight * (1 - belief)
        # One vote of each kind is added, so that no labeller is ever beyond doubt.
        p1 = (w1 @ good + 1) / (w1 @ (good | bad) + 2)
        p0 = (w0 @ bad + 1) / (w0 @ (good | bad) + 2)
        prior = (w1.sum() + 1) / (weight.sum() + 2)
        odds = np.log(prior / (1 - prior)) + good @ np.log(p1 / (1 - p0)) + bad @ np.log((1 - p1) / p0)
        new = sigmoid(odds)
        if np.abs(new - belief).max() < 1e-9:
            break
        belief = new
    said = [{"name": name, "good": float(a), "bad": float(b)} for name, a, b in zip(LABELLERS, p1, p0, strict=False)]
    return dict(zip(patterns, belief.tolist(), strict=True)), said


@dataclass
class Model:
    weights: np.ndarray
    accuracies: list[dict[str, float]]
    posterior: dict[str, float]

    def score(self, texts: list[str | None]) -> list[float]:
        """From 0 to 1; a text without words has 0."""
        shapes = [shape((t or "").encode()) for t in texts]
        x = np.stack([features(*s) for s in shapes]) if shapes else np.zeros((0, WIDTH), np.float32)
        return [float(v) if s[0].words else 0.0 for v, s in zip(sigmoid(x @ self.weights), shapes, strict=True)]


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 6000, seed: int = 5) -> Model:
    """Count vote patterns over all documents, estimate the labellers, and fit the scorer.

    The scorer sees at most about ``sample`` documents, chosen by a seeded hash; their
    features come to the driver. There are at most 3**9 patterns. Null texts and texts
    without words are left out; repeated rows count each; an empty table gives a model that
    scores everything at 0.5. Other columns are not read.
    """
    few_rows(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                for t in b.column(0).slice(i, SLICE).to_pylist():
                    s = shape(t.encode())[0]
                    if s.words:
                        seen[votes(s)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    total = rows.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r["pattern"]: r["n"] for r in total.collect()}
    posterior, said = estimate(counts)
    if not counts:
        return Model(np.zeros(WIDTH, np.float32), said, posterior)
    share = min(1.0, sample / sum(counts.values()))
    place = F.xxhash64(F.lit(seed), id_key(F.col("id")), "text") / F.lit(2.0**64) + 0.5

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shape(t.encode()) for t in b.column(0).to_pylist()]
            own = [s for s in own if s[0].words]
            x = [features(*s) for s in own]
            at = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays([pa.array([votes(s[0]) for s in own], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([v[i] for v, i in zip(x, at, strict=True)], pa.list_(pa.float32()))], names=["pattern", "at", "x"])

    got = rows.where(place < share).select("text").mapInArrow(chosen, "pattern string, at array<int>, x array<float>").toPandas()
    x = np.zeros((len(got), WIDTH), np.float32)
    for row, at, v in zip(x, got["at"], got["x"], strict=True):
        row[at] = v
    y = got["pattern"].map(posterior).to_numpy(float)
    # Documents of which the votes leave doubt count for less.
    weight = 0.1 + 1.8 * np.abs(y - 0.5)
    return Model(logistic(x, y, weight), said, posterior) if len(got) else Model(np.zeros(WIDTH, np.float32), said, posterior)


def rate(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input with ``score`` and ``kept`` (score at least ``least``); input columns with these names are replaced.

    A null text or one without words has score 0 and is rejected. Repeated rows are rated
    one by one, alike. Texts of any length are rated as a whole. An empty table stays empty.
    """
    few_rows(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out: list[float] = []
        for i in range(0, len(texts), SLICE):
            out += model.score(texts.slice(i, SLICE).to_pylist())
        return pa.array(out, pa.float64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "kept")]
    out = docs.select(*kept, score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("kept", F.col("score") >= F.lit(float(least)))
