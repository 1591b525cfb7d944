"""Language identification by hierarchical discrimination.

A first set of linear machines tells language families apart; within a family, one
machine for each pair of languages votes. All read hashed byte n-grams of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, id_key
from .linear import machine, ngram_counts, scaled, sigmoid

# Families of languages by ISO 639-1 code; another language is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"],
    "turkic": ["az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu", "se"],
    "semitic": ["am", "ar", "he", "mt"],
}
UNKNOWN = "und"
BITS, SIZES = 12, (2, 3)
_LETTER = regex.compile(r"\p{L}")
# Bytes of ASCII that are no letters count as spaces.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(text: str) -> np.ndarray:
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    keep = np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]
    return scaled(ngram_counts(b[keep], SIZES, BITS))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    """Weights: a row for each family, and for each pair of languages of a family."""

    families: list[list[str]]
    family_weights: np.ndarray
    pairs: list[tuple[int, int, int]]  # family, and the two languages' places in it
    pair_weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and a score from 0 to 1; UNKNOWN and 0 for texts without letters."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if has_letter(t)] if self.families else []
        if not own:
            return names, scores
        x = np.stack([features(texts[i]) for i in own])
        by_family = sigmoid(4 * (x @ self.family_weights.T))
        by_pair = x @ self.pair_weights.T
        for i, f_scores, margins in zip(own, by_family, by_pair, strict=True):
            k = int(f_scores.argmax())
            wins, sure = np.zeros(len(self.families[k])), np.zeros(len(self.families[k]))
            for (fam, a, b), m in zip(self.pairs, margins, strict=True):
                if fam == k:
                    wins[a if m >= 0 else b] += 1
                    sure[a] += m
                    sure[b] -= m
            best = max(range(len(wins)), key=lambda j: (wins[j], sure[j]))
            within = sigmoid(4 * sure[best] / max(1, len(wins) - 1)) if len(wins) > 1 else 1.0
            names[i], scores[i] = self.families[k][best], float(min(1.0, max(0.0, f_scores[k] * within)))
        return names, scores


def family_groups(langs: list[str]) -> list[list[str]]:
    of = {x: f for f, xs in FAMILIES.items() for x in xs}
    groups: dict[str, list[str]] = {}
    for x in sorted(langs):
        groups.setdefault(of.get(x, x), []).append(x)
    return list(groups.values())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1000, most: int = 20_000, seed: int = 11) -> Model:
    """Fit a model on rows with a language and a letter: at most ``per_language`` of each language and ``most`` in all, chosen by a seeded hash of id and text.

    The rows of a language are counted over all rows; features of the chosen ones come to
    the driver, ``2 * 2**BITS`` numbers for each at most. Rows without language, text or
    letter are left out; repeated rows count each; an empty table gives a model of no language.
    """
    few_rows(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # A margin over the wanted share, and the exact number by order of the hash.
    per_language = max(1, min(per_language, most // max(1, len(counts))))
    share = {x: min(1.0, (per_language + 4 * per_language**0.5) / n) for x, n in counts.items()}
    if not share:
        return Model([], np.zeros((0, len(SIZES) << BITS)), [], np.zeros((0, len(SIZES) << BITS)))
    place = F.xxhash64(F.lit(seed), id_key(F.col("id")), "text") / F.lit(2.0**64) + 0.5
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    chosen = rows.withColumn("place", place).where(F.col("place") < wanted).select("lang", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([v[i] for v, i in zip(x, at, strict=True)], pa.list_(pa.float32()))], names=["lang", "place", "at", "x"])

    got = chosen.mapInArrow(run, "lang string, place double, at array<int>, x array<float>").toPandas().sort_values(["lang", "place"]).groupby("lang").head(per_language)
    x = np.zeros((len(got), len(SIZES) << BITS), np.float32)
    for row, at, v in zip(x, got["at"], got["x"], strict=True):
        row[at] = v
    lang = got["lang"].to_numpy()
    del got
    families = family_groups(sorted(set(lang)))
    if len(families) > 1:
        family = np.stack([machine(x, np.where(np.isin(lang, f), 1.0, -1.0)) for f in families])
    else:
        family = np.zeros((1, x.shape[1]), np.float32)
    pairs, weights = [], []
    for k, f in enumerate(families):
        for a in range(len(f)):
            for b in range(a + 1, len(f)):
                own = np.isin(lang, [f[a], f[b]])
                pairs.append((k, a, b))
                weights.append(machine(x[own], np.where(lang[own] == f[a], 1.0, -1.0)))
    return Model(families, family, pairs, np.stack(weights) if weights else np.zeros((0, x.shape[1]), np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score``; input columns with these names are replaced.

    A null text or one without letters, and every text if the model has no language, gets
    ``und`` and score 0. An empty table gives an empty table.
    """
    few_rows(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of families and pairs, not of rows

    @F.arrow_udf("lang string, score double")
    def tell(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for i in range(0, len(texts), 256):
            n, s = told.value.predict(texts.slice(i, 256).to_pylist())
            names += n
            scores += s
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*kept, tell(F.col(text_col).cast("string")).alias("__lang_told"))
    return out.select(*kept, F.col("__lang_told.lang").alias("lang_pred"), F.col("__lang_told.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
