"""Line dedup, mixing, packing, token files and language identification against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import langid, line_dedup, mixing, packing, tokenbin
from gridloom.llm.encoding import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "this line is long enough to be a key of forty points"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


ROWS = [
    (None, None, None),
    (1, "", "a"),
    (2, LONG + "\nshort\n" + LONG, "a"),
    (3, " \t" + LONG.upper() + "\x0b\nother", "b"),
    (4, LONG, "b"),
    (5, LONG + "\n", "b"),
    (6, "x\n" + LONG, None),
    (6, "x\n" + LONG, None),
    (7, "ein Straße\r\n" + LONG, "c"),
    (8, " ".join(["long"] * 6000), "a"),
]


def dedup_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    have = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                have[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t, _ in rows:
        own, lines = -(2**63) if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if not (len(have.get(key(x), ())) >= min_docs and max(have[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    frame = docs(spark, ROWS).withColumn("n_lines", F.lit(-1)).withColumn("n_dropped", F.lit("x"))
    out = line_dedup.dedup_lines(frame)
    assert out.columns == frame.columns
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()], key=str)
    assert got == sorted(dedup_by_hand(ROWS), key=str)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    budget, caps, weights = 1665.0, {"a": 200.0, "b": 20.0, "c": 2000.0, None: 0.0}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, fixed = {}, set()
    while True:
        rest = budget - sum(caps[s] for s in fixed)
        total = sum(weights[s] for s in caps if s not in fixed)
        want = {s: caps[s] if s in fixed else rest * weights[s] / total for s in caps}
        above = {s for s in caps if s not in fixed and want[s] > caps[s]}
        if not above:
            break
        fixed |= above
    assert got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300))
def test_budget_is_fitted_as_well_as_possible(counts, budget):
    lengths, ns = list(counts), list(counts.values())
    taken = mixing.fit_budget(lengths, ns, budget)
    assert all(0 <= t <= n for t, n in zip(taken, ns, strict=True))
    reach = {0}
    for a, n in counts.items():
        reach = {s + k * a for s in reach for k in range(n + 1)}
    # The share of each length is fixed first, so the whole need not be the best sum, but it is within a length of it.
    total = sum(a * t for a, t in zip(lengths, taken, strict=True))
    best = max(s for s in reach if s <= budget)
    assert total <= budget or budget >= sum(a * n for a, n in counts.items())
    assert best - total <= max(lengths)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", None, "ü"])) for i in range(400)] + [(7, "same text", "a")] * 3 + [(None, None, None)]
    out = mixing.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(out["size"]) == sorted(size(t) for _, t, _ in rows)
    assert set(out["taken"] - out["copies"] * out["size"]) == {0} and out["copies"].between(0, 2).all()
    for _, g in out.groupby(out["source"].fillna("-")):
        assert g["source_size"].iloc[0] == g["size"].sum()
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    again = mixing.mix(docs(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "text_hash", "copies"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    rows_out = mixing.mixed(docs(spark, rows)).collect()
    assert sum(size(r.text) for r in rows_out) == out["taken"].sum() and len(rows_out) == out["copies"].sum()
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_mix_of_a_hot_length(spark):
    rows = [(i, "one two three", "hot") for i in range(3000)] + [(10_000, "a", "b")]
    out = mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("a")).collect()
    assert all(abs(r.t - r.a) <= 3 for r in out)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_equals_one_call(path):
    whole, rng = plain(path), random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "don't", "'s", "'", "é", "É", "ß", "Σ", "ς", "İ", "0", "12", "!", "!!", "_", "́", "\xa0", "\x1c", "²", "中", "가", "😀", "<|endoftext|>", ".", " ", "​", "|", "="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))) for _ in range(3000)] + [None, ""]
    got = Encoder(path).ids(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, ascii(t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_are_as_in_the_library(spark, path):
    """Against the library as it comes: an added token in a text is one id."""
    whole, rng = Tokenizer.from_file(path), random.Random(6)
    parts = [" ", "\n", "a", "The", "'s", "é", "0", "!", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "endoftext", "."]
    texts = ["end <|endoftext|> of", "a<|startoftext|>b", "<|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(1000)]
    got = Encoder.of(path).ids(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)
    rows = [(i, t, "a") for i, t in enumerate(texts[:20])]
    sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs(spark, rows), path).select("doc_id", "doc_tokens").collect()} == sizes
    store = tokenbin.TokenStore.write(docs(spark, rows), path)
    assert {r.doc_id: r.n_tokens for r in store.read(docs(spark, rows).select(F.col("doc_id").alias("key"))).collect()} == sizes


def test_packing(spark):
    rng, whole = random.Random(2), plain(BYTE)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "ß", "gamma\n"]) for _ in range(rng.choice([3, 40, 300, 1500, 5000]))), "a") for i in range(80)] + [(None, None, None), (5, "again", "b"), (5, "again", "b")]
    out = packing.pack(docs(spark, rows).withColumn("ids", F.lit("clash")), BYTE, buffer_tokens=20_000).toPandas()
    want = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows)
    out["doc_id"] = out["doc_id"].fillna(-1)
    pieces, got = defaultdict(list), []
    for r in out.itertuples():
        pieces[r.doc_id].append(r)
    for own in pieces.values():
        if own[0].doc_id != 5:
            ids = [x for r in sorted(own, key=lambda r: r.start) for x in packing.words_of(r.ids)]
            assert len(ids) == own[0].doc_tokens
            got.append(tuple(ids))
        else:
            assert sum(r.length for r in own) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows if i == 5)
    assert set(got) <= set(want)
    assert out["length"].sum() == sum(map(len, want))
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    padded = out.groupby("sequence_id").agg(n=("length", "sum"), tier=("tier", "first"))
    assert (padded["n"] == padded["tier"]).sum() >= len(padded) - 4  # one open window for each task
    assert packing.pack(docs(spark, []), BYTE).count() == 0


def test_token_files(spark):
    rng, whole = random.Random(3), plain(WORD)
    rows = [(i * 7 - 300, " ".join(rng.choice(["Alpha", "beta,", "ß", "d'or\n"]) for _ in range(rng.randrange(0, 60))), "a") for i in range(200)] + [(None, None, None), (None, "none", "x"), (7, "zz", "b"), (7, "aa", "b")]
    frame = docs(spark, rows).drop_duplicates(["doc_id", "text"])
    store = tokenbin.TokenStore.write(frame, WORD, keys_per_bucket=32, shards=5)
    keys = frame.select(F.coalesce("doc_id", F.lit(tokenbin.NULL_KEY)).alias("key"))
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in store.read(keys).collect())
    order = sorted(frame.collect(), key=lambda r: (tokenbin.NULL_KEY if r.doc_id is None else r.doc_id, (r.text or "").encode()))
    start = 0
    for r, (at, i, n, raw) in zip(order, got, strict=True):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (at, i, n) == (start, r.doc_id, len(ids)) and np.frombuffer(raw, "<u4").tolist() == ids
        start += len(ids)
    assert store.get(7) == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in sorted(r.text for r in order if r.doc_id == 7)]
    assert store.get(123_456_789) == [] and len(store.get(None)) == 2
    absent = spark.createDataFrame([(10**12 + i,) for i in range(500)], "key long")
    assert store.lookup(absent).count() == 0
    empty = tokenbin.TokenStore.write(docs(spark, []), WORD)
    assert empty.read(keys).count() == 0 and empty.get(1) == []


def test_token_files_of_one_id(spark):
    """Rows of one id (here null) that go on in several shards, and what clashes by name."""
    rng, whole = random.Random(5), plain(WORD)
    rows = [(None, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 9))), "a") for _ in range(300)] + [(i, f"text {i}", "a") for i in range(40)] + [(3, "long " * 9000, "b")]
    frame = docs(spark, rows).withColumn("key", F.lit("clash")).withColumn("shard", F.lit("clash"))
    store = tokenbin.TokenStore.write(frame, WORD, keys_per_bucket=8, shards=6)
    found = store.read(frame.select(F.coalesce("doc_id", F.lit(tokenbin.NULL_KEY)).alias("key"))).collect()
    order = sorted(rows, key=lambda r: (tokenbin.NULL_KEY if r[0] is None else r[0], r[1].encode()))
    start = 0
    for (i, t, _), r in zip(order, sorted(found, key=lambda r: r.start), strict=True):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    assert spark.read.parquet(f"{store.folder}/runs").count() > 1
    assert store.get(None) == [[*whole.encode(t, add_special_tokens=False).ids, 2] for i, t, _ in order if i is None]
    assert len(store.get(3)) == 2 and store.get(12) == [[*whole.encode("text 12", add_special_tokens=False).ids, 2]] and store.get(99) == []


def test_shares_of_many_lengths():
    """Of 20,000 lengths each is within a document of its share, and the budget is met."""
    rng = random.Random(3)
    lengths = rng.sample(range(1, 60_000), 20_000)
    counts = [rng.randrange(1, 4) for _ in lengths]
    total = sum(a * c for a, c in zip(lengths, counts, strict=True))
    for budget in (total // 3, total // 2 + 1, total - 7):
        taken = mixing.fit_budget(lengths, counts, budget)
        assert sum(a * t for a, t in zip(lengths, taken, strict=True)) == budget
        assert max(abs(t - c * budget / total) for t, c in zip(taken, counts, strict=True)) < 1
    assert mixing.fit_budget([0, 5], [9, 4], 10) == [0, 2] and mixing.fit_budget([0], [3], 5) == [0]
    taken = mixing.fit_budget([1000, 1001], [10**6, 10**6], 667_000_123)
    assert 0 <= 667_000_123 - sum(a * t for a, t in zip([1000, 1001], taken, strict=True)) < 1000


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_hash_index_is_minimal_and_perfect(keys):
    at = np.array(sorted(keys), np.uint64)
    values = np.zeros(len(at), tokenbin.SLOT)
    values["first"] = np.arange(len(at))
    own = tokenbin.HashIndex.from_bytes(tokenbin.HashIndex.build(at, values).to_bytes())
    assert sorted(own.rank(at)) == list(range(len(at)))
    found, slots = own.find(at)
    assert found.all() and slots["first"].tolist() == list(range(len(at)))


def test_language_id(spark):
    words = {"en": "the of and with this that from", "de": "der und nicht eine für über auf", "fr": "le des une pour est dans être", "es": "el los una para está como año", "fi": "ja on ei että mutta tämä kun"}
    rng = random.Random(4)
    rows = []
    for i in range(600):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(4, 60))), lang))
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (None, "der und nicht eine über auf für", None)]
    frame = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], DOCS).withColumn("score", F.lit("clash"))
    hold = langid.held_out(F.col("doc_id"))
    model = langid.train(frame.where(~hold), per_language=100)
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"], ["fi"]]
    out = langid.predict(frame.withColumn("held_out", hold), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in out if r.doc_id is not None)
    own = [r for r in out if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97
    assert {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert next(r.lang_pred for r in out if r.doc_id is None) == "de"
    nothing = langid.train(frame.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(frame, nothing).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).count() == 0


def test_kept_text_hash_is_of_utf8(spark):
    out = line_dedup.dedup_lines(docs(spark, [(1, "naïve\nß", "a")])).select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).head().h
    assert out == hashlib.sha256("naïve\nß".encode()).hexdigest()
